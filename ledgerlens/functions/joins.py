"""Joins of fact rows to per-key rows that survive a hot key.

Adaptive execution splits the partition of a hot key (and broadcasts a side
that turns out small) only where both inputs of a join are plain shuffles. A
per-key frame fresh from ``groupBy(key)`` is not: it is already partitioned by
its aggregate, so all fact rows of a hot key would meet in one task.
``keyed_join`` writes that frame first. Then both sides are scans or plain
shuffles whatever the data look like: no key is listed, sampled or capped, and
no row count picks another plan. ``spark.sql.adaptive.forceOptimizeSkewedJoin``
(``session.SCALE_DEFAULTS``) lets the split happen below an aggregate as well.
Rows with a NULL key never match and are split like those of a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import materialize


def keyed_join(fact: DataFrame, keyed: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """``fact.join(keyed, key, how)``; ``keyed`` has one row per key and comes from an aggregate."""
    if how not in ("inner", "left"):
        raise ValueError("keyed_join supports inner and left joins (fact on the left)")
    return fact.join(materialize(keyed), key, how)
