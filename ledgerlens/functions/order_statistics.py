"""Several order statistics of one frame - percentiles per group and global ranks - from one dealing.

Each statistic alone (``percentile_cont``, ``value_ranks``) counts its values,
deals them out by range and writes them. Here all of them share one frame of
(statistic, group, value) with counts: it is aggregated, dealt out by range and
written once, and one running count inside each partition gives the rank of
every value of every statistic. As there, no group is held by one task: a group
is spread over as many partitions as its values need, ties are one row, and one
row per group and partition (its number of values) makes the counts global.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .percentile import attach


@dataclass(frozen=True)
class Percentile:
    """``out``: interpolated percentile ``p`` of ``value`` in each ``group`` (NULL values ignored)."""

    out: str
    value: str
    p: float
    group: str


@dataclass(frozen=True)
class Rank:
    """``out``: SQL ``rank()`` of ``value`` in the whole frame; NULL values first if ascending, else last."""

    out: str
    value: str
    ascending: bool = True
    group: str | None = field(default=None, init=False)


def with_order_statistics(df: DataFrame, statistics: Sequence[Percentile | Rank]) -> DataFrame:
    """``df`` plus one column for each statistic. ``df`` is read several times, so it should be written
    already; groups are strings, values numbers (ranked as doubles)."""
    if not statistics:
        return df
    group = lambda s: F.col(s.group).cast("string") if s.group else F.lit(None).cast("string")
    each = [F.struct(F.lit(k).alias("_s"), group(s).alias("_g"), F.col(s.value).cast("double").alias("_v")) for k, s in enumerate(statistics)]
    values = df.select(F.explode(F.array(*each)).alias("x")).select("x.*")
    ignored = reduce(lambda a, b: a | b, [(F.col("_s") == k) & F.col("_v").isNull() for k, s in enumerate(statistics) if isinstance(s, Percentile)], F.lit(False))
    counts = values.where(~ignored).groupBy("_s", "_g", "_v").agg(F.count(F.lit(1)).alias("_c"))
    dealt = materialize(counts.repartitionByRange("_s", "_g", "_v").withColumn("_p", F.spark_partition_id()))

    whole = Window.partitionBy("_s", "_g")
    earlier = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_s", "_g", "_p").agg(F.sum("_c").alias("_pc")).select(
        F.col("_s").alias("_s2"), F.col("_g").alias("_g2"), F.col("_p").alias("_p2"), F.coalesce(F.sum("_pc").over(earlier), F.lit(0)).alias("_before"), F.sum("_pc").over(whole).alias("_n")
    )
    within = Window.partitionBy("_s", "_g", "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = (F.col("_s") == F.col("_s2")) & F.col("_g").eqNullSafe(F.col("_g2")) & (F.col("_p") == F.col("_p2"))
    last = F.col("_before") + F.sum("_c").over(within)  # rows up to this value
    ranked = dealt.join(sizes, same).select("_s", "_g", "_v", "_n", (last - F.col("_c")).alias("_first"), last.alias("_last"))
    # of a percentile only the one or two values at its ranks are needed
    ranked = materialize(ranked.where(reduce(lambda a, b: a | b, [(F.col("_s") == k) & _wanted(s) for k, s in enumerate(statistics)])))

    out = df
    for k, s in enumerate(statistics):
        of = ranked.where(F.col("_s") == k)
        if isinstance(s, Rank):
            place = F.col("_first") + 1 if s.ascending else F.col("_n") - F.col("_last") + 1
            found, key = of.select(F.col("_v").alias("_key"), place.cast("bigint").alias(s.out)), F.col(s.value).cast("double")
        else:
            h, x = (F.col("_n") - 1) * F.lit(float(s.p)), F.col("_v")
            covers = lambda r: (F.col("_first") <= r) & (r < F.col("_last"))
            low, high = F.max(F.when(covers(F.floor(h)), x)), F.max(F.when(covers(F.ceil(h)), x))
            ends = of.groupBy("_g", "_n").agg(low.alias("lo"), high.alias("hi"))
            value = F.col("lo") + (h - F.floor(h)) * (F.col("hi") - F.col("lo"))
            found, key = ends.select(F.col("_g").alias("_key"), value.alias(s.out)), F.col(s.group).cast("string")
        out = attach(out.withColumn("_key", key), found, ["_key"]).drop("_key")
    return out


def _wanted(s: Percentile | Rank) -> Column:
    if isinstance(s, Rank):
        return F.lit(True)
    h = (F.col("_n") - 1) * F.lit(float(s.p))
    return (F.col("_first") <= F.ceil(h)) & (F.floor(h) < F.col("_last"))
