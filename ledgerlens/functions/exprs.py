"""Column helpers shared by the operators.

All of them are built-in Spark expressions (no Python per row), so they stay
inside whole-stage code generation. Timestamps are kept ``timestamp_ntz``
(wall clock in UTC, see ``sources.tables.to_utc_ntz``), which makes every
helper independent of the session time zone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
MONEY_SUM = "decimal(38,2)"

_MICROS = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """``n * 1.0 / nullif(d, 0)`` as a double; NULL when ``d`` is 0 or NULL."""
    d = col(denominator).cast("double")
    return col(numerator).cast("double") / F.when(d != 0, d)


def elapsed(end: str | Column, start: str | Column, unit: str = "second") -> Column:
    """Elapsed time ``end - start`` in ``unit`` as a double (``extract(epoch)`` / unit)."""
    micros = F.timestamp_diff("MICROSECOND", col(start), col(end))
    return micros.cast("double") / float(_MICROS[unit])


def week_start(ts: str | Column) -> Column:
    """Monday of the week of ``ts`` as a date (``date_trunc('week', ts)::date``)."""
    return F.trunc(F.to_date(col(ts)), "week")


def month_start(ts: str | Column) -> Column:
    """First day of the month of ``ts`` as a date (``date_trunc('month', ts)``)."""
    return F.trunc(F.to_date(col(ts)), "month")


def days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def months(n: int) -> Column:
    return F.make_ym_interval(F.lit(0), F.lit(n))


def normalize_plan(plan: str | Column) -> Column:
    """Fold case and collapse name drift of a plan tier.

    Fixed values that must equal the reference's rule: ``pro`` and
    ``professional`` become ``pro``; anything else is lower-cased; NULL stays
    NULL.
    """
    p = F.lower(col(plan))
    return F.when(p == "professional", F.lit("pro")).otherwise(p)


def closed_cohort(week: str | Column, horizon_days: int, closed_by) -> Column:
    """Whether every member of a weekly cohort has been seen for ``horizon_days``
    by the date ``closed_by`` (None: every cohort counts as closed)."""
    return F.lit(True) if closed_by is None else F.date_add(col(week), 7 + horizon_days) <= F.lit(closed_by)


def bucket_ordinal(label: str | Column, labels: Sequence[str]) -> Column:
    """Position (1-based) of ``label`` in ``labels``; NULL when absent."""
    c = col(label)
    expr = None
    for i, name in enumerate(labels, start=1):
        expr = F.when(c == name, F.lit(i)) if expr is None else expr.when(c == name, F.lit(i))
    return expr


def with_scalars(df, one_row):
    """Append the columns of a one-row frame (a global aggregate) to every row
    of ``df`` as a scalar subquery: computed once, no join of any kind."""
    packed = one_row.select(F.struct(*one_row.columns).alias("_s")).scalar()
    return df.select("*", *[packed.getField(c).alias(c) for c in one_row.columns])
