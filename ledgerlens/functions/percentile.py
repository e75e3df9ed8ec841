"""Exact ``percentile_cont`` per group without gathering a group in one task.

Spark's exact ``percentile`` aggregate keeps every distinct value of a group in
one task's memory, and a window ordered within a group puts the whole group in
one task. Both break when one group holds a third of all rows. Here:

1. values are counted per (group, value) with map-side partial aggregation,
   dealt out by range of (group, value) and written with their partition's
   number, so a group is spread over as many tasks as its values need;
2. one row per group and partition (its number of values) gives the group's
   size, the ranks each partition covers and the one or two partitions that
   hold a wanted rank;
3. a running count inside those partitions finds the values at these ranks.

Every step is exact and the same at every size. The result is the interpolated
value of PostgreSQL/DuckDB ``percentile_cont``: with ``h = (n - 1) p``,
``x[floor h] + (h - floor h) (x[ceil h] - x[floor h])``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

DEFAULT_ACCURACY = 100_000
# Operators report percentiles to 9 decimals: below that, engines disagree in
# the last bit of the interpolation.
PERCENTILE_DIGITS = 9


def percentile_cont(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    percentiles: dict[str, float],
    accuracy: int = DEFAULT_ACCURACY,
    digits: int | None = None,
    approx: bool = False,
) -> DataFrame:
    """Exact interpolated percentiles of ``value`` per ``keys`` group.

    ``percentiles`` maps output column name -> fraction in [0, 1]. NULL values
    are ignored; groups without a non-NULL value are absent from the result
    (callers left-join it to their group frame). Output columns are doubles,
    rounded to ``digits`` decimals when given (engines differ in the last bit
    of the interpolation). ``df`` is read once.

    ``approx=True`` returns ``percentile_approx`` (nearest sample value, rank
    error at most n / accuracy) from a single aggregate instead.
    """
    keys = list(keys)
    if not keys:  # one global group
        out = percentile_cont(df.withColumn("_g", F.lit(0)), ["_g"], value, percentiles, accuracy, digits, approx)
        return out.drop("_g")
    if not percentiles:
        raise ValueError("no percentile requested")
    vals = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if approx:
        cols = [F.percentile_approx("_v", float(p), accuracy) for p in percentiles.values()]
        cols = cols if digits is None else [F.round(c, digits) for c in cols]
        return vals.groupBy(*keys).agg(*[c.alias(n) for c, n in zip(cols, percentiles)])

    counts = vals.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    dealt = materialize(counts.repartitionByRange(*keys, "_v").withColumn("_p", F.spark_partition_id()))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(*keys, "_p").agg(F.sum("_c").alias("_pc")).select(
        *keys, "_p", "_pc", F.coalesce(F.sum("_pc").over(earlier), F.lit(0)).alias("_before"), F.sum("_pc").over(group).alias("_n")
    )
    # one row per group, wanted percentile and partition that holds one of its two ranks
    each = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(float(p)).alias("p")) for j, p in enumerate(percentiles.values())]))
    targets = parts.withColumn("_t", each).select(*keys, "_p", "_before", "_pc", F.col("_t.j").alias("_j"), ((F.col("_n") - 1).cast("double") * F.col("_t.p")).alias("_h"))
    targets = targets.withColumn("_klo", F.floor("_h")).withColumn("_khi", F.ceil("_h"))
    targets = materialize(targets.where((F.col("_khi") >= F.col("_before")) & (F.col("_klo") < F.col("_before") + F.col("_pc"))).drop("_pc"))
    within = Window.partitionBy(*keys, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    needed = _join_null_safe(dealt, targets.select(*keys, "_p").distinct(), [*keys, "_p"]).withColumn("_cum", F.sum("_c").over(within))
    located = _join_null_safe(needed, targets, [*keys, "_p"])
    # a value covers ranks [before + cum - c, before + cum - 1]
    last = F.col("_before") + F.col("_cum")
    covers = lambda k: (last - F.col("_c") <= F.col(k)) & (F.col(k) < last)
    ends = located.groupBy(*keys, "_j", "_h", "_klo").agg(
        F.max(F.when(covers("_klo"), F.col("_v"))).alias("_xlo"), F.max(F.when(covers("_khi"), F.col("_v"))).alias("_xhi")
    )
    exact = F.col("_xlo") + (F.col("_h") - F.col("_klo")) * (F.col("_xhi") - F.col("_xlo"))
    exact = exact if digits is None else F.round(exact, digits)
    return ends.groupBy(*keys).agg(*[F.max(F.when(F.col("_j") == j, exact)).alias(name) for j, name in enumerate(percentiles)])


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner equi-join on ``keys`` where NULL matches NULL (GROUP BY semantics)."""
    renamed = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    cond = None
    for i, k in enumerate(keys):
        c = left[k].eqNullSafe(renamed[f"_r{i}"])
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, "inner").drop(*[f"_r{i}" for i in range(len(keys))])


def attach(left: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join per-group ``stats`` onto ``left`` by ``keys`` with GROUP BY
    semantics (NULL key matches NULL key).

    The right side's keys are re-aliased first, so the join is unambiguous
    even when both sides derive from the same DataFrame.
    """
    keys = list(keys)
    right = stats.select(*[F.col(k).alias(f"_a{i}") for i, k in enumerate(keys)], *[c for c in stats.columns if c not in keys])
    cond = None
    for i, k in enumerate(keys):
        c = left[k].eqNullSafe(right[f"_a{i}"])
        cond = c if cond is None else cond & c
    return left.join(right, cond, how).drop(*[f"_a{i}" for i in range(len(keys))])
