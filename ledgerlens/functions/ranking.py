"""SQL ``rank()`` over a whole frame without sending every row to one task.

``rank() over (order by v)`` with no partition makes Spark move the whole
frame into a single partition. Here the rank of a value is one plus the
number of rows ordered before it:

1. distinct values with their row counts (``groupBy`` with partial
   aggregation - ties collapse to one row), dealt out by range of the value
   and written with their partition's number;
2. rows per partition and their running total (a window over one row per
   partition);
3. inside each partition a running count over its own values;
4. rank = rows in earlier partitions + rows earlier in the partition + 1,
   joined back to the frame by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .percentile import attach


def value_ranks(df: DataFrame, value: str, out: str, ascending: bool = True) -> DataFrame:
    """``value, out`` for each distinct value: its ``rank() over (order by value [desc])`` in ``df``.

    Null placement follows Spark's default for the direction (first when
    ascending, last when descending), as ``F.rank().over(...)`` would.
    """
    order = F.col(value).asc() if ascending else F.col(value).desc()
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    dealt = materialize(counts.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_p").agg(F.sum("_c").alias("_pc")).select("_p", F.coalesce(F.sum("_pc").over(earlier), F.lit(0)).alias("_off"))
    within = Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_c").over(within), F.lit(0))
    ranks = dealt.withColumn("_before", before).join(offsets, "_p")
    return materialize(ranks.select(value, (F.col("_off") + F.col("_before") + 1).cast("bigint").alias(out)))


def global_rank(df: DataFrame, value: str, out: str, ascending: bool = True) -> DataFrame:
    """``df`` plus column ``out`` = ``rank() over (order by value [desc])``."""
    return attach(df, value_ranks(df, value, out, ascending), [value], "left")
