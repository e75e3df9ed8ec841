"""As-of join: for each point the next event of the same key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def next_event(points: DataFrame, events: DataFrame, key: str, point_time: str, event_time: str, out: str) -> DataFrame:
    """``points`` plus ``out``: the earliest ``event_time`` of the same key at or after ``point_time``.

    Points and events are sorted together by (key, time) over range partitions,
    so a hot key - or a hot time of one key - is spread over as many tasks as its
    rows need and no point meets more than one event. A point finds its event in its own partition, or
    else at the head of a later one: per key and partition one row (its first
    event) tells.
    """
    columns = points.columns
    row = F.struct(*[F.col(c) for c in columns])
    left = points.select(F.col(key).alias("_k"), F.col(point_time).alias("_t"), F.lit(0).alias("_kind"), row.alias("_row"))
    empty = F.lit(None).cast(left.schema["_row"].dataType)
    right = events.select(F.col(key).alias("_k"), F.col(event_time).alias("_t"), F.lit(1).alias("_kind"), empty.alias("_row"))
    right = right.where(F.col("_k").isNotNull() & F.col("_t").isNotNull()).distinct()
    # at one time points come before events, so an event at the point's own time counts
    # and points of one time are cut apart by a hash of their row: none depends on another
    dealt = left.unionByName(right).repartitionByRange("_k", "_t", "_kind", F.xxhash64("_row")).withColumn("_p", F.spark_partition_id())
    dealt = materialize(dealt)
    event = F.when(F.col("_kind") == 1, F.col("_t"))
    heads = dealt.groupBy("_k", "_p").agg(F.min(event).alias("_head"))
    later = Window.partitionBy("_k").orderBy("_p").rowsBetween(1, Window.unboundedFollowing)
    heads = materialize(heads.select("_k", "_p", F.min("_head").over(later).alias("_later")))
    within = Window.partitionBy("_k", "_p").orderBy("_t", "_kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = dealt.withColumn("_here", F.min(event).over(within)).where("_kind = 0")
    joined = found.join(heads.withColumnRenamed("_p", "_hp").withColumnRenamed("_k", "_hk"), (F.col("_p") == F.col("_hp")) & F.col("_k").eqNullSafe(F.col("_hk")), "left")
    ok = F.col("_k").isNotNull() & F.col("_t").isNotNull()
    return joined.select("_row.*", F.when(ok, F.coalesce("_here", "_later")).alias(out))
