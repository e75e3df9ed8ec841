"""Several order statistics from one dealing, against Spark's own windows and aggregates."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.functions.order_statistics import Percentile, Rank, with_order_statistics
from ledgerlens.plans.inspect import physical_plan

SCHEMA = "id int, g string, x double, y bigint"


def _rows(n, seed=0):
    rng = random.Random(seed)
    some = lambda f: None if rng.random() < 0.05 else f()
    group = lambda: "hot" if rng.random() < 0.4 else some(lambda: f"g{rng.randrange(7)}")
    return [(i, group(), some(lambda: float(rng.randrange(40)) / 8), some(lambda: rng.randrange(10**6))) for i in range(n)]


@pytest.mark.parametrize("n, parts", [(0, 1), (1, 1), (400, 1), (3000, 9)])
def test_equals_windows_and_percentile(spark, n, parts):
    df = spark.createDataFrame(_rows(n), SCHEMA).repartition(parts)
    statistics = [Percentile("median", "x", 0.5, "g"), Percentile("high", "y", 0.9, "g"), Rank("up", "x"), Rank("down", "y", ascending=False)]
    want = (
        df.withColumn("median", F.percentile("x", 0.5).over(Window.partitionBy("g")))
        .withColumn("high", F.percentile("y", 0.9).over(Window.partitionBy("g")))
        .withColumn("up", F.rank().over(Window.orderBy(F.asc("x"))).cast("bigint"))
        .withColumn("down", F.rank().over(Window.orderBy(F.desc("y"))).cast("bigint"))
    )
    got = with_order_statistics(df, statistics)
    assert got.columns == want.columns
    key = lambda r: r[0]
    for a, b in zip(sorted(map(tuple, got.collect()), key=key), sorted(map(tuple, want.collect()), key=key), strict=True):
        assert a[:4] == b[:4] and a[6:] == b[6:]
        assert a[4:6] == pytest.approx(b[4:6]) if None not in a[4:6] else a[4:6] == b[4:6]


def test_nothing_asked(spark):
    df = spark.createDataFrame(_rows(5), SCHEMA)
    assert with_order_statistics(df, []).columns == df.columns


def test_no_group_is_one_task(spark):
    df = spark.createDataFrame(_rows(50), SCHEMA)
    plan = physical_plan(with_order_statistics(df, [Rank("up", "x")]))
    assert "SinglePartition" not in plan
