"""global_rank against Spark's single-partition rank() window."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.functions.ranking import global_rank


@pytest.mark.parametrize("ascending", [True, False])
def test_matches_window_rank(spark, ascending):
    df = spark.range(0, 3000).select(
        "id",
        F.when(F.col("id") % 97 == 0, F.lit(None)).otherwise((F.col("id") * 7919) % 211).cast("double").alias("v"),
    )
    order = F.col("v").asc() if ascending else F.col("v").desc()
    want = {r["id"]: r["r"] for r in df.select("id", F.rank().over(Window.orderBy(order)).alias("r")).collect()}
    got = {r["id"]: r["r"] for r in global_rank(df, "v", "r", ascending).collect()}
    assert got == want


@pytest.mark.parametrize("ascending", [True, False])
def test_many_ties(spark, ascending):
    df = spark.range(0, 5000).select("id", ((F.col("id") * 31) % 17).cast("long").alias("v"))
    order = F.col("v").asc() if ascending else F.col("v").desc()
    want = {r["id"]: r["r"] for r in df.select("id", F.rank().over(Window.orderBy(order)).alias("r")).collect()}
    got = {r["id"]: r["r"] for r in global_rank(df, "v", "r", ascending).collect()}
    assert got == want

