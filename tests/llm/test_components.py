from pyspark.sql import functions as F

from ledgerlens.llm import components as cc


def test_joins_have_no_fresh_aggregate_below(spark, monkeypatch):
    plans, write = [], cc.written

    def noted(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df)

    monkeypatch.setattr(cc, "written", noted)
    star = spark.range(1, 300).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    chain = spark.range(1000, 1005).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    got = {(r.node, r.root) for r in cc.components(star.unionByName(chain)).collect()}
    assert got == {(n, 0) for n in range(300)} | {(n, 1000) for n in range(1000, 1006)}
    joins = [p for p in plans if "Join" in p]
    assert len(joins) >= 2
    assert not any("Aggregate" in p[p.index("Join") :] for p in joins), joins
