"""One key holding a third of all rows, with broadcasts off and skew-join
splitting forced on tiny partitions: results must not change."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlens.oracle.check import compare, rows_of_spark
from ledgerlens.oracle.queries import SQL, oracle_sql
from ledgerlens.operators import ecom, saas
from ledgerlens.plans.inspect import explain
from ledgerlens.registry import roles
from ledgerlens.sources.roles import ECOM_SINCE, SAAS_AS_OF

oracle_sql()

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1024",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1024",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture(scope="module")
def skewed(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    r = roles(spark, "/root/testdata/sf0.01")
    hot = lambda c, k: F.when(F.col(k) % 3 == 0, F.lit(7)).otherwise(F.col(c))
    frames = {
        "subscription_events": r.subscription_events.withColumn("account_id", hot("account_id", "event_id")),
        "accounts": r.accounts,
        "trials": r.trials.withColumn("account_id", hot("account_id", "trial_id")),
        "customers": r.customers,
        "sessions": r.sessions.withColumn("customer_id", hot("customer_id", "session_id")),
        "session_events": r.session_events,
        "subscriptions": r.subscriptions,
        "features": r.features,
        "feature_events": r.feature_events.withColumn(
            "account_id", F.when(F.xxhash64("account_id", "feature_id", "occurred_at") % 3 == 0, F.lit(7)).otherwise(F.col("account_id"))
        ),
    }
    con = duckdb.connect()
    for name, df in frames.items():
        arrow = df.toArrow()  # noqa: F841
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM arrow")
    yield frames, con
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _check(con, key, df):
    sc, sr = rows_of_spark(df)
    rel = con.sql(SQL[key])
    res = compare(sc, sr, rel.columns, rel.fetchall())
    assert res["match"], res


def test_hot_account(skewed):
    f, con = skewed
    ev, acc = f["subscription_events"], f["accounts"]
    _check(con, "mrr_movements", saas.mrr_movements(ev, as_of=SAAS_AS_OF))
    rr = saas.revenue_retention(ev, as_of=SAAS_AS_OF)
    _check(con, "revenue_retention", rr)
    trials = f["trials"]
    _check(con, "trial_conversion", saas.trial_conversion(trials, ev))
    _check(con, "trial_conversion_strict", saas.trial_conversion(trials, ev, strict=True))
    _check(con, "expansion_revenue", saas.expansion_revenue(ev, acc, as_of=SAAS_AS_OF))
    plan = explain(rr, "formatted")
    assert "SortMergeJoin" in plan


def test_hot_customer(skewed):
    f, con = skewed
    c, s, e = f["customers"], f["sessions"], f["session_events"]
    _check(con, "activation_curve", ecom.activation_curve(c, s, e, since=ECOM_SINCE))
    _check(con, "cohort_retention", ecom.cohort_retention(c, s, e, since=ECOM_SINCE))


def test_keyed_join_equals_plain_join(spark, skewed):
    from ledgerlens.functions.joins import keyed_join

    f, _ = skewed
    ev = f["subscription_events"].select("event_id", "account_id", "mrr_delta")
    per = ev.groupBy("account_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("account_id") % 5 != 1)
    for how in ("inner", "left"):
        plain = sorted(ev.join(per, "account_id", how).collect())
        joined = sorted(keyed_join(ev, per, "account_id", how).select(*plain[0].__fields__).collect())
        assert plain == joined


def test_hot_side_is_split(spark, skewed):
    """The join with a written per-key side runs with its hot partition split."""
    from ledgerlens.functions.joins import keyed_join

    f, _ = skewed
    # a partition is split by the tasks that wrote it, so there must be several
    ev = f["subscription_events"].select("event_id", "account_id", "mrr_delta").repartition(8)
    per = ev.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))
    out = keyed_join(ev, per, "account_id").groupBy("account_id").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"))
    assert all(r["rows"] == r["n"] for r in out.collect())
    assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()


def test_hot_account_feature_adoption(skewed):
    f, con = skewed
    args = (f["accounts"], f["subscriptions"], f["feature_events"], f["features"])
    _check(con, "feature_adoption", saas.feature_adoption(*args, as_of=SAAS_AS_OF))
    _check(con, "feature_adoption_strict", saas.feature_adoption(*args, as_of=SAAS_AS_OF, strict=True))
