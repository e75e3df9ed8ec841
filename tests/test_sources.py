"""Catalog source and the timezone normaliser (D5)."""

import datetime as dt

from ledgerlens.operators import saas
from ledgerlens.sources.catalog import CatalogTables
from ledgerlens.sources.tables import to_utc_ntz


def test_zoned_and_naive_to_utc(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        df = spark.sql(
            "SELECT TIMESTAMP '2026-04-19 05:30:00' AS zoned, TIMESTAMP_NTZ '2026-04-19 05:30:00' AS naive"
        )
        row = to_utc_ntz(df).collect()[0]
        assert row["zoned"] == dt.datetime(2026, 4, 19, 0, 0)  # 05:30 IST is midnight UTC
        assert row["naive"] == dt.datetime(2026, 4, 19, 5, 30)  # naive values are already UTC by default
        row = to_utc_ntz(df, naive_zone="Asia/Kolkata").collect()[0]
        assert row["naive"] == dt.datetime(2026, 4, 19, 0, 0)
        assert dict(to_utc_ntz(df).dtypes) == {"zoned": "timestamp_ntz", "naive": "timestamp_ntz"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_catalog_tables(spark):
    ev = spark.createDataFrame(
        [(1, 1, "subscription_started", 10, dt.datetime(2026, 5, 1))],
        "event_id bigint, account_id bigint, event_type string, mrr_delta int, event_time timestamp_ntz",
    ).selectExpr("*", "CAST(mrr_delta AS DECIMAL(18,2)) AS d").drop("mrr_delta").withColumnRenamed("d", "mrr_delta")
    ev.createOrReplaceGlobalTempView("subscription_events")
    tables = CatalogTables(spark, saas_schema="global_temp")
    rows = saas.mrr_movements(tables.saas("subscription_events")).collect()
    assert rows[0]["new_mrr"] == 10 and rows[0]["month"] == dt.date(2026, 5, 1)
