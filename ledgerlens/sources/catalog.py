"""Operator inputs read by name from the session catalog.

The original queries read ``ecom.<table>`` and ``saas.<table>`` from a
database. With the tables registered in a Spark catalog (Hive metastore,
Unity/Glue-style catalogs, or global temp views) this loader returns them as
DataFrames, with every timestamp column put on UTC wall clock
(``to_utc_ntz``, rule D5) so zoned and naive columns mix safely.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import to_utc_ntz

ECOM_TABLES = ("customers", "sessions", "session_channels", "session_events", "product_variants", "products", "categories")
SAAS_TABLES = ("accounts", "users", "subscriptions", "subscription_events", "plans", "trials", "features", "events")


class CatalogTables:
    """``ecom`` / ``saas`` tables from the catalog, normalised on load."""

    def __init__(self, spark: SparkSession, ecom_schema: str = "ecom", saas_schema: str = "saas", naive_zone: str = "UTC"):
        self.spark = spark
        self.ecom_schema = ecom_schema
        self.saas_schema = saas_schema
        self.naive_zone = naive_zone

    def _read(self, schema: str, name: str) -> DataFrame:
        return to_utc_ntz(self.spark.table(f"{schema}.{name}"), self.naive_zone)

    def ecom(self, name: str) -> DataFrame:
        if name not in ECOM_TABLES:
            raise KeyError(name)
        return self._read(self.ecom_schema, name)

    def saas(self, name: str) -> DataFrame:
        if name not in SAAS_TABLES:
            raise KeyError(name)
        return self._read(self.saas_schema, name)
