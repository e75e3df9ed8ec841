"""Parquet table access and the time-zone normaliser (data-quality rule D5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class Tables:
    """Lazily opened parquet tables under one folder.

    Only the columns an operator selects are read (Catalyst prunes the scan's
    ReadSchema) and filters on them reach the parquet reader as PushedFilters.
    """

    def __init__(self, spark: SparkSession, base_dir: str):
        self.spark = spark
        self.base_dir = base_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.base_dir}/{name}.parquet")
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name in ("spark", "base_dir"):
            raise AttributeError(name)
        return self[name]


def to_utc_ntz(df: DataFrame, naive_zone: str = "UTC") -> DataFrame:
    """Put every timestamp column of ``df`` on one footing: UTC wall clock as
    ``timestamp_ntz`` (data-quality rule D5).

    A zoned ``timestamp`` column holds instants; it is rendered in UTC. A naive
    ``timestamp_ntz`` column is read as wall clock in ``naive_zone`` and moved
    to UTC (a no-op for the default). Afterwards week/day buckets and
    differences between a zoned and a naive column do not depend on the
    session time zone.
    """
    session_zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    out = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, T.TimestampType):
            c = F.convert_timezone(F.lit(session_zone), F.lit("UTC"), c.cast("timestamp_ntz"))
        elif isinstance(field.dataType, T.TimestampNTZType) and naive_zone != "UTC":
            c = F.convert_timezone(F.lit(naive_zone), F.lit("UTC"), c)
        out.append(c.alias(field.name))
    return df.select(*out)
