"""Session settings the operators are planned for.

The operators only use the DataFrame API, so they run on any session. These
settings are what they are tuned for on a cluster: adaptive execution (runtime
broadcast of small sides, skew-join splitting, partition coalescing) and a
checkpoint folder taken from the cluster when it names one. Timestamps are
handled as ``timestamp_ntz`` wall clock, so no operator depends on the session
time zone.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)

# Settings applied only where the session does not already define them.
SCALE_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when the join feeds an aggregate on the same
    # key: the aggregate then gets its own exchange with a map-side partial
    # aggregation, instead of one task holding a third of all rows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply SCALE_DEFAULTS to a running session, keeping any value the
    user gave when building it or set since."""
    for key, value in SCALE_DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: that of the innermost
    ``scratch_tables`` scope, else ``spark.checkpoint.dir`` where the session or
    its context names one, else a folder in the warehouse.

    A warehouse in the local file system is shared only where driver and
    executors are one machine; elsewhere each executor would write to its own
    disk and results would lack rows, so this is refused.
    """
    folder = _scratch.get() or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    scheme = warehouse.split(":", 1)[0] if ":" in warehouse else "file"
    if scheme == "file" and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{warehouse}/_ledgerlens"


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[str]:
    """Scope whose intermediate tables are deleted at its end: they go to a
    folder of their own below the shared one. Results have to be consumed
    (written, collected, shown) inside the scope, as they read these tables."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scope-{uuid.uuid4().hex}"
    token = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ledgerlens") -> SparkSession:
    """Local session for tests and the bench (no UI server)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("LEDGERLENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="ledgerlens-"))
    )
    for key, value in SCALE_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _write(df, path: str) -> None:
    df.write.parquet(path)


def materialize(df):
    """Cut the lineage of a reduced frame that is read more than once, or that
    is to reach a join without its aggregate's partitioning.

    The frame is written as Parquet to the shared checkpoint folder and read
    back: later passes do not repeat the upstream work, a lost executor does
    not either, and Spark knows its size when it plans the joins.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/t-{uuid.uuid4().hex}"
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
