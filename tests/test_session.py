"""Session helpers: scale settings and the checkpoint folder."""

import os

import pytest

from ledgerlens.plans.inspect import physical_plan
from ledgerlens.session import ensure_checkpoint_dir, materialize, scratch_tables, tune


def test_tune_sets_skew_handling(spark):
    tune(spark)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
    assert spark.conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin") == "true"


def test_checkpoint_folder_is_reused(spark):
    first = ensure_checkpoint_dir(spark)
    assert first and ensure_checkpoint_dir(spark) == first


def _session(settings, master, folder=None):
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: settings.get(key, default))

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: folder)

    Session.sparkContext.master = master
    return Session


@pytest.mark.parametrize(
    "settings, master, folder, want",
    [
        ({"spark.sql.warehouse.dir": "file:/w/"}, "local[2]", None, "file:/w/_ledgerlens"),
        ({"spark.sql.warehouse.dir": "hdfs:///w"}, "yarn", None, "hdfs:///w/_ledgerlens"),
        ({"spark.sql.warehouse.dir": "file:/w"}, "yarn", "hdfs:///c", "hdfs:///c"),
        ({"spark.sql.warehouse.dir": "file:/w", "spark.checkpoint.dir": "file:///shared"}, "spark://h:1", None, "file:///shared"),
    ],
)
def test_folder_of_written_tables(settings, master, folder, want):
    assert ensure_checkpoint_dir(_session(settings, master, folder)) == want


@pytest.mark.parametrize("warehouse", ["file:/w", "/w"])
def test_a_local_warehouse_is_refused_on_a_cluster(warehouse):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_session({"spark.sql.warehouse.dir": warehouse}, "yarn"))


def test_a_scope_deletes_its_tables(spark):
    outside = ensure_checkpoint_dir(spark)
    with scratch_tables(spark) as folder:
        assert materialize(spark.range(5).selectExpr("id AS x")).count() == 5
        with scratch_tables(spark) as inner:
            assert inner.startswith(folder) and ensure_checkpoint_dir(spark) == inner
        assert len(os.listdir(folder.removeprefix("file://"))) == 1
    assert ensure_checkpoint_dir(spark) == outside and not os.path.exists(folder.removeprefix("file://"))


def test_tune_keeps_what_the_user_set(spark):
    key = "spark.sql.adaptive.forceOptimizeSkewedJoin"
    spark.conf.set(key, "false")
    tune(spark)
    kept = spark.conf.get(key)
    spark.conf.set(key, "true")
    assert kept == "false"


def test_materialize_cuts_lineage(spark):
    df = materialize(spark.range(10).selectExpr("id * 2 AS x"))
    assert sorted(r["x"] for r in df.collect()) == list(range(0, 20, 2))
    assert "Range (" not in physical_plan(df) and "FileScan parquet" in physical_plan(df)
