"""The distributed exact percentile against DuckDB's percentile_cont."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from ledgerlens.functions.percentile import percentile_cont


def _frame(seed=7, n=6000):
    rng = np.random.default_rng(seed)
    # group "hot" holds a third of all rows; heavy ties in "ties"; tiny groups.
    g = np.where(np.arange(n) % 3 == 0, "hot", rng.choice(["a", "b", "c", "ties"], size=n))
    v = rng.normal(100, 30, size=n).round(3)
    v = np.where(g == "ties", rng.integers(0, 4, size=n).astype(float), v)
    v = np.where(rng.random(n) < 0.05, np.nan, v)  # NULLs are ignored
    df = pd.DataFrame({"g": g, "v": v})
    extra = pd.DataFrame({"g": ["single", "pair", "pair", "allnull"], "v": [5.0, 1.0, 2.0, np.nan]})
    return pd.concat([df, extra], ignore_index=True)


@pytest.mark.parametrize("parts", ["1", "13"])
def test_matches_duckdb(spark, parts):
    """However many range partitions a group is spread over."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _matches_duckdb(spark)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def _matches_duckdb(spark):
    pdf = _frame()
    sdf = spark.createDataFrame(pdf.astype({"v": "float64"})).selectExpr("g", "CASE WHEN isnan(v) THEN NULL ELSE v END AS v")
    got = percentile_cont(sdf, ["g"], "v", {"p50": 0.5, "p90": 0.9, "p0": 0.0, "p100": 1.0})
    got = {r["g"]: r for r in got.collect()}
    want = duckdb.sql(
        "SELECT g, percentile_cont(0.5) WITHIN GROUP (ORDER BY v) p50, percentile_cont(0.9) WITHIN GROUP (ORDER BY v) p90, "
        "min(v) p0, max(v) p100 FROM pdf WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY g"
    ).fetchall()
    assert "allnull" not in got
    assert len(want) == len(got)
    for g, p50, p90, p0, p100 in want:
        assert got[g]["p50"] == p50, g  # unrounded: exact here
        assert got[g]["p90"] == p90, g
        assert got[g]["p0"] == p0 and got[g]["p100"] == p100, g


def test_global_group(spark):
    sdf = spark.range(1, 1001).selectExpr("CAST(id AS DOUBLE) AS v")
    row = percentile_cont(sdf, [], "v", {"m": 0.5}).collect()[0]
    assert row["m"] == 500.5


def test_null_group_key(spark):
    sdf = spark.createDataFrame([(None, 1.0), (None, 3.0), ("x", 2.0)], "g string, v double")
    got = {r["g"]: r["m"] for r in percentile_cont(sdf, ["g"], "v", {"m": 0.5}).collect()}
    assert got == {None: 2.0, "x": 2.0}


from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    rows=st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.integers(-50, 50).map(float))), min_size=1, max_size=300),
    p=st.sampled_from([0.0, 0.1, 0.5, 0.9, 0.99, 1.0]),
)
def test_property_matches_duckdb(spark, rows, p):
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    sdf = spark.createDataFrame(rows, "g int, v double")
    got = {r["g"]: r["x"] for r in percentile_cont(sdf, ["g"], "v", {"x": p}).collect()}
    want = dict(
        duckdb.sql(f"SELECT g, percentile_cont({p}) WITHIN GROUP (ORDER BY v) FROM pdf WHERE v IS NOT NULL GROUP BY g").fetchall()
    )
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == pytest.approx(want[g], rel=1e-12, abs=1e-12)


def test_approx_option_close(spark):
    sdf = spark.range(1, 20001).selectExpr("id % 3 AS g", "CAST(id AS DOUBLE) AS v")
    exact = {r["g"]: r["m"] for r in percentile_cont(sdf, ["g"], "v", {"m": 0.5}).collect()}
    approx = {r["g"]: r["m"] for r in percentile_cont(sdf, ["g"], "v", {"m": 0.5}, accuracy=1000, approx=True).collect()}
    assert exact.keys() == approx.keys()
    for g in exact:
        assert abs(exact[g] - approx[g]) <= 20000 / 1000 * 3 + 3  # within the rank error, in value units
