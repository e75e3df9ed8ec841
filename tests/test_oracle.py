"""Every registry key against its DuckDB oracle on the driver tables
(sf0.001 by default; LEDGERLENS_TEST_SF=/root/testdata/sf0.01 for the gate)."""

import pytest

import __spark_entry__ as entry
from ledgerlens.oracle.check import compare, duck, rows_of_duck, rows_of_spark
from ledgerlens.registry import QUERIES

KEYS = list(QUERIES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_key_has_an_oracle():
    assert set(KEYS) <= set(entry.oracle_sql()) and set(KEYS) <= set(entry.queries())


@pytest.mark.parametrize("key", KEYS)
def test_key_matches_oracle(spark, sf_dir, con, key):
    sc, sr = rows_of_spark(entry.queries()[key](spark, sf_dir))
    dc, dr = rows_of_duck(con, entry.oracle_sql()[key])
    res = compare(sc, sr, dc, dr)
    assert res["match"], res


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[0] == "month"
