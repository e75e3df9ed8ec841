"""Plan-shape checks over every registered query."""

import pytest

import __spark_entry__ as entry
from ledgerlens.plans.inspect import explain, forbidden_nodes, scan_schemas, written_plans
from ledgerlens.registry import QUERIES

KEYS = list(QUERIES)
# columns that no operator needs, by table: a scan that reads one is not pruned
UNUSED = ("o_orderstatus", "o_clerk", "o_comment", "l_extendedprice", "l_discount", "c_address", "c_phone", "p_retailprice", "props")


@pytest.mark.parametrize("key", KEYS)
def test_no_cross_products_or_python(spark, sf_dir, key):
    """In the final plan and in those of all tables written on the way."""
    with written_plans([]) as plans:
        plans.append(explain(QUERIES[key](spark, sf_dir), "formatted"))
    for plan in plans:
        assert forbidden_nodes(plan) == []
        assert not [s for s in scan_schemas(plan) for c in UNUSED if c in s]
    assert len(plans) <= 10


def test_scans_are_pruned(spark, sf_dir):
    # mrr_movements needs 4 of the 6 orders columns
    schemas = scan_schemas(entry.queries()["mrr_movements"](spark, sf_dir))
    assert schemas and all("o_orderstatus" not in s for s in schemas)
    # the cart operator reads 5 of the 6 events columns, never props
    schemas = scan_schemas(entry.queries()["cart_abandonment"](spark, sf_dir))
    assert schemas and all("props" not in s for s in schemas)


def test_filters_reach_stored_parquet(spark, sf_dir, tmp_path):
    """On stored tables (not role views) the operators' filters are pushed
    into the parquet scan."""
    from ledgerlens.operators import ecom, saas
    from ledgerlens.registry import roles
    from ledgerlens.sources.roles import SAAS_AS_OF

    r = roles(spark, sf_dir)
    r.session_events.write.parquet(str(tmp_path / "session_events"))
    r.subscription_events.write.parquet(str(tmp_path / "subscription_events"))
    se = spark.read.parquet(str(tmp_path / "session_events"))
    sub = spark.read.parquet(str(tmp_path / "subscription_events"))

    cart = explain(ecom.cart_abandonment(se))
    assert "PushedFilters: [In(event_type" in cart or "PushedFilters: [IsNotNull(event_type), In(event_type" in cart
    mrr = explain(saas.mrr_movements(sub, as_of=SAAS_AS_OF))
    assert "LessThanOrEqual(event_time" in mrr and "Not(EqualTo(event_type,trial_started))" in mrr
