"""Hand-made edge frames (FIXTURES.md) run through each operator and through
its DuckDB oracle on the same frames; a few quirks are also asserted by value.

Dates sit around the role-data parameters: e-commerce ``since`` 2024-01-02,
SaaS ``as_of`` 2001-01-01.
"""

import datetime as dt
from decimal import Decimal as D

import duckdb
import pytest

from ledgerlens.oracle.check import compare, rows_of_spark
from ledgerlens.oracle.queries import SQL, oracle_sql  # noqa: F401  (oracle_sql registers D/R keys)
from ledgerlens.operators import ecom, quality, saas
from ledgerlens.sources.roles import ECOM_SINCE, SAAS_AS_OF

oracle_sql()

T = dt.datetime

SCHEMAS = {
    "customers": "customer_id bigint, created_at timestamp_ntz",
    "sessions": "session_id bigint, customer_id bigint",
    "session_channels": "session_id bigint, channel string",
    "session_events": "session_id bigint, occurred_at timestamp_ntz, event_type string, variant_id bigint, quantity int, unit_price decimal(18,2)",
    "product_variants": "variant_id bigint, product_id bigint",
    "products": "product_id bigint, product_name string, category_id string",
    "categories": "category_id string, category_name string",
    "subscription_events": "event_id bigint, subscription_id bigint, account_id bigint, event_type string, mrr_delta decimal(18,2), "
    "seats_delta int, from_plan string, to_plan string, event_time timestamp_ntz",
    "accounts": "account_id bigint, signup_date timestamp_ntz, acquisition_channel string, account_type string",
    "subscriptions": "subscription_id bigint, user_id bigint, account_id bigint, plan string, plan_id bigint, seat_count int, "
    "mrr decimal(18,2), status string, start_date timestamp_ntz, cancelled_at timestamp_ntz, cancellation_reason string",
    "trials": "trial_id bigint, account_id bigint, started_at timestamp_ntz",
    "features": "feature_id string, feature_name string",
    "feature_events": "account_id bigint, feature_id string, occurred_at timestamp_ntz",
    "telemetry": "event_id bigint, user_id bigint, account_id bigint, feature_id string, occurred_at timestamp_ntz, properties string",
    "users": "user_id bigint, account_id bigint, is_active int",
    "plans": "plan_id bigint, plan_name string, monthly_price decimal(18,2), billing_interval string",
}


class Fixture:
    def __init__(self, spark, **tables):
        self.spark = spark
        self.df = {name: spark.createDataFrame(rows, SCHEMAS[name]) for name, rows in tables.items()}
        self.con = duckdb.connect()
        for name, df in self.df.items():
            arrow = df.toArrow()  # noqa: F841  (referenced by name below)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM arrow")

    def check(self, key, result):
        sc, sr = rows_of_spark(result)
        rel = self.con.sql(SQL[key])
        res = compare(sc, sr, rel.columns, rel.fetchall())
        assert res["match"], res
        return {tuple(r) for r in sr}, [r.asDict() for r in result.collect()]


# ----------------------------------------------------------------- ecom
@pytest.fixture(scope="module")
def shop(spark):
    since = T(2024, 1, 2)
    return Fixture(
        spark,
        customers=[
            (1, since),  # no session at all
            (2, T(2024, 1, 3, 10)),  # first action before signup, another after
            (3, T(2024, 1, 4, 8)),  # action exactly at signup + 7 days
            (4, T(2024, 1, 7, 12)),  # Sunday signup (week of Monday 2024-01-01)
            (5, T(2024, 1, 1, 23)),  # before since: excluded
            (6, T(2024, 1, 9)),  # activity 6.99 and 7.0 days after signup
            (7, T(2024, 1, 9)),  # activity only in week 5+
        ],
        sessions=[(20, 2), (21, 2), (30, 3), (40, 4), (60, 6), (61, 6), (70, 7), (90, None), (91, 4), (92, 4)],
        session_channels=[(20, "organic"), (21, "email"), (21, "paid_social"), (30, "organic"), (40, "referral"), (90, "email"), (92, "email"), (92, "email")],
        session_events=[
            (20, T(2024, 1, 2, 9), "add_to_cart", 1, 2, D("249.99")),  # before signup of customer 2
            (21, T(2024, 1, 4, 9), "purchase", None, 1, D("10.00")),  # purchase with no earlier step
            (21, T(2024, 1, 4, 8), "product_view", 1, 1, None),
            (30, T(2024, 1, 11, 8), "begin_checkout", 2, 1, D("5.00")),  # exactly +7 days
            (30, T(2024, 1, 11, 8), "add_to_cart", 2, 1, D("500.00")),
            (40, T(2024, 1, 8, 12), "add_address", 3, 1, D("1.00")),
            (40, T(2024, 1, 8, 12), "add_to_cart", 3, 1, D("1999.50")),  # gap cart value
            (40, T(2024, 1, 8, 13), "product_view", 3, 1, D("1.00")),
            (60, T(2024, 1, 15, 23, 45), "product_view", 4, 1, None),  # 6.99 days
            (61, T(2024, 1, 16), "product_view", 4, 1, None),  # 7.0 days
            (61, T(2024, 1, 16), "add_to_cart", None, 3, D("4999.50")),  # NULL variant
            (70, T(2024, 2, 14), "product_view", 5, 1, None),  # week 5
            (90, T(2024, 1, 5), "add_to_cart", 5, 1, None),  # NULL price -> NULL cart value
            (91, T(2024, 1, 5), "purchase", 5, 1, D("3.00")),  # purchase without cart
            (92, T(2024, 1, 6), "select_shipping", 6, 1, D("1.00")),
            (92, T(2024, 1, 6), "add_to_cart", 6, 3, D("5000.00")),
            (92, T(2024, 1, 6, 1), "add_to_cart", 7, 1, D("0.00")),
            (93, T(2024, 1, 6), "add_to_cart", 7, 1, D("499.99")),
            (94, T(2024, 1, 6), "add_to_cart", 7, 1, D("1999.00")),
            (95, T(2024, 1, 6), "add_to_cart", 7, 1, D("14999.50")),
            (96, T(2024, 1, 6), "add_to_cart", 7, 1, D("15000.00")),
            (96, T(2024, 1, 6), "purchase", 7, 1, D("15000.00")),
            (97, T(2024, 1, 6), "product_view", 8, 1, None),  # tied views with variant 5
        ],
        product_variants=[(1, 10), (2, 10), (3, 11), (4, 12), (5, 13), (6, 14), (7, 15), (8, 16)],
        products=[(10, "kettle", "home"), (11, "lamp", "home"), (12, "watch", "wear"), (13, "scarf", "wear"), (14, "pan", "home"), (15, "cart-only", "home"), (16, "hat", "wear")],
        categories=[("home", "Home"), ("wear", "Wear")],
    )


def test_activation_edges(shop, spark):
    c, s, e = shop.df["customers"], shop.df["sessions"], shop.df["session_events"]
    shop.check("activation_curve", ecom.activation_curve(c, s, e, since=ECOM_SINCE))
    _, rows = shop.check("activation_curve_strict", ecom.activation_curve(c, s, e, since=ECOM_SINCE, strict=True))
    by_week = {r["signup_week"]: r for r in rows}
    # strict: customer 2 acts after signup on 01-04 -> activated; 3 exactly +7 days -> activated
    assert by_week[dt.date(2024, 1, 1)]["activated_7d"] == 3


def test_activation_reference_rule(shop):
    c, s, e = shop.df["customers"], shop.df["sessions"], shop.df["session_events"]
    rows = {r["signup_week"]: r for r in ecom.activation_curve(c, s, e, since=ECOM_SINCE).collect()}
    # first action ever of customer 2 precedes signup -> not activated (Q1)
    assert rows[dt.date(2024, 1, 1)]["activated_7d"] == 1  # only customer 3 (exactly +7 days)
    assert rows[dt.date(2024, 1, 1)]["cohort_size"] == 4


def test_funnel_edges(shop):
    s, ch, e = shop.df["sessions"], shop.df["session_channels"], shop.df["session_events"]
    _, rows = shop.check("checkout_funnel", ecom.checkout_funnel(s, ch, e))
    by = {r["channel"]: r for r in rows}
    assert by["email"]["purchased"] == 1 and by["paid_social"]["begin_checkout"] == 1  # lone purchase counts in every step


def test_retention_edges(shop):
    c, s, e = shop.df["customers"], shop.df["sessions"], shop.df["session_events"]
    _, rows = shop.check("cohort_retention", ecom.cohort_retention(c, s, e, since=ECOM_SINCE))
    shop.check("cohort_retention_strict", ecom.cohort_retention(c, s, e, since=ECOM_SINCE, strict=True))
    week2 = {r["cohort_week"]: r for r in rows}[dt.date(2024, 1, 8)]
    assert (week2["cohort_size"], week2["w0_active"], week2["w1_retained"]) == (2, 1, 1)


def test_engagement_edges(shop):
    e, v, p, c = (shop.df[k] for k in ("session_events", "product_variants", "products", "categories"))
    _, rows = shop.check("product_engagement", ecom.product_engagement(e, v, p, c))
    ids = {r["product_id"] for r in rows}
    assert 15 not in ids  # carts without views are left out


def test_cart_edges(shop):
    e = shop.df["session_events"]
    _, rows = shop.check("cart_abandonment", ecom.cart_abandonment(e))
    _, strict_rows = shop.check("cart_abandonment_strict", ecom.cart_abandonment(e, strict=True))
    top = {r["cart_bucket"]: r for r in rows}["15000+"]
    assert top["atc_sessions"] == 5  # 1999.50, 14999.50, a NULL value and two of 15000 land in the top bucket
    strict = {r["cart_bucket"]: r["atc_sessions"] for r in strict_rows}
    assert strict["unknown"] == 1 and strict["15000+"] == 2


# ----------------------------------------------------------------- saas
AS_OF = T(2001, 1, 1)


@pytest.fixture(scope="module")
def books(spark):
    ev = [
        # account 1: start, cancel, start -> reactivation
        (1, 1, 1, "subscription_started", D("100.00"), None, None, "pro", T(1999, 1, 10)),
        (2, 1, 1, "cancelled", D("-100.00"), None, "pro", None, T(1999, 3, 10)),
        (3, 1, 1, "trial_converted", D("120.00"), None, None, "pro", T(1999, 6, 10)),
        # account 2: cancel at the same instant as a start -> not reactivation
        (4, 2, 2, "cancelled", D("-10.00"), None, "pro", None, T(1999, 2, 1)),
        (5, 2, 2, "subscription_started", D("10.00"), None, None, "pro", T(1999, 2, 1)),
        # account 3: two starts at one instant, a seat add and a contraction in 12 months
        (6, 3, 3, "subscription_started", D("10.00"), None, None, "pro", T(1999, 4, 5)),
        (7, 3, 3, "trial_converted", D("20.00"), None, None, "pro", T(1999, 4, 5)),
        (8, 3, 3, "seat_add", D("5.00"), 2, "pro", "pro", T(1999, 8, 1)),
        (9, 3, 3, "plan_changed", D("-3.00"), None, "enterprise", "pro", T(1999, 9, 1)),
        (10, 3, 3, "plan_changed", D("0.00"), None, "pro", "pro", T(1999, 9, 2)),  # zero delta: unclassified
        # account 4: leap-day start, cancel exactly at start + 12 months (inclusive)
        (11, 4, 4, "subscription_started", D("50.00"), None, None, "pro", T(1996, 2, 29)),
        (12, 4, 4, "cancelled", D("-50.00"), None, "pro", None, T(1997, 2, 28)),
        # account 5: all-zero starting MRR, no movement
        (13, 5, 5, "subscription_started", D("0.00"), None, None, "pro", T(1999, 11, 1)),
        # expansion window bounds and the cut-off
        (14, 1, 1, "addon_attach", D("7.00"), None, "pro", "pro", T(2000, 7, 1)),  # = as_of - 6 months
        (15, 1, 1, "plan_changed", D("9.00"), None, "pro", "enterprise", AS_OF),  # at midnight of as_of
        (16, 1, 1, "seat_add", D("4.00"), 1, "pro", "pro", T(2001, 1, 1, 0, 0, 1)),  # one second after
        (17, 6, 6, "plan_changed", D("-2.00"), None, "enterprise", "pro", T(2000, 9, 1)),  # negative plan change
        (18, 99, 99, "seat_add", D("3.00"), 1, "pro", "pro", T(2000, 9, 1)),  # account absent
        (19, 1, 1, "trial_started", D("0.00"), None, None, None, T(1998, 12, 1)),
        (20, 7, 7, "subscription_started", D("15.00"), None, None, "pro", T(1998, 1, 1)),  # a month far from others
        (21, 6, 6, "seat_add", D("6.00"), 2, "pro", "pro", T(2000, 10, 1)),
    ]
    return Fixture(
        spark,
        subscription_events=ev,
        accounts=[
            (1, T(1998, 12, 1), "organic", "self_serve"),
            (2, T(1999, 1, 1), "referral", "b2b"),
            (3, T(1999, 3, 1), "organic", "self_serve"),
            (4, T(1996, 1, 1), "partner", "b2b"),
            (5, T(1999, 10, 1), "organic", "self_serve"),
            (6, T(2000, 1, 1), "outbound", "b2b"),
            (7, T(2000, 12, 1), "organic", "self_serve"),  # not eligible (too recent)
            (8, T(1999, 5, 1), "organic", "self_serve"),  # no subscription
        ],
        subscriptions=[
            (100, 1, 1, "pro", 1, 1, D("49.00"), "active", T(1999, 1, 10), None, None),
            (101, 1, 1, "Pro", None, 1, D("12.34"), "churned", T(1999, 6, 10), T(1999, 7, 1), None),  # NULL reason
            (102, None, 2, "professional", None, 3, D("147.00"), "active", None, T(1999, 1, 20), "too_expensive"),  # NULL start
            (103, None, 2, "enterprise", 2, 2, D("1.00"), "paused", T(1999, 2, 1), None, None),
            (104, 3, 3, "Enterprise", 2, 1, D("199.00"), "past_due", T(1999, 4, 5), T(1999, 5, 1), None),  # tied start_date
            (105, 3, 3, "enterprise", 2, 1, D("199.00"), "churned", T(1999, 4, 5), None, "not_using"),
            (106, 4, 4, None, None, 1, D("5.00"), "active", T(2000, 2, 29), None, None),  # NULL plan
            (107, 5, 5, "basic", None, 1, D("1.00"), "trialing", T(1999, 11, 1), None, None),  # plan without a match
        ],
        trials=[
            (1, 1, T(1999, 1, 1)),  # conversion (01-10) within 14 days? 9 days
            (2, 2, T(1999, 1, 18)),  # exactly 14 days before first conversion (02-01)
            (3, 3, T(1999, 5, 1)),  # conversion before the trial
            (4, 8, T(1999, 5, 1)),  # never converts
            (5, 1, T(1999, 6, 1)),  # second trial of account 1
        ],
        features=[("f1", "search"), ("f2", "export"), ("f3", "export"), ("f4", "unused"), ("f5", None)],
        feature_events=[
            (1, "f1", T(1998, 12, 5)),
            (1, "f2", T(1998, 11, 1)),  # before signup: counts by the reference rule
            (3, "f1", T(1999, 3, 10)),
            (3, "f2", T(1999, 3, 2)),
            (3, "f3", T(1999, 3, 3)),  # adopts both "export" features
            (5, "f3", T(1999, 10, 30)),  # after the 14-day window
            (8, "f1", T(1999, 5, 2)),
            (8, None, T(1999, 5, 2)),
            (1, "f5", T(1998, 12, 6)),  # adopters of a feature without a name
            (3, "f5", T(1999, 3, 4)),
        ],
        telemetry=[
            (1, 1, 1, "f1", T(2000, 1, 1), '{"feature": "search"}'),
            (2, 777, 3, None, T(2000, 1, 1), '{"feature": "export"}'),  # orphan user, account present
            (3, 3, 3, None, T(2000, 1, 1), '{"feature": "gone"}'),
        ],
        users=[(1, 1, 1), (3, 3, 0), (4, 4, 2)],
        # a name repeats per billing interval, in another spelling
        plans=[
            (1, "pro", D("49.00"), "monthly"),
            (2, "enterprise", D("199.00"), "monthly"),
            (3, "Professional", D("39.00"), "annual"),
            (4, "Enterprise", D("159.00"), "annual"),
        ],
    )


def test_mrr_edges(books):
    ev = books.df["subscription_events"]
    _, rows = books.check("mrr_movements", saas.mrr_movements(ev, as_of=SAAS_AS_OF))
    by = {r["month"]: r for r in rows}
    assert by[dt.date(1999, 6, 1)]["reactivation_mrr"] == D("120.00")
    assert by[dt.date(1999, 2, 1)]["new_mrr"] == D("10.00")  # cancel at the same instant is not earlier
    assert dt.date(2001, 1, 1) in by  # midnight of as_of is kept
    _, strict = books.check("mrr_movements_strict", saas.mrr_movements(ev, as_of=SAAS_AS_OF, strict=True))
    sby = {r["month"]: r for r in strict}
    assert sby[dt.date(1998, 2, 1)]["net_new_mrr"] == 0  # spine month
    assert sby[dt.date(1999, 9, 1)]["unclassified_mrr"] == D("0.00")


def test_trial_edges(books):
    tr, ev = books.df["trials"], books.df["subscription_events"]
    books.check("trial_conversion", saas.trial_conversion(tr, ev))
    books.check("trial_conversion_strict", saas.trial_conversion(tr, ev, strict=True))


def test_revenue_retention_edges(books):
    ev = books.df["subscription_events"]
    _, rows = books.check("revenue_retention", saas.revenue_retention(ev, as_of=SAAS_AS_OF))
    _, strict = books.check("revenue_retention_strict", saas.revenue_retention(ev, as_of=SAAS_AS_OF, strict=True))
    april = {r["cohort_month"]: r for r in rows}[dt.date(1999, 4, 1)]
    april_strict = {r["cohort_month"]: r for r in strict}[dt.date(1999, 4, 1)]
    assert april["cohort_starting_mrr"] == D("30.00")
    assert april["expansion_mrr_12m"] == D("20.00")  # two tied starts: 2 x 2 x 5 (Q15)
    assert april_strict["expansion_mrr_12m"] == D("5.00")
    zero = {r["cohort_month"]: r for r in rows}[dt.date(1999, 11, 1)]
    assert zero["grr"] is None  # all-zero starting MRR
    leap = {r["cohort_month"]: r for r in rows}[dt.date(1996, 2, 1)]
    assert leap["churn_mrr_12m"] == D("-50.00")  # cancel at 1997-02-28 = leap-day start + 12 months, inclusive


def test_feature_adoption_edges(books):
    a, s, u, f = (books.df[k] for k in ("accounts", "subscriptions", "feature_events", "features"))
    _, rows = books.check("feature_adoption", saas.feature_adoption(a, s, u, f, as_of=SAAS_AS_OF))
    books.check("feature_adoption_strict", saas.feature_adoption(a, s, u, f, as_of=SAAS_AS_OF, strict=True))
    by = {r["feature_name"]: r for r in rows}
    assert by["unused"]["accounts_adopted"] == 0 and by["unused"]["retention_rate_adopted"] is None
    assert by[None]["accounts_adopted"] == 2  # features without a name are a group of their own


def test_expansion_edges(books):
    ev, a = books.df["subscription_events"], books.df["accounts"]
    _, rows = books.check("expansion_revenue", saas.expansion_revenue(ev, a, as_of=SAAS_AS_OF))
    by = {r["expansion_type"]: r for r in rows}
    assert by["addon"]["expansion_events"] == 1  # lower bound inclusive
    assert by["plan_upgrade"]["expansion_events"] == 1  # upper bound inclusive, negative change excluded
    assert by["seats_added"]["expansion_events"] == 1  # absent account and the event after as_of are dropped


def test_sample_queries(books):
    s, ev = books.df["subscriptions"], books.df["subscription_events"]
    books.check("active_paying_accounts", saas.active_paying_accounts(s))
    _, rows = books.check("plan_breakdown", saas.plan_breakdown(s))
    assert {r["plan_normalized"]: r["subscriptions"] for r in rows} == {"pro": 3, "enterprise": 3, None: 1, "basic": 1}
    books.check("first_events", saas.first_events(ev))


def test_quality_edges(books):
    d = books.df
    _, rows = books.check("plan_id_backfill", quality.plan_id_backfill(d["subscriptions"], d["plans"]))
    assert len(rows) == 8 and {r["subscription_id"]: r["resolved_plan_id"] for r in rows}[102] == 1
    _, rows = books.check("mrr_price_check", quality.mrr_price_check(d["subscriptions"], d["plans"], d["accounts"]))
    assert sum(r["subscriptions"] for r in rows) == 8
    empty = d["subscriptions"].limit(0)
    row = quality.soft_fk_check([("accounts", d["accounts"], "account_id", "subscriptions", empty, "account_id")]).first()
    assert (row["child_rows"], row["orphan_rows"]) == (0, 0)
    _, rows = books.check("unattributed_events", quality.unattributed_events(d["telemetry"], d["users"]))
    assert {r["attribution"]: r["events"] for r in rows} == {"attributed": 2, "unattributed": 1}
    _, rows = books.check("cancellation_reasons", quality.cancellation_reasons(d["subscriptions"]))
    assert {r["cancellation_reason"] for r in rows} == {"no reason given", "not_using"}
    _, rows = books.check("subs_per_account", quality.subs_per_account(d["accounts"], d["subscriptions"]))
    assert {r["n_subscriptions"]: r["accounts"] for r in rows} == {0: 3, 1: 2, 2: 3}
    books.check("flag_domain", quality.flag_domain(d["users"]))
    books.check("feature_id_coverage", quality.feature_id_coverage(d["telemetry"], d["features"]))


def test_feature_adoption_min_uses(books):
    a, s, u, f = (books.df[k] for k in ("accounts", "subscriptions", "feature_events", "features"))
    got = saas.feature_adoption(a, s, u, f, as_of=SAAS_AS_OF, min_uses=2)
    sc, sr = rows_of_spark(got)
    rel = books.con.sql(SQL["feature_adoption"].replace("count(*) >= 1", "count(*) >= 2"))
    res = compare(sc, sr, rel.columns, rel.fetchall())
    assert res["match"], res


def test_revenue_retention_horizon_boundary(spark):
    ev = spark.createDataFrame(
        [
            (1, 1, 1, "subscription_started", D("10.00"), None, None, "pro", T(2024, 2, 29)),
            (2, 2, 2, "subscription_started", D("20.00"), None, None, "pro", T(2024, 1, 31, 12)),
            (3, 1, 1, "seat_add", D("1.00"), 1, "pro", "pro", T(2025, 2, 28)),
        ],
        SCHEMAS["subscription_events"],
    )
    # 2024-02-29 + 12 months = 2025-02-28: included on that day, not the day before
    rows = saas.revenue_retention(ev, as_of=dt.date(2025, 2, 28)).collect()
    assert [(r["cohort_month"], r["cohort_starting_mrr"], r["expansion_mrr_12m"]) for r in rows] == [
        (dt.date(2024, 1, 1), D("20.00"), D("0.00")),
        (dt.date(2024, 2, 1), D("10.00"), D("1.00")),
    ]
    assert [r["cohort_month"] for r in saas.revenue_retention(ev, as_of=dt.date(2025, 2, 27)).collect()] == [dt.date(2024, 1, 1)]
    # one-month horizon: 2024-01-31 12:00 + 1 month = 2024-02-29 12:00, after midnight of 02-29
    assert saas.revenue_retention(ev, as_of=dt.date(2024, 2, 29), horizon_months=1).collect() == []
    assert len(saas.revenue_retention(ev, as_of=dt.date(2024, 3, 1), horizon_months=1).collect()) == 1


def test_unfinished_cohorts_are_left_out(shop, books):
    c, s, e = shop.df["customers"], shop.df["sessions"], shop.df["session_events"]
    args = {"since": dt.date(2024, 1, 2)}
    for run, column, horizon in (
        (lambda **k: ecom.activation_curve(c, s, e, **args, **k), "signup_week", 7),
        (lambda **k: ecom.cohort_retention(c, s, e, **args, **k), "cohort_week", 35),
        (lambda **k: saas.trial_conversion(books.df["trials"], books.df["subscription_events"], **k), "trial_week", 60),
    ):
        every = [tuple(r) for r in run().collect()]
        weeks = sorted(r[0] for r in every)
        last = weeks[len(weeks) // 2]
        kept = [tuple(r) for r in run(closed_by=last + dt.timedelta(days=7 + horizon)).collect()]
        assert sorted(kept, key=str) == sorted((r for r in every if r[0] <= last), key=str) and column
