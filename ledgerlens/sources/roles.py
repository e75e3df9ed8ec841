"""Role views: the driver tables re-read as the ``ecom`` and ``saas`` tables the
operators take as input.

The reference's own data is private, so every operator input is derived from
the driver's TPC-H-style tables with built-in expressions only; each role's
work grows with those tables. ``ledgerlens.oracle.roles`` defines the same
views as DuckDB CTEs; the two must stay in step.

Fixed values of this mapping (channel names follow the reference's funnel
header; everything else is our own choice):

* session channels by ``session_id % 5``: paid_social, organic, referral,
  email, affiliate
* driver event type -> e-commerce event: view -> product_view,
  click -> add_to_cart, signup -> begin_checkout, purchase -> purchase,
  error -> add_address / select_shipping / add_payment by ``event_id % 3``
* subscription event type by ``o_orderkey % 8``: subscription_started,
  trial_converted, plan_changed (up), plan_changed (down), seat_add,
  addon_attach, cancelled, trial_started
* plan text by order priority 1..5: pro, Pro, professional, enterprise,
  Enterprise; plans: 1 pro 49.00 and 2 enterprise 199.00 monthly,
  3 Pro 39.00 and 4 Enterprise 159.00 annual
* subscription status by ``o_orderkey % 5``: active, churned, trialing,
  past_due, paused
* cancellation reason by ``o_orderkey % 4``: too_expensive, missing_features,
  switched_competitor, not_using
* acquisition channel by ``c_nationkey % 5``: organic, paid_search,
  referral, partner, outbound
* role-data parameters: e-commerce ``since`` 2024-01-02, SaaS ``as_of``
  2001-01-01
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import MONEY, normalize_plan
from .tables import Tables

ECOM_SINCE = dt.date(2024, 1, 2)
SAAS_AS_OF = dt.date(2001, 1, 1)

SECOND_USER_OFFSET = 2_000_000_000
ORPHAN_USER_OFFSET = 1_000_000_000
SECOND_TRIAL_OFFSET = 1_000_000_000


def _case(c, mapping: dict, default=None):
    expr = None
    for k, v in mapping.items():
        cond = c == F.lit(k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def _ntz(y: int, m: int, d: int):
    return F.lit(dt.datetime(y, m, d)).cast("timestamp_ntz")


class Roles:
    """Role DataFrames built lazily from a ``Tables`` instance."""

    def __init__(self, tables: Tables):
        self.t = tables
        self.spark = tables.spark
        self._memo: dict[str, DataFrame] = {}

    def _get(self, name, build):
        if name not in self._memo:
            self._memo[name] = build()
        return self._memo[name]

    # ------------------------------------------------------------------ ecom
    @property
    def customers(self) -> DataFrame:
        def build():
            c = self.t.customer
            return c.select(
                F.col("c_custkey").alias("customer_id"),
                (
                    _ntz(2024, 1, 1)
                    + F.make_dt_interval((F.col("c_custkey") % 21).cast("int"), (F.col("c_custkey") % 24).cast("int"))
                ).alias("created_at"),
            )

        return self._get("customers", build)

    @property
    def sessions(self) -> DataFrame:
        def build():
            e = self.t.events
            return e.select(
                (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("session_id"),
                # anonymous before the day of the first login, and always for a few visitors
                F.when((F.col("user_id") % 50 != 49) & (F.dayofmonth("ts") >= F.col("user_id") % 25), F.col("user_id")).alias("customer_id"),
            ).distinct()

        return self._get("sessions", build)

    @property
    def session_channels(self) -> DataFrame:
        def build():
            # the page view carries the channel: sessions without one have none
            views = self.t.events.where(F.col("event_type") == "view")
            s = views.select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("session_id")).distinct()
            base = s.select(
                "session_id",
                _case(F.col("session_id") % 5, {0: "paid_social", 1: "organic", 2: "referral", 3: "email", 4: "affiliate"}).alias("channel"),
            )
            extra = s.where(F.col("session_id") % 7 == 0).select("session_id", F.lit("organic").alias("channel"))
            return base.unionByName(extra)

        return self._get("session_channels", build)

    @property
    def session_events(self) -> DataFrame:
        def build():
            e = self.t.events
            k = F.col("event_id")
            variants = self.t.part.agg((2 * F.count(F.lit(1))).alias("n")).scalar()
            etype = (
                _case(F.col("event_type"), {"view": "product_view", "click": "add_to_cart", "signup": "begin_checkout", "purchase": "purchase"})
                .when(F.col("event_type") == "error", _case(k % 3, {0: "add_address", 1: "select_shipping"}, "add_payment"))
            )
            return e.select(
                (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("session_id"),
                F.col("ts").alias("occurred_at"),
                etype.alias("event_type"),
                F.when(k % 97 != 0, k % F.nullif(variants, F.lit(0))).alias("variant_id"),
                (1 + k % 5).cast("int").alias("quantity"),
                F.when(k % 89 != 0, (F.col("value").cast(MONEY) * 25).cast(MONEY)).alias("unit_price"),
            )

        return self._get("session_events", build)

    @property
    def product_variants(self) -> DataFrame:
        return self._get(
            "product_variants",
            lambda: self.t.part.select(
                F.explode(F.array(2 * F.col("p_partkey"), 2 * F.col("p_partkey") + 1)).alias("variant_id"), F.col("p_partkey").alias("product_id")
            ),
        )

    @property
    def products(self) -> DataFrame:
        return self._get(
            "products",
            lambda: self.t.part.select(
                F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("category_id")
            ),
        )

    @property
    def categories(self) -> DataFrame:
        return self._get(
            "categories",
            lambda: self.t.part.select(F.col("p_type").alias("category_id"), F.lower("p_type").alias("category_name")).distinct(),
        )

    # ------------------------------------------------------------------ saas
    @staticmethod
    def _is_b2b():
        return F.col("c_mktsegment").isin("MACHINERY", "AUTOMOBILE")

    @property
    def accounts(self) -> DataFrame:
        def build():
            c = self.t.customer
            b2b = self._is_b2b()
            return c.select(
                F.col("c_custkey").alias("account_id"),
                F.when(b2b, F.lit("b2b")).otherwise(F.lit("self_serve")).alias("account_type"),
                F.when(b2b, F.col("c_mktsegment")).alias("industry"),
                F.when(b2b, (10 + F.col("c_custkey") % 490).cast("int")).alias("employee_count"),
                F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("country"),
                (_ntz(1995, 1, 1) + F.make_dt_interval(((F.col("c_custkey") * 37) % 2400).cast("int"))).alias("signup_date"),
                _case(F.col("c_nationkey") % 5, {0: "organic", 1: "paid_search", 2: "referral", 3: "partner", 4: "outbound"}).alias(
                    "acquisition_channel"
                ),
            )

        return self._get("accounts", build)

    @staticmethod
    def _plan_text():
        return _case(
            F.substring("o_orderpriority", 1, 1),
            {"1": "pro", "2": "Pro", "3": "professional", "4": "enterprise", "5": "Enterprise"},
        )

    @property
    def subscription_events(self) -> DataFrame:
        def build():
            o = self.t.orders
            k = F.col("o_orderkey")
            kind = k % 8
            price = F.col("o_totalprice").cast(MONEY)
            return o.select(
                k.alias("event_id"),
                (k - kind).alias("subscription_id"),
                F.col("o_custkey").alias("account_id"),
                F.col("o_custkey").alias("user_id"),
                F.col("o_custkey").alias("actor_user_id"),
                _case(
                    kind,
                    {0: "subscription_started", 1: "trial_converted", 2: "plan_changed", 3: "plan_changed", 4: "seat_add", 5: "addon_attach", 6: "cancelled"},
                    "trial_started",
                ).alias("event_type"),
                F.when(kind.isin(0, 1, 7), F.lit(None).cast("string")).when(kind == 2, F.lit("pro")).otherwise(F.lit("enterprise")).alias("from_plan"),
                F.when(kind == 6, F.lit(None).cast("string")).when(kind == 3, F.lit("pro")).otherwise(F.lit("enterprise")).alias("to_plan"),
                F.when(kind == 7, F.lit(Decimal("0.00")).cast(MONEY))
                .when((kind == 2) & (k % 101 == 0), F.lit(Decimal("0.00")).cast(MONEY))
                .when(kind.isin(3, 6), (-price).cast(MONEY))
                .otherwise(price)
                .alias("mrr_delta"),
                F.when(kind == 4, (1 + k % 5).cast("int")).alias("seats_delta"),
                F.col("o_orderdate").alias("event_time"),
            )

        return self._get("subscription_events", build)

    @property
    def plans(self) -> DataFrame:
        schema = T.StructType(
            [
                T.StructField("plan_id", T.LongType()),
                T.StructField("plan_name", T.StringType()),
                T.StructField("monthly_price", T.DecimalType(18, 2)),
                T.StructField("seat_limit", T.IntegerType()),
                T.StructField("billing_interval", T.StringType()),
            ]
        )
        rows = [
            (1, "pro", Decimal("49.00"), 10, "monthly"),
            (2, "enterprise", Decimal("199.00"), 500, "monthly"),
            (3, "Pro", Decimal("39.00"), 10, "annual"),
            (4, "Enterprise", Decimal("159.00"), 500, "annual"),
        ]
        return self._get("plans", lambda: self.spark.createDataFrame(rows, schema))

    @property
    def subscriptions(self) -> DataFrame:
        def build():
            o = self.t.orders
            c = self.t.customer.select("c_custkey", "c_mktsegment")
            j = o.join(c, o.o_custkey == c.c_custkey, "inner")
            k = F.col("o_orderkey")
            b2b = self._is_b2b()
            plan = self._plan_text()
            seats = F.when(b2b, (1 + k % 20).cast("int")).otherwise(F.lit(1))
            unit = F.when(normalize_plan(plan) == "pro", F.lit(Decimal("49.00"))).otherwise(F.lit(Decimal("199.00"))).cast(MONEY)
            return j.select(
                k.alias("subscription_id"),
                F.when(~b2b, F.col("o_custkey")).alias("user_id"),
                F.col("o_custkey").alias("account_id"),
                plan.alias("plan"),
                F.when(
                    k % 11 != 0, (F.when(normalize_plan(plan) == "pro", F.lit(1)).otherwise(F.lit(2)) + F.when(k % 17 == 0, F.lit(2)).otherwise(F.lit(0))).cast("long")
                ).alias("plan_id"),
                seats.alias("seat_count"),
                F.when(b2b & (k % 7 != 0), (unit * seats).cast(MONEY)).otherwise(F.col("o_totalprice").cast(MONEY)).alias("mrr"),
                _case(k % 5, {0: "active", 1: "churned", 2: "trialing", 3: "past_due"}, "paused").alias("status"),
                F.when(k % 53 != 0, F.col("o_orderdate")).alias("start_date"),
                F.when(k % 3 == 0, F.col("o_orderdate") + F.make_dt_interval((k % 400).cast("int"))).alias("cancelled_at"),
                F.when(
                    (k % 3 == 0) & (k % 15 != 0),
                    _case(k % 4, {0: "too_expensive", 1: "missing_features", 2: "switched_competitor"}, "not_using"),
                ).alias("cancellation_reason"),
            )

        return self._get("subscriptions", build)

    @property
    def trials(self) -> DataFrame:
        def build():
            se = self.subscription_events
            conv = (
                se.where(F.col("event_type").isin("trial_converted", "subscription_started"))
                .groupBy("account_id")
                .agg(F.min(F.struct("event_time", "event_id")).alias("_c"))
                .select("account_id", F.col("_c.event_time").alias("first_conv"), F.col("_c.event_id").alias("conv_id"))
            )
            a = self.accounts.select("account_id", "signup_date")
            j = a.join(conv, "account_id", "left")
            started = F.when((F.col("account_id") % 3 == 0) | F.col("first_conv").isNull(), F.col("signup_date")).otherwise(
                F.col("first_conv") - F.make_dt_interval(((F.col("account_id") * 7) % 75).cast("int"))
            )
            first = j.select(F.col("account_id").alias("trial_id"), "account_id", started.alias("started_at"), "first_conv", "conv_id")
            second = first.where(F.col("account_id") % 10 == 0).select(
                (F.col("account_id") + SECOND_TRIAL_OFFSET).alias("trial_id"),
                "account_id",
                (F.col("started_at") - F.make_dt_interval(F.lit(30))).alias("started_at"),
                "first_conv",
                "conv_id",
            )
            both = first.unionByName(second)
            converted = F.col("first_conv") >= F.col("started_at")
            return both.select(
                "trial_id",
                "account_id",
                "started_at",
                (F.col("started_at") + F.make_dt_interval(F.lit(14))).alias("ends_at"),
                F.when(converted, F.col("first_conv")).alias("converted_at"),
                F.when(converted, F.col("conv_id")).alias("converted_subscription_id"),
            )

        return self._get("trials", build)

    @property
    def features(self) -> DataFrame:
        """Feature catalog: part types (used in orders) and the telemetry event
        vocabulary (never in orders, so these features have no adopters)."""

        def build():
            from_parts = self.t.part.select(
                F.col("p_type").alias("feature_id"), F.when(F.col("p_type") != "SMALL", F.lower("p_type")).alias("feature_name"), F.lit("core").alias("category")
            )
            from_events = self.t.events.select(
                F.col("event_type").alias("feature_id"), F.col("event_type").alias("feature_name"), F.lit("telemetry").alias("category")
            )
            return from_parts.unionByName(from_events).distinct()

        return self._get("features", build)

    @property
    def feature_events(self) -> DataFrame:
        """Product usage for feature adoption: one row per order line."""

        def build():
            li = self.t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber")
            o = self.t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
            p = self.t.part.select("p_partkey", "p_type")
            j = li.join(o, li.l_orderkey == o.o_orderkey, "inner").join(p, li.l_partkey == p.p_partkey, "inner")
            return j.select(
                F.col("o_custkey").alias("user_id"),
                F.col("o_custkey").alias("account_id"),
                F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 10 != 0, F.col("p_type")).alias("feature_id"),
                F.col("o_orderdate").alias("occurred_at"),
            )

        return self._get("feature_events", build)

    @property
    def telemetry(self) -> DataFrame:
        """Product telemetry (``saas.events``) with orphan users and legacy rows."""

        def build():
            e = self.t.events
            k = F.col("event_id")
            return e.select(
                k.alias("event_id"),
                F.when(k % 250 == 0, F.col("user_id") + ORPHAN_USER_OFFSET).otherwise(F.col("user_id")).alias("user_id"),
                F.col("user_id").alias("account_id"),
                F.when(k % 4 != 0, F.col("event_type")).alias("feature_id"),
                F.col("ts").alias("occurred_at"),
                F.concat(F.lit('{"feature": "'), F.col("event_type"), F.lit('"}')).alias("properties"),
            )

        return self._get("telemetry", build)

    @property
    def users(self) -> DataFrame:
        def build():
            c = self.t.customer
            k = F.col("c_custkey")
            plan_type = _case(k % 5, {0: "pro", 1: "Pro", 2: "professional", 3: "enterprise"}, "Enterprise")
            first = c.select(
                k.alias("user_id"), k.alias("account_id"), plan_type.alias("plan_type"), F.lit("owner").alias("role"), (k % 3).cast("int").alias("is_active")
            )
            second = c.where(self._is_b2b()).select(
                (k + SECOND_USER_OFFSET).alias("user_id"), k.alias("account_id"), plan_type.alias("plan_type"), F.lit("member").alias("role"), F.lit(1).alias("is_active")
            )
            return first.unionByName(second)

        return self._get("users", build)
