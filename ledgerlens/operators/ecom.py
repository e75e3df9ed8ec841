"""E-commerce behaviour operators (the ``ecom`` queries).

Inputs are the ``customers``, ``sessions``, ``session_channels``,
``session_events``, ``product_variants``, ``products`` and ``categories``
tables (see ``FIXTURES.md``). Events are always reduced to session, customer
or product grain by an aggregate before they meet another table, so the wide
fact table is shuffled once with map-side partial aggregation and a hot
session, customer or product is combined in many tasks before its final
merge.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import MONEY_SUM, bucket_ordinal, closed_cohort, days, elapsed, ratio, week_start
from ..functions.order_statistics import Percentile, Rank, with_order_statistics
from ..functions.percentile import PERCENTILE_DIGITS, attach, percentile_cont
from ..session import materialize

# Fixed values that must equal the reference's (vocabulary, steps, buckets, defaults).
ACTIVATION_TYPES = ("add_to_cart", "begin_checkout", "purchase")
RETENTION_TYPES = ("product_view", "add_to_cart", "purchase")
FUNNEL_STEPS = (
    ("begin_checkout", "begin_checkout"),
    ("add_address", "address"),
    ("select_shipping", "shipping"),
    ("add_payment", "payment"),
    ("purchase", "purchased"),
)
FUNNEL_DROPS = ("drop_address_pct", "drop_shipping_pct", "drop_payment_pct", "drop_final_pct")
CART_BUCKETS = (
    ("<500", None, 500),
    ("500-1999", 500, 1999),
    ("2000-4999", 2000, 4999),
    ("5000-14999", 5000, 14999),
)
CART_TOP_BUCKET = "15000+"
CART_TOP_FROM = 15000
REFERENCE_SINCE = dt.date(2026, 4, 19)
VIEW, ADD_TO_CART, PURCHASE = "product_view", "add_to_cart", "purchase"


def _since(d: dt.date) -> F.Column:
    return F.lit(dt.datetime(d.year, d.month, d.day)).cast("timestamp_ntz")


def _signups(customers: DataFrame, since: dt.date) -> DataFrame:
    return customers.where(F.col("created_at") >= _since(since)).select(
        "customer_id", F.col("created_at").alias("signup_at"), week_start("created_at").alias("signup_week")
    )


def _window_sessions(sessions: DataFrame, signups: DataFrame) -> DataFrame:
    """Sessions of customers who signed up in the window, with the signup
    time (session grain), written once."""
    known = sessions.select("session_id", "customer_id").where(F.col("customer_id").isNotNull())
    return materialize(known.join(signups.select("customer_id", "signup_at"), "customer_id"))


def _signup_activity(events: DataFrame, sessions: DataFrame, signups: DataFrame, types: Sequence[str]) -> DataFrame:
    """Events of ``types`` with their customer and signup time.

    Events meet the window's sessions on ``session_id``. Both are scans here, so
    Spark broadcasts the sessions if their size allows, else shuffles both and
    splits a hot session.
    """
    acts = events.where(F.col("event_type").isin(*types)).select("session_id", "occurred_at")
    return acts.join(_window_sessions(sessions, signups), "session_id")


# --------------------------------------------------------------------- E1
def activation_curve(
    customers: DataFrame,
    sessions: DataFrame,
    events: DataFrame,
    since: dt.date = REFERENCE_SINCE,
    types: Sequence[str] = ACTIVATION_TYPES,
    window_days: int = 7,
    strict: bool = False,
    approx_percentiles: bool = False,
    closed_by: dt.date | None = None,
) -> DataFrame:
    """Share of each weekly signup cohort whose first meaningful action came
    within ``window_days`` of signup, with median and p90 minutes to it.

    Reference rule: the first action *ever* is tested, so a customer whose
    first action precedes signup is not activated even if they act again in
    the window. ``strict=True`` takes the first action at or after signup.
    ``closed_by`` leaves out cohorts whose window is not over by that date.

    Plan: the type filter is applied to the event scan (pushed down); events
    meet the sessions of customers in the signup window and are reduced to one
    minimum per customer; the percentile helper never gathers a cohort in one
    task.
    """
    signups = _signups(customers, since).where(closed_cohort("signup_week", window_days, closed_by))
    if strict:
        # activity at or after a signup in the window is at or after `since`
        acts = _signup_activity(events.where(F.col("occurred_at") >= _since(since)), sessions, signups, types)
        acts = acts.where(F.col("occurred_at") >= F.col("signup_at"))
    else:
        acts = _signup_activity(events, sessions, signups, types)
    first = acts.groupBy("customer_id").agg(F.min("occurred_at").alias("first_action_at"))
    fa = F.col("first_action_at")
    activated = fa.isNotNull() & (fa >= F.col("signup_at")) & (fa <= F.col("signup_at") + days(window_days))
    calc = materialize(
        signups.join(first, "customer_id", "left").select(
            "signup_week",
            F.when(activated, F.lit(1)).otherwise(F.lit(0)).alias("activated"),
            F.when(activated, elapsed(fa, "signup_at", "minute")).alias("minutes_to_activation"),
        )
    )
    cohorts = calc.groupBy("signup_week").agg(
        F.count(F.lit(1)).alias("cohort_size"), F.sum("activated").cast("bigint").alias("activated_7d")
    )
    pct = percentile_cont(
        calc,
        ["signup_week"],
        "minutes_to_activation",
        {"median_minutes_to_activation": 0.5, "p90_minutes_to_activation": 0.9},
        digits=PERCENTILE_DIGITS,
        approx=approx_percentiles,
    )
    return attach(cohorts.select("*", ratio("activated_7d", "cohort_size").alias("activation_rate_7d")), pct, ["signup_week"]).orderBy(
        "signup_week"
    )


# --------------------------------------------------------------------- E2
def checkout_funnel(
    sessions: DataFrame,
    session_channels: DataFrame,
    events: DataFrame,
    steps: Sequence[tuple[str, str]] = FUNNEL_STEPS,
    drop_names: Sequence[str] | None = None,
) -> DataFrame:
    """Furthest checkout step per session and channel; per channel the number
    of sessions reaching each step and the drop rate between steps.

    The step reached is the maximum step code among the session's events (not
    an ordered path). Sessions are counted once per channel they are tagged
    with; sessions without a channel or without any step are left out.
    """
    names = [name for _, name in steps]
    if drop_names is None:
        drop_names = FUNNEL_DROPS if tuple(steps) == FUNNEL_STEPS else tuple(f"drop_{n}_pct" for n in names[1:])
    code = None
    for i, (etype, _) in enumerate(steps, start=1):
        cond = F.col("event_type") == etype
        code = F.when(cond, F.lit(i)) if code is None else code.when(cond, F.lit(i))
    step_types = [etype for etype, _ in steps]
    reached = events.where(F.col("event_type").isin(*step_types)).groupBy("session_id").agg(F.max(code).alias("max_step"))
    # Join first, then collapse duplicate (session, channel) tags: the join is
    # hash-partitioned on session_id, which already satisfies the grouping on
    # (session_id, channel), so de-duplicating costs no extra shuffle.
    tagged = (
        reached.join(sessions.select("session_id"), "session_id", "left_semi")
        .join(session_channels.select("session_id", "channel"), "session_id", "inner")
        .groupBy("session_id", "channel")
        .agg(F.max("max_step").alias("max_step"))
    )
    counts = tagged.groupBy("channel").agg(
        *[F.count_if(F.col("max_step") >= i).alias(name) for i, name in enumerate(names, start=1)]
    )
    drops = [ratio(F.col(a) - F.col(b), a).alias(d) for a, b, d in zip(names[:-1], names[1:], drop_names)]
    return counts.select("channel", *names, *drops).orderBy(F.col(names[0]).desc())


# --------------------------------------------------------------------- E3
def cohort_retention(
    customers: DataFrame,
    sessions: DataFrame,
    events: DataFrame,
    since: dt.date = REFERENCE_SINCE,
    types: Sequence[str] = RETENTION_TYPES,
    weeks: int = 4,
    strict: bool = False,
    closed_by: dt.date | None = None,
) -> DataFrame:
    """Weekly behavioural retention: of each signup-week cohort, how many were
    active in week 0 and in weeks 1..``weeks`` after signup.

    Week index is ``floor(elapsed / 7 days)`` clipped at 0, so activity before
    signup lands in week 0. Reference rule: a customer with no activity at all
    also counts as week-0 active (``greatest(NULL, 0) = 0``); ``strict=True``
    does not count them. ``closed_by`` leaves out cohorts whose last week is not
    over by that date.

    Plan: the reference's nine filtered ``count(distinct)`` become one
    aggregate of per-week 0/1 flags per customer (no Expand of the rows), then
    plain sums per cohort.
    """
    signups = _signups(customers, since).withColumnRenamed("signup_week", "cohort_week")
    signups = signups.where(closed_cohort("cohort_week", 7 * (weeks + 1), closed_by))
    act = _signup_activity(events, sessions, signups, types)
    week_index = F.greatest(F.floor(elapsed("occurred_at", "signup_at", "second") / 604800.0), F.lit(0))
    if strict:
        week_index = F.floor(elapsed("occurred_at", "signup_at", "second") / 604800.0)
        week_index = F.when(week_index < 0, F.lit(0)).otherwise(week_index)
    flags = act.select("customer_id", week_index.alias("wi")).groupBy("customer_id").agg(
        *[F.max(F.when(F.col("wi") == w, F.lit(1)).otherwise(F.lit(0))).alias(f"f{w}") for w in range(weeks + 1)]
    )
    j = signups.join(flags, "customer_id", "left")
    no_activity = F.col("f0").isNull()
    w0 = F.when(no_activity, F.lit(0 if strict else 1)).otherwise(F.col("f0"))
    per_customer = j.select(
        "cohort_week", w0.alias("w0"), *[F.coalesce(F.col(f"f{w}"), F.lit(0)).alias(f"w{w}") for w in range(1, weeks + 1)]
    )
    cohorts = per_customer.groupBy("cohort_week").agg(
        F.count(F.lit(1)).alias("cohort_size"),
        F.sum("w0").cast("bigint").alias("w0_active"),
        *[F.sum(f"w{w}").cast("bigint").alias(f"w{w}_retained") for w in range(1, weeks + 1)],
    )
    rates = [ratio(f"w{w}_retained", "cohort_size").alias(f"w{w}_retention_rate") for w in range(1, weeks + 1)]
    return cohorts.select("*", *rates).orderBy("cohort_week")


# --------------------------------------------------------------------- E4
def product_engagement(
    events: DataFrame,
    variants: DataFrame,
    products: DataFrame,
    categories: DataFrame,
    approx_percentiles: bool = False,
) -> DataFrame:
    """Views, add-to-cart sessions and cart rate per product, against the
    median cart rate of its category, with global ranks by views (descending)
    and by cart rate (ascending).

    Reference rules: the rate divides cart *sessions* by view *rows*; products
    without a view and events without a variant are left out.

    Plan: one pass over the events pre-aggregates to (variant, cart session)
    before the variant join, so the join sees one row per variant and cart
    session instead of one per event. The median and the two catalogue-wide
    ranks come from one dealing of distinct values with their counts
    (``with_order_statistics``), so no task holds the whole catalogue.
    """
    ev = events.where(F.col("event_type").isin(VIEW, ADD_TO_CART) & F.col("variant_id").isNotNull())
    pre = ev.groupBy("variant_id", F.when(F.col("event_type") == ADD_TO_CART, F.col("session_id")).alias("cart_session")).agg(
        F.count_if(F.col("event_type") == VIEW).alias("views")
    )
    per_product = (
        pre.join(variants.select("variant_id", "product_id"), "variant_id", "inner")
        .groupBy("product_id")
        .agg(F.sum("views").alias("views"), F.count_distinct("cart_session").alias("add_to_cart_sessions"))
        .where(F.col("views") > 0)
    )
    rates = materialize(
        per_product.join(products.select("product_id", "product_name", "category_id"), "product_id", "inner")
        .join(categories.select("category_id", F.col("category_name").alias("category")), "category_id", "inner")
        .select(
            "product_id",
            "product_name",
            "category",
            F.col("views").cast("bigint").alias("views"),
            F.col("add_to_cart_sessions").cast("bigint").alias("add_to_cart_sessions"),
            ratio("add_to_cart_sessions", "views").alias("atc_rate"),
        )
    )
    # inner join on category: NULL categories drop out, as in the SQL
    named = rates.where(F.col("category").isNotNull())
    ranks = [Rank("views_rank", "views", ascending=False), Rank("atc_rate_rank", "atc_rate")]
    if approx_percentiles:
        medians = percentile_cont(rates, ["category"], "atc_rate", {"category_median_atc_rate": 0.5}, approx=True)
        ranked = with_order_statistics(named.join(materialize(medians), "category"), ranks)
    else:
        ranked = with_order_statistics(named, [Percentile("category_median_atc_rate", "atc_rate", 0.5, "category"), *ranks])
    return ranked.select(
        "product_id",
        "product_name",
        "category",
        "views",
        "add_to_cart_sessions",
        "atc_rate",
        F.round(F.col("atc_rate") - F.col("category_median_atc_rate"), PERCENTILE_DIGITS).alias("atc_rate_vs_category_median"),
        "views_rank",
        "atc_rate_rank",
    ).orderBy(F.col("views").desc())


# --------------------------------------------------------------------- E5
def cart_abandonment(
    events: DataFrame,
    buckets: Sequence[tuple[str, float | None, float | None]] = CART_BUCKETS,
    top_bucket: str = CART_TOP_BUCKET,
    top_from: float = CART_TOP_FROM,
    strict: bool = False,
) -> DataFrame:
    """Cart sessions by cart-value bucket: purchased, abandoned, abandonment
    rate and the cart value left in abandoned sessions.

    Reference rule: buckets are closed integer ranges, so a value in a gap
    (1999.50) or a NULL cart value falls to the top bucket. ``strict=True``
    uses half-open ranges ``[lo, next lo)`` (the last one ends at ``top_from``)
    and labels NULL values ``unknown``.

    Plan: a single ``groupBy(session)`` computes cart value, cart-row count and
    the purchase flag together; the bucket aggregate then runs over
    session-grain rows.
    """
    ev = events.where(F.col("event_type").isin(ADD_TO_CART, PURCHASE))
    is_cart = F.col("event_type") == ADD_TO_CART
    sessions = (
        ev.groupBy("session_id")
        .agg(
            F.sum(F.when(is_cart, F.col("quantity") * F.col("unit_price"))).alias("cart_value"),
            F.count_if(is_cart).alias("cart_rows"),
            F.max(F.col("event_type") == PURCHASE).alias("any_purchase"),
        )
        .where(F.col("cart_rows") > 0)
    )
    v = F.col("cart_value")
    label = None
    for i, (name, lo, hi) in enumerate(buckets):
        if strict:
            upper = buckets[i + 1][1] if i + 1 < len(buckets) else top_from
            cond = (v >= lo if lo is not None else F.lit(True)) & (v < upper)
        else:
            cond = (v < hi) if lo is None else v.between(lo, hi)
        label = F.when(cond, F.lit(name)) if label is None else label.when(cond, F.lit(name))
    if strict:
        label = F.when(v.isNull(), F.lit("unknown")).otherwise(label.otherwise(F.lit(top_bucket)))
    else:
        label = label.otherwise(F.lit(top_bucket))
    purchased = F.when(F.col("any_purchase") & F.col("session_id").isNotNull(), F.lit(1)).otherwise(F.lit(0))
    flagged = sessions.select(label.alias("cart_bucket"), "cart_value", purchased.alias("purchased"))
    out = flagged.groupBy("cart_bucket").agg(
        F.count(F.lit(1)).alias("atc_sessions"),
        F.sum("purchased").cast("bigint").alias("purchased_sessions"),
        F.sum(F.when(F.col("purchased") == 0, v)).cast(MONEY_SUM).alias("gmv_left_on_table"),
    )
    order = [name for name, _, _ in buckets] + [top_bucket] + (["unknown"] if strict else [])
    return out.select(
        "cart_bucket",
        "atc_sessions",
        "purchased_sessions",
        (F.col("atc_sessions") - F.col("purchased_sessions")).alias("abandoned_sessions"),
        ratio(F.col("atc_sessions") - F.col("purchased_sessions"), "atc_sessions").alias("abandonment_rate"),
        "gmv_left_on_table",
    ).orderBy(bucket_ordinal("cart_bucket", order))
