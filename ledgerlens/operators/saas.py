"""Subscription-revenue operators (the ``saas`` queries and sample queries).

Every operator is a pure function from DataFrames and parameters to a
DataFrame (operators with percentiles, ranks or per-account joins write a few
reduced tables while being built). Defaults follow the reference queries; ``strict=True`` switches on
the corrected reading of a rule that looks unintended (see README).

Scale notes that apply throughout:

* Per-account facts (first start, first cancel, latest subscription) are
  aggregates (``groupBy`` with map-side partial aggregation, ``min``/``max`` of
  a struct for arg-min/arg-max), never windows partitioned by account: one
  account may hold a third of all rows.
* Fact rows meet per-account facts through equi-joins on ``account_id``, with
  the per-account side written first (``functions.joins.keyed_join``), so that
  adaptive execution can split a hot account or broadcast a small side. There
  is no broadcast hint; one-row totals are attached as scalar subqueries.
* Month- or cohort-grain outputs use windows without partition only after the
  data has been reduced to that grain.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import MONEY_SUM, closed_cohort, days, elapsed, month_start, months, normalize_plan, ratio, week_start, with_scalars
from ..functions.asof import next_event
from ..functions.joins import keyed_join
from ..functions.percentile import PERCENTILE_DIGITS, attach, percentile_cont
from ..session import materialize

# Fixed values that must equal the reference's (event vocabulary and defaults).
START_TYPES = ("subscription_started", "trial_converted")
EXPANSION_TYPES = ("seat_add", "addon_attach")
PLAN_CHANGED = "plan_changed"
CANCELLED = "cancelled"
TRIAL_STARTED = "trial_started"
REFERENCE_AS_OF = dt.date(2026, 6, 15)
CONVERSION_DAYS = (14, 30, 60)


def _ts(d: dt.date | dt.datetime) -> F.Column:
    """A date parameter as a timestamp_ntz literal (midnight), like ``date 'x'``
    compared with a timestamp."""
    if not isinstance(d, dt.datetime):
        d = dt.datetime(d.year, d.month, d.day)
    return F.lit(d).cast("timestamp_ntz")


def _is_expansion(event_type: F.Column, delta: F.Column) -> F.Column:
    return event_type.isin(*EXPANSION_TYPES) | ((event_type == PLAN_CHANGED) & (delta > 0))


def _is_contraction(event_type: F.Column, delta: F.Column) -> F.Column:
    return (event_type == PLAN_CHANGED) & (delta < 0)


# --------------------------------------------------------------------- S1
def mrr_movements(
    sub_events: DataFrame,
    as_of: dt.date = REFERENCE_AS_OF,
    strict: bool = False,
) -> DataFrame:
    """Monthly MRR decomposition into new / expansion / contraction / churn /
    reactivation, net new MRR and a running ending MRR.

    A start event (``subscription_started`` / ``trial_converted``) is a
    reactivation when the account has any cancel strictly earlier. Instead of a
    correlated EXISTS, each account's first cancel time is aggregated once and
    compared: ``exists(cancel < t) <=> min(cancel time) < t``.

    ``strict=True`` adds ``unclassified_mrr`` (deltas in no bucket, e.g.
    ``plan_changed`` with a zero delta) and fills months without events from a
    month spine so ``ending_mrr`` carries over them.
    """
    ev = sub_events.select("account_id", "event_type", "mrr_delta", "event_time")
    etype, delta, t = F.col("event_type"), F.col("mrr_delta"), F.col("event_time")

    # a cancel after as_of can never precede a kept start: filter it at the scan
    first_cancel = (
        ev.where((etype == CANCELLED) & (t <= _ts(as_of))).groupBy("account_id").agg(F.min("event_time").alias("first_cancel_at"))
    )
    scoped = ev.where((etype != TRIAL_STARTED) & (t <= _ts(as_of)))

    starts = (
        keyed_join(scoped.where(etype.isin(*START_TYPES)), first_cancel, "account_id", "left")
        .select(
            month_start(t).alias("month"),
            delta,
            F.when(F.col("first_cancel_at") < t, F.lit("reactivation")).otherwise(F.lit("new")).alias("bucket"),
        )
    )
    others = scoped.where(~etype.isin(*START_TYPES)).select(
        month_start(t).alias("month"),
        delta,
        F.when(_is_expansion(etype, delta), F.lit("expansion"))
        .when(_is_contraction(etype, delta), F.lit("contraction"))
        .when(etype == CANCELLED, F.lit("churn"))
        .alias("bucket"),
    )
    classified = starts.unionByName(others)

    def bucket_sum(name):
        return F.sum(F.when(F.col("bucket") == name, delta)).cast(MONEY_SUM)

    monthly = classified.groupBy("month").agg(
        bucket_sum("new").alias("new_mrr"),
        bucket_sum("expansion").alias("expansion_mrr"),
        bucket_sum("contraction").alias("contraction_mrr"),
        bucket_sum("churn").alias("churn_mrr"),
        bucket_sum("reactivation").alias("reactivation_mrr"),
        F.sum(delta).cast(MONEY_SUM).alias("net_new_mrr"),
        F.sum(F.when(F.col("bucket").isNull(), delta)).cast(MONEY_SUM).alias("unclassified_mrr"),
    )
    if strict:
        # Month spine between the first and last month (bounded by the calendar,
        # not by the data volume).
        bounds = monthly.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
        spine = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month"))
        monthly = spine.join(monthly, "month", "left").withColumn("net_new_mrr", F.coalesce("net_new_mrr", F.lit(0).cast(MONEY_SUM)))
    # The running total runs over month-grain rows only (one row per month).
    running = Window.orderBy("month").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cols = ["month", "new_mrr", "expansion_mrr", "contraction_mrr", "churn_mrr", "reactivation_mrr", "net_new_mrr"]
    if strict:
        cols.append("unclassified_mrr")
    return monthly.select(*cols, F.sum("net_new_mrr").over(running).cast(MONEY_SUM).alias("ending_mrr")).orderBy("month")


# --------------------------------------------------------------------- S2
def trial_conversion(
    trials: DataFrame,
    sub_events: DataFrame,
    conversion_days: Sequence[int] = CONVERSION_DAYS,
    strict: bool = False,
    approx_percentiles: bool = False,
    closed_by: dt.date | None = None,
) -> DataFrame:
    """Trial-to-paid conversion by weekly trial cohort.

    A trial converts at the account's first ``trial_converted`` /
    ``subscription_started`` event ever, counted only when it is not before the
    trial start (the reference rule). ``strict=True`` instead takes the first
    conversion at or after each trial's start (an as-of join: no trial meets
    more than one conversion, however many an account has). ``closed_by`` leaves
    out cohorts whose longest conversion window is not over by that date.
    """
    conv_events = sub_events.where(F.col("event_type").isin(*START_TYPES) & F.col("event_time").isNotNull()).select(
        "account_id", "event_time"
    )
    tr = trials.select("trial_id", "account_id", "started_at")
    tr = tr.where(closed_cohort(week_start("started_at"), max(conversion_days), closed_by))
    if not strict:
        first_conv = conv_events.groupBy("account_id").agg(F.min("event_time").alias("first_conversion_at"))
        joined = keyed_join(tr, first_conv, "account_id", "left")
    else:
        joined = next_event(tr, conv_events, "account_id", "started_at", "event_time", "first_conversion_at")
    days_to_convert = F.when(
        F.col("first_conversion_at").isNotNull() & (F.col("first_conversion_at") >= F.col("started_at")),
        elapsed("first_conversion_at", "started_at", "day"),
    )
    calc = materialize(joined.select(week_start("started_at").alias("trial_week"), days_to_convert.alias("days_to_convert")))
    aggs = [F.count(F.lit(1)).alias("trials_started")]
    aggs += [F.count_if(F.col("days_to_convert") <= n).alias(f"converted_by_{n}d") for n in conversion_days]
    cohorts = calc.groupBy("trial_week").agg(*aggs)
    rates = [ratio(f"converted_by_{n}d", "trials_started").alias(f"conv_rate_{n}d") for n in conversion_days]
    med = percentile_cont(calc, ["trial_week"], "days_to_convert", {"median_days_trial_to_paid": 0.5}, digits=PERCENTILE_DIGITS, approx=approx_percentiles)
    return attach(cohorts.select("*", *rates), med, ["trial_week"]).orderBy("trial_week")


# --------------------------------------------------------------------- S3
def revenue_retention(
    sub_events: DataFrame,
    as_of: dt.date = REFERENCE_AS_OF,
    horizon_months: int = 12,
    strict: bool = False,
) -> DataFrame:
    """Gross and net revenue retention of monthly start cohorts.

    An account's cohort is the month of its first start event; its starting MRR
    is the delta of the start event(s) at that instant. Within
    ``(start, start + horizon]`` any cancel marks the account churned (its whole
    starting MRR is churn); otherwise expansion and contraction deltas in the
    window are added for NRR. Only cohorts whose horizon ends by ``as_of``.

    Reference rule kept by default: when ``n`` start events share the first
    instant, the account contributes ``n`` rows, so its expansion and
    contraction count ``n * n`` times. ``strict=True`` counts them once and also
    reports ``grr_net_contraction`` (kept MRR after contraction / starting).

    Plan: every read is keyed by ``account_id``. Starts are reduced to one row
    per account by aggregation (arg-min on a struct); the window facts come
    from one join of the relevant events with that row, reduced again by an
    aggregate; no self-join of raw events, no EXISTS.
    """
    ev = sub_events.select("account_id", "event_type", "mrr_delta", "event_time").where(
        F.col("account_id").isNotNull() & F.col("event_time").isNotNull()
    )
    horizon = months(horizon_months)

    # Only cohorts with start + horizon <= as_of are reported. A first start of
    # such an account lies before as_of - horizon (+3 days covers month-end
    # clamping), so later start events can neither be its minimum nor tie it:
    # filtering them at the scan keeps every reported value (the exact test
    # follows below).
    latest_start = _ts(as_of) - horizon + days(3)
    per_instant = (
        ev.where(F.col("event_type").isin(*START_TYPES) & (F.col("event_time") <= latest_start))
        .groupBy("account_id", "event_time")
        .agg(F.sum("mrr_delta").alias("start_mrr"), F.count(F.lit(1)).alias("n_starts"))
    )
    starts = (
        per_instant.groupBy("account_id")
        .agg(F.min(F.struct("event_time", "start_mrr", "n_starts")).alias("s"))
        .select(
            "account_id",
            F.col("s.event_time").alias("start_time"),
            F.col("s.start_mrr").alias("starting_mrr"),
            F.col("s.n_starts").alias("n_starts"),
        )
        .where(F.col("start_time") + horizon <= _ts(as_of))
    )
    starts = materialize(starts)  # read twice below, and joined without its aggregate's partitioning

    etype, delta, t = F.col("event_type"), F.col("mrr_delta"), F.col("event_time")
    in_window = (
        ev.where(etype.isin(CANCELLED, PLAN_CHANGED, *EXPANSION_TYPES) & (t <= _ts(as_of)))  # window ends by as_of
        .join(starts.select("account_id", "start_time"), "account_id")
        .where((t > F.col("start_time")) & (t <= F.col("start_time") + horizon))
        .groupBy("account_id")
        .agg(
            F.max(etype == CANCELLED).alias("churned"),
            F.sum(F.when(_is_expansion(etype, delta), delta)).alias("expansion"),
            F.sum(F.when(_is_contraction(etype, delta), delta)).alias("contraction"),
        )
    )
    acc = starts.join(in_window, "account_id", "left").select(
        month_start("start_time").alias("cohort_month"),
        "starting_mrr",
        F.coalesce("churned", F.lit(False)).alias("churned"),
        "n_starts",
        "expansion",
        "contraction",
    )
    fan = F.lit(1) if strict else F.col("n_starts") * F.col("n_starts")
    kept = ~F.col("churned")
    zero = F.lit(0).cast("decimal(18,2)")
    per_account = acc.select(
        "cohort_month",
        "starting_mrr",
        F.when(kept, F.col("starting_mrr")).otherwise(zero).alias("retained"),
        F.when(kept, F.coalesce("expansion", zero) * fan).otherwise(zero).alias("exp"),
        F.when(kept, F.coalesce("contraction", zero) * fan).otherwise(zero).alias("con"),
        F.when(~kept, -F.col("starting_mrr")).otherwise(zero).alias("churn"),
    )
    cohorts = per_account.groupBy("cohort_month").agg(
        F.sum("starting_mrr").cast(MONEY_SUM).alias("cohort_starting_mrr"),
        F.sum("retained").cast(MONEY_SUM).alias("retained_mrr_12m"),
        F.sum("exp").cast(MONEY_SUM).alias("expansion_mrr_12m"),
        F.sum("con").cast(MONEY_SUM).alias("contraction_mrr_12m"),
        F.sum("churn").cast(MONEY_SUM).alias("churn_mrr_12m"),
    )
    out = cohorts.select(
        "*",
        ratio("retained_mrr_12m", "cohort_starting_mrr").alias("grr"),
        ratio(F.col("retained_mrr_12m") + F.col("expansion_mrr_12m") + F.col("contraction_mrr_12m"), "cohort_starting_mrr").alias("nrr"),
    )
    if strict:
        out = out.withColumn("grr_net_contraction", ratio(F.col("retained_mrr_12m") + F.col("contraction_mrr_12m"), "cohort_starting_mrr"))
    return out.orderBy("cohort_month")


# --------------------------------------------------------------------- S4
def latest_subscription(subscriptions: DataFrame) -> DataFrame:
    """One subscription per account: latest ``start_date`` (NULL first, as a
    descending PostgreSQL sort), ties broken by the larger ``subscription_id``.

    An arg-max aggregate (map-side combinable), not a window per account.
    """
    key = F.struct(F.col("start_date").isNull(), F.col("start_date"), F.col("subscription_id"), F.col("cancelled_at"))
    return (
        subscriptions.groupBy("account_id")
        .agg(F.max(key).alias("s"))
        .select("account_id", F.col("s.subscription_id").alias("subscription_id"), F.col("s.cancelled_at").alias("cancelled_at"))
    )


def feature_adoption(
    accounts: DataFrame,
    subscriptions: DataFrame,
    usage: DataFrame,
    features: DataFrame,
    as_of: dt.date = REFERENCE_AS_OF,
    retain_days: int = 90,
    adopt_days: int = 14,
    min_uses: int = 1,
    strict: bool = False,
) -> DataFrame:
    """Retention of feature adopters against non-adopters, per feature name.

    Eligible accounts signed up at least ``retain_days`` before ``as_of``; an
    account is retained unless its latest subscription was cancelled within
    ``retain_days`` of signup (no subscription counts as retained). It adopted
    a feature with at least ``min_uses`` uses up to ``adopt_days`` after signup.

    The reference compares every feature with every account (a cross join) and
    averages the retained flag on both sides. Here only adopter pairs are
    materialised; the non-adopter side follows from per-name totals:
    with ``k`` feature rows of a name, ``N`` eligible accounts and ``R``
    retained ones, the non-adopter rows are ``k N - pairs`` with
    ``k R - retained pairs`` retained, and an account is a non-adopter unless it
    adopted all ``k`` features of the name.

    ``strict=True``: usage must also be at or after signup, accounts without a
    subscription are dropped, and results are per feature id (``feature_id``
    column added).
    """
    cutoff = dt.datetime(as_of.year, as_of.month, as_of.day) - dt.timedelta(days=retain_days)
    eligible = accounts.where(F.col("signup_date") <= _ts(cutoff)).select("account_id", "signup_date")
    latest = latest_subscription(subscriptions)
    how = "inner" if strict else "left"
    kept = F.col("cancelled_at").isNull() | (F.col("cancelled_at") > F.col("signup_date") + days(retain_days))
    # reduced and written once: read for the adopters and for the totals
    retention = materialize(
        eligible.join(latest, "account_id", how).select("account_id", "signup_date", F.when(kept, 1).otherwise(0).alias("retained"))
    )

    # Eligible accounts signed up by the cutoff, so no use after cutoff +
    # adopt_days can count: that bound is applied at the usage scan.
    last_use = _ts(cutoff + dt.timedelta(days=adopt_days))
    used = usage.where(F.col("feature_id").isNotNull() & (F.col("occurred_at") <= last_use)).select(
        "account_id", "feature_id", "occurred_at"
    )
    if min_uses <= 1 and not strict:
        # One use inside the window <=> the first use is inside it: reduce the
        # usage to one row per (account, feature) before it meets the accounts.
        # An account then has at most one row per feature, so this join has no
        # hot key and needs no salt.
        first_use = used.groupBy("account_id", "feature_id").agg(F.min("occurred_at").alias("occurred_at"))
        adopters = (
            first_use.join(retention, "account_id", "inner")
            .where(F.col("occurred_at") <= F.col("signup_date") + days(adopt_days))
            .select("account_id", "feature_id", "retained")
        )
    else:
        window_ok = F.col("occurred_at") <= F.col("signup_date") + days(adopt_days)
        if strict:
            window_ok = window_ok & (F.col("occurred_at") >= F.col("signup_date"))
        adopters = (
            keyed_join(used, retention, "account_id")
            .where(window_ok)
            .groupBy("account_id", "feature_id")
            .agg(F.count(F.lit(1)).alias("usage_count"), F.max("retained").alias("retained"))
            .where(F.col("usage_count") >= min_uses)
            .select("account_id", "feature_id", "retained")
        )

    group_col = "feature_id" if strict else "feature_name"
    feats = features.select("feature_id", "feature_name")
    per_group_rows = materialize(feats.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("k"), *([F.min("feature_name").alias("feature_name")] if strict else [])
    ))
    pairs = adopters.join(feats, "feature_id", "inner")
    per_account = pairs.groupBy(group_col, "account_id").agg(
        F.count(F.lit(1)).alias("nf"), F.max("retained").alias("retained")
    )
    # null-safe: features without a name are a group of their own
    adopted = (
        attach(per_account, per_group_rows.select(group_col, "k"), [group_col], "inner")
        .groupBy(group_col)
        .agg(
            F.sum("nf").alias("pairs"),
            F.sum(F.col("nf") * F.col("retained")).alias("pairs_retained"),
            F.count(F.lit(1)).alias("accounts_adopted"),
            F.count_if(F.col("nf") == F.col("k")).alias("adopted_all"),
        )
    )
    # One-row totals attached as a scalar subquery (no join); without eligible
    # accounts the reference's cross join yields no rows, and so does this.
    totals = retention.agg(F.count(F.lit(1)).alias("n_accounts"), F.sum("retained").alias("n_retained")).where(
        F.col("n_accounts") > 0
    )
    base = attach(per_group_rows, adopted, [group_col]).select(
        *per_group_rows.columns,
        F.coalesce("pairs", F.lit(0)).alias("pairs"),
        F.coalesce("pairs_retained", F.lit(0)).alias("pairs_retained"),
        F.coalesce("accounts_adopted", F.lit(0)).alias("accounts_adopted"),
        F.coalesce("adopted_all", F.lit(0)).alias("adopted_all"),
    )
    joined = with_scalars(base, totals).where(F.col("n_accounts").isNotNull())
    rest_rows = F.col("k") * F.col("n_accounts") - F.col("pairs")
    rest_ret = F.col("k") * F.col("n_retained") - F.col("pairs_retained")
    rate_adopted = ratio("pairs_retained", "pairs")
    rate_not = ratio(rest_ret, rest_rows)
    cols = [
        F.col("feature_name"),
        F.col("accounts_adopted").cast("bigint").alias("accounts_adopted"),
        (F.col("n_accounts") - F.col("adopted_all")).cast("bigint").alias("accounts_not_adopted"),
        rate_adopted.alias("retention_rate_adopted"),
        rate_not.alias("retention_rate_not_adopted"),
        (rate_adopted - rate_not).alias("retention_lift_pp"),
        ratio(rate_adopted - rate_not, rate_not).alias("retention_lift_pct"),
    ]
    if strict:
        cols.insert(0, F.col("feature_id"))
    return joined.select(*cols).orderBy(F.col("retention_lift_pp").desc_nulls_first())


# --------------------------------------------------------------------- S5
def expansion_revenue(
    sub_events: DataFrame,
    accounts: DataFrame,
    as_of: dt.date = REFERENCE_AS_OF,
    lookback_months: int = 6,
    approx_percentiles: bool = False,
) -> DataFrame:
    """Expansion by vector (seats added, add-on, plan upgrade) in the closed
    window ``[as_of - lookback, as_of]``, with per-account value and the median
    days from account signup to the expansion event."""
    etype, delta, t = F.col("event_type"), F.col("mrr_delta"), F.col("event_time")
    lo = _ts(as_of) - months(lookback_months)
    ee = sub_events.where(_is_expansion(etype, delta) & (t >= lo) & (t <= _ts(as_of))).select(
        "account_id",
        "mrr_delta",
        "event_time",
        F.when(etype == "seat_add", F.lit("seats_added"))
        .when(etype == "addon_attach", F.lit("addon"))
        .when((etype == PLAN_CHANGED) & (delta > 0), F.lit("plan_upgrade"))
        .alias("expansion_type"),
    )
    # read twice below (totals, percentile): filter and join run once
    j = materialize(
        ee.join(accounts.select("account_id", "signup_date"), "account_id", "inner").select(
            "expansion_type", "account_id", "mrr_delta", elapsed("event_time", "signup_date", "day").alias("days_from_signup")
        )
    )
    by_type = j.groupBy("expansion_type").agg(
        F.count(F.lit(1)).alias("expansion_events"),
        F.count_distinct("account_id").alias("accounts_expanded"),
        F.sum("mrr_delta").cast(MONEY_SUM).alias("expansion_mrr_total"),
    )
    med = percentile_cont(j, ["expansion_type"], "days_from_signup", {"median_days_from_signup_to_expansion": 0.5}, digits=PERCENTILE_DIGITS, approx=approx_percentiles)
    return attach(
        by_type.select("*", ratio("expansion_mrr_total", "accounts_expanded").alias("expansion_mrr_per_account")), med, ["expansion_type"]
    ).orderBy(F.col("expansion_mrr_total").desc_nulls_first())


# ------------------------------------------------------- sample queries
def active_paying_accounts(subscriptions: DataFrame) -> DataFrame:
    """Distinct accounts with an active subscription (status case-folded)."""
    return subscriptions.where(F.lower("status") == "active").agg(F.count_distinct("account_id").alias("active_paying_accounts"))


def plan_breakdown(subscriptions: DataFrame) -> DataFrame:
    """Subscriptions per normalised plan tier."""
    return (
        subscriptions.groupBy(normalize_plan("plan").alias("plan_normalized"))
        .agg(F.count(F.lit(1)).alias("subscriptions"))
        .orderBy(F.col("subscriptions").desc())
    )


def first_events(sub_events: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` earliest subscription events (a top-k report; ties broken by
    ``event_id`` so the result is deterministic). Planned as a
    TakeOrderedAndProject: each task keeps its own top ``n``."""
    return sub_events.select("event_id", "account_id", "event_type", "from_plan", "to_plan", "mrr_delta", "event_time").orderBy(
        F.col("event_time").asc_nulls_last(), F.col("event_id").asc_nulls_last()
    ).limit(n)
