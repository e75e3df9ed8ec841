"""Data-quality jobs over the ``saas`` tables (rules D1-D15 in README).

Each job is one or two aggregates over the tables it checks. Membership tests
("does this key exist in the parent?") first reduce the child to one row per
key with its counts, so a hot key is one row, and then join the parent's
distinct keys with a marker column.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import MONEY, MONEY_SUM, elapsed, normalize_plan, ratio
from ..sources.tables import to_utc_ntz
from .saas import REFERENCE_AS_OF, _ts

NO_REASON = "no reason given"
UNATTRIBUTED = "unattributed"


def _with_marker(child: DataFrame, parent_keys: DataFrame, child_key: str, parent_key: str, marker: str) -> DataFrame:
    """``child`` plus a boolean ``marker``: its key exists among ``parent_keys``
    (a left join to the parent's distinct keys)."""
    keys = (
        parent_keys.select(F.col(parent_key).alias(child_key)).where(F.col(child_key).isNotNull()).distinct().withColumn(marker, F.lit(True))
    )
    return child.join(keys, child_key, "left").withColumn(marker, F.coalesce(F.col(marker), F.lit(False)))


# D1
def subscription_grain(subscriptions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rows per account type with user-grain (user set) vs account-grain (user
    NULL) counts and the seat-count range."""
    j = subscriptions.join(accounts.select("account_id", "account_type"), "account_id", "left")
    return j.groupBy(F.coalesce("account_type", F.lit("unknown")).alias("account_type")).agg(
        F.count(F.lit(1)).alias("subscriptions"),
        F.count_if(F.col("user_id").isNotNull()).alias("user_grain_rows"),
        F.count_if(F.col("user_id").isNull()).alias("account_grain_rows"),
        F.min("seat_count").alias("min_seats"),
        F.max("seat_count").alias("max_seats"),
    )


# D2
def mrr_price_check(subscriptions: DataFrame, plans: DataFrame, accounts: DataFrame) -> DataFrame:
    """Snapshot MRR against list price x seats, per account type. The plan is
    resolved as in ``plan_id_backfill``, so rows with a NULL ``plan_id`` are
    priced, and each subscription counts once."""
    priced = (
        _with_plan(subscriptions, plans)
        .join(accounts.select("account_id", "account_type"), "account_id", "left")
        .withColumn("_list", (F.col("_price") * F.col("seat_count")).cast(MONEY))
    )
    match = F.col("mrr") == F.col("_list")
    return priced.groupBy(F.coalesce("account_type", F.lit("unknown")).alias("account_type")).agg(
        F.count(F.lit(1)).alias("subscriptions"),
        F.count_if(F.col("_list").isNotNull()).alias("priced"),
        F.count_if(match).alias("price_match"),
        F.count_if(~match).alias("price_mismatch"),
        F.sum(F.when(~match, F.col("mrr") - F.col("_list"))).cast(MONEY_SUM).alias("mismatch_mrr_gap"),
    )


# D3
def status_counts(subscriptions: DataFrame) -> DataFrame:
    """Subscriptions per status and the table total (to confirm no status is
    missed). The total is a window over the few status rows."""
    per = subscriptions.groupBy("status").agg(F.count(F.lit(1)).alias("subscriptions"))
    return per.select("status", "subscriptions", F.sum("subscriptions").over(Window.partitionBy()).alias("total_subscriptions"))


# D4
def trial_state(trials: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Consistency of trial conversion fields: converted iff ``converted_at``
    is set, and the converted subscription id resolves."""
    key = "converted_subscription_id"
    conv, sid = F.col("converted_at").isNotNull(), F.col(key).isNotNull()
    # one row per id; all trials without one are a single row
    per = trials.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), F.count_if(conv).alias("_conv"))
    t = _with_marker(per, subscriptions, key, "subscription_id", "_resolves")

    def total(rows, when=None):
        picked = F.col(rows) if when is None else F.when(when, F.col(rows))
        return F.coalesce(F.sum(picked), F.lit(0)).cast("bigint")

    return t.withColumn("_open", F.col("_rows") - F.col("_conv")).agg(
        total("_rows").alias("trials"),
        total("_conv").alias("converted"),
        total("_conv", ~sid).alias("converted_without_subscription"),
        total("_open", sid).alias("subscription_without_conversion"),
        total("_rows", sid & F.col("_resolves")).alias("subscription_resolves"),
        total("_rows", sid & ~F.col("_resolves")).alias("subscription_unresolved"),
    )


# D7
def _with_plan(subscriptions: DataFrame, plans: DataFrame) -> DataFrame:
    """``subscriptions`` plus ``_pid`` and ``_price`` of its plan: the one with its
    ``plan_id`` or, where that is NULL, the one its normalised text names.

    A name stands for several plans (one per billing interval): the monthly one
    goes first, then the smallest id. Either side of each join has one row per
    key, so subscriptions keep their grain.
    """
    best = F.min(F.struct(F.col("billing_interval") != "monthly", "plan_id", "monthly_price"))
    by_name = plans.groupBy(normalize_plan("plan_name").alias("_plan")).agg(best.alias("_n"))
    by_id = plans.groupBy(F.col("plan_id").alias("_id")).agg(F.min("monthly_price").alias("_own"))
    text = F.when(F.col("plan_id").isNull(), normalize_plan("plan"))
    j = subscriptions.withColumn("_text", text).join(by_name, F.col("_text") == F.col("_plan"), "left").join(by_id, F.col("plan_id") == F.col("_id"), "left")
    return j.select(
        *subscriptions.columns,
        F.coalesce(F.col("plan_id"), F.col("_n.plan_id")).alias("_pid"),
        F.coalesce("_own", F.col("_n.monthly_price")).alias("_price"),
    )


def plan_id_backfill(subscriptions: DataFrame, plans: DataFrame) -> DataFrame:
    """Subscriptions with ``plan_id`` filled from the normalised plan text when
    NULL (see ``_with_plan`` for names of several plans); ``backfilled`` marks
    the repaired rows."""
    return _with_plan(subscriptions, plans).select(
        "subscription_id",
        "plan",
        "plan_id",
        F.col("_pid").alias("resolved_plan_id"),
        (F.col("plan_id").isNull() & F.col("_pid").isNotNull()).cast("int").alias("backfilled"),
    )


# D8
def future_dated_events(sub_events: DataFrame, as_of: dt.date = REFERENCE_AS_OF) -> DataFrame:
    """How many subscription events lie after the cut-off."""
    future = F.col("event_time") > _ts(as_of)
    return sub_events.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(future).alias("future_dated_events"),
        F.count_if(F.col("event_time") <= _ts(as_of)).alias("kept_events"),
    )


# D9
def cancellation_reasons(subscriptions: DataFrame) -> DataFrame:
    """Churned subscriptions per reason; a NULL reason is its own bucket."""
    return (
        subscriptions.where(F.col("status") == "churned")
        .groupBy(F.coalesce("cancellation_reason", F.lit(NO_REASON)).alias("cancellation_reason"))
        .agg(F.count(F.lit(1)).alias("subscriptions"))
    )


# D10
def attribute_events(telemetry: DataFrame, users: DataFrame) -> DataFrame:
    """Telemetry rows with ``attribution``: ``attributed`` when the user exists,
    else ``unattributed``; ``account_id`` is kept either way."""
    t = _with_marker(telemetry, users, "user_id", "user_id", "_known")
    return t.withColumn("attribution", F.when(F.col("_known"), F.lit("attributed")).otherwise(F.lit(UNATTRIBUTED))).drop("_known")


def unattributed_events(telemetry: DataFrame, users: DataFrame) -> DataFrame:
    """Event and account counts per attribution label."""
    per = telemetry.groupBy("user_id", "account_id").agg(F.count(F.lit(1)).alias("_rows"))
    return (
        attribute_events(per, users)
        .groupBy("attribution")
        .agg(F.sum("_rows").alias("events"), F.count_distinct("account_id").alias("accounts"))
    )


# D11
def subs_per_account(accounts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Histogram: how many accounts have 0, 1, 2, ... subscriptions."""
    per = subscriptions.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))
    j = accounts.select("account_id").join(per, "account_id", "left")
    return j.groupBy(F.coalesce("n", F.lit(0)).alias("n_subscriptions")).agg(F.count(F.lit(1)).alias("accounts"))


# D12
def soft_fk_check(pairs: Sequence[tuple[str, DataFrame, str, str, DataFrame, str]]) -> DataFrame:
    """Orphan rows per soft foreign key.

    ``pairs`` holds ``(parent_name, parent_df, parent_key, child_name,
    child_df, child_key)``; the output has one row per pair with the number of
    child rows carrying a key and how many of those have no parent.
    """
    parts = []
    for parent_name, parent, pkey, child_name, child, ckey in pairs:
        # one row per child key with its row count, so a hot key costs nothing
        c = child.select(F.col(ckey).alias("_ck")).where(F.col("_ck").isNotNull()).groupBy("_ck").agg(F.count(F.lit(1)).alias("_rows"))
        m = _with_marker(c, parent, "_ck", pkey, "_found")
        parts.append(
            m.agg(
                F.coalesce(F.sum("_rows"), F.lit(0)).cast("bigint").alias("child_rows"),
                F.coalesce(F.sum(F.when(~F.col("_found"), F.col("_rows"))), F.lit(0)).cast("bigint").alias("orphan_rows"),
            ).select(
                F.lit(parent_name).alias("parent"),
                F.lit(child_name).alias("child"),
                F.lit(ckey).alias("key_column"),
                "child_rows",
                "orphan_rows",
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# D13
def feature_id_coverage(telemetry: DataFrame, features: DataFrame) -> DataFrame:
    """Share of telemetry rows with a ``feature_id``; rows without one are
    recoverable when the feature name in ``properties`` names a feature."""
    has_id = F.col("feature_id").isNotNull()
    # the name matters only where the id is missing; one row per case and name
    name = F.when(~has_id, F.get_json_object("properties", "$.feature"))
    per = telemetry.groupBy(has_id.alias("_has"), name.alias("_name")).agg(F.count(F.lit(1)).alias("_rows"))
    m = _with_marker(per, features, "_name", "feature_name", "_known")

    def total(when):
        return F.coalesce(F.sum(F.when(when, F.col("_rows"))), F.lit(0)).cast("bigint")

    has, known = F.col("_has"), F.col("_known")
    return m.agg(
        total(F.lit(True)).alias("events"),
        total(has).alias("with_feature_id"),
        total(~has).alias("without_feature_id"),
        total(~has & known).alias("recoverable_from_properties"),
        total(~has & ~known).alias("unrecoverable"),
        ratio(total(has), total(F.lit(True))).alias("feature_id_share"),
    )


# D5
def signup_lag(accounts: DataFrame, sub_events: DataFrame, naive_zone: str = "UTC") -> DataFrame:
    """Per account type, how long after signup the first subscription event came.

    ``accounts.signup_date`` may be zoned and ``sub_events.event_time`` naive wall
    clock of ``naive_zone``: both are put on UTC wall clock before they are
    bucketed or subtracted, so the result does not depend on the session's zone.
    """
    a = to_utc_ntz(accounts.select("account_id", "account_type", "signup_date"), naive_zone)
    first = to_utc_ntz(sub_events.select("account_id", "event_time"), naive_zone).groupBy("account_id").agg(F.min("event_time").alias("first_at"))
    hours = elapsed("first_at", "signup_date", "hour")
    return a.join(first, "account_id").groupBy("account_type").agg(
        F.count(F.lit(1)).alias("accounts"),
        F.count_if(F.to_date("first_at") == F.to_date("signup_date")).alias("same_utc_day"),
        F.count_if(hours < 0).alias("event_before_signup"),
        F.round(F.min(hours), 6).alias("min_hours"),
        F.round(F.max(hours), 6).alias("max_hours"),
    )


# D14
def flag_domain(users: DataFrame, flag: str = "is_active", domain: Sequence[int] = (0, 1)) -> DataFrame:
    """Value counts of an integer flag with an in-domain marker."""
    return (
        users.groupBy(F.col(flag).alias("value"))
        .agg(F.count(F.lit(1)).alias("users"))
        .select("value", "users", F.coalesce(F.col("value").isin(*domain), F.lit(False)).cast("int").alias("in_domain"))
    )


# D15
def signups(users: DataFrame, accounts: DataFrame) -> DataFrame:
    """The ``signups`` helper view: users with their account's signup date and
    acquisition channel as signup source (definition inferred; unpublished)."""
    return users.select("user_id", "account_id").join(
        accounts.select("account_id", "signup_date", F.col("acquisition_channel").alias("signup_source")), "account_id", "inner"
    ).select("user_id", "account_id", "signup_date", "signup_source")
