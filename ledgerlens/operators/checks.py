"""Reconciliation and invariant jobs (R1-R12 in README).

They read operator outputs (cohort-, channel-, bucket- or month-grain, so
small) and, where an invariant needs it, one aggregate of a base table. Each
returns a one-row (or few-row) DataFrame of counts; a healthy run has zero
violations.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import MONEY_SUM, month_start, months, with_scalars
from .saas import REFERENCE_AS_OF, _ts


def _one_row_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Attach the one-row aggregate ``right`` to ``left`` (scalar subquery)."""
    return with_scalars(left, right)


# R1
def check_activation(activation: DataFrame) -> DataFrame:
    return activation.agg(
        F.count(F.lit(1)).alias("cohorts"), F.count_if(F.col("activated_7d") > F.col("cohort_size")).alias("violations")
    )


# R2
def check_funnel(funnel: DataFrame, steps: Sequence[str] = ("begin_checkout", "address", "shipping", "payment", "purchased")) -> DataFrame:
    bad = None
    for a, b in zip(steps[:-1], steps[1:]):
        c = F.col(a) < F.col(b)
        bad = c if bad is None else bad | c
    return funnel.agg(F.count(F.lit(1)).alias("channels"), F.count_if(bad).alias("violations"))


# R3
def check_retention_gap(retention: DataFrame) -> DataFrame:
    return retention.agg(
        F.sum("cohort_size").cast("bigint").alias("cohort_size"),
        F.sum("w0_active").cast("bigint").alias("w0_active"),
        (F.sum("cohort_size") - F.sum("w0_active")).cast("bigint").alias("gap"),
    )


# R4
def check_engagement(engagement: DataFrame) -> DataFrame:
    return engagement.agg(
        F.count(F.lit(1)).alias("products"),
        F.count_if(F.col("add_to_cart_sessions") > F.col("views")).alias("carts_exceed_views"),
        F.count_if((F.col("atc_rate") < 0) | (F.col("atc_rate") > 1)).alias("rate_out_of_range"),
    )


# R5
def check_cart_total(abandonment: DataFrame, events: DataFrame) -> DataFrame:
    buckets = abandonment.agg(F.sum("atc_sessions").cast("bigint").alias("bucket_sessions"))
    flat = events.where(F.col("event_type") == "add_to_cart").agg(F.count_distinct("session_id").alias("unsegmented_sessions"))
    return _one_row_join(buckets, flat).withColumn("difference", F.col("bucket_sessions") - F.col("unsegmented_sessions"))


# R6
def mrr_reconciliation(movements: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Ending MRR of the last month (event sum) against the snapshot MRR of
    active subscriptions, then active + paused + past_due."""
    ending = movements.agg(F.max_by("ending_mrr", "month").cast(MONEY_SUM).alias("event_sum_ending_mrr"))
    status = F.lower("status")
    snap = subscriptions.agg(
        F.sum(F.when(status == "active", F.col("mrr"))).cast(MONEY_SUM).alias("snapshot_active_mrr"),
        F.sum(F.when(status.isin("active", "paused", "past_due"), F.col("mrr"))).cast(MONEY_SUM).alias("snapshot_open_mrr"),
    )
    j = _one_row_join(ending, snap)
    return j.select(
        "*",
        (F.col("event_sum_ending_mrr") - F.col("snapshot_active_mrr")).cast(MONEY_SUM).alias("gap_active"),
        (F.col("event_sum_ending_mrr") - F.col("snapshot_open_mrr")).cast(MONEY_SUM).alias("gap_open"),
    )


# R7
def duplicate_starts(sub_events: DataFrame, start_types: Sequence[str] = ("subscription_started", "trial_converted")) -> DataFrame:
    """Subscriptions with more than one start event."""
    return (
        sub_events.where(F.col("event_type").isin(*start_types))
        .groupBy("subscription_id")
        .agg(F.count(F.lit(1)).alias("start_events"))
        .where(F.col("start_events") > 1)
    )


# R8
def check_trials(conversion: DataFrame, days: Sequence[int] = (14, 30, 60)) -> DataFrame:
    bad = None
    for a, b in zip(days[:-1], days[1:]):
        c = F.col(f"converted_by_{a}d") > F.col(f"converted_by_{b}d")
        bad = c if bad is None else bad | c
    first = f"converted_by_{days[0]}d"
    return conversion.agg(
        F.count(F.lit(1)).alias("cohorts"),
        F.count_if(bad).alias("nesting_violations"),
        F.sum("trials_started").cast("bigint").alias("trials_started"),
        F.sum(first).cast("bigint").alias(first),
    ).withColumn(f"overall_conv_rate_{days[0]}d", F.col(first).cast("double") / F.when(F.col("trials_started") != 0, F.col("trials_started").cast("double")))


# R9
def check_retention_identity(retention: DataFrame) -> DataFrame:
    identity = F.col("retained_mrr_12m") + F.col("churn_mrr_12m") == F.col("cohort_starting_mrr")
    return retention.agg(
        F.count(F.lit(1)).alias("cohorts"),
        F.count_if(~identity).alias("identity_violations"),
        F.count_if(F.col("grr") > 1).alias("grr_above_one"),
        F.count_if(F.col("nrr") > 1).alias("nrr_above_one"),
    )


# R10
def check_adoption(adoption: DataFrame, accounts: DataFrame, as_of: dt.date = REFERENCE_AS_OF, retain_days: int = 90) -> DataFrame:
    cutoff = dt.datetime(as_of.year, as_of.month, as_of.day) - dt.timedelta(days=retain_days)
    eligible = accounts.where(F.col("signup_date") <= _ts(cutoff)).agg(F.count(F.lit(1)).alias("eligible_accounts"))
    j = _one_row_join(adoption, eligible)
    return j.groupBy("eligible_accounts").agg(
        F.count(F.lit(1)).alias("features"),
        F.count_if(F.col("accounts_adopted") + F.col("accounts_not_adopted") != F.col("eligible_accounts")).alias("split_violations"),
    )


# R11
def assert_grain(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows against distinct keys; ``fanout`` > 0 means the frame is not at
    the grain of ``keys`` (a join multiplied rows)."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(*keys).alias("distinct_keys")).select(
        F.lit(name).alias("frame"), "rows", "distinct_keys", (F.col("rows") - F.col("distinct_keys")).alias("fanout")
    )


def check_fanout(accounts: DataFrame, subscriptions: DataFrame, as_of: dt.date = REFERENCE_AS_OF, retain_days: int = 90) -> DataFrame:
    """The feature-adoption subscription join, before and after keeping one
    subscription per account."""
    from .saas import latest_subscription

    cutoff = dt.datetime(as_of.year, as_of.month, as_of.day) - dt.timedelta(days=retain_days)
    eligible = accounts.where(F.col("signup_date") <= _ts(cutoff)).select("account_id")
    fanned = eligible.join(subscriptions.select("account_id", "subscription_id"), "account_id", "left")
    deduped = eligible.join(latest_subscription(subscriptions), "account_id", "left")
    return assert_grain(fanned, ["account_id"], "eligible_x_subscriptions").unionByName(
        assert_grain(deduped, ["account_id"], "eligible_x_latest_subscription")
    )


# R12
def expansion_reconciliation(
    expansion: DataFrame, movements: DataFrame, as_of: dt.date = REFERENCE_AS_OF, lookback_months: int = 6
) -> DataFrame:
    """Rolling-window expansion (S5) against calendar-month expansion (S1)
    over the months the rolling window touches."""
    rolling = expansion.agg(F.sum("expansion_mrr_total").cast(MONEY_SUM).alias("rolling_expansion_mrr"))
    first_month = month_start(_ts(as_of) - months(lookback_months))
    calendar = movements.where(F.col("month") >= first_month).agg(F.sum("expansion_mrr").cast(MONEY_SUM).alias("calendar_expansion_mrr"))
    return _one_row_join(rolling, calendar).withColumn(
        "difference", (F.col("calendar_expansion_mrr") - F.col("rolling_expansion_mrr")).cast(MONEY_SUM)
    )
