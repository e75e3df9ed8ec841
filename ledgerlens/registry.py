"""Registry keys -> (spark, sf_dir) -> DataFrame, over the role views.

Parameters come from the role mapping (``sources.roles``): the driver data
lives in other years than the reference's, so ``since`` and ``as_of`` move
with it; every other parameter keeps the reference default.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import checks, ecom, quality, saas
from .session import tune
from .sources.roles import ECOM_SINCE, SAAS_AS_OF, Roles
from .sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]
# date up to which the role data counts as seen, for the keys that report closed cohorts only
ECOM_CLOSED_BY = dt.date(2024, 1, 24)


def roles(spark: SparkSession, sf_dir: str) -> Roles:
    return Roles(Tables(tune(spark), sf_dir))


def _e1(strict, closed_by=None):
    return lambda s, d: (
        lambda r: ecom.activation_curve(r.customers, r.sessions, r.session_events, since=ECOM_SINCE, strict=strict, closed_by=closed_by)
    )(roles(s, d))


def _e3(strict):
    return lambda s, d: (lambda r: ecom.cohort_retention(r.customers, r.sessions, r.session_events, since=ECOM_SINCE, strict=strict))(roles(s, d))


def _e5(strict):
    return lambda s, d: ecom.cart_abandonment(roles(s, d).session_events, strict=strict)


def _s1(strict):
    return lambda s, d: saas.mrr_movements(roles(s, d).subscription_events, as_of=SAAS_AS_OF, strict=strict)


def _s2(strict, closed_by=None):
    return lambda s, d: (lambda r: saas.trial_conversion(r.trials, r.subscription_events, strict=strict, closed_by=closed_by))(roles(s, d))


def _s3(strict):
    return lambda s, d: saas.revenue_retention(roles(s, d).subscription_events, as_of=SAAS_AS_OF, strict=strict)


def _s4(strict):
    return lambda s, d: (
        lambda r: saas.feature_adoption(r.accounts, r.subscriptions, r.feature_events, r.features, as_of=SAAS_AS_OF, strict=strict)
    )(roles(s, d))


QUERIES: dict[str, Query] = {
    "activation_curve": _e1(False),
    "checkout_funnel": lambda s, d: (lambda r: ecom.checkout_funnel(r.sessions, r.session_channels, r.session_events))(roles(s, d)),
    "cohort_retention": _e3(False),
    "product_engagement": lambda s, d: (
        lambda r: ecom.product_engagement(r.session_events, r.product_variants, r.products, r.categories)
    )(roles(s, d)),
    "cart_abandonment": _e5(False),
    "mrr_movements": _s1(False),
    "trial_conversion": _s2(False),
    "revenue_retention": _s3(False),
    "feature_adoption": _s4(False),
    "expansion_revenue": lambda s, d: (
        lambda r: saas.expansion_revenue(r.subscription_events, r.accounts, as_of=SAAS_AS_OF)
    )(roles(s, d)),
    "active_paying_accounts": lambda s, d: saas.active_paying_accounts(roles(s, d).subscriptions),
    "plan_breakdown": lambda s, d: saas.plan_breakdown(roles(s, d).subscriptions),
    "first_events": lambda s, d: saas.first_events(roles(s, d).subscription_events),
    # strict readings of rules that look unintended (README, "Quirks")
    "activation_curve_strict": _e1(True),
    "cohort_retention_strict": _e3(True),
    "cart_abandonment_strict": _e5(True),
    "mrr_movements_strict": _s1(True),
    "trial_conversion_strict": _s2(True),
    "revenue_retention_strict": _s3(True),
    "feature_adoption_strict": _s4(True),
    # closed cohorts only: every member has been seen for the whole horizon
    "activation_curve_closed": _e1(False, ECOM_CLOSED_BY),
    "trial_conversion_closed": _s2(False, SAAS_AS_OF),
}


# ----------------------------------------------------------- data quality
def _soft_fk_pairs(r: Roles):
    """The soft foreign keys of the schema notes that exist in the role data
    (tables without data - seats, invoices, payment attempts, tickets,
    experiments - are not listed)."""
    return [
        ("accounts", r.accounts, "account_id", "users", r.users, "account_id"),
        ("accounts", r.accounts, "account_id", "subscriptions", r.subscriptions, "account_id"),
        ("accounts", r.accounts, "account_id", "subscription_events", r.subscription_events, "account_id"),
        ("accounts", r.accounts, "account_id", "trials", r.trials, "account_id"),
        ("accounts", r.accounts, "account_id", "events", r.telemetry, "account_id"),
        ("subscriptions", r.subscriptions, "subscription_id", "subscription_events", r.subscription_events, "subscription_id"),
        ("plans", r.plans, "plan_id", "subscriptions", r.subscriptions, "plan_id"),
        ("users", r.users, "user_id", "events", r.telemetry, "user_id"),
        ("features", r.features, "feature_id", "events", r.telemetry, "feature_id"),
        ("subscriptions", r.subscriptions, "subscription_id", "trials", r.trials, "converted_subscription_id"),
    ]


def _signup_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as zoned instants (written down at +02:00), events as naive wall clock of India."""
    r = roles(spark, sf_dir)
    zoned = F.to_timestamp(F.concat(F.col("signup_date").cast("string"), F.lit("+02:00")))
    return quality.signup_lag(r.accounts.withColumn("signup_date", zoned), r.subscription_events, naive_zone="Asia/Kolkata")


def _r(fn):
    return lambda s, d: fn(roles(s, d))


QUERIES.update(
    {
        "subscription_grain": _r(lambda r: quality.subscription_grain(r.subscriptions, r.accounts)),
        "mrr_price_check": _r(lambda r: quality.mrr_price_check(r.subscriptions, r.plans, r.accounts)),
        "status_counts": _r(lambda r: quality.status_counts(r.subscriptions)),
        "trial_state": _r(lambda r: quality.trial_state(r.trials, r.subscriptions)),
        "plan_id_backfill": _r(lambda r: quality.plan_id_backfill(r.subscriptions, r.plans)),
        "signup_lag": _signup_lag,
        "future_dated_events": _r(lambda r: quality.future_dated_events(r.subscription_events, as_of=SAAS_AS_OF)),
        "cancellation_reasons": _r(lambda r: quality.cancellation_reasons(r.subscriptions)),
        "unattributed_events": _r(lambda r: quality.unattributed_events(r.telemetry, r.users)),
        "subs_per_account": _r(lambda r: quality.subs_per_account(r.accounts, r.subscriptions)),
        "soft_fk_check": _r(lambda r: quality.soft_fk_check(_soft_fk_pairs(r))),
        "feature_id_coverage": _r(lambda r: quality.feature_id_coverage(r.telemetry, r.features)),
        "flag_domain": _r(lambda r: quality.flag_domain(r.users)),
        "signups": _r(lambda r: quality.signups(r.users, r.accounts)),
    }
)


# ----------------------------------------------------------- reconciliation
QUERIES.update(
    {
        "check_activation": lambda s, d: checks.check_activation(QUERIES["activation_curve"](s, d)),
        "check_funnel": lambda s, d: checks.check_funnel(QUERIES["checkout_funnel"](s, d)),
        "check_retention_gap": lambda s, d: checks.check_retention_gap(QUERIES["cohort_retention"](s, d)),
        "check_engagement": lambda s, d: checks.check_engagement(QUERIES["product_engagement"](s, d)),
        "check_cart_total": lambda s, d: checks.check_cart_total(QUERIES["cart_abandonment"](s, d), roles(s, d).session_events),
        "mrr_reconciliation": lambda s, d: checks.mrr_reconciliation(QUERIES["mrr_movements"](s, d), roles(s, d).subscriptions),
        "duplicate_starts": _r(lambda r: checks.duplicate_starts(r.subscription_events)),
        "check_trials": lambda s, d: checks.check_trials(QUERIES["trial_conversion"](s, d)),
        "check_retention_identity": lambda s, d: checks.check_retention_identity(QUERIES["revenue_retention"](s, d)),
        "check_adoption": lambda s, d: checks.check_adoption(QUERIES["feature_adoption"](s, d), roles(s, d).accounts, as_of=SAAS_AS_OF),
        "check_fanout": _r(lambda r: checks.check_fanout(r.accounts, r.subscriptions, as_of=SAAS_AS_OF)),
        "expansion_reconciliation": lambda s, d: checks.expansion_reconciliation(
            QUERIES["expansion_revenue"](s, d), QUERIES["mrr_movements"](s, d), as_of=SAAS_AS_OF
        ),
    }
)
