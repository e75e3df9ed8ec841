"""Repartitioning and reordering the inputs leaves every result unchanged."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import ecom, saas
from ledgerlens.registry import roles
from ledgerlens.sources.roles import ECOM_SINCE, SAAS_AS_OF


def _shuffle(df, n, seed):
    return df.repartition(n, F.xxhash64(F.lit(seed), *df.columns)).sortWithinPartitions(F.xxhash64(F.lit(seed + 1), *df.columns))


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


CASES = {
    "mrr_movements": lambda r, p: saas.mrr_movements(p(r.subscription_events), as_of=SAAS_AS_OF),
    "revenue_retention": lambda r, p: saas.revenue_retention(p(r.subscription_events), as_of=SAAS_AS_OF),
    "expansion_revenue": lambda r, p: saas.expansion_revenue(p(r.subscription_events), p(r.accounts), as_of=SAAS_AS_OF),
    "trial_conversion": lambda r, p: saas.trial_conversion(p(r.trials), p(r.subscription_events)),
    "feature_adoption": lambda r, p: saas.feature_adoption(
        p(r.accounts), p(r.subscriptions), p(r.feature_events), p(r.features), as_of=SAAS_AS_OF
    ),
    "activation_curve": lambda r, p: ecom.activation_curve(p(r.customers), p(r.sessions), p(r.session_events), since=ECOM_SINCE),
    "cohort_retention": lambda r, p: ecom.cohort_retention(p(r.customers), p(r.sessions), p(r.session_events), since=ECOM_SINCE),
    "product_engagement": lambda r, p: ecom.product_engagement(
        p(r.session_events), p(r.product_variants), p(r.products), p(r.categories)
    ),
    "checkout_funnel": lambda r, p: ecom.checkout_funnel(p(r.sessions), p(r.session_channels), p(r.session_events)),
    "cart_abandonment": lambda r, p: ecom.cart_abandonment(p(r.session_events)),
}


@pytest.mark.parametrize("key", list(CASES))
def test_permuted_inputs(spark, key):
    r = roles(spark, "/root/testdata/sf0.01")
    base = _rows(CASES[key](r, lambda df: df))
    permuted = _rows(CASES[key](r, lambda df: _shuffle(df, 5, 11)))
    assert base == permuted
