"""DuckDB oracle SQL for the data-quality (D) and reconciliation (R) keys.

Membership tests are written as EXISTS / NOT EXISTS here (the Spark side uses
marker joins); reconciliation checks wrap the operator oracles as subqueries.
"""

from __future__ import annotations

from .queries import A, PLAN_NORMALIZED, SQL, ratio

PLAN_OF_SUB = PLAN_NORMALIZED  # over column ``plan``

SQL["subscription_grain"] = """
SELECT coalesce(a.account_type, 'unknown') AS account_type,
       count(*) AS subscriptions,
       count(*) FILTER (WHERE s.user_id IS NOT NULL) AS user_grain_rows,
       count(*) FILTER (WHERE s.user_id IS NULL) AS account_grain_rows,
       min(s.seat_count) AS min_seats,
       max(s.seat_count) AS max_seats
FROM subscriptions s LEFT JOIN accounts a ON s.account_id = a.account_id
GROUP BY 1
"""

# the plan of a subscription: by id, or by text where there is no id (monthly first, then the smallest id)
_PLAN_OF = f"""
  SELECT s.*, coalesce(s.plan_id, p.plan_id) AS pid, coalesce(own.monthly_price, p.monthly_price) AS price
  FROM subscriptions s
  LEFT JOIN plans own ON own.plan_id = s.plan_id
  LEFT JOIN (SELECT DISTINCT ON (tier) replace(lower(plan_name), 'professional', 'pro') AS tier, plan_id, monthly_price
             FROM plans ORDER BY tier, billing_interval <> 'monthly', plan_id) p
    ON s.plan_id IS NULL AND p.tier = {PLAN_OF_SUB.replace("(plan)", "(s.plan)")}"""

SQL["mrr_price_check"] = f"""
WITH priced AS (
  SELECT coalesce(a.account_type, 'unknown') AS account_type, s.mrr, CAST(s.price * s.seat_count AS DECIMAL(18,2)) AS list_mrr
  FROM ({_PLAN_OF}) s LEFT JOIN accounts a ON s.account_id = a.account_id
)
SELECT account_type,
       count(*) AS subscriptions,
       count(list_mrr) AS priced,
       count(*) FILTER (mrr = list_mrr) AS price_match,
       count(*) FILTER (mrr <> list_mrr) AS price_mismatch,
       CAST(sum(mrr - list_mrr) FILTER (mrr <> list_mrr) AS DECIMAL(38,2)) AS mismatch_mrr_gap
FROM priced GROUP BY account_type
"""

SQL["signup_lag"] = """
WITH utc AS (
  SELECT account_type, signup_date - INTERVAL 2 HOUR AS signed,
         (SELECT min(event_time) FROM subscription_events e WHERE e.account_id = a.account_id) - INTERVAL 330 MINUTE AS first_at
  FROM accounts a
)
SELECT account_type, count(*) AS accounts,
       count(*) FILTER (CAST(signed AS DATE) = CAST(first_at AS DATE)) AS same_utc_day,
       count(*) FILTER (first_at < signed) AS event_before_signup,
       round(min(date_diff('microsecond', signed, first_at) / 3.6e9), 6) AS min_hours,
       round(max(date_diff('microsecond', signed, first_at) / 3.6e9), 6) AS max_hours
FROM utc WHERE first_at IS NOT NULL GROUP BY account_type
"""

SQL["status_counts"] = """
SELECT status, count(*) AS subscriptions, CAST(sum(count(*)) OVER () AS BIGINT) AS total_subscriptions
FROM subscriptions GROUP BY status
"""

SQL["trial_state"] = """
SELECT count(*) AS trials,
       count(*) FILTER (WHERE converted_at IS NOT NULL) AS converted,
       count(*) FILTER (WHERE converted_at IS NOT NULL AND converted_subscription_id IS NULL) AS converted_without_subscription,
       count(*) FILTER (WHERE converted_at IS NULL AND converted_subscription_id IS NOT NULL) AS subscription_without_conversion,
       count(*) FILTER (WHERE converted_subscription_id IS NOT NULL AND EXISTS (
           SELECT 1 FROM subscriptions s WHERE s.subscription_id = t.converted_subscription_id)) AS subscription_resolves,
       count(*) FILTER (WHERE converted_subscription_id IS NOT NULL AND NOT EXISTS (
           SELECT 1 FROM subscriptions s WHERE s.subscription_id = t.converted_subscription_id)) AS subscription_unresolved
FROM trials t
"""

SQL["plan_id_backfill"] = f"""
SELECT subscription_id, plan, plan_id, pid AS resolved_plan_id, CAST(plan_id IS NULL AND pid IS NOT NULL AS INTEGER) AS backfilled
FROM ({_PLAN_OF})
"""

SQL["future_dated_events"] = f"""
SELECT count(*) AS events,
       count(*) FILTER (WHERE event_time > {A}) AS future_dated_events,
       count(*) FILTER (WHERE event_time <= {A}) AS kept_events
FROM subscription_events
"""

SQL["cancellation_reasons"] = """
SELECT coalesce(cancellation_reason, 'no reason given') AS cancellation_reason, count(*) AS subscriptions
FROM subscriptions WHERE status = 'churned' GROUP BY 1
"""

SQL["unattributed_events"] = """
SELECT CASE WHEN EXISTS (SELECT 1 FROM users u WHERE u.user_id = e.user_id) THEN 'attributed' ELSE 'unattributed' END AS attribution,
       count(*) AS events,
       count(DISTINCT e.account_id) AS accounts
FROM telemetry e GROUP BY 1
"""

SQL["subs_per_account"] = """
WITH per AS (
  SELECT a.account_id, count(s.subscription_id) AS n
  FROM accounts a LEFT JOIN subscriptions s ON a.account_id = s.account_id
  GROUP BY a.account_id
)
SELECT n AS n_subscriptions, count(*) AS accounts FROM per GROUP BY n
"""

_FK = [
    ("accounts", "account_id", "users", "account_id"),
    ("accounts", "account_id", "subscriptions", "account_id"),
    ("accounts", "account_id", "subscription_events", "account_id"),
    ("accounts", "account_id", "trials", "account_id"),
    ("accounts", "account_id", "telemetry", "account_id"),
    ("subscriptions", "subscription_id", "subscription_events", "subscription_id"),
    ("plans", "plan_id", "subscriptions", "plan_id"),
    ("users", "user_id", "telemetry", "user_id"),
    ("features", "feature_id", "telemetry", "feature_id"),
    ("subscriptions", "subscription_id", "trials", "converted_subscription_id"),
]
_FK_NAMES = {"telemetry": "events"}


def _fk_part(parent, pkey, child, ckey):
    return f"""SELECT '{parent}' AS parent, '{_FK_NAMES.get(child, child)}' AS child, '{ckey}' AS key_column,
       count(*) AS child_rows,
       count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pkey} = c.{ckey})) AS orphan_rows
FROM {child} c WHERE c.{ckey} IS NOT NULL"""


SQL["soft_fk_check"] = "\nUNION ALL\n".join(_fk_part(*p) for p in _FK)

SQL["feature_id_coverage"] = f"""
WITH named AS (
  SELECT e.feature_id,
         EXISTS (SELECT 1 FROM features f WHERE f.feature_name = json_extract_string(e.properties, '$.feature')) AS known
  FROM telemetry e
)
SELECT count(*) AS events,
       count(*) FILTER (WHERE feature_id IS NOT NULL) AS with_feature_id,
       count(*) FILTER (WHERE feature_id IS NULL) AS without_feature_id,
       count(*) FILTER (WHERE feature_id IS NULL AND known) AS recoverable_from_properties,
       count(*) FILTER (WHERE feature_id IS NULL AND NOT known) AS unrecoverable,
       {ratio("count(*) FILTER (WHERE feature_id IS NOT NULL)", "count(*)")} AS feature_id_share
FROM named
"""

SQL["flag_domain"] = """
SELECT is_active AS value, count(*) AS users, CAST(coalesce(is_active IN (0, 1), false) AS INTEGER) AS in_domain
FROM users GROUP BY is_active
"""

SQL["signups"] = """
SELECT u.user_id, u.account_id, a.signup_date, a.acquisition_channel AS signup_source
FROM users u JOIN accounts a ON u.account_id = a.account_id
"""


# ------------------------------------------------------------ reconciliation
def sub(key: str) -> str:
    return f"({SQL[key].strip()})"


SQL["check_activation"] = f"""
SELECT count(*) AS cohorts, count(*) FILTER (WHERE activated_7d > cohort_size) AS violations
FROM {sub("activation_curve")} x
"""

SQL["check_funnel"] = f"""
SELECT count(*) AS channels,
       count(*) FILTER (WHERE begin_checkout < address OR address < shipping OR shipping < payment OR payment < purchased) AS violations
FROM {sub("checkout_funnel")} x
"""

SQL["check_retention_gap"] = f"""
SELECT CAST(sum(cohort_size) AS BIGINT) AS cohort_size, CAST(sum(w0_active) AS BIGINT) AS w0_active,
       CAST(sum(cohort_size) - sum(w0_active) AS BIGINT) AS gap
FROM {sub("cohort_retention")} x
"""

SQL["check_engagement"] = f"""
SELECT count(*) AS products,
       count(*) FILTER (WHERE add_to_cart_sessions > views) AS carts_exceed_views,
       count(*) FILTER (WHERE atc_rate < 0 OR atc_rate > 1) AS rate_out_of_range
FROM {sub("product_engagement")} x
"""

SQL["check_cart_total"] = f"""
WITH b AS (SELECT CAST(sum(atc_sessions) AS BIGINT) AS bucket_sessions FROM {sub("cart_abandonment")} x),
     f AS (SELECT count(DISTINCT session_id) AS unsegmented_sessions FROM session_events WHERE event_type = 'add_to_cart')
SELECT bucket_sessions, unsegmented_sessions, bucket_sessions - unsegmented_sessions AS difference FROM b, f
"""

SQL["mrr_reconciliation"] = f"""
WITH e AS (SELECT CAST(arg_max(ending_mrr, month) AS DECIMAL(38,2)) AS event_sum_ending_mrr FROM {sub("mrr_movements")} x),
     s AS (SELECT CAST(sum(mrr) FILTER (WHERE lower(status) = 'active') AS DECIMAL(38,2)) AS snapshot_active_mrr,
                  CAST(sum(mrr) FILTER (WHERE lower(status) IN ('active', 'paused', 'past_due')) AS DECIMAL(38,2)) AS snapshot_open_mrr
           FROM subscriptions)
SELECT event_sum_ending_mrr, snapshot_active_mrr, snapshot_open_mrr,
       CAST(event_sum_ending_mrr - snapshot_active_mrr AS DECIMAL(38,2)) AS gap_active,
       CAST(event_sum_ending_mrr - snapshot_open_mrr AS DECIMAL(38,2)) AS gap_open
FROM e, s
"""

SQL["duplicate_starts"] = """
SELECT subscription_id, count(*) AS start_events
FROM subscription_events WHERE event_type IN ('subscription_started', 'trial_converted')
GROUP BY subscription_id HAVING count(*) > 1
"""

SQL["check_trials"] = f"""
SELECT count(*) AS cohorts,
       count(*) FILTER (WHERE converted_by_14d > converted_by_30d OR converted_by_30d > converted_by_60d) AS nesting_violations,
       CAST(sum(trials_started) AS BIGINT) AS trials_started,
       CAST(sum(converted_by_14d) AS BIGINT) AS converted_by_14d,
       {ratio("sum(converted_by_14d)", "sum(trials_started)")} AS overall_conv_rate_14d
FROM {sub("trial_conversion")} x
"""

SQL["check_retention_identity"] = f"""
SELECT count(*) AS cohorts,
       count(*) FILTER (WHERE NOT (retained_mrr_12m + churn_mrr_12m = cohort_starting_mrr)) AS identity_violations,
       count(*) FILTER (WHERE grr > 1) AS grr_above_one,
       count(*) FILTER (WHERE nrr > 1) AS nrr_above_one
FROM {sub("revenue_retention")} x
"""

SQL["check_adoption"] = f"""
WITH e AS (SELECT count(*) AS eligible_accounts FROM accounts WHERE signup_date <= {A} - INTERVAL 90 DAY)
SELECT e.eligible_accounts, count(*) AS features,
       count(*) FILTER (WHERE x.accounts_adopted + x.accounts_not_adopted <> e.eligible_accounts) AS split_violations
FROM {sub("feature_adoption")} x, e
GROUP BY e.eligible_accounts
"""

SQL["check_fanout"] = f"""
WITH eligible AS (SELECT account_id FROM accounts WHERE signup_date <= {A} - INTERVAL 90 DAY),
ranked AS (
  SELECT account_id, subscription_id,
         row_number() OVER (PARTITION BY account_id ORDER BY start_date DESC NULLS FIRST, subscription_id DESC) AS rn
  FROM subscriptions
),
fanned AS (SELECT e.account_id FROM eligible e LEFT JOIN subscriptions s ON e.account_id = s.account_id),
deduped AS (SELECT e.account_id FROM eligible e LEFT JOIN ranked r ON e.account_id = r.account_id AND r.rn = 1)
SELECT 'eligible_x_subscriptions' AS frame, count(*) AS rows, count(DISTINCT account_id) AS distinct_keys,
       count(*) - count(DISTINCT account_id) AS fanout FROM fanned
UNION ALL
SELECT 'eligible_x_latest_subscription', count(*), count(DISTINCT account_id), count(*) - count(DISTINCT account_id) FROM deduped
"""

SQL["expansion_reconciliation"] = f"""
WITH r AS (SELECT CAST(sum(expansion_mrr_total) AS DECIMAL(38,2)) AS rolling_expansion_mrr FROM {sub("expansion_revenue")} x),
     c AS (SELECT CAST(sum(expansion_mrr) AS DECIMAL(38,2)) AS calendar_expansion_mrr FROM {sub("mrr_movements")} y
           WHERE month >= CAST(date_trunc('month', {A} - INTERVAL 6 MONTH) AS DATE))
SELECT rolling_expansion_mrr, calendar_expansion_mrr,
       CAST(calendar_expansion_mrr - rolling_expansion_mrr AS DECIMAL(38,2)) AS difference
FROM r, c
"""
