"""DuckDB oracle SQL per registry key.

Each query states an operator's rules over the role views in a form of its own:
facts are gathered per customer, session, account or trial as lists or single
rows, and the rules are read off these. Neither the steps of the Spark plans nor
any other SQL is followed, so agreement of the two results says something about
both. Money is cast to DECIMAL(38,2), ratios are DOUBLE divisions, counts are
BIGINT, weeks and months are DATEs.
"""

from __future__ import annotations

from .roles import ECOM_SINCE, SAAS_AS_OF, with_roles

S = f"TIMESTAMP '{ECOM_SINCE} 00:00:00'"
A = f"DATE '{SAAS_AS_OF}'"
STARTS = "('subscription_started', 'trial_converted')"
PLAN_NORMALIZED = "replace(lower(plan), 'professional', 'pro')"

_DAY = 86_400_000_000  # microseconds


def ratio(n: str, d: str) -> str:
    return f"CAST({n} AS DOUBLE) / NULLIF(CAST({d} AS DOUBLE), 0)"


def money(expr: str, name: str) -> str:
    return f"CAST({expr} AS DECIMAL(38,2)) AS {name}"


SQL: dict[str, str] = {}


# ------------------------------------------------------------ E1 activation
def _activation(first_action: str) -> str:
    """``first_action``: the action that counts, of the customer's sorted action times ``times``."""
    in_time = f"us BETWEEN 0 AND {7 * _DAY}"
    return f"""
WITH lag AS (
  SELECT CAST(date_trunc('week', created_at) AS DATE) AS signup_week,
         date_diff('microsecond', created_at, {first_action}) AS us
  FROM customers
  LEFT JOIN (SELECT customer_id, list_sort(list(occurred_at)) AS times
             FROM session_events NATURAL JOIN sessions
             WHERE event_type IN ('purchase', 'begin_checkout', 'add_to_cart')
             GROUP BY ALL) USING (customer_id)
  WHERE created_at >= {S}
)
SELECT signup_week,
       count(*) AS cohort_size,
       count(*) FILTER ({in_time}) AS activated_7d,
       {ratio(f"count(*) FILTER ({in_time})", "count(*)")} AS activation_rate_7d,
       round(quantile_cont(us / 6e7, 0.5) FILTER ({in_time}), 9) AS median_minutes_to_activation,
       round(quantile_cont(us / 6e7, 0.9) FILTER ({in_time}), 9) AS p90_minutes_to_activation
FROM lag GROUP BY ALL
"""


SQL["activation_curve"] = _activation("times[1]")
# a cohort is closed when its last member has been seen for seven days
SQL["activation_curve_closed"] = f"SELECT * FROM ({_activation('times[1]')}) WHERE signup_week + INTERVAL 14 DAY <= DATE '2024-01-24'"
SQL["activation_curve_strict"] = _activation("list_filter(times, lambda x: x >= created_at)[1]")

# ---------------------------------------------------------------- E2 funnel
_STEPS = ["begin_checkout", "address", "shipping", "payment", "purchased"]
_DROPS = ["drop_address_pct", "drop_shipping_pct", "drop_payment_pct", "drop_final_pct"]
SQL["checkout_funnel"] = f"""
WITH furthest AS (
  SELECT session_id,
         max(list_position(['begin_checkout', 'add_address', 'select_shipping', 'add_payment', 'purchase'], event_type)) AS step
  FROM session_events SEMI JOIN sessions USING (session_id) GROUP BY session_id
), per AS (
  SELECT channel, list(step) AS steps
  FROM (SELECT DISTINCT session_id, channel FROM session_channels) JOIN furthest USING (session_id)
  WHERE step > 0 GROUP BY channel
), reached AS (
  SELECT channel, list_transform(range(1, 6), lambda k: len(list_filter(steps, lambda s: s >= k))) AS n FROM per
)
SELECT channel,
       {", ".join(f"n[{k + 1}] AS {name}" for k, name in enumerate(_STEPS))},
       {", ".join(f"{ratio(f'n[{k + 1}] - n[{k + 2}]', f'n[{k + 1}]')} AS {name}" for k, name in enumerate(_DROPS))}
FROM reached
"""


# ------------------------------------------------------------- E3 retention
def _retention(without_activity: str) -> str:
    """``without_activity``: the weeks in which a customer without any activity counts as active."""
    back = [f"count(*) FILTER (list_contains(weeks, {w}))" for w in range(5)]
    return f"""
WITH seen AS (
  SELECT customer_id, created_at, list(occurred_at) FILTER (occurred_at IS NOT NULL) AS times
  FROM customers
  LEFT JOIN (SELECT customer_id, occurred_at FROM session_events NATURAL JOIN sessions
             WHERE event_type IN ('purchase', 'add_to_cart', 'product_view')) USING (customer_id)
  WHERE created_at >= {S} GROUP BY ALL
), active AS (
  SELECT CAST(date_trunc('week', created_at) AS DATE) AS cohort_week,
         coalesce(list_transform(times, lambda x: CAST(greatest(date_diff('microsecond', created_at, x), 0) // {7 * _DAY} AS BIGINT)),
                  {without_activity}) AS weeks
  FROM seen
)
SELECT cohort_week, count(*) AS cohort_size, {back[0]} AS w0_active,
       {", ".join(f"{back[w]} AS w{w}_retained" for w in range(1, 5))},
       {", ".join(f"{ratio(back[w], 'count(*)')} AS w{w}_retention_rate" for w in range(1, 5))}
FROM active GROUP BY cohort_week
"""


SQL["cohort_retention"] = _retention("[CAST(0 AS BIGINT)]")
SQL["cohort_retention_strict"] = _retention("CAST([] AS BIGINT[])")

# ------------------------------------------------------------ E4 engagement
SQL["product_engagement"] = f"""
WITH per AS (
  SELECT product_id, product_name, category_name AS category,
         count(*) FILTER (event_type = 'product_view') AS views,
         count(DISTINCT session_id) FILTER (event_type = 'add_to_cart') AS add_to_cart_sessions
  FROM session_events JOIN product_variants USING (variant_id) JOIN products USING (product_id) JOIN categories USING (category_id)
  GROUP BY ALL HAVING views > 0
), rated AS (
  SELECT *, {ratio("add_to_cart_sessions", "views")} AS atc_rate FROM per WHERE category IS NOT NULL
)
SELECT product_id, product_name, category, views, add_to_cart_sessions, atc_rate,
       round(atc_rate - median(atc_rate) OVER (PARTITION BY category), 9) AS atc_rate_vs_category_median,
       (SELECT 1 + count(*) FROM rated o WHERE o.views > r.views) AS views_rank,
       (SELECT 1 + count(*) FROM rated o WHERE o.atc_rate < r.atc_rate) AS atc_rate_rank
FROM rated r
"""


# ----------------------------------------------------------- E5 abandonment
def _abandonment(upper: str, top: str) -> str:
    """``upper``: whether value ``v`` is below the bucket's end; ``top``: label of a value in no bucket."""
    return f"""
WITH cart AS (
  SELECT session_id, sum(quantity * unit_price) FILTER (event_type = 'add_to_cart') AS v,
         bool_or(event_type = 'purchase') AND session_id IS NOT NULL AS bought
  FROM session_events GROUP BY session_id HAVING bool_or(event_type = 'add_to_cart')
), range_of (label, lo, hi, next_lo) AS (
  VALUES ('<500', -1000000000, 499.99, 500), ('500-1999', 500, 1999, 2000), ('2000-4999', 2000, 4999, 5000), ('5000-14999', 5000, 14999, 15000)
)
SELECT coalesce(label, {top}) AS cart_bucket,
       count(*) AS atc_sessions,
       count(*) FILTER (bought) AS purchased_sessions,
       count(*) FILTER (NOT bought) AS abandoned_sessions,
       {ratio("count(*) FILTER (NOT bought)", "count(*)")} AS abandonment_rate,
       {money("sum(v) FILTER (NOT bought)", "gmv_left_on_table")}
FROM cart LEFT JOIN range_of ON v >= lo AND {upper}
GROUP BY 1
"""


SQL["cart_abandonment"] = _abandonment("v <= hi", "'15000+'")
SQL["cart_abandonment_strict"] = _abandonment("v < next_lo", "CASE WHEN v IS NULL THEN 'unknown' ELSE '15000+' END")

# -------------------------------------------------------------- S1 movements
_S1 = {
    "new": f"kind IN {STARTS} AND NOT came_back",
    "expansion": "kind IN ('addon_attach', 'seat_add') OR (kind = 'plan_changed' AND d > 0)",
    "contraction": "kind = 'plan_changed' AND d < 0",
    "churn": "kind = 'cancelled'",
    "reactivation": f"kind IN {STARTS} AND came_back",
}
_S1_MONTHS = f"""
WITH moved AS (
  SELECT CAST(date_trunc('month', event_time) AS DATE) AS month, event_type AS kind, mrr_delta AS d,
         coalesce(account_id IS NOT NULL AND event_time > min(event_time) FILTER (event_type = 'cancelled') OVER (PARTITION BY account_id), false)
           AS came_back
  FROM subscription_events WHERE event_time <= {A}
), by_month AS (
  SELECT month, {", ".join(f"sum(d) FILTER ({rule}) AS {name}_mrr" for name, rule in _S1.items())},
         sum(d) AS net, sum(d) FILTER (({" OR ".join(f"({rule})" for rule in _S1.values())}) IS NOT TRUE) AS rest
  FROM moved WHERE kind <> 'trial_started' GROUP BY month
)"""
_S1_COLUMNS = ", ".join(money(f"{name}_mrr", f"{name}_mrr") for name in _S1)
SQL["mrr_movements"] = f"""{_S1_MONTHS}
SELECT month, {_S1_COLUMNS}, {money("net", "net_new_mrr")}, {money("sum(net) OVER (ORDER BY month)", "ending_mrr")}
FROM by_month
"""
SQL["mrr_movements_strict"] = f"""{_S1_MONTHS}
SELECT CAST(m AS DATE) AS month, {_S1_COLUMNS}, {money("coalesce(net, 0)", "net_new_mrr")}, {money("rest", "unclassified_mrr")},
       {money("sum(coalesce(net, 0)) OVER (ORDER BY m)", "ending_mrr")}
FROM (SELECT unnest(range(CAST(min(month) AS TIMESTAMP), max(month) + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS m FROM by_month)
LEFT JOIN by_month ON month = CAST(m AS DATE)
"""


# ------------------------------------------------------------------ S2 trials
def _trials(conversion: str) -> str:
    """``conversion``: the one that counts, of the account's sorted conversion times ``times``."""
    by = {n: f"count(*) FILTER (us BETWEEN 0 AND {n * _DAY})" for n in (14, 30, 60)}
    return f"""
WITH lag AS (
  SELECT CAST(date_trunc('week', started_at) AS DATE) AS trial_week,
         date_diff('microsecond', started_at, {conversion}) AS us
  FROM trials
  LEFT JOIN (SELECT account_id, list_sort(list(event_time)) AS times FROM subscription_events
             WHERE event_type IN {STARTS} AND event_time IS NOT NULL GROUP BY account_id) USING (account_id)
)
SELECT trial_week, count(*) AS trials_started,
       {", ".join(f"{c} AS converted_by_{n}d" for n, c in by.items())},
       {", ".join(f"{ratio(c, 'count(*)')} AS conv_rate_{n}d" for n, c in by.items())},
       round(median(us / CAST({_DAY} AS DOUBLE)) FILTER (us >= 0), 9) AS median_days_trial_to_paid
FROM lag GROUP BY trial_week
"""


SQL["trial_conversion"] = _trials("times[1]")
# ... and for trials sixty days
SQL["trial_conversion_closed"] = f"SELECT * FROM ({_trials('times[1]')}) WHERE trial_week + INTERVAL 67 DAY <= {A}"
SQL["trial_conversion_strict"] = _trials("list_filter(times, lambda x: x >= started_at)[1]")


# --------------------------------------------------------------- S3 retention
def _revenue(times: str, extra: str = "") -> str:
    """``times``: how often an account's movements count (``n`` start events at its first instant)."""
    total = {c: f"sum({c})" for c in ("base", "kept", "up", "down", "lost")}
    columns = ", ".join(
        money(total[c], name)
        for c, name in (
            ("base", "cohort_starting_mrr"), ("kept", "retained_mrr_12m"), ("up", "expansion_mrr_12m"),
            ("down", "contraction_mrr_12m"), ("lost", "churn_mrr_12m"),
        )
    )
    return f"""
WITH life AS (
  SELECT account_id, list({{'t': event_time, 'k': event_type, 'd': CAST(mrr_delta AS DECIMAL(38,2))}}) AS e
  FROM subscription_events WHERE account_id IS NOT NULL AND event_time IS NOT NULL GROUP BY account_id
), begun AS (
  SELECT e, list_min([x.t for x in e if x.k IN {STARTS}]) AS t0 FROM life
), year AS (
  SELECT CAST(date_trunc('month', t0) AS DATE) AS cohort_month,
         [x.d for x in e if x.t = t0 AND x.k IN {STARTS}] AS first_deltas,
         [x for x in e if x.t > t0 AND x.t <= t0 + INTERVAL 12 MONTH] AS later
  FROM begun WHERE t0 + INTERVAL 12 MONTH <= {A}
), summed AS (
  SELECT cohort_month, coalesce(list_sum(first_deltas), 0) AS base, len(first_deltas) AS n,
         len([x for x in later if x.k = 'cancelled']) > 0 AS gone,
         coalesce(list_sum([x.d for x in later if x.k IN ('addon_attach', 'seat_add') OR (x.k = 'plan_changed' AND x.d > 0)]), 0) AS more,
         coalesce(list_sum([x.d for x in later if x.k = 'plan_changed' AND x.d < 0]), 0) AS less
  FROM year
), accounts_of AS (
  SELECT cohort_month, base, if(gone, 0, base) AS kept, if(gone, -base, 0) AS lost,
         if(gone, 0, more * {times}) AS up, if(gone, 0, less * {times}) AS down
  FROM summed
)
SELECT cohort_month, {columns},
       {ratio("sum(kept)", "sum(base)")} AS grr,
       {ratio("sum(kept) + sum(up) + sum(down)", "sum(base)")} AS nrr{extra}
FROM accounts_of GROUP BY cohort_month
"""


SQL["revenue_retention"] = _revenue("n * n")
SQL["revenue_retention_strict"] = _revenue("1", f", {ratio('sum(kept) + sum(down)', 'sum(base)')} AS grr_net_contraction")


# ---------------------------------------------------------------- S4 adoption
def _adoption(key: str, names: str, without_subscription: str, earliest: str) -> str:
    """An account's adopted features as a list; ``key``: what a row of the result stands for."""
    rate_in, rate_out = ratio("sum(has * kept)", "sum(has)"), ratio("sum((size - has) * kept)", "sum(size - has)")
    return f"""
WITH latest AS (
  SELECT account_id, list(cancelled_at ORDER BY start_date DESC NULLS FIRST, subscription_id DESC)[1] AS cancelled_at
  FROM subscriptions GROUP BY account_id
), member AS (
  SELECT account_id, signup_date, if(cancelled_at <= signup_date + INTERVAL 90 DAY, 0, 1) AS kept
  FROM accounts {without_subscription} JOIN latest USING (account_id) WHERE signup_date + INTERVAL 90 DAY <= {A}
), adopted AS (
  SELECT account_id, kept, has_ids FROM member
  LEFT JOIN (SELECT account_id, list(feature_id) AS has_ids
             FROM (SELECT account_id, feature_id FROM member JOIN feature_events USING (account_id)
                   WHERE feature_id IS NOT NULL AND occurred_at BETWEEN {earliest} AND signup_date + INTERVAL 14 DAY
                   GROUP BY ALL HAVING count(*) >= 1)
             GROUP BY account_id) USING (account_id)
), grouped AS (
  SELECT {key}, {names} AS feature_name_, list(feature_id) AS ids FROM features GROUP BY {key}
), pair AS (
  SELECT {key}, feature_name_, len(ids) AS size, kept, coalesce(len(list_intersect(ids, has_ids)), 0) AS has FROM grouped, adopted
)
SELECT {"feature_id, " if key == "feature_id" else ""}feature_name_ AS feature_name,
       count(*) FILTER (has > 0) AS accounts_adopted,
       count(*) FILTER (has < size) AS accounts_not_adopted,
       {rate_in} AS retention_rate_adopted,
       {rate_out} AS retention_rate_not_adopted,
       {rate_in} - {rate_out} AS retention_lift_pp,
       ({rate_in} - {rate_out}) / NULLIF({rate_out}, 0) AS retention_lift_pct
FROM pair GROUP BY {key}, feature_name_
"""


SQL["feature_adoption"] = _adoption("feature_name", "feature_name", "LEFT", "TIMESTAMP '0001-01-01 00:00:00'")
SQL["feature_adoption_strict"] = _adoption("feature_id", "min(feature_name)", "", "signup_date")

# --------------------------------------------------------------- S5 expansion
SQL["expansion_revenue"] = f"""
WITH per_account AS (
  SELECT CASE event_type WHEN 'addon_attach' THEN 'addon' WHEN 'seat_add' THEN 'seats_added' ELSE 'plan_upgrade' END AS expansion_type,
         account_id, sum(mrr_delta) AS gained,
         list(date_diff('microsecond', signup_date, event_time) / CAST({_DAY} AS DOUBLE)) AS lags
  FROM subscription_events JOIN accounts USING (account_id)
  WHERE event_time BETWEEN {A} - INTERVAL 6 MONTH AND {A}
    AND (event_type IN ('addon_attach', 'seat_add') OR (event_type = 'plan_changed' AND mrr_delta > 0))
  GROUP BY ALL
)
SELECT expansion_type, CAST(sum(len(lags)) AS BIGINT) AS expansion_events, count(*) AS accounts_expanded,
       {money("sum(gained)", "expansion_mrr_total")}, {ratio("sum(gained)", "count(*)")} AS expansion_mrr_per_account,
       round(list_median(flatten(list(lags))), 9) AS median_days_from_signup_to_expansion
FROM per_account GROUP BY expansion_type
"""

# ------------------------------------------------------------- sample queries
SQL["active_paying_accounts"] = """
SELECT count(*) AS active_paying_accounts
FROM (SELECT account_id FROM subscriptions WHERE account_id IS NOT NULL GROUP BY account_id HAVING bool_or(lower(status) = 'active'))
"""

SQL["plan_breakdown"] = f"""
SELECT {PLAN_NORMALIZED} AS plan_normalized, count(*) AS subscriptions FROM subscriptions GROUP BY 1
"""

SQL["first_events"] = """
SELECT event_id, account_id, event_type, from_plan, to_plan, mrr_delta, event_time
FROM subscription_events QUALIFY row_number() OVER (ORDER BY event_time NULLS LAST, event_id) <= 10
"""


def oracle_sql() -> dict[str, str]:
    from . import quality_sql  # noqa: F401  (registers the D and R keys)

    return {k: with_roles(v) for k, v in SQL.items()}
