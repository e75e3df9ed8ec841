"""The role views of ``ledgerlens.sources.roles`` as DuckDB CTEs.

Every oracle query is prefixed with these CTEs (DuckDB skips the ones a query
does not read), so the oracle sees exactly the tables the Spark operators see.
"""

from __future__ import annotations

ECOM_SINCE = "2024-01-02"
SAAS_AS_OF = "2001-01-01"

PLAN_TEXT = (
    "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'pro' WHEN '2' THEN 'Pro' "
    "WHEN '3' THEN 'professional' WHEN '4' THEN 'enterprise' WHEN '5' THEN 'Enterprise' END"
)

ROLE_CTES: list[tuple[str, str]] = [
    (
        "customers",
        """SELECT c_custkey AS customer_id,
       TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(c_custkey % 21 AS INTEGER))
         + to_hours(CAST(c_custkey % 24 AS INTEGER)) AS created_at
FROM customer""",
    ),
    (
        "sessions",
        """SELECT DISTINCT user_id * 100 + dayofmonth(ts) AS session_id,
       CASE WHEN user_id % 50 <> 49 AND dayofmonth(ts) >= user_id % 25 THEN user_id END AS customer_id
FROM events""",
    ),
    (
        "session_channels",
        """SELECT session_id,
       CASE session_id % 5 WHEN 0 THEN 'paid_social' WHEN 1 THEN 'organic' WHEN 2 THEN 'referral'
                           WHEN 3 THEN 'email' WHEN 4 THEN 'affiliate' END AS channel
FROM (SELECT DISTINCT user_id * 100 + dayofmonth(ts) AS session_id FROM events WHERE event_type = 'view')
UNION ALL
SELECT DISTINCT user_id * 100 + dayofmonth(ts), 'organic' FROM events
WHERE event_type = 'view' AND (user_id * 100 + dayofmonth(ts)) % 7 = 0""",
    ),
    (
        "session_events",
        """SELECT user_id * 100 + dayofmonth(ts) AS session_id,
       ts AS occurred_at,
       CASE event_type WHEN 'view' THEN 'product_view' WHEN 'click' THEN 'add_to_cart'
                       WHEN 'signup' THEN 'begin_checkout' WHEN 'purchase' THEN 'purchase'
                       WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 'add_address'
                                                          WHEN 1 THEN 'select_shipping'
                                                          ELSE 'add_payment' END END AS event_type,
       CASE WHEN event_id % 97 <> 0 THEN event_id % nullif((SELECT 2 * count(*) FROM part), 0) END AS variant_id,
       CAST(1 + event_id % 5 AS INTEGER) AS quantity,
       CASE WHEN event_id % 89 <> 0 THEN CAST(CAST(value AS DECIMAL(18,2)) * 25 AS DECIMAL(18,2)) END AS unit_price
FROM events""",
    ),
    ("product_variants", "SELECT unnest([2 * p_partkey, 2 * p_partkey + 1]) AS variant_id, p_partkey AS product_id FROM part"),
    ("products", "SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category_id FROM part"),
    ("categories", "SELECT DISTINCT p_type AS category_id, lower(p_type) AS category_name FROM part"),
    (
        "accounts",
        """SELECT c_custkey AS account_id,
       CASE WHEN c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') THEN 'b2b' ELSE 'self_serve' END AS account_type,
       CASE WHEN c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') THEN c_mktsegment END AS industry,
       CASE WHEN c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') THEN CAST(10 + c_custkey % 490 AS INTEGER) END AS employee_count,
       'N' || CAST(c_nationkey AS VARCHAR) AS country,
       TIMESTAMP '1995-01-01 00:00:00' + to_days(CAST((c_custkey * 37) % 2400 AS INTEGER)) AS signup_date,
       CASE c_nationkey % 5 WHEN 0 THEN 'organic' WHEN 1 THEN 'paid_search' WHEN 2 THEN 'referral'
                            WHEN 3 THEN 'partner' WHEN 4 THEN 'outbound' END AS acquisition_channel
FROM customer""",
    ),
    (
        "subscription_events",
        """SELECT o_orderkey AS event_id,
       o_orderkey - o_orderkey % 8 AS subscription_id,
       o_custkey AS account_id,
       o_custkey AS user_id,
       o_custkey AS actor_user_id,
       CASE o_orderkey % 8 WHEN 0 THEN 'subscription_started' WHEN 1 THEN 'trial_converted'
                           WHEN 2 THEN 'plan_changed' WHEN 3 THEN 'plan_changed' WHEN 4 THEN 'seat_add'
                           WHEN 5 THEN 'addon_attach' WHEN 6 THEN 'cancelled' ELSE 'trial_started' END AS event_type,
       CASE WHEN o_orderkey % 8 IN (0, 1, 7) THEN NULL WHEN o_orderkey % 8 = 2 THEN 'pro' ELSE 'enterprise' END AS from_plan,
       CASE WHEN o_orderkey % 8 = 6 THEN NULL WHEN o_orderkey % 8 = 3 THEN 'pro' ELSE 'enterprise' END AS to_plan,
       CASE WHEN o_orderkey % 8 = 7 THEN CAST(0 AS DECIMAL(18,2))
            WHEN o_orderkey % 8 = 2 AND o_orderkey % 101 = 0 THEN CAST(0 AS DECIMAL(18,2))
            WHEN o_orderkey % 8 IN (3, 6) THEN CAST(-CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(18,2))
            ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS mrr_delta,
       CASE WHEN o_orderkey % 8 = 4 THEN CAST(1 + o_orderkey % 5 AS INTEGER) END AS seats_delta,
       o_orderdate AS event_time
FROM orders""",
    ),
    (
        "plans",
        """SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'pro', CAST(49.00 AS DECIMAL(18,2)), 10, 'monthly'),
                           (CAST(2 AS BIGINT), 'enterprise', CAST(199.00 AS DECIMAL(18,2)), 500, 'monthly'),
                           (CAST(3 AS BIGINT), 'Pro', CAST(39.00 AS DECIMAL(18,2)), 10, 'annual'),
                           (CAST(4 AS BIGINT), 'Enterprise', CAST(159.00 AS DECIMAL(18,2)), 500, 'annual'))
       AS p(plan_id, plan_name, monthly_price, seat_limit, billing_interval)""",
    ),
    (
        "subscriptions",
        f"""SELECT o_orderkey AS subscription_id,
       CASE WHEN c_mktsegment NOT IN ('MACHINERY', 'AUTOMOBILE') THEN o_custkey END AS user_id,
       o_custkey AS account_id,
       {PLAN_TEXT} AS plan,
       CASE WHEN o_orderkey % 11 <> 0 THEN
            CAST(CASE WHEN lower({PLAN_TEXT}) IN ('pro', 'professional') THEN 1 ELSE 2 END
                 + CASE WHEN o_orderkey % 17 = 0 THEN 2 ELSE 0 END AS BIGINT) END AS plan_id,
       CASE WHEN c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') THEN CAST(1 + o_orderkey % 20 AS INTEGER) ELSE 1 END AS seat_count,
       CASE WHEN c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') AND o_orderkey % 7 <> 0 THEN
            CAST(CAST(CASE WHEN lower({PLAN_TEXT}) IN ('pro', 'professional') THEN 49.00 ELSE 199.00 END AS DECIMAL(18,2))
                 * CAST(1 + o_orderkey % 20 AS INTEGER) AS DECIMAL(18,2))
            ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS mrr,
       CASE o_orderkey % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'churned' WHEN 2 THEN 'trialing'
                           WHEN 3 THEN 'past_due' ELSE 'paused' END AS status,
       CASE WHEN o_orderkey % 53 <> 0 THEN o_orderdate END AS start_date,
       CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + to_days(CAST(o_orderkey % 400 AS INTEGER)) END AS cancelled_at,
       CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 15 <> 0 THEN
            CASE o_orderkey % 4 WHEN 0 THEN 'too_expensive' WHEN 1 THEN 'missing_features'
                                WHEN 2 THEN 'switched_competitor' ELSE 'not_using' END END AS cancellation_reason
FROM orders JOIN customer ON o_custkey = c_custkey""",
    ),
    (
        "trial_first_conversion",
        """SELECT c.account_id, c.first_conv, min(se.event_id) AS conv_id
FROM (SELECT account_id, min(event_time) AS first_conv FROM subscription_events
      WHERE event_type IN ('trial_converted', 'subscription_started') GROUP BY account_id) c
JOIN subscription_events se
  ON se.account_id = c.account_id AND se.event_time = c.first_conv
 AND se.event_type IN ('trial_converted', 'subscription_started')
GROUP BY c.account_id, c.first_conv""",
    ),
    (
        "trial_base",
        """SELECT a.account_id AS trial_id, a.account_id,
       CASE WHEN a.account_id % 3 = 0 OR c.first_conv IS NULL THEN a.signup_date
            ELSE c.first_conv - to_days(CAST((a.account_id * 7) % 75 AS INTEGER)) END AS started_at,
       c.first_conv, c.conv_id
FROM accounts a LEFT JOIN trial_first_conversion c ON a.account_id = c.account_id""",
    ),
    (
        "trials",
        """SELECT trial_id, account_id, started_at, started_at + INTERVAL 14 DAY AS ends_at,
       CASE WHEN first_conv >= started_at THEN first_conv END AS converted_at,
       CASE WHEN first_conv >= started_at THEN conv_id END AS converted_subscription_id
FROM (SELECT * FROM trial_base
      UNION ALL
      SELECT trial_id + 1000000000, account_id, started_at - INTERVAL 30 DAY, first_conv, conv_id
      FROM trial_base WHERE account_id % 10 = 0) t""",
    ),
    (
        "features",
        """SELECT DISTINCT p_type AS feature_id, CASE WHEN p_type <> 'SMALL' THEN lower(p_type) END AS feature_name, 'core' AS category FROM part
UNION
SELECT DISTINCT event_type, event_type, 'telemetry' FROM events""",
    ),
    (
        "feature_events",
        """SELECT o_custkey AS user_id, o_custkey AS account_id,
       CASE WHEN (l_orderkey + l_linenumber) % 10 <> 0 THEN p_type END AS feature_id,
       o_orderdate AS occurred_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    ),
    (
        "telemetry",
        """SELECT event_id,
       CASE WHEN event_id % 250 = 0 THEN user_id + 1000000000 ELSE user_id END AS user_id,
       user_id AS account_id,
       CASE WHEN event_id % 4 <> 0 THEN event_type END AS feature_id,
       ts AS occurred_at,
       '{"feature": "' || event_type || '"}' AS properties
FROM events""",
    ),
    (
        "users",
        """SELECT c_custkey AS user_id, c_custkey AS account_id,
       CASE c_custkey % 5 WHEN 0 THEN 'pro' WHEN 1 THEN 'Pro' WHEN 2 THEN 'professional'
                          WHEN 3 THEN 'enterprise' ELSE 'Enterprise' END AS plan_type,
       'owner' AS role, CAST(c_custkey % 3 AS INTEGER) AS is_active
FROM customer
UNION ALL
SELECT c_custkey + 2000000000, c_custkey,
       CASE c_custkey % 5 WHEN 0 THEN 'pro' WHEN 1 THEN 'Pro' WHEN 2 THEN 'professional'
                          WHEN 3 THEN 'enterprise' ELSE 'Enterprise' END,
       'member', 1
FROM customer WHERE c_mktsegment IN ('MACHINERY', 'AUTOMOBILE')""",
    ),
]


def with_roles(body: str) -> str:
    """Prefix ``body`` (a query that may start with its own WITH) with the role CTEs."""
    roles = ",\n".join(f"{name} AS (\n{sql}\n)" for name, sql in ROLE_CTES)
    stripped = body.lstrip()
    if stripped[:4].upper() == "WITH":
        return f"WITH {roles},\n{stripped[4:].lstrip()}"
    return f"WITH {roles}\n{stripped}"
