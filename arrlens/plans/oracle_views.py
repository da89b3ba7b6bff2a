"""The five business views as SQL CTE text, for the DuckDB oracle.

Same definitions as ``arrlens.sources.fixtures`` (which builds them with the
DataFrame API), written as SQL over the driver's pre-registered tables.
"""

from __future__ import annotations

import re

VIEW_SQL = {
    "accounts": """
SELECT c.c_custkey AS account_id, c.c_name AS account_name,
       c.c_mktsegment AS industry, n.n_name AS country,
       CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE r.r_name END AS referral_source,
       CASE c.c_custkey % 3 WHEN 0 THEN 'Basic' WHEN 1 THEN 'Pro' ELSE 'Enterprise' END AS plan_tier,
       f.signup_date,
       c.c_custkey % 10 = 3 AS is_trial,
       c.c_acctbal < 1000 AS churn_flag
FROM customer c
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS signup_date
           FROM orders GROUP BY o_custkey) f ON c.c_custkey = f.o_custkey""",
    "subscriptions": """
SELECT o_orderkey AS subscription_id, o_custkey AS account_id,
       CAST(o_orderdate AS DATE) AS start_date,
       CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0
            THEN CAST(o_orderdate + INTERVAL 90 DAY AS DATE) END AS end_date,
       CASE (o_orderkey + o_custkey) % 3 WHEN 0 THEN 'Basic' WHEN 1 THEN 'Pro' ELSE 'Enterprise' END AS plan_tier,
       CASE WHEN o_orderkey % 10 = 7 THEN CAST(0 AS BIGINT)
            ELSE CAST(floor(o_totalprice / 500) AS BIGINT)
                 * (CASE (o_orderkey + o_custkey) % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 10 END) END AS mrr_amount,
       1 + (o_orderkey * 7) % 60 AS seats,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'annual' ELSE 'monthly' END AS billing_frequency,
       o_orderkey % 5 <> 0 AS auto_renew_flag,
       (o_orderkey * 13) % 100 < 4 + CAST(floor(o_totalprice / 50000) AS BIGINT) AS upgrade_flag,
       (o_orderkey * 17) % 100 < 4 AS downgrade_flag,
       (o_orderstatus = 'F' AND o_orderkey % 3 = 0) AS churn_flag
FROM orders""",
    "feature_usage": """
SELECT concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR), '-',
              CAST(l_partkey AS VARCHAR), '-', CAST(l_suppkey AS VARCHAR)) AS usage_id,
       l_orderkey AS subscription_id,
       CAST(l_shipdate AS DATE) AS usage_date,
       concat('feature_', CAST(l_partkey % 40 AS VARCHAR)) AS feature_name,
       CAST(l_quantity AS BIGINT) AS usage_count,
       CAST(floor(l_extendedprice / 10) AS BIGINT) AS usage_duration_secs,
       CASE WHEN l_returnflag = 'R' THEN CAST(l_linenumber % 3 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS error_count,
       l_partkey % 40 >= 36 AS is_beta_feature
FROM lineitem""",
    "support": """
SELECT event_id AS ticket_id,
       user_id * 10 + event_id % 10 AS account_id,
       ts AS submitted_at,
       CAST(floor(value) AS BIGINT) AS resolution_time_hours,
       CASE CAST(floor(event_id / 10) AS BIGINT) % 7 WHEN 0 THEN 'urgent' WHEN 1 THEN 'high'
            WHEN 2 THEN 'medium' ELSE 'low' END AS priority,
       CASE WHEN CAST(floor(event_id / 10) AS BIGINT) % 4 = 0 THEN NULL
            ELSE CAST(1 + CAST(floor(event_id / 10) AS BIGINT) % 5 AS DOUBLE) END AS satisfaction_score,
       value > 100 AS escalation_flag
FROM events WHERE event_type = 'error'""",
    "churn_events": """
SELECT event_id AS churn_event_id,
       user_id * 10 + event_id % 10 AS account_id,
       CAST(ts AS DATE) AS churn_date,
       CAST(floor(event_id / 10) AS BIGINT) % 10 = 0 AS is_reactivation,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS feedback_text
FROM events WHERE event_type = 'view'""",
}

_ORDER = ["accounts", "subscriptions", "feature_usage", "support", "churn_events"]


def with_views(body: str) -> str:
    """Prefix ``body`` with the business views it references, as CTEs.

    ``body`` may itself start with WITH; it is wrapped as a subquery so both
    levels of CTEs stay valid.
    """
    used = [v for v in _ORDER if re.search(rf"\b{v}\b", body)]
    if not used:
        return body
    ctes = ",\n".join(f"{v} AS ({VIEW_SQL[v]}\n)" for v in used)
    return f"WITH {ctes}\nSELECT * FROM (\n{body}\n) AS oracle_result"
