"""Oracle SQL (DuckDB dialect) for every SQL-checkable query key.

Each entry is an independent formulation of the key's result over the
business views (``oracle_views.with_views`` prefixes the view CTEs). The
Spark side is written with the DataFrame API or Spark SQL; only the rounding
helpers are shared, because both engines must round the same way.
"""

from __future__ import annotations

from ..functions.exact import dround_sql as dr
from ..functions.exact import ratio_round_sql as rr
from .oracle_views import with_views

MONTH = "STRFTIME(start_date, '%Y-%m')"
B = "CAST({} AS BIGINT)".format

ORACLE: dict[str, str] = {}


def oracle(key: str):
    def deco(fn):
        ORACLE[key] = fn
        return fn
    return deco


# --------------------------------------------------------------------------
# profiling
# --------------------------------------------------------------------------
_TABLE_COLS = {"accounts": 9, "subscriptions": 12, "feature_usage": 8, "support": 8,
               "churn_events": 5}


@oracle("profile_row_counts")
def _():
    return "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, COUNT(*) AS n_rows, CAST({n} AS BIGINT) AS n_columns FROM {t}"
        for t, n in _TABLE_COLS.items())


@oracle("profile_fk")
def _():
    parts = ["SELECT 'accounts' AS table_name, 'account_id' AS key_name, "
             "COUNT(DISTINCT account_id) AS distinct_keys, CAST(NULL AS BIGINT) AS orphans FROM accounts"]
    for child, ck, parent, pk in [("subscriptions", "account_id", "accounts", "account_id"),
                                  ("feature_usage", "subscription_id", "subscriptions", "subscription_id"),
                                  ("support", "account_id", "accounts", "account_id"),
                                  ("churn_events", "account_id", "accounts", "account_id")]:
        parts.append(
            f"SELECT '{child}', '{ck}', (SELECT COUNT(*) FROM (SELECT DISTINCT {ck} FROM {child})), "
            f"(SELECT COUNT(*) FROM (SELECT DISTINCT {ck} AS k FROM {child} "
            f"EXCEPT SELECT {pk} FROM {parent}))")
    return "\nUNION ALL\n".join(parts)


@oracle("profile_fanout")
def _():
    parts = []
    for rel, tbl, k in [("subscriptions_per_account", "subscriptions", "account_id"),
                        ("usage_events_per_subscription", "feature_usage", "subscription_id"),
                        ("tickets_per_account", "support", "account_id")]:
        parts.append(f"SELECT '{rel}' AS relation, COUNT(DISTINCT {k}) AS parents, "
                     f"CAST(COUNT({k}) AS DOUBLE) / COUNT(DISTINCT {k}) AS avg_children FROM {tbl}")
    return "\nUNION ALL\n".join(parts)


@oracle("profile_date_ranges")
def _():
    parts = []
    for t, c in [("accounts", "signup_date"), ("subscriptions", "start_date"),
                 ("feature_usage", "usage_date"), ("support", "submitted_at"),
                 ("churn_events", "churn_date")]:
        parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
                     f"CAST(MIN({c}) AS DATE) AS min_date, CAST(MAX({c}) AS DATE) AS max_date FROM {t}")
    return "\nUNION ALL\n".join(parts)


@oracle("account_distribution")
def _():
    return "\nUNION ALL\n".join(
        f"SELECT '{d}' AS dimension, {d} AS value, COUNT(*) AS n_accounts FROM accounts "
        f"WHERE {d} IS NOT NULL GROUP BY {d}"
        for d in ["plan_tier", "industry", "referral_source"])


@oracle("account_status")
def _():
    return f"""
SELECT total_accounts, active_accounts, churned_accounts, trial_accounts,
       {rr('active_accounts', 'total_accounts', 1, 100)} AS active_pct,
       {rr('churned_accounts', 'total_accounts', 1, 100)} AS churned_pct,
       {rr('trial_accounts', 'total_accounts', 1, 100)} AS trial_pct
FROM (SELECT COUNT(*) AS total_accounts,
             COUNT(*) FILTER (WHERE NOT churn_flag) AS active_accounts,
             COUNT(*) FILTER (WHERE churn_flag) AS churned_accounts,
             COUNT(*) FILTER (WHERE is_trial) AS trial_accounts
      FROM accounts)"""


@oracle("reactivation_share")
def _():
    return f"""
SELECT churn_events, reactivations, {rr('reactivations', 'churn_events', 1, 100)} AS reactivation_pct
FROM (SELECT COUNT(*) AS churn_events,
             COUNT(*) FILTER (WHERE is_reactivation) AS reactivations FROM churn_events)"""


@oracle("expansion_universe")
def _():
    return ("SELECT * FROM accounts WHERE churn_flag = FALSE "
            "AND plan_tier IN ('Basic', 'Pro')")


@oracle("subscription_summary")
def _():
    return f"""
SELECT *, {rr('active_subscriptions', 'total_subscriptions', 1, 100)} AS active_pct,
          {rr('churned_subscriptions', 'total_subscriptions', 1, 100)} AS churned_pct,
          {rr('upgraded_subscriptions', 'total_subscriptions', 1, 100)} AS upgraded_pct,
          {rr('downgraded_subscriptions', 'total_subscriptions', 1, 100)} AS downgraded_pct
FROM (SELECT COUNT(*) AS total_subscriptions,
             COUNT(*) FILTER (WHERE end_date IS NULL) AS active_subscriptions,
             COUNT(*) FILTER (WHERE churn_flag) AS churned_subscriptions,
             COUNT(*) FILTER (WHERE upgrade_flag) AS upgraded_subscriptions,
             COUNT(*) FILTER (WHERE downgrade_flag) AS downgraded_subscriptions,
             MIN(mrr_amount) AS min_mrr, MAX(mrr_amount) AS max_mrr,
             AVG(mrr_amount) AS avg_mrr
      FROM subscriptions)"""


@oracle("avg_mrr_by_tier")
def _():
    return (f"SELECT plan_tier, {rr('SUM(mrr_amount)', 'COUNT(mrr_amount)', 0)} AS avg_mrr "
            "FROM subscriptions WHERE plan_tier IS NOT NULL GROUP BY plan_tier")


# --------------------------------------------------------------------------
# revenue
# --------------------------------------------------------------------------
ACTIVE_PAID = "(SELECT * FROM subscriptions WHERE mrr_amount > 0 AND end_date IS NULL)"
PAID = "(SELECT * FROM subscriptions WHERE mrr_amount > 0)"


@oracle("mrr_snapshot")
def _():
    return (f"SELECT COUNT(*) AS active_subscriptions, {B('SUM(mrr_amount)')} AS total_mrr, "
            f"{B('SUM(mrr_amount) * 12')} AS total_arr FROM {ACTIVE_PAID} s")


@oracle("mrr_by_plan")
def _():
    return f"""
SELECT plan_tier, total_mrr, {rr('total_mrr', 'subscriptions', 0)} AS avg_mrr, subscriptions,
       {rr('total_mrr', f'(SELECT SUM(mrr_amount) FROM {ACTIVE_PAID} x)', 1, 100)} AS pct_of_mrr
FROM (SELECT plan_tier, {B('SUM(mrr_amount)')} AS total_mrr, COUNT(*) AS subscriptions
      FROM {ACTIVE_PAID} s GROUP BY plan_tier)"""


@oracle("monthly_mrr")
def _():
    return f"""
SELECT month, new_mrr,
       {B('SUM(new_mrr) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS cumulative_mrr
FROM (SELECT {MONTH} AS month, {B('SUM(mrr_amount)')} AS new_mrr FROM {PAID} s GROUP BY 1)"""


_NRR_SELECT = f"""
  starting_mrr, expansion_mrr, churned_mrr, contraction_mrr,
  starting_mrr + expansion_mrr - churned_mrr - contraction_mrr AS ending_mrr,
  {rr('starting_mrr + expansion_mrr - churned_mrr - contraction_mrr', 'starting_mrr', 1, 100)} AS nrr_pct"""
_NRR_AGGS = f"""
  {B('SUM(mrr_amount)')} AS starting_mrr,
  {B('COALESCE(SUM(mrr_amount) FILTER (WHERE upgrade_flag), 0)')} AS expansion_mrr,
  {B('COALESCE(SUM(mrr_amount) FILTER (WHERE churn_flag), 0)')} AS churned_mrr,
  {B('COALESCE(SUM(mrr_amount) FILTER (WHERE downgrade_flag), 0)')} AS contraction_mrr"""


@oracle("nrr")
def _():
    return f"SELECT {_NRR_SELECT} FROM (SELECT {_NRR_AGGS} FROM {PAID} s)"


@oracle("sql_nrr")
def _():
    """Own formulation: one row per combination of flags, weighted by the flags."""
    return f"""
WITH g AS (SELECT CAST(upgrade_flag AS BIGINT) AS up, CAST(churn_flag AS BIGINT) AS ch, CAST(downgrade_flag AS BIGINT) AS dn,
                  SUM(mrr_amount) AS m FROM subscriptions WHERE mrr_amount > 0 GROUP BY ALL),
w AS (SELECT {B('SUM(m)')} AS starting_mrr, {B('COALESCE(SUM(m * up), 0)')} AS expansion_mrr,
             {B('COALESCE(SUM(m * ch), 0)')} AS churned_mrr, {B('COALESCE(SUM(m * dn), 0)')} AS contraction_mrr,
             {B('SUM(m * (1 + up - ch - dn))')} AS ending_mrr FROM g)
SELECT *, {dr('ending_mrr * 100.0 / starting_mrr', 1)} AS nrr_pct FROM w"""


@oracle("nrr_by_segment")
def _():
    parts = []
    for d in ["industry", "plan_tier"]:
        parts.append(f"""
SELECT '{d}' AS dimension, seg AS segment, {_NRR_SELECT}
FROM (SELECT seg, {_NRR_AGGS}
      FROM (SELECT s.mrr_amount, s.upgrade_flag, s.churn_flag, s.downgrade_flag, a.{d} AS seg
            FROM {PAID} s JOIN accounts a ON s.account_id = a.account_id) x
      WHERE seg IS NOT NULL GROUP BY seg)""")
    return "\nUNION ALL\n".join(parts)


def _rate_sql(key: str, src: str) -> str:
    return f"""
SELECT {key}, total, upgrades, {rr('upgrades', 'total', 1, 100)} AS upgrade_rate_pct
FROM (SELECT {key}, COUNT(subscription_id) AS total,
             COUNT(*) FILTER (WHERE upgrade_flag) AS upgrades
      FROM {src} WHERE {key} IS NOT NULL GROUP BY {key})"""


@oracle("upgrade_rate_by_plan")
def _():
    return _rate_sql("plan_tier", PAID + " s")


@oracle("upgrade_rate_by_industry")
def _():
    return _rate_sql("industry", f"(SELECT s.subscription_id, s.upgrade_flag, a.industry FROM {PAID} s "
                                 "LEFT JOIN accounts a ON s.account_id = a.account_id) x")


@oracle("upgrade_rate_by_referral")
def _():
    return _rate_sql("referral_source",
                     f"(SELECT s.subscription_id, s.upgrade_flag, a.referral_source FROM {PAID} s "
                     "LEFT JOIN accounts a ON s.account_id = a.account_id) x")


TIER_AVG = f"""tier_avg AS (
  SELECT plan_tier, {rr('SUM(mrr_amount)', 'COUNT(*)', 0)} AS avg_mrr
  FROM {ACTIVE_PAID} s GROUP BY plan_tier),
uplift AS (
  SELECT 'Basic' AS plan_tier, 'Pro' AS next_tier,
         CAST((SELECT avg_mrr FROM tier_avg WHERE plan_tier = 'Pro')
            - (SELECT avg_mrr FROM tier_avg WHERE plan_tier = 'Basic') AS BIGINT) AS mrr_uplift
  UNION ALL
  SELECT 'Pro', 'Enterprise',
         CAST((SELECT avg_mrr FROM tier_avg WHERE plan_tier = 'Enterprise')
            - (SELECT avg_mrr FROM tier_avg WHERE plan_tier = 'Pro') AS BIGINT))"""


@oracle("expansion_opportunity")
def _():
    return f"""
WITH {TIER_AVG},
motions AS (
  SELECT u.plan_tier || ' -> ' || u.next_tier AS motion, c.accounts, u.mrr_uplift AS avg_mrr_uplift,
         c.accounts * u.mrr_uplift AS opportunity_mrr
  FROM uplift u JOIN (SELECT plan_tier, COUNT(*) AS accounts FROM accounts
                      WHERE NOT churn_flag AND plan_tier IN ('Basic', 'Pro') GROUP BY plan_tier) c
    ON u.plan_tier = c.plan_tier),
allm AS (
  SELECT * FROM motions
  UNION ALL
  SELECT 'Total', {B('SUM(accounts)')}, CAST(NULL AS BIGINT), {B('SUM(opportunity_mrr)')} FROM motions)
SELECT motion, accounts, avg_mrr_uplift, opportunity_mrr, opportunity_mrr * 12 AS opportunity_arr,
       CAST(opportunity_mrr * 15 AS DOUBLE) / 100 AS target_mrr_15pct,
       CAST(opportunity_mrr * 180 AS DOUBLE) / 100 AS target_arr_15pct
FROM allm"""


# --------------------------------------------------------------------------
# the five SQL queries
# --------------------------------------------------------------------------
@oracle("sql_mrr_by_plan_month")
def _():
    return f"""
WITH per_month_tier AS (
  SELECT {MONTH} AS month, plan_tier, COUNT(*) AS subscriptions, {B('SUM(mrr_amount)')} AS total_mrr
  FROM {ACTIVE_PAID} s GROUP BY ALL),
month_total AS (SELECT month, SUM(total_mrr) AS month_mrr FROM per_month_tier GROUP BY month)
SELECT p.month, p.plan_tier, p.subscriptions, p.total_mrr,
       {rr('p.total_mrr', 'p.subscriptions', 0)} AS avg_mrr,
       {rr('p.total_mrr', 'm.month_mrr', 1, 100)} AS pct_of_month_mrr
FROM per_month_tier p JOIN month_total m ON p.month = m.month"""


@oracle("sql_upgrade_by_segment")
def _():
    ups = "COUNT(*) FILTER (WHERE s.upgrade_flag)"
    return f"""
SELECT a.industry, a.referral_source,
       COUNT(DISTINCT s.account_id) AS total_accounts,
       COUNT(*) AS total_subscriptions,
       {ups} AS upgrades,
       {rr(ups, 'COUNT(*)', 1, 100)} AS upgrade_rate_pct,
       {rr('SUM(s.mrr_amount)', 'COUNT(*)', 0)} AS avg_mrr
FROM {PAID} s JOIN accounts a ON a.account_id = s.account_id
GROUP BY ALL"""


# usage of live subscriptions (trials included) of known accounts, per account
_LIVE_USAGE = f"""live_usage AS (
  SELECT s.account_id, u.usage_count, u.usage_duration_secs, u.feature_name, u.error_count
  FROM feature_usage u JOIN subscriptions s ON u.subscription_id = s.subscription_id
  WHERE s.end_date IS NULL AND s.account_id IN (SELECT account_id FROM accounts)),
usage_by_account AS (
  SELECT account_id, {B('SUM(usage_count)')} AS usage_count, {B('SUM(usage_duration_secs)')} AS duration,
         COUNT(DISTINCT feature_name) AS features, {B('SUM(error_count)')} AS errors
  FROM live_usage GROUP BY account_id),
tickets_by_account AS (
  SELECT account_id, COUNT(*) AS tickets,
         {rr('SUM(satisfaction_score)', 'COUNT(satisfaction_score)', 2)} AS satisfaction,
         COUNT(*) FILTER (WHERE escalation_flag) AS escalations
  FROM support GROUP BY account_id)"""


@oracle("sql_account_summary")
def _():
    return f"""
WITH live_paid AS (
  SELECT account_id, COUNT(*) AS n_subscriptions, {B('SUM(mrr_amount)')} AS total_mrr,
         {B('SUM(seats)')} AS total_seats,
         MAX(CASE WHEN upgrade_flag THEN 1 ELSE 0 END) AS has_upgraded,
         MAX(CASE WHEN downgrade_flag THEN 1 ELSE 0 END) AS has_downgraded
  FROM {ACTIVE_PAID} s GROUP BY account_id),
{_LIVE_USAGE}
SELECT a.account_id, a.account_name, a.industry, a.plan_tier, a.referral_source, a.churn_flag,
       p.n_subscriptions, p.total_mrr, p.total_seats, p.has_upgraded, p.has_downgraded,
       COALESCE(u.usage_count, 0) AS total_usage_count,
       COALESCE(u.duration, 0) AS total_usage_duration,
       COALESCE(u.features, 0) AS unique_features_used,
       COALESCE(u.errors, 0) AS total_errors,
       COALESCE(k.tickets, 0) AS n_tickets,
       COALESCE(k.satisfaction, 0) AS avg_satisfaction,
       COALESCE(k.escalations, 0) AS n_escalations
FROM accounts a
LEFT JOIN live_paid p USING (account_id)
LEFT JOIN usage_by_account u USING (account_id)
LEFT JOIN tickets_by_account k USING (account_id)
WHERE NOT a.churn_flag"""


def sql_targets_body(limit: int | None = 20) -> str:
    # weight in percent over the amount that earns it: 40 / 100000, 30 / 500, 20 / 50000, 10 / 20
    score = " + ".join(f"CAST({w} AS DECIMAL(6,4)) * CAST({x} AS DECIMAL(24,0))" for w, x in [
        ("0.0004", "COALESCE(u.duration, 0)"), ("0.06", "p.total_seats"), ("0.0004", "p.total_mrr"),
        ("0.5", "p.n_subscriptions")])
    tail = f"ORDER BY sql_expansion_score DESC, a.account_id LIMIT {limit}" if limit else ""
    return f"""
WITH live_paid AS (
  SELECT account_id, COUNT(*) AS n_subscriptions, {B('SUM(mrr_amount)')} AS total_mrr,
         {B('SUM(seats)')} AS total_seats
  FROM {ACTIVE_PAID} s GROUP BY account_id),
{_LIVE_USAGE}
SELECT a.account_id, a.account_name, a.industry, a.plan_tier, a.referral_source,
       p.total_mrr, p.total_seats, p.n_subscriptions,
       COALESCE(u.duration, 0) AS total_usage_duration,
       COALESCE(u.features, 0) AS unique_features_used,
       COALESCE(k.satisfaction, 0) AS avg_satisfaction,
       COALESCE(k.escalations, 0) AS n_escalations,
       CAST(ROUND({score}, 1) AS DOUBLE) AS sql_expansion_score
FROM accounts a
JOIN live_paid p ON p.account_id = a.account_id
LEFT JOIN usage_by_account u ON u.account_id = a.account_id
LEFT JOIN tickets_by_account k ON k.account_id = a.account_id
WHERE NOT a.churn_flag AND a.plan_tier IN ('Basic', 'Pro')
{tail}"""


@oracle("sql_top_targets")
def _():
    return sql_targets_body(20)


@oracle("mrr_month_pivot")
def _():
    cols = ", ".join(f"{B(f'SUM(mrr_amount) FILTER (WHERE plan_tier = {chr(39)}{t}{chr(39)})')} AS {t}"
                     for t in ["Basic", "Pro", "Enterprise"])
    return f"SELECT {MONTH} AS month, {cols} FROM {ACTIVE_PAID} s GROUP BY 1"


def oracle_sql() -> dict[str, str]:
    from . import oracle_model  # noqa: F401  (registers the model-side oracles)
    return {k: with_views(fn() if callable(fn) else fn) for k, fn in ORACLE.items()}
