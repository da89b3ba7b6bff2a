"""Oracle SQL (DuckDB) for the feature table, signals, model, scoring and
target-list keys."""

from __future__ import annotations

from ..functions.exact import dround_sql as dr
from ..functions.exact import ratio_round_sql as rr
from ..operators import model as M
from ..operators import period_kpis as K
from ..operators import signals as S
from ..operators.snapshots import LAGS
from ..operators.targets import KPI_TARGETS, OUTREACH
from .oracle import ORACLE, oracle, _NRR_AGGS, _NRR_SELECT, PAID, sql_targets_body

B = "CAST({} AS BIGINT)".format

# The driver tables are TPC-H-style; the categorical vocabularies of the
# business views are therefore fixed: market segments, region names, tiers.
VOCAB = {
    "plan_tier": ["Basic", "Enterprise", "Pro"],
    "industry": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "referral_source": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"],
}
NAMES = M.feature_names(VOCAB)

ACC = ["account_id", "account_name", "industry", "country", "referral_source", "plan_tier",
       "signup_date", "is_trial", "churn_flag"]
SUBF = ["total_mrr", "avg_mrr", "max_mrr", "total_seats", "avg_seats", "n_subscriptions",
        "has_upgraded", "has_downgraded", "is_annual", "auto_renew"]
USEF = ["total_usage_count", "avg_usage_count", "total_usage_duration", "unique_features_used",
        "total_errors", "beta_feature_usage"]
SUPF = ["n_tickets", "avg_satisfaction", "avg_resolution_hours", "n_escalations", "n_urgent"]
ZERO = ["total_usage_count", "unique_features_used", "total_errors", "beta_feature_usage",
        "n_tickets", "n_escalations", "n_urgent"]


def _median(col: str, rel: str) -> str:
    return (f"(SELECT (percentile_disc(0.5) WITHIN GROUP (ORDER BY {col}) "
            f"- percentile_disc(0.5) WITHIN GROUP (ORDER BY -{col})) / 2 FROM {rel})")


def feature_ctes(p: str = "f", universe: bool = False, lag_days: int | None = None) -> str:
    """CTEs ending in ``{p}_feat``: the filled account feature table."""
    pop_where = "WHERE NOT churn_flag AND plan_tier IN ('Basic', 'Pro')" if universe else ""
    in_pop = f"AND account_id IN (SELECT account_id FROM {p}_pop)" if universe else ""
    base = "SELECT * FROM accounts"
    if lag_days is None:
        active, ucut, scut = "end_date IS NULL", "", ""
    else:
        cut = f"(SELECT MAX(start_date) - {lag_days} FROM subscriptions)"
        # accounts of that date: signed up, and churned or not by the last event until then
        latest = "CAST(datediff('day', DATE '1970-01-01', churn_date) AS HUGEINT) * 1000000000000 + churn_event_id"
        base = f"""SELECT * FROM (SELECT a.* REPLACE (CASE WHEN e.n_before > 0 THEN e.churned WHEN e.n > 0 THEN FALSE
                                   ELSE a.churn_flag END AS churn_flag)
           FROM accounts a LEFT JOIN (
             SELECT account_id, COUNT(churn_date) AS n, COUNT(*) FILTER (WHERE churn_date <= {cut}) AS n_before,
                    arg_max(NOT is_reactivation, {latest}) FILTER (WHERE churn_date <= {cut}) AS churned
             FROM churn_events GROUP BY account_id) e ON a.account_id = e.account_id
           WHERE a.signup_date <= {cut}) acc"""
        active = f"start_date <= {cut} AND (end_date IS NULL OR end_date > {cut})"
        ucut = f"AND u.usage_date <= {cut}"
        scut = f"AND CAST(submitted_at AS DATE) <= {cut}"
    fill = []
    for c in ACC + SUBF + USEF + SUPF:
        if c in ZERO:
            fill.append(f"COALESCE({c}, 0) AS {c}")
        elif c in ("avg_satisfaction", "avg_resolution_hours"):
            fill.append(f"COALESCE({c}, {_median(c, p + '_raw')}) AS {c}")
        else:
            fill.append(c)
    return f"""
{p}_pop AS ({base} {pop_where}),
{p}_aps AS (SELECT * FROM subscriptions WHERE mrr_amount > 0 AND {active} {in_pop}),
{p}_sf AS (
  SELECT account_id, {B('SUM(mrr_amount)')} AS total_mrr, AVG(mrr_amount) AS avg_mrr,
         MAX(mrr_amount) AS max_mrr, {B('SUM(seats)')} AS total_seats, AVG(seats) AS avg_seats,
         COUNT(subscription_id) AS n_subscriptions, BOOL_OR(upgrade_flag) AS has_upgraded,
         BOOL_OR(downgrade_flag) AS has_downgraded, BOOL_OR(billing_frequency = 'annual') AS is_annual,
         BOOL_OR(auto_renew_flag) AS auto_renew
  FROM {p}_aps GROUP BY account_id),
{p}_uf AS (
  SELECT s.account_id, {B('SUM(u.usage_count)')} AS total_usage_count, AVG(u.usage_count) AS avg_usage_count,
         {B('SUM(u.usage_duration_secs)')} AS total_usage_duration,
         COUNT(DISTINCT u.feature_name) AS unique_features_used,
         {B('SUM(u.error_count)')} AS total_errors,
         COUNT(*) FILTER (WHERE u.is_beta_feature) AS beta_feature_usage
  FROM feature_usage u JOIN {p}_aps s ON u.subscription_id = s.subscription_id
  WHERE TRUE {ucut} GROUP BY s.account_id),
{p}_pf AS (
  SELECT account_id, COUNT(ticket_id) AS n_tickets, AVG(satisfaction_score) AS avg_satisfaction,
         AVG(resolution_time_hours) AS avg_resolution_hours,
         COUNT(*) FILTER (WHERE escalation_flag) AS n_escalations,
         COUNT(*) FILTER (WHERE priority = 'urgent') AS n_urgent
  FROM support WHERE TRUE {in_pop} {scut} GROUP BY account_id),
{p}_raw AS (
  SELECT {', '.join('a.' + c for c in ACC)}, {', '.join('sf.' + c for c in SUBF)},
         {', '.join('uf.' + c for c in USEF)}, {', '.join('pf.' + c for c in SUPF)}
  FROM {p}_pop a
  LEFT JOIN {p}_sf sf ON a.account_id = sf.account_id
  LEFT JOIN {p}_uf uf ON a.account_id = uf.account_id
  LEFT JOIN {p}_pf pf ON a.account_id = pf.account_id),
{p}_feat AS (SELECT {', '.join(fill)} FROM {p}_raw)"""


def _enc_cols() -> list[str]:
    cols = [f"COALESCE(CAST({f} AS DOUBLE), 0.0) AS {f}" for f in M.NUM_FEATURES]
    for c in M.CAT_FEATURES:
        for v in VOCAB[c]:
            cols.append(f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS {M.dummy_name(c, v)}")
    return cols


SPLIT = ("row_number() OVER (PARTITION BY has_upgraded ORDER BY md5(concat(CAST(account_id AS VARCHAR), '-42'))) "
         "<= (2 * COUNT(*) OVER (PARTITION BY has_upgraded) + 5) // 10")


def model_ctes(p: str = "f", lag_days: int | None = None) -> str:
    """Feature CTEs plus ``{p}_enc`` (encoded), ``{p}_lab`` (labelled, split),
    ``{p}_st`` (one row of train statistics)."""
    split = SPLIT
    stats = ", ".join(f"AVG({f}) AS m_{f}, STDDEV_POP({f}) AS s_{f}" for f in NAMES)
    return f"""{feature_ctes(p, False, lag_days)},
{p}_enc AS (SELECT account_id, CAST(has_upgraded AS INTEGER) AS has_upgraded, {', '.join(_enc_cols())}
            FROM {p}_feat),
{p}_lab AS (SELECT *, {split} AS is_test FROM {p}_enc WHERE has_upgraded IS NOT NULL),
{p}_st AS (SELECT {stats} FROM {p}_lab WHERE NOT is_test)"""


def zexpr(f: str, src: str = None, st: str = "st") -> str:
    x = src or f
    return (f"(({x}) - {st}.m_{f}) / (CASE WHEN {st}.s_{f} = 0 OR {st}.s_{f} IS NULL THEN 1.0 "
            f"ELSE {st}.s_{f} END)")


def logit_sql(zname) -> str:
    expr = f"CAST({M.PUBLISHED_INTERCEPT!r} AS DOUBLE)"
    for f in NAMES:
        b = M.PUBLISHED_COEFFICIENTS.get(f, 0.0)
        if b != 0.0:
            expr = f"{expr} + CAST({b!r} AS DOUBLE) * {zname(f)}"
    return expr


def _phi(f: str, zname) -> str:
    return f"CAST({M.PUBLISHED_COEFFICIENTS.get(f, 0.0)!r} AS DOUBLE) * {zname(f)}"


def test_scores_ctes() -> str:
    zs = ", ".join(f"{zexpr(f)} AS z_{f}" for f in NAMES)
    return f"""{model_ctes()},
t_z AS (SELECT l.account_id, l.has_upgraded, {zs}
        FROM f_lab l CROSS JOIN f_st st WHERE l.is_test),
t_sc AS (SELECT account_id, has_upgraded,
                {dr(logit_sql(lambda f: 'z_' + f), 6)} AS logit,
                {dr('1.0 / (1.0 + exp(-(' + logit_sql(lambda f: 'z_' + f) + ')))', 6)} AS probability
         FROM t_z),
t_scores AS (SELECT *, CAST(probability > 0.5 AS INTEGER) AS predicted FROM t_sc)"""


def universe_ctes(p: str = "u", lag_days: int | None = None, train: str = "f") -> str:
    """Universe features scored with the train statistics of ``{train}_st``:
    ``{p}_scored`` with z__*, logit, probability, score, band."""
    enc = {f: f"COALESCE(CAST({f} AS DOUBLE), 0.0)" for f in M.NUM_FEATURES}
    for c in M.CAT_FEATURES:
        for v in VOCAB[c]:
            enc[M.dummy_name(c, v)] = f"(CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END)"
    zs = ", ".join(f"{zexpr(f, enc[f])} AS z__{f}" for f in NAMES)
    lg = logit_sql(lambda f: "z__" + f)
    score = dr(f"1.0 / (1.0 + exp(-({lg}))) * 100", 1)
    return f"""{feature_ctes(p, True, lag_days)},
{p}_z AS (SELECT x.*, {zs} FROM {p}_feat x CROSS JOIN {train}_st st),
{p}_s1 AS (SELECT *, {lg} AS logit,
                  {dr(f'1.0 / (1.0 + exp(-({lg})))', 6)} AS upgrade_probability,
                  {score} AS expansion_readiness_score
           FROM {p}_z),
{p}_scored AS (SELECT *, CASE WHEN expansion_readiness_score > 0 AND expansion_readiness_score <= 25 THEN 'Low'
                              WHEN expansion_readiness_score > 25 AND expansion_readiness_score <= 50 THEN 'Medium'
                              WHEN expansion_readiness_score > 50 AND expansion_readiness_score <= 75 THEN 'High'
                              WHEN expansion_readiness_score > 75 AND expansion_readiness_score <= 100 THEN 'Very High'
                         END AS readiness_band
               FROM {p}_s1)"""


def reasons_ctes(p: str = "u") -> str:
    rows = "\n    UNION ALL\n".join(
        f"SELECT account_id, {i} AS pos, '{f}' AS name, CAST({_phi(f, lambda g: 'z__' + g)} AS DECIMAL(38,6)) AS phi "
        f"FROM {p}_scored" for i, f in enumerate(NAMES))
    return f"""{p}_phi AS ({rows}),
{p}_rk AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY abs(phi) DESC, pos) AS rk FROM {p}_phi),
{p}_reasons AS (
  SELECT account_id,
         string_agg(name || ' (' || CASE WHEN phi > 0 THEN '+' ELSE '-' END
                    || CAST(CAST(ROUND(ABS(phi), 2) AS DECIMAL(38,2)) AS VARCHAR) || ')', ' | ' ORDER BY rk)
           AS top_shap_reasons
  FROM {p}_rk WHERE rk <= 3 GROUP BY account_id)"""


OUT = ["account_id", "account_name", "industry", "country", "plan_tier", "referral_source",
       "total_mrr", "total_seats", "total_usage_count", "unique_features_used", "avg_satisfaction",
       "n_escalations"]


def scored_ctes() -> str:
    up = """tier_avg AS (
  SELECT plan_tier, CAST(ROUND(SUM(mrr_amount) / COUNT(*)) AS BIGINT) AS avg_mrr
  FROM subscriptions WHERE mrr_amount > 0 AND end_date IS NULL GROUP BY plan_tier),
uplift AS (
  SELECT 'Basic' AS plan_tier,
         (SELECT avg_mrr FROM tier_avg WHERE plan_tier = 'Pro') - (SELECT avg_mrr FROM tier_avg WHERE plan_tier = 'Basic') AS potential_mrr_uplift
  UNION ALL
  SELECT 'Pro', (SELECT avg_mrr FROM tier_avg WHERE plan_tier = 'Enterprise') - (SELECT avg_mrr FROM tier_avg WHERE plan_tier = 'Pro'))"""
    prio = "CASE " + " ".join(f"WHEN s.readiness_band = '{b}' THEN '{lab}'" for b, lab in OUTREACH.items()) + " END"
    return f"""{model_ctes()},
{universe_ctes()},
{reasons_ctes()},
{up},
scored AS (
  SELECT {', '.join('s.' + c for c in OUT)}, s.has_upgraded, s.upgrade_probability, s.expansion_readiness_score,
         s.readiness_band, r.top_shap_reasons, up.potential_mrr_uplift,
         up.potential_mrr_uplift * 12 AS potential_arr_uplift, {prio} AS outreach_priority
  FROM u_scored s JOIN u_reasons r ON s.account_id = r.account_id
  LEFT JOIN uplift up ON s.plan_tier = up.plan_tier)"""


def W(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


# --------------------------------------------------------------------------
# features
# --------------------------------------------------------------------------
@oracle("features_subscription")
def _():
    return W(feature_ctes(), "SELECT * FROM f_sf")


@oracle("features_usage")
def _():
    return W(feature_ctes(), "SELECT * FROM f_uf")


@oracle("features_support")
def _():
    return "SELECT * FROM (WITH " + feature_ctes() + " SELECT * FROM f_pf) x"


@oracle("account_features")
def _():
    return W(feature_ctes(), "SELECT * FROM f_feat")


@oracle("universe_features")
def _():
    return W(feature_ctes("u", True), "SELECT * FROM u_feat")


@oracle("null_audit")
def _():
    cols = ACC + SUBF + USEF + SUPF
    parts = " UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count FROM f_feat"
                               for c in cols)
    return W(feature_ctes(), f"SELECT * FROM ({parts}) n WHERE null_count > 0")


def _cohort(metrics: list[str]) -> str:
    parts = []
    for m in metrics:
        up = f"AVG(CASE WHEN has_upgraded THEN CAST({m} AS DOUBLE) END)"
        no = f"AVG(CASE WHEN NOT has_upgraded THEN CAST({m} AS DOUBLE) END)"
        parts.append(f"SELECT '{m}' AS metric, {up} AS up, {no} AS not_up FROM f_feat")
    body = f"""SELECT metric, {dr('up', 4)} AS upgraded, {dr('not_up', 4)} AS not_upgraded,
       {dr('(up - not_up) / NULLIF(not_up, 0) * 100', 1)} AS diff_pct
FROM ({' UNION ALL '.join(parts)}) c"""
    return W(feature_ctes(), body)


ORACLE["cohort_usage"] = lambda: _cohort(S.COHORT_USAGE)
ORACLE["cohort_support"] = lambda: _cohort(S.COHORT_SUPPORT)
ORACLE["cohort_seats"] = lambda: _cohort(S.COHORT_SEATS)


@oracle("account_upgrade_rate")
def _():
    parts = " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {d} AS value, COUNT(*) AS accounts, "
        f"COUNT(*) FILTER (WHERE has_upgraded) AS upgraded FROM f_feat "
        f"WHERE {d} IS NOT NULL AND has_upgraded IS NOT NULL GROUP BY {d}" for d in S.PROFILE_DIMS)
    return W(feature_ctes(), f"SELECT *, {rr('upgraded', 'accounts', 1, 100)} AS upgrade_rate_pct FROM ({parts}) r")


@oracle("box_stats")
def _():
    parts = " UNION ALL ".join(
        f"SELECT has_upgraded AS upgraded, '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM f_feat "
        f"WHERE has_upgraded IS NOT NULL AND {m} IS NOT NULL" for m in S.BOX_METRICS)
    return W(feature_ctes(), f"""
SELECT upgraded, metric, COUNT(*) AS n, MIN(v) AS min,
       {dr('quantile_cont(v, 0.25)', 6)} AS q1, {dr('quantile_cont(v, 0.5)', 6)} AS median,
       {dr('quantile_cont(v, 0.75)', 6)} AS q3, MAX(v) AS max
FROM ({parts}) l GROUP BY upgraded, metric""")


def _corr_body() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, corr(CAST({c} AS DOUBLE), CAST(has_upgraded AS DOUBLE)) AS r FROM f_feat"
        for c in S.CORRELATION_FEATURES)
    return f"SELECT feature, {dr('abs(r)', 6)} AS correlation, CAST(SIGN(r) AS DOUBLE) AS direction FROM ({parts}) c"


@oracle("label_correlation")
def _():
    return W(feature_ctes(), _corr_body())


@oracle("label_correlation_top5")
def _():
    return W(feature_ctes(), f"""
SELECT *, correlation > 0.1 AS is_strong FROM ({_corr_body()}) c
ORDER BY correlation DESC, feature LIMIT 5""")


@oracle("upgrade_by_usage_quartile")
def _():
    x = "CAST(total_usage_duration AS DOUBLE)"
    return W(feature_ctes(), f"""
edges AS (SELECT quantile_cont({x}, 0.25) AS e1, quantile_cont({x}, 0.5) AS e2,
                 quantile_cont({x}, 0.75) AS e3 FROM f_feat WHERE total_usage_duration IS NOT NULL),
q AS (SELECT f.*, 1 + CAST({x} > e1 AS INTEGER) + CAST({x} > e2 AS INTEGER) + CAST({x} > e3 AS INTEGER) AS quartile
      FROM f_feat f CROSS JOIN edges WHERE total_usage_duration IS NOT NULL)
SELECT quartile, COUNT(*) AS accounts, MIN(total_usage_duration) AS min_value,
       MAX(total_usage_duration) AS max_value, COUNT(has_upgraded) AS labelled,
       COUNT(*) FILTER (WHERE has_upgraded) AS upgraded,
       {rr('COUNT(*) FILTER (WHERE has_upgraded)', 'COUNT(has_upgraded)', 1, 100)} AS upgrade_rate_pct
FROM q GROUP BY quartile""".replace("\nedges AS", ", edges AS", 1))


@oracle("usage_p90_trigger")
def _():
    x = "CAST(total_usage_duration AS DOUBLE)"
    return W(feature_ctes("u", True), f"""
, thr AS (SELECT quantile_cont({x}, 0.9) AS t FROM u_feat WHERE total_usage_duration IS NOT NULL)
SELECT account_id, account_name, plan_tier, total_usage_duration, {dr('t', 6)} AS threshold
FROM u_feat CROSS JOIN thr WHERE total_usage_duration IS NOT NULL AND {x} >= t""")


@oracle("usage_stream")
def _():
    return f"""
WITH u AS (
  SELECT s.account_id, u.usage_date, u.usage_duration_secs AS d
  FROM feature_usage u JOIN subscriptions s ON u.subscription_id = s.subscription_id
  WHERE s.mrr_amount > 0 AND s.end_date IS NULL),
m AS (SELECT account_id, STRFTIME(usage_date, '%Y-%m') AS month, SUM(d) AS d FROM u GROUP BY 1, 2),
thr AS (SELECT quantile_cont(CAST(d AS DOUBLE), 0.9) AS v FROM m),
daily AS (SELECT account_id, usage_date, SUM(d) AS d FROM u GROUP BY 1, 2),
w AS (SELECT account_id, CAST(usage_date - CAST(k AS INTEGER) AS DATE) AS start_day, d
      FROM daily CROSS JOIN range(30) AS r(k)),
s AS (SELECT account_id, start_day, SUM(d) AS d FROM w GROUP BY 1, 2)
SELECT account_id, MIN(start_day) AS first_window_start, COUNT(*) AS windows_over,
       {B('MAX(d)')} AS peak_usage_duration, {dr('MAX(v)', 6)} AS threshold
FROM s, thr WHERE d >= v GROUP BY account_id"""


@oracle("usage_live_threshold")
def _():
    return f"""
SELECT COUNT(*) AS account_months, {dr('quantile_cont(CAST(d AS DOUBLE), 0.9)', 6)} AS threshold, TRUE AS live_within_error
FROM (SELECT s.account_id, STRFTIME(u.usage_date, '%Y-%m') AS month, SUM(u.usage_duration_secs) AS d
      FROM feature_usage u JOIN subscriptions s ON u.subscription_id = s.subscription_id
      WHERE s.mrr_amount > 0 AND s.end_date IS NULL GROUP BY 1, 2) m"""


@oracle("usage_decline")
def _():
    return f"""
WITH m AS (
  SELECT s.account_id, STRFTIME(u.usage_date, '%Y-%m') AS month, {B('SUM(u.usage_duration_secs)')} AS duration
  FROM feature_usage u JOIN subscriptions s ON u.subscription_id = s.subscription_id
  WHERE s.mrr_amount > 0 AND s.end_date IS NULL
  GROUP BY 1, 2),
w AS (SELECT *, lag(month) OVER (PARTITION BY account_id ORDER BY month) AS prev_month,
             lag(duration) OVER (PARTITION BY account_id ORDER BY month) AS prev_duration,
             row_number() OVER (PARTITION BY account_id ORDER BY month DESC) AS rn_desc
      FROM m)
SELECT account_id, month, duration, prev_month, prev_duration,
       {rr('prev_duration - duration', 'prev_duration', 1, 100)} AS decline_pct
FROM w WHERE rn_desc = 1 AND duration < prev_duration"""


@oracle("early_warning")
def _():
    return f"""
WITH aps AS (SELECT * FROM subscriptions WHERE mrr_amount > 0 AND end_date IS NULL),
m AS (SELECT s.account_id, date_trunc('month', u.usage_date) AS month, {B('SUM(u.usage_duration_secs)')} AS duration
      FROM feature_usage u JOIN aps s ON u.subscription_id = s.subscription_id GROUP BY 1, 2),
thr AS (SELECT quantile_cont(CAST(duration AS DOUBLE), 0.9) AS t FROM m),
since AS (SELECT account_id, MIN(d) AS first FROM (
            SELECT account_id, date_trunc('month', start_date) AS d FROM aps
            UNION ALL SELECT account_id, month FROM m) x GROUP BY account_id),
cal AS (SELECT DISTINCT unnest(generate_series((SELECT MIN(first) FROM since)::TIMESTAMP,
                                               (SELECT MAX(month) FROM m)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month),
sp AS (SELECT s.account_id, c.month, COALESCE(m.duration, 0) AS duration
       FROM since s JOIN cal c ON c.month >= s.first LEFT JOIN m ON m.account_id = s.account_id AND m.month = c.month),
w AS (SELECT *, lag(duration) OVER (PARTITION BY account_id ORDER BY month) AS prev,
             row_number() OVER (PARTITION BY account_id ORDER BY month DESC) AS back FROM sp),
a AS (SELECT account_id, COUNT(*) AS n, MAX(month) AS month, MAX(duration) FILTER (WHERE back = 1) AS duration,
             MAX(prev) FILTER (WHERE back = 1) AS prev_duration,
             MIN(back) FILTER (WHERE prev IS NULL OR duration >= prev) - 1 AS months_declining,
             COALESCE(MIN(back) FILTER (WHERE duration > 0) - 1, COUNT(*)) AS months_silent
      FROM w GROUP BY account_id),
r AS (SELECT a.*, t, CASE WHEN months_silent > 0 THEN 'silent'
                          WHEN months_declining > 0 AND duration < t THEN 'declining' END AS status FROM a, thr)
SELECT account_id, status, STRFTIME(month, '%Y-%m') AS month, duration, prev_duration,
       {rr('prev_duration - duration', 'prev_duration', 1, 100)} AS decline_pct,
       CAST(months_declining AS INTEGER) AS months_declining, CAST(months_silent AS INTEGER) AS months_silent,
       {dr('t', 6)} AS threshold
FROM r WHERE status IS NOT NULL"""


@oracle("kpi_by_period")
def _():
    def part(kind: str, everyone: bool) -> str:
        period = "STRFTIME(month, '%Y-%m')" if kind == "month" else "concat(year(month), '-Q', quarter(month))"
        who = "'All'" if everyone else "industry"
        return (f"SELECT '{kind}' AS period_type, {period} AS period, {who} AS industry, SUM(started) AS started, "
                f"SUM(upgraded) AS upgraded, SUM(pro) AS pro, SUM(pro_up) AS pro_up, SUM(exp) AS exp, "
                f"SUM(con) AS con, SUM(churned) AS churned FROM filled GROUP BY 1, 2, 3")
    rolled = " UNION ALL ".join(part(k, e) for k in ("month", "quarter") for e in (True, False))
    rows = [("expansion_mrr", "CAST(exp AS DOUBLE)", f"CASE WHEN industry = 'All' THEN {K.MONTHLY_EXPANSION_MRR!r} * k END", ">="),
            ("contraction_mrr", "CAST(con AS DOUBLE)", f"CASE WHEN industry = 'All' THEN {K.MONTHLY_CONTRACTION_MRR!r} * k END", "<="),
            ("churned_mrr", "CAST(churned AS DOUBLE)", "NULL", ">="),
            ("upgrade_conversion_pct", rr("upgraded", "started", 1, 100),
             "CASE industry WHEN 'HealthTech' THEN 12.0 END", ">="),
            ("pro_conversion_pct", rr("pro_up", "pro", 1, 100),
             f"CASE WHEN industry = 'All' AND k = 3 THEN {K.QUARTERLY_PRO_CONVERSION_PCT!r} END", ">=")]
    out = " UNION ALL ".join(
        f"SELECT period_type, period, industry, '{n}' AS kpi, {a} AS actual, CAST({g} AS DOUBLE) AS target, "
        f"{a} {op} CAST({g} AS DOUBLE) AS met FROM p" for n, a, g, op in rows)
    return f"""
WITH s AS (SELECT x.*, COALESCE(a.industry, 'unknown') AS industry
           FROM subscriptions x JOIN accounts a ON a.account_id = x.account_id WHERE mrr_amount > 0),
ev AS (SELECT industry, date_trunc('month', start_date)::DATE AS month, 1 AS started, CAST(upgrade_flag AS BIGINT) AS upgraded,
              CAST(plan_tier = 'Pro' AS BIGINT) AS pro, CAST(plan_tier = 'Pro' AND upgrade_flag AS BIGINT) AS pro_up,
              CASE WHEN upgrade_flag THEN mrr_amount ELSE 0 END AS exp,
              CASE WHEN downgrade_flag THEN mrr_amount ELSE 0 END AS con, 0 AS churned FROM s
       UNION ALL SELECT industry, date_trunc('month', end_date)::DATE, 0, 0, 0, 0, 0, 0, mrr_amount FROM s
       WHERE end_date IS NOT NULL),
cal AS (SELECT unnest(generate_series((SELECT MIN(month) FROM ev)::TIMESTAMP, (SELECT MAX(month) FROM ev)::TIMESTAMP,
                                      INTERVAL 1 MONTH))::DATE AS month),
filled AS (SELECT * FROM ev UNION ALL
           SELECT i.industry, c.month, 0, 0, 0, 0, 0, 0, 0 FROM (SELECT DISTINCT industry FROM ev) i CROSS JOIN cal c),
p AS (SELECT *, CASE period_type WHEN 'quarter' THEN 3 ELSE 1 END AS k FROM ({rolled}) r)
{out}"""


# --------------------------------------------------------------------------
# model
# --------------------------------------------------------------------------
@oracle("class_balance")
def _():
    return W(feature_ctes(), "SELECT has_upgraded, COUNT(*) AS accounts FROM f_feat "
                             "WHERE has_upgraded IS NOT NULL GROUP BY has_upgraded")


@oracle("one_hot")
def _():
    return W(model_ctes(), "SELECT * FROM f_enc")


@oracle("train_test_split")
def _():
    return W(model_ctes(), "SELECT account_id, has_upgraded, is_test FROM f_lab")


_OFFSET = len(M.NUM_FEATURES)


def dictionary_ctes() -> str:
    """Category values numbered after the numeric inputs, with the training
    rows' share and the standard deviation of their indicator."""
    cats = " UNION ALL ".join(f"SELECT {i} AS pos, '{c}' AS cat, f.{c} AS value, l.is_test IS FALSE AS in_train "
                              f"FROM f_feat f LEFT JOIN f_lab l ON f.account_id = l.account_id"
                              for i, c in enumerate(M.CAT_FEATURES))
    return f"""{model_ctes()},
d_n AS (SELECT COUNT(*) AS n FROM f_lab WHERE NOT is_test),
d_v AS (SELECT pos, cat, value, COUNT(*) FILTER (WHERE in_train) AS n_train
        FROM ({cats}) v WHERE value IS NOT NULL GROUP BY pos, cat, value),
d AS (SELECT cat, value, row_number() OVER (ORDER BY pos, value) - 1 + {_OFFSET} AS idx, n_train,
             n_train / n AS mean,
             CASE WHEN n_train IN (0, n) THEN 1.0 ELSE sqrt((n_train / n) * (1 - n_train / n)) END AS std
      FROM d_v, d_n)"""


@oracle("category_dictionary")
def _():
    return W(dictionary_ctes(), f"SELECT cat, value, idx, n_train, {dr('mean', 6)} AS mean, {dr('std', 6)} AS std FROM d")


@oracle("sparse_features")
def _():
    nums = " UNION ALL ".join(f"SELECT l.account_id, CAST({i} AS BIGINT) AS idx, {zexpr(f, 'l.' + f)} AS value "
                              f"FROM f_lab l CROSS JOIN f_st st" for i, f in enumerate(M.NUM_FEATURES))
    cats = " UNION ALL ".join(f"SELECT l.account_id, d.idx, 1 / d.std AS value FROM f_lab l "
                              f"JOIN f_feat f ON l.account_id = f.account_id "
                              f"JOIN d ON d.cat = '{c}' AND d.value = f.{c}" for c in M.CAT_FEATURES)
    return W(dictionary_ctes(), f"SELECT account_id, idx, {dr('value', 6)} AS value FROM ({nums} UNION ALL {cats}) e "
                                "WHERE value <> 0")


@oracle("lr_gradient")
def _():
    """At the optimum every component rounds to 0."""
    nums = " UNION ALL ".join(f"SELECT '{f}' AS feature" for f in [*M.NUM_FEATURES, "intercept"])
    return W(dictionary_ctes(), f"SELECT feature, CAST(0 AS DOUBLE) AS abs_gradient FROM "
                                f"({nums} UNION ALL SELECT concat(cat, '=', value) FROM d) f")


@oracle("class_weights")
def _():
    return W(model_ctes(), """
SELECT has_upgraded, COUNT(*) AS n, (SELECT COUNT(*) FROM f_lab WHERE NOT is_test) / (2 * COUNT(*)) AS weight
FROM f_lab WHERE NOT is_test GROUP BY has_upgraded""")


@oracle("standardized_features")
def _():
    zs = ", ".join(f"{dr(zexpr(f), 6)} AS z_{f}" for f in NAMES)
    return W(model_ctes(), f"SELECT l.account_id, l.has_upgraded, l.is_test, {zs} FROM f_lab l CROSS JOIN f_st st")


@oracle("engagement_score")
def _():
    e = f"({zexpr('total_usage_duration')} + {zexpr('total_usage_count')}) / 2"
    return W(model_ctes(), f"SELECT l.account_id, l.has_upgraded, {dr(e, 6)} AS engagement_score "
                           f"FROM f_lab l CROSS JOIN f_st st")


@oracle("linear_score")
def _():
    return W(test_scores_ctes(), "SELECT * FROM t_scores")


def _auc_body() -> str:
    return """
h AS (SELECT probability AS score, COUNT(*) FILTER (WHERE has_upgraded = 1) AS pos,
             COUNT(*) FILTER (WHERE has_upgraded = 0) AS neg FROM t_scores GROUP BY probability),
c AS (SELECT *, COALESCE(SUM(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM h)
SELECT """ + f"""{B('SUM(pos)')} AS positives, {B('SUM(neg)')} AS negatives,
       {dr('CAST(SUM(2 * pos * neg_below + pos * neg) AS DOUBLE) / (2.0 * CAST(SUM(pos) AS DOUBLE) * CAST(SUM(neg) AS DOUBLE))', 6)} AS auc
FROM c"""


@oracle("auc")
def _():
    return W(test_scores_ctes() + ",", _auc_body())


@oracle("roc_curve")
def _():
    return W(test_scores_ctes() + ",", f"""
h AS (SELECT probability AS score, COUNT(*) FILTER (WHERE has_upgraded = 1) AS pos,
             COUNT(*) FILTER (WHERE has_upgraded = 0) AS neg FROM t_scores GROUP BY probability),
c AS (SELECT score,
             SUM(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
             SUM(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
             SUM(pos) OVER () AS P, SUM(neg) OVER () AS N FROM h)
SELECT score AS threshold, {dr('CAST(fp AS DOUBLE) / NULLIF(N, 0)', 6)} AS fpr,
       {dr('CAST(tp AS DOUBLE) / NULLIF(P, 0)', 6)} AS tpr FROM c
UNION ALL SELECT CAST(NULL AS DOUBLE), 0.0, 0.0""")


@oracle("classification_report")
def _():
    def ratio(a, b):
        return f"CAST({a} AS DOUBLE) / NULLIF({b}, 0)"
    p1, r1, f1 = ratio("tp", "tp + fp"), ratio("tp", "tp + fn"), ratio("2 * tp", "2 * tp + fp + fn")
    p0, r0, f0 = ratio("tn", "tn + fn"), ratio("tn", "tn + fp"), ratio("2 * tn", "2 * tn + fn + fp")
    s1, s0, n = "(tp + fn)", "(tn + fp)", "(tp + fp + fn + tn)"
    rows = [("0", p0, r0, f0, s0), ("1", p1, r1, f1, s1),
            ("accuracy", "NULL", "NULL", ratio("tp + tn", n), n),
            ("macro avg", f"({p0} + {p1}) / 2", f"({r0} + {r1}) / 2", f"({f0} + {f1}) / 2", n),
            ("weighted avg", f"(({p0}) * {s0} + ({p1}) * {s1}) / {n}",
             f"(({r0}) * {s0} + ({r1}) * {s1}) / {n}", f"(({f0}) * {s0} + ({f1}) * {s1}) / {n}", n)]
    sel = " UNION ALL ".join(
        f"SELECT '{nm}' AS class_label, {dr(a, 6)} AS precision, {dr(b, 6)} AS recall, "
        f"{dr(c, 6)} AS f1_score, CAST({d} AS BIGINT) AS support FROM cm" for nm, a, b, c, d in rows)
    return W(test_scores_ctes() + ",", f"""
cm AS (SELECT COUNT(*) FILTER (WHERE has_upgraded = 1 AND predicted = 1) AS tp,
              COUNT(*) FILTER (WHERE has_upgraded = 0 AND predicted = 1) AS fp,
              COUNT(*) FILTER (WHERE has_upgraded = 1 AND predicted = 0) AS fn,
              COUNT(*) FILTER (WHERE has_upgraded = 0 AND predicted = 0) AS tn FROM t_scores)
{sel}""")


@oracle("contribution_summary")
def _():
    zs = ", ".join(f"{zexpr(f)} AS z_{f}" for f in NAMES)
    parts = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, AVG(ABS({_phi(f, lambda g: 'z_' + g)})) AS a, "
        f"CAST({(1.0 if M.PUBLISHED_COEFFICIENTS.get(f, 0.0) > 0 else -1.0 if M.PUBLISHED_COEFFICIENTS.get(f, 0.0) < 0 else 0.0)!r} AS DOUBLE) AS direction FROM tz"
        for f in NAMES)
    return W(model_ctes() + f",\ntz AS (SELECT {zs} FROM f_lab l CROSS JOIN f_st st WHERE l.is_test)",
             f"SELECT feature, {dr('a', 6)} AS mean_abs_contribution, direction FROM ({parts}) s")


# --------------------------------------------------------------------------
# scoring
# --------------------------------------------------------------------------
def _U(body: str) -> str:
    return W(model_ctes() + ",\n" + universe_ctes(), body)


@oracle("readiness_score")
def _():
    return _U("SELECT account_id, upgrade_probability, expansion_readiness_score FROM u_scored")


@oracle("readiness_band")
def _():
    return _U("SELECT account_id, expansion_readiness_score, readiness_band FROM u_scored")


@oracle("contributions")
def _():
    phis = ", ".join(f"{dr(_phi(f, lambda g: 'z__' + g), 6)} AS phi_{f}" for f in NAMES)
    return _U(f"SELECT account_id, {dr('logit', 6)} AS logit, {phis} FROM u_scored")


@oracle("top_reasons")
def _():
    return W(model_ctes() + ",\n" + universe_ctes() + ",\n" + reasons_ctes(),
             "SELECT account_id, top_shap_reasons FROM u_reasons")


@oracle("scored_accounts")
def _():
    return W(scored_ctes(), f"SELECT {', '.join(OUT)}, upgrade_probability, expansion_readiness_score, "
                            "readiness_band, top_shap_reasons FROM scored")


@oracle("score_distribution")
def _():
    return _U(f"""SELECT readiness_band, COUNT(*) AS accounts, {dr('AVG(expansion_readiness_score)', 1)} AS avg_score,
       MIN(expansion_readiness_score) AS min_score, MAX(expansion_readiness_score) AS max_score
FROM u_scored WHERE readiness_band IS NOT NULL GROUP BY readiness_band""")


@oracle("top_scored")
def _():
    return W(scored_ctes(), """SELECT account_id, account_name, industry, plan_tier, total_mrr,
       expansion_readiness_score, readiness_band, top_shap_reasons
FROM scored ORDER BY expansion_readiness_score DESC, account_id LIMIT 10""")


@oracle("score_histogram")
def _():
    return _U("""SELECT CAST(LEAST(FLOOR(expansion_readiness_score / 5.0), 19) * 5 AS DOUBLE) AS bin_start,
       COUNT(*) AS accounts FROM u_scored GROUP BY 1""")


# --------------------------------------------------------------------------
# target list
# --------------------------------------------------------------------------
@oracle("score_by_plan")
def _():
    return _U(f"SELECT plan_tier, COUNT(*) AS accounts, {dr('AVG(expansion_readiness_score)', 1)} AS avg_score "
              "FROM u_scored GROUP BY plan_tier")


@oracle("target_uplift")
def _():
    return W(scored_ctes(), "SELECT account_id, plan_tier, readiness_band, potential_mrr_uplift, "
                            "potential_arr_uplift, outreach_priority FROM scored")


@oracle("tier_summary")
def _():
    return W(scored_ctes(), f"""SELECT outreach_priority, COUNT(*) AS accounts,
       {dr('AVG(expansion_readiness_score)', 1)} AS avg_score,
       {B('SUM(potential_mrr_uplift)')} AS total_mrr_uplift, {B('SUM(potential_arr_uplift)')} AS total_arr_uplift
FROM scored WHERE outreach_priority IS NOT NULL GROUP BY outreach_priority""")


@oracle("top_targets")
def _():
    return W(scored_ctes(), """SELECT account_id, account_name AS account, industry, plan_tier AS plan,
       total_mrr AS current_mrr, total_seats AS seats, total_usage_count AS usage_count,
       unique_features_used AS features_used, expansion_readiness_score AS readiness_score,
       outreach_priority AS priority
FROM scored WHERE readiness_band IN ('Very High', 'High')
ORDER BY expansion_readiness_score DESC, account_id LIMIT 20""")


@oracle("arr_opportunity")
def _():
    return W(scored_ctes(), f"""SELECT *, CAST(tier12_arr * 15 AS DOUBLE) / 100 AS tier12_target_arr_15pct,
       CAST(tier12_arr * 15 AS DOUBLE) / 1200 AS tier12_target_mrr_15pct
FROM (SELECT {B('SUM(potential_arr_uplift)')} AS total_addressable_arr,
             {B("COALESCE(SUM(potential_arr_uplift) FILTER (WHERE readiness_band IN ('Very High', 'High')), 0)")} AS tier12_arr,
             {B("COALESCE(SUM(potential_arr_uplift) FILTER (WHERE readiness_band = 'Very High'), 0)")} AS tier1_arr,
             COUNT(*) FILTER (WHERE readiness_band IN ('Very High', 'High')) AS tier12_accounts,
             COUNT(*) FILTER (WHERE readiness_band = 'Very High') AS tier1_accounts
      FROM scored) a""")


@oracle("arr_by_plan")
def _():
    return W(scored_ctes(), f"""SELECT plan_tier, COUNT(*) AS accounts, {dr('AVG(expansion_readiness_score)', 1)} AS avg_score,
       {B('SUM(potential_arr_uplift)')} AS total_arr_potential FROM scored GROUP BY plan_tier""")


@oracle("target_list")
def _():
    cols = ["account_id", "account_name", "industry", "country", "plan_tier", "total_mrr", "total_seats",
            "total_usage_count", "unique_features_used", "avg_satisfaction", "expansion_readiness_score",
            "readiness_band", "outreach_priority", "potential_mrr_uplift", "potential_arr_uplift"]
    return W(scored_ctes(), f"SELECT {', '.join(cols)} FROM scored")


@oracle("dual_top_overlap")
def _():
    return W(model_ctes() + ",\n" + universe_ctes(), f"""
mt AS (SELECT account_id, account_name, expansion_readiness_score FROM u_scored
       ORDER BY expansion_readiness_score DESC, account_id LIMIT 20),
st AS ({sql_targets_body(20)})
SELECT mt.account_id, mt.account_name, mt.expansion_readiness_score, st.sql_expansion_score
FROM mt JOIN st ON mt.account_id = st.account_id""".replace("\nmt AS", ", mt AS", 1))


@oracle("tier_transitions")
def _():
    return W(model_ctes() + ",\n" + universe_ctes() + ",\n" + universe_ctes("p", lag_days=180), f"""
, j AS (SELECT COALESCE(a.account_id, b.account_id) AS account_id, a.readiness_band AS prev_band,
             b.readiness_band AS cur_band, a.expansion_readiness_score AS prev_score,
             b.expansion_readiness_score AS cur_score
      FROM p_scored a FULL JOIN u_scored b ON a.account_id = b.account_id)
SELECT account_id, prev_band, cur_band, prev_score, cur_score,
       {dr('cur_score - prev_score', 1)} AS score_change,
       COALESCE(cur_band = 'Very High', FALSE) AND NOT COALESCE(prev_band = 'Very High', FALSE) AS entered_tier1
FROM j WHERE prev_band IS DISTINCT FROM cur_band""")


@oracle("conversion_by_tier")
def _():
    return W(scored_ctes(), f"""SELECT outreach_priority, COUNT(*) AS accounts, COUNT(has_upgraded) AS labelled,
       COUNT(*) FILTER (WHERE has_upgraded) AS converted,
       {rr('COUNT(*) FILTER (WHERE has_upgraded)', 'COUNT(has_upgraded)', 1, 100)} AS conversion_rate_pct
FROM scored WHERE outreach_priority IS NOT NULL GROUP BY outreach_priority""")


@oracle("score_history")
def _():
    lags = (*LAGS, 0)
    ctes = ",\n".join([model_ctes(), universe_ctes()] + [universe_ctes(f"h{n}", lag_days=n) for n in LAGS])
    return W(ctes, " UNION ALL ".join(
        f"""SELECT {n} AS snapshot, readiness_band, COUNT(*) AS accounts, {dr('AVG(expansion_readiness_score)', 1)} AS avg_score
FROM {f'h{n}' if n else 'u'}_scored WHERE readiness_band IS NOT NULL GROUP BY readiness_band""" for n in lags))


@oracle("tier_conversion_ratio")
def _():
    def one(band, what):
        return f"COUNT({what}) FILTER (WHERE readiness_band = '{band}')"
    up = "CASE WHEN has_upgraded THEN 1 END"
    return _U(f"""SELECT {rr('c1', 'n1', 1, 100)} AS tier1_pct, {rr('c3', 'n3', 1, 100)} AS tier3_pct,
       {rr('c1 * n3', 'c3 * n1', 2)} AS ratio, {rr('c1 * n3', 'c3 * n1', 2)} >= 2.0 AS ranks_well
FROM (SELECT {one('Very High', up)} AS c1, {one('Very High', 'has_upgraded')} AS n1,
             {one('Medium', up)} AS c3, {one('Medium', 'has_upgraded')} AS n3 FROM u_scored) r""")


@oracle("kpi_vs_target")
def _():
    t = KPI_TARGETS
    return f"""
WITH n AS (SELECT {_NRR_SELECT} FROM (SELECT {_NRR_AGGS} FROM {PAID} s) a),
pro AS (SELECT {rr("COUNT(*) FILTER (WHERE upgrade_flag)", 'COUNT(subscription_id)', 1, 100)} AS pro
        FROM {PAID} s WHERE plan_tier = 'Pro'),
k AS (SELECT 'expansion_mrr_converted' AS kpi, CAST(expansion_mrr AS DOUBLE) AS actual, {t['expansion_mrr_converted']!r} AS target, TRUE AS hib FROM n
      UNION ALL SELECT 'contraction_mrr', CAST(contraction_mrr AS DOUBLE), {t['contraction_mrr']!r}, FALSE FROM n
      UNION ALL SELECT 'nrr_pct', nrr_pct, {t['nrr_pct']!r}, TRUE FROM n
      UNION ALL SELECT 'pro_to_enterprise_conversion_pct', pro, {t['pro_to_enterprise_conversion_pct']!r}, TRUE FROM pro)
SELECT kpi, actual, CAST(target AS DOUBLE) AS target,
       CASE WHEN hib THEN actual >= target ELSE actual <= target END AS met FROM k"""


@oracle("model_drift")
def _():
    phis = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, AVG(ABS({_phi(f, lambda g: 'z_' + g)})) AS a FROM t_z" for f in NAMES)
    auc = _auc_body().replace("\nSELECT ", "\n, auc_row AS (SELECT ", 1) + ")"
    return W(test_scores_ctes() + ",", auc + f""",
cs AS (SELECT feature, {dr('a', 6)} AS m FROM ({phis}) p),
top AS (SELECT feature FROM cs ORDER BY m DESC, feature LIMIT 1)
SELECT auc, auc < 0.6 AS retrain, top.feature AS top_feature,
       'total_usage_duration' AS baseline_top_feature, top.feature <> 'total_usage_duration' AS top_feature_changed
FROM auc_row, top""")


@oracle("tier_summary_formatted")
def _():
    return W(scored_ctes(), f"""SELECT outreach_priority, COUNT(*) AS accounts,
       {dr('AVG(expansion_readiness_score)', 1)} AS avg_score,
       '$' || format('{{:,}}', CAST(SUM(potential_mrr_uplift) AS BIGINT)) AS total_mrr_uplift,
       '$' || format('{{:,}}', CAST(SUM(potential_arr_uplift) AS BIGINT)) AS total_arr_uplift
FROM scored WHERE outreach_priority IS NOT NULL GROUP BY outreach_priority""")


def _scores_ctes(lab: str, st: str, p: str) -> str:
    """Test-set z, scores and per-feature mean |contribution| for one
    labelled relation, standardised with the statistics row ``st``."""
    zs = ", ".join(f"{zexpr(f)} AS z_{f}" for f in NAMES)
    lg = logit_sql(lambda f: "z_" + f)
    phis = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, AVG(ABS({_phi(f, lambda g: 'z_' + g)})) AS a FROM {p}_z" for f in NAMES)
    return f"""{p}_z AS (SELECT l.has_upgraded, {zs} FROM {lab} l CROSS JOIN {st} st WHERE l.is_test),
{p}_sc AS (SELECT has_upgraded, {dr(f'1.0 / (1.0 + exp(-({lg})))', 6)} AS probability FROM {p}_z),
{p}_h AS (SELECT probability AS score, COUNT(*) FILTER (WHERE has_upgraded = 1) AS pos,
                 COUNT(*) FILTER (WHERE has_upgraded = 0) AS neg FROM {p}_sc GROUP BY probability),
{p}_c AS (SELECT *, COALESCE(SUM(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                 AS neg_below FROM {p}_h),
{p}_auc AS (SELECT {dr('CAST(SUM(2 * pos * neg_below + pos * neg) AS DOUBLE) / (2.0 * CAST(SUM(pos) AS DOUBLE) * CAST(SUM(neg) AS DOUBLE))', 6)} AS auc FROM {p}_c),
{p}_top AS (SELECT feature FROM (SELECT feature, {dr('a', 6)} AS m FROM ({phis}) x)
            ORDER BY m DESC, feature LIMIT 1)"""


@oracle("snapshot_drift")
def _():
    ctes = ",\n".join([model_ctes(), feature_ctes("g", False, 180).strip().rstrip(","),
                       f"""g_enc AS (SELECT account_id, CAST(has_upgraded AS INTEGER) AS has_upgraded, {', '.join(_enc_cols())} FROM g_feat),
g_lab AS (SELECT *, {SPLIT} AS is_test
          FROM g_enc WHERE has_upgraded IS NOT NULL)""",
                       _scores_ctes("f_lab", "f_st", "c"), _scores_ctes("g_lab", "f_st", "p")])
    return W(ctes, f"""
SELECT c_auc.auc AS auc, p_auc.auc AS prev_auc, c_auc.auc < {0.60!r} AS retrain,
       c_top.feature AS top_feature, p_top.feature AS prev_top_feature,
       c_top.feature <> p_top.feature AS top_feature_changed
FROM c_auc, p_auc, c_top, p_top""")
