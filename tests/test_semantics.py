"""Edge cases of the analysis' semantics on hand-written frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrlens.functions.exact import dround_sql, ratio_round_sql
from arrlens.operators import features as FE
from arrlens.operators import model as M
from arrlens.operators import profile, revenue, signals
from arrlens.operators.scoring import ScoringRun
from arrlens.plans import sql_queries
from frames import acc, sub, tables, ticket, use


def one(spark, expr):
    return spark.sql(f"SELECT {expr} AS v").first()["v"]


# -- rounding ------------------------------------------------------------------
@pytest.mark.parametrize("num,den,digits,scale,expected", [
    (7, 2, 0, 1, 4.0), (-7, 2, 0, 1, -4.0), (1, 3, 1, 100, 33.3), (2, 3, 1, 100, 66.7),
    (1, 8, 2, 1, 0.13), (5, 0, 1, 100, None), (0, 5, 1, 100, 0.0),
])
def test_ratio_round_is_half_away_from_zero(spark, num, den, digits, scale, expected):
    assert one(spark, ratio_round_sql(str(num), str(den), digits, scale)) == expected


def test_dround_absorbs_binary_noise(spark):
    # 0.5145 * 100 is 51.449999... in binary; the decimal rendering is a tie
    assert one(spark, dround_sql("0.5145D * 100", 1)) == 51.5
    assert one(spark, dround_sql("-2.5D", 0)) == -3.0


# -- bands ---------------------------------------------------------------------
def test_band_edges_right_closed(spark):
    scores = [0.0, 0.1, 25.0, 25.1, 50.0, 50.1, 75.0, 75.1, 100.0, 100.1]
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    got = [r["b"] for r in df.select(M.readiness_band(F.col("s")).alias("b")).collect()]
    assert got == [None, "Low", "Low", "Medium", "Medium", "High", "High", "Very High",
                   "Very High", None]


# -- NRR -----------------------------------------------------------------------
def test_nrr_flags_are_not_exclusive(spark):
    t = tables(spark, [acc(1)], [sub(1, 1, mrr=100, up=True, down=True, churn=True),
                                 sub(2, 1, mrr=50), sub(3, 1, mrr=0, up=True)])
    r = revenue.nrr(t).first()
    assert (r.starting_mrr, r.expansion_mrr, r.churned_mrr, r.contraction_mrr) == (150, 100, 100, 100)
    assert r.ending_mrr == 50 and r.nrr_pct == 33.3
    s = sql_queries.nrr(t).first()
    assert s.asDict() == r.asDict()


# -- null group keys -----------------------------------------------------------
def test_null_referral_dropped_by_dataframe_metrics_kept_by_sql(spark):
    t = tables(spark, [acc(1, referral=None), acc(2, referral="R1")],
               [sub(1, 1, up=True), sub(2, 2)])
    df_rates = revenue.upgrade_rate_by_account_dim(t, "referral_source").collect()
    assert [r.referral_source for r in df_rates] == ["R1"]
    sql_rates = sql_queries.upgrade_by_segment(t).collect()
    assert sorted((r.referral_source or "") for r in sql_rates) == ["", "R1"]


# -- feature table ---------------------------------------------------------------
def test_feature_fills_and_label(spark):
    t = tables(
        spark,
        [acc(1), acc(2), acc(3), acc(4)],
        [sub(10, 1, mrr=100, up=True), sub(20, 2, ended=True), sub(30, 3, mrr=0),
         sub(40, 4, mrr=10)],
        [use("u1", 10, "f1", dur=5), use("u2", 10, "f1", dur=7), use("u3", 10, "f2", dur=1),
         use("u4", 20, "f1", dur=100)],
        [ticket(1, 1, sat=4.0), ticket(2, 1, sat=None), ticket(3, 2, sat=2.0), ticket(4, 3, sat=None)])
    f = {r.account_id: r for r in FE.account_features(t, materialize=False).collect()}
    a1 = f[1]
    assert a1.has_upgraded is True and a1.total_usage_duration == 13
    assert a1.unique_features_used == 2 and a1.n_tickets == 2 and a1.avg_satisfaction == 4.0
    # ended-only (2) and zero-MRR-only (3) accounts: no label, counts zero-filled
    assert f[2].has_upgraded is None and f[2].total_usage_count == 0
    assert f[3].n_subscriptions is None and f[3].n_tickets == 1
    # median over non-null account means {4.0, 2.0} -> 3.0 fills 3 (all null) and 4 (no ticket)
    assert f[3].avg_satisfaction == 3.0 and f[4].avg_satisfaction == 3.0


@pytest.mark.parametrize("values,expected", [([1.0, 2.0, 4.0, 10.0], 3.0), ([5.0, 1.0, 3.0], 3.0),
                                             ([None, None], None)])
def test_median_matches_pandas(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select(FE.median_col(df, "x").alias("m")).first()["m"]
    assert got == expected


# -- signals ---------------------------------------------------------------------
def test_cohort_zero_baseline_gives_null(spark):
    df = spark.createDataFrame([(True, 5), (False, 0)], "has_upgraded boolean, total_errors bigint")
    r = signals.cohort_comparison(df, ["total_errors"]).first()
    assert r.upgraded == 5.0 and r.not_upgraded == 0.0 and r.diff_pct is None


def test_quartiles_are_right_closed(spark):
    rows = [(i, float(i), i % 2 == 0) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "account_id bigint, total_usage_duration double, has_upgraded boolean")
    got = {r.quartile: r.accounts for r in signals.upgrade_by_usage_quartile(df).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 2}


# -- evaluation --------------------------------------------------------------------
def _scored(spark, pairs):
    return spark.createDataFrame(pairs, "has_upgraded int, probability double")


def test_auc_extremes(spark):
    assert M.auc(_scored(spark, [(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)])).first().auc == 1.0
    assert M.auc(_scored(spark, [(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)])).first().auc == 0.5
    assert M.auc(_scored(spark, [(1, 0.1), (0, 0.9)])).first().auc == 0.0


def test_roc_starts_at_origin_and_ends_at_one(spark):
    pts = M.roc_curve(_scored(spark, [(1, 0.9), (0, 0.7), (1, 0.4), (0, 0.1)])).collect()
    assert (None, 0.0, 0.0) in [(p.threshold, p.fpr, p.tpr) for p in pts]
    assert max((p.fpr, p.tpr) for p in pts) == (1.0, 1.0)


def test_classification_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (0, 1)], "has_upgraded int, predicted int")
    rep = {r.class_label: r for r in M.classification_report(df).collect()}
    assert rep["1"].precision == 0.5 and rep["1"].recall == 0.5 and rep["1"].support == 2
    assert rep["0"].precision == round(2 / 3, 6) and rep["accuracy"].f1_score == 0.6


def test_top_reasons_ties_keep_feature_order(spark):
    model = M.LinearModel({"a": 1.0, "b": -1.0, "c": 1.0, "d": 0.5}, 0.0)
    df = spark.createDataFrame([(0.5, 0.5, -0.25, 0.2)], "a double, b double, c double, d double")
    txt = df.select(M.top_reasons(model, ["a", "b", "c", "d"]).alias("r")).first().r
    assert txt == "a (+0.50) | b (-0.50) | c (-0.25)"


def test_scaler_constant_feature_divides_by_one(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, 3.0)], "k double, v double")
    sc = M.Scaler.fit(df, ["k", "v"])
    z = df.select(sc.z("k").alias("zk"), sc.z("v").alias("zv")).collect()
    assert [r.zk for r in z] == [0.0, 0.0] and [r.zv for r in z] == [-1.0, 1.0]


def test_unseen_category_encodes_to_zeros(spark):
    vocab = {"plan_tier": ["Basic", "Pro"], "industry": ["A"], "referral_source": ["R1"]}
    cols = M.encoded_columns(vocab)
    df = spark.createDataFrame([("Gold", "A", None)], "plan_tier string, industry string, referral_source string")
    row = df.select(*[cols[n].alias(n) for n in ["plan_tier_Basic", "plan_tier_Pro", "industry_A",
                                                  "referral_source_R1"]]).first()
    assert tuple(row) == (0, 0, 1, 0)


# -- the Spark ML fit equals the analysis' objective ------------------------------
def test_logistic_fit_matches_newton_solution(spark, sf_dir):
    from arrlens.sources.fixtures import Tables
    run = ScoringRun(Tables(spark, sf_dir))
    fitted = run.fitted()
    train = run.scaler.transform(run.train, [M.LABEL]).toPandas()
    X = train[run.names].to_numpy(float)
    y = train[M.LABEL].to_numpy(float)
    n, n1 = len(y), y.sum()
    w = np.where(y == 1, n / (2 * n1), n / (2 * (n - n1)))
    Xb = np.hstack([np.ones((n, 1)), X])
    beta = np.zeros(Xb.shape[1])
    reg = np.eye(Xb.shape[1]); reg[0, 0] = 0.0  # intercept unpenalised
    for _ in range(50):  # Newton on 1/2|b|^2 + sum w_i logloss_i
        p = 1 / (1 + np.exp(-Xb @ beta))
        g = Xb.T @ (w * (p - y)) + reg @ beta
        H = (Xb * (w * p * (1 - p))[:, None]).T @ Xb + reg
        beta -= np.linalg.solve(H, g)
    got = np.array([fitted.intercept] + [fitted.coefficients[f] for f in run.names])
    assert np.allclose(got, beta, atol=1e-4), np.abs(got - beta).max()


# -- cross-key identities on the fixture -----------------------------------------------
def test_identities(spark, sf_dir):
    from arrlens.sources.fixtures import Tables
    t = Tables(spark, sf_dir)
    n = revenue.nrr(t).first()
    assert n.asDict() == sql_queries.nrr(t).first().asDict()
    snap = revenue.mrr_snapshot(t).first()
    d1 = sql_queries.mrr_by_plan_month(t).agg(F.sum("total_mrr")).first()[0]
    assert d1 == snap.total_mrr
    last = revenue.monthly_mrr(t).orderBy(F.desc("month")).first()
    assert last.cumulative_mrr == n.starting_mrr
    run = ScoringRun(t)
    bands = run.score_distribution().agg(F.sum("accounts")).first()[0]
    scored = run.universe_scored
    assert bands == scored.where("expansion_readiness_score > 0").count()
    # logit = intercept + sum of contributions
    c = run.contributions().toPandas()
    phis = c[[x for x in c.columns if x.startswith("phi_")]].sum(axis=1)
    assert np.allclose(phis, c["logit"], atol=1e-5)


# -- plans -------------------------------------------------------------------------------
def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["sql_account_summary", "sql_top_targets", "scored_accounts",
                                 "target_list", "usage_decline", "nrr_by_segment", "auc"])
def test_plans_have_no_python_udf_or_cartesian(spark, sf_dir, key):
    import __spark_entry__ as entry
    plan = _plan(entry.queries()[key](spark, sf_dir))
    for bad in ["BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"]:
        assert bad not in plan, (key, bad)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    from arrlens.sources.fixtures import Tables
    df = revenue.mrr_snapshot(Tables(spark, sf_dir))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double,o_orderdate" in plan
    assert "o_orderpriority" not in plan


def test_readers_roundtrip_csv(spark, tmp_path):
    from arrlens.sources import readers
    from arrlens.sources.fixtures import Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    out = str(tmp_path / "subs")
    readers.write_table(t.subscriptions, out, fmt="csv")
    back = readers.read_csv_table(spark, "subscriptions", out)
    assert back.schema == readers.csv_schema("subscriptions")
    want = t.subscriptions.select(*[t.subscriptions[f.name].cast(f.dataType) for f in back.schema.fields])
    assert back.count() == want.count() and back.exceptAll(want).count() == 0


def test_csv_by_header_name(spark, tmp_path):
    from arrlens.sources import readers
    accounts = tmp_path / "accounts.csv"
    accounts.write_text("account_id,account_name,industry,country,signup_date,referral_source,plan_tier,extra,is_trial,churn_flag\n"
                        "A-2e4581,Company 0,EdTech,US,2024-10-16,partner,Basic,7,False,True\n"
                        "A-43a9e3,Company 1,,IN,not a date,event,Pro,8,True,False\n")
    rows = readers.read_csv_table(spark, "accounts", str(accounts)).orderBy("account_id").collect()
    assert [r.account_id for r in rows] == ["A-2e4581", "A-43a9e3"]
    assert rows[0].referral_source == "partner" and str(rows[0].signup_date) == "2024-10-16"
    assert rows[0].plan_tier == "Basic" and rows[0].churn_flag is True and rows[1].signup_date is None
    bad = {r.column: r.cells for r in readers.corrupt_cells(spark, "accounts", str(accounts)).collect()}
    assert bad.pop("signup_date") == 1 and set(bad.values()) == {0}
    tickets = tmp_path / "support.csv"
    tickets.write_text("ticket_id,account_id,submitted_at,closed_at,resolution_time_hours,priority,satisfaction_score,escalation_flag\n"
                       "T-1,A-2e4581,2024-01-02 03:04:05,2024-01-02 15:34:05,12.5,high,,False\n")
    row = readers.read_csv_table(spark, "support", str(tickets)).first()
    assert row.resolution_time_hours == 12.5 and row.satisfaction_score is None and row.submitted_at.hour == 3
    with pytest.raises(ValueError, match="churn_date"):
        readers.read_csv_table(spark, "churn_events", str(accounts))


@pytest.mark.parametrize("reuse", ["true", "false"])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_quantiles_are_exact(spark, reuse, adaptive):
    import numpy as np
    from arrlens.functions.quantiles import exact_quantiles
    rng = np.random.default_rng(4)
    data = {"a": rng.normal(0, 1e4, 3000), "b": np.r_[np.zeros(500), -rng.exponential(1e-6, 300), rng.integers(0, 5, 700)],
            "c": np.array([7.25])}
    df = spark.createDataFrame([(g, float(x)) for g, v in data.items() for x in v] + [("a", None)], "g string, x double")
    old = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = {(r.g, r.q): r.value for r in exact_quantiles(df.repartition(7), "x", [0.0, 0.25, 0.5, 0.9, 1.0], ["g"]).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(got) == 15
    for (g, q), v in got.items():
        assert v == pytest.approx(np.quantile(data[g], q), rel=1e-12, abs=1e-18)


def test_mean_usage_leaves_nulls_out(spark):
    from arrlens.operators import features
    usage = spark.createDataFrame([(1, "f", 10, 5, 0, False), (1, "f", None, 5, 0, False), (2, "g", None, 1, 0, True)],
                                  "subscription_id long, feature_name string, usage_count long, usage_duration_secs long, "
                                  "error_count long, is_beta_feature boolean")
    subs = spark.createDataFrame([(1, 1), (2, 2)], "subscription_id long, account_id long")
    got = {r.account_id: r.avg_usage_count for r in
           features.usage_signals(features.usage_by_account_feature(usage, subs)).collect()}
    assert got == {1: 10.0, 2: None}


def test_outputs_are_ordered(spark, sf_dir):
    import __spark_entry__ as entry
    for key in ("scored_accounts", "target_list"):
        scores = [r.expansion_readiness_score for r in entry.queries()[key](spark, sf_dir).collect()]
        assert scores == sorted(scores, reverse=True)
    mrr = [r.total_mrr for r in entry.queries()["sql_account_summary"](spark, sf_dir).collect()]
    filled = [m for m in mrr if m is not None]
    assert mrr == sorted(filled, reverse=True) + [None] * (len(mrr) - len(filled))


# -- more edge frames ---------------------------------------------------------------
def test_orphans_are_counted(spark):
    t = tables(spark, [acc(1)], [sub(10, 1), sub(20, 99)],
               [use("u1", 10), use("u2", 77), use("u3", 77)], [ticket(1, 1), ticket(2, 55)])
    got = {r.table_name: (r.distinct_keys, r.orphans) for r in profile.foreign_keys(t).collect()}
    assert got["subscriptions"] == (2, 1)
    assert got["feature_usage"] == (2, 1)
    assert got["support"] == (2, 1)
    assert got["accounts"] == (1, None)


def test_top_k_ties_broken_by_account_id(spark):
    model = M.LinearModel({}, 0.0)  # every account scores exactly 50.0
    t = tables(spark, [acc(i) for i in range(1, 31)], [sub(i, i) for i in range(1, 31)])
    run = ScoringRun(t, model=model)
    top = [r.account_id for r in run.top_scored(10).collect()]
    assert top == list(range(1, 11))
    sql_top = [r.account_id for r in sql_queries.top_targets(t, 5).collect()]
    assert sql_top == [1, 2, 3, 4, 5]


def test_single_class_training_is_rejected(spark):
    t = tables(spark, [acc(i) for i in range(1, 6)], [sub(i, i, up=False) for i in range(1, 6)])
    with pytest.raises(ValueError):
        ScoringRun(t).fitted()


def test_empty_tables(spark):
    t = tables(spark, [], [], [], [], [])
    r = revenue.nrr(t).first()
    assert r.starting_mrr is None and r.nrr_pct is None
    assert revenue.mrr_snapshot(t).first().active_subscriptions == 0
    assert FE.account_features(t, materialize=False).count() == 0
    assert signals.upgrade_by_usage_quartile(
        spark.createDataFrame([], "account_id bigint, total_usage_duration bigint, has_upgraded boolean")
    ).count() == 0


def test_auc_matches_spark_ml_evaluator(spark, sf_dir):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from arrlens.sources.fixtures import Tables
    run = ScoringRun(Tables(spark, sf_dir))
    scores = run.test_scores().select(F.col("has_upgraded").cast("double").alias("label"),
                                      F.col("probability").alias("raw"))
    ev = BinaryClassificationEvaluator(rawPredictionCol="raw", labelCol="label",
                                       metricName="areaUnderROC", numBins=0)
    assert abs(ev.evaluate(scores) - run.auc().first().auc) < 1e-6


def test_vocabulary_is_whole_and_names_differ(spark):
    values = [f"v{i}" for i in range(5000)] + ["A B", "A-B", "A_B", "A  B"]
    df = spark.createDataFrame([(v, "x", None) for v in values], "industry string, plan_tier string, referral_source string")
    vocab = M.vocabularies(df, ["industry", "plan_tier", "referral_source"])
    assert sorted(values) == vocab["industry"] and vocab["plan_tier"] == ["x"] and vocab["referral_source"] == []
    assert len({M.dummy_name("industry", v) for v in values}) == len(values)



# -- values at the edge of a type ---------------------------------------------------
INF = float("inf")


@pytest.mark.parametrize("values", [
    [1.0, float("nan"), 3.0], [INF, 1.0, 2.0], [-INF, 1.0, INF], [float("nan")] * 3, [INF, INF, None, 5.0],
    [-INF, -1e308, 5e-324, 0.0, -0.0, 1e308, INF], [-INF, INF],
])
def test_quantiles_with_nan_and_infinity(spark, values):
    """As pandas computes them: NaN left out, infinities ordered."""
    import pandas as pd
    from arrlens.functions.quantiles import exact_quantiles
    df = spark.createDataFrame([(v,) for v in values], "v double")
    s = pd.Series(values, dtype=float).dropna().sort_values().tolist()
    got = {r.q: r.value for r in exact_quantiles(df, "v", [0.0, 0.25, 0.5, 1.0]).collect()}
    med = [r.value for r in exact_quantiles(df, "v", [0.5], median=True).collect()]
    if not s:
        assert got == {} and med == []
        return
    for q, v in got.items():
        pos = q * (len(s) - 1)
        lo, hi = s[math.floor(pos)], s[math.ceil(pos)]
        want = lo if lo == hi else lo + (pos - math.floor(pos)) * (hi - lo)
        assert v == want or (math.isnan(v) and math.isnan(want)), (q, v, want)
    want = (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2
    assert med[0] == want or (math.isnan(med[0]) and math.isnan(want))


@pytest.mark.parametrize("num,den,scale", [(10 ** 16, 3, 100), (9 * 10 ** 18, 7, 1000), (5, 9 * 10 ** 18, 100)])
def test_ratio_round_of_large_numbers(spark, num, den, scale):
    got = one(spark, ratio_round_sql(f"CAST({num} AS BIGINT)", f"CAST({den} AS BIGINT)", 1, scale))
    assert got == pytest.approx(num * scale / den, rel=1e-12, abs=0.05)


def test_empty_sums_are_zero(spark):
    t = tables(spark, [acc(1)], [sub(10, 1, seats=None)], [use("u", 10, count=None, dur=None, err=None)])
    r = FE.raw_features(t).first()
    assert (r.total_seats, r.total_usage_count, r.total_usage_duration, r.total_errors) == (0, 0, 0, 0)
    assert r.avg_usage_count is None


def test_report_orders(spark, sf_dir):
    """The hash comparison with the oracles ignores the order of rows."""
    import __spark_entry__ as entry

    def rows(key):
        return entry.queries()[key](spark, sf_dir).collect()

    got = [(r.month, r.plan_tier) for r in rows("sql_mrr_by_plan_month")]
    assert got == sorted(got) and len(set(r[0] for r in got)) > 1
    got = [(r.dimension, -r.n_accounts, r.value) for r in rows("account_distribution")]
    assert got == sorted(got)
    for key, col in (("avg_mrr_by_tier", "avg_mrr"), ("score_by_plan", "avg_score")):
        got = [r[col] for r in rows(key)]
        assert got == sorted(got, reverse=True)
    got = [r.correlation for r in rows("label_correlation")]
    assert got == sorted(got)
