"""As-of snapshots, early warning, per-period KPIs, manifests and table scopes."""

import datetime as dt
import gc
import os
import shutil
import time

import pytest

from arrlens.operators import snapshots, targets
from arrlens.operators.early_warning import early_warning, usage_spine
from arrlens.operators.period_kpis import kpi_by_period
from arrlens.operators.scoring import ScoringRun
from arrlens.session import TableScope, manifest, materialize
from arrlens.sources.fixtures import SOURCES, Tables
from frames import tables


def d(text):
    return dt.date.fromisoformat(text)


def account(i, signup="2024-01-01", churn=False, industry="A", tier="Basic"):
    return (i, f"Co_{i}", industry, "X", "R", tier, d(signup) if signup else None, False, churn)


def subscription(sid, aid, start, end=None, mrr=100, tier="Basic", up=False, down=False):
    return (sid, aid, d(start), d(end) if end else None, tier, mrr, 1, "monthly", True, up, down, False)


def usage(uid, sid, day, dur):
    return (uid, sid, d(day), "f", 1, dur, 0, False)


def churn(cid, aid, day, back=False):
    return (cid, aid, d(day) if day else None, back, None)


def test_status_is_that_of_the_date(spark):
    t = tables(spark, [account(1, churn=True), account(2, churn=True), account(3), account(4, signup="2024-05-01"),
                       account(5, signup=None), account(6)],
               churn=[churn(1, 2, "2024-03-01"), churn(2, 2, "2024-04-01", back=True), churn(3, 3, "2024-04-10"),
                      churn(4, 6, "2024-03-01", back=True), churn(5, 6, "2024-03-01"), churn(6, 1, None)])
    dates = {n: d(x) for n, x in enumerate(["2024-02-01", "2024-03-01", "2024-04-01", "2024-04-30"])}
    got = {(r.account_id, r.snapshot): r.churn_flag for r in snapshots.accounts_asof(t, dates).collect()}
    want = {1: [True] * 4,                       # no dated event: today's flag
            2: [False, True, False, False],      # churned, then back
            3: [False, False, False, True],
            6: [False, True, True, True]}        # the last of two events on one day
    assert got == {(a, n): v for a, vs in want.items() for n, v in enumerate(vs)}   # 4 and 5 had not signed up


def test_one_pass_equals_separate_builds(spark):
    subs = [subscription(1, 1, "2024-01-05", "2024-02-10"), subscription(2, 1, "2024-02-01", mrr=50, up=True),
            subscription(3, 2, "2024-03-01"), subscription(4, 2, "2024-01-01", mrr=0)]
    use = [usage(f"u{k}", 1 + k % 3, str(d("2024-01-06") + dt.timedelta(days=3 * k)), k) for k in range(30)]
    t = tables(spark, [account(1), account(2)], subs, use)
    dates = {n: d(x) for n, x in enumerate(["2024-01-31", "2024-02-15", "2024-03-20"])}
    rows = {(r.snapshot, r.account_id): r for r in snapshots.raw_features(t, dates).collect()}
    assert len(rows) == 6
    for (n, a), r in rows.items():
        live = [s for s in subs if s[1] == a and s[5] > 0 and s[2] <= dates[n] and (s[3] is None or s[3] > dates[n])]
        seen = [u for u in use if u[1] in {s[0] for s in live} and u[2] <= dates[n]]
        assert r.total_mrr == (sum(s[5] for s in live) if live else None)
        assert r.total_usage_duration == (sum(u[5] for u in seen) if seen else None)
        assert r.has_upgraded == (any(s[9] for s in live) if live else None)


def test_rows_are_dealt_before_they_are_copied(spark):
    """What is shuffled does not grow with the number of dates: usage rows travel to their
    account as they are, and no sum by snapshot or feature is shuffled after that but for the joined tables."""
    import re
    subs = [subscription(1, 1, "2024-01-05", "2024-02-10"), subscription(2, 1, "2024-02-01"), subscription(3, 2, "2024-03-01")]
    use = [usage(f"u{k}", 1 + k % 3, str(d("2024-01-06") + dt.timedelta(days=k)), k) for k in range(90)]
    t = tables(spark, [account(1), account(2)], subs, use)
    dates = {n: d("2024-01-01") + dt.timedelta(days=n) for n in range(100)}   # more than a word has bits
    df = snapshots.raw_features(t, dates)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\([^)]*feature_name", plan)
    assert len(re.findall(r"Exchange hashpartitioning\(account_id#\d+L?, \d+\), REPARTITION_BY_NUM", plan)) == 3
    got = {(r.snapshot, r.account_id): (r.total_usage_duration, r.unique_features_used, r.n_subscriptions) for r in df.collect()}
    assert len(got) == 200
    for (n, a), row in got.items():
        live = {s[0] for s in subs if s[1] == a and s[2] <= dates[n] and (s[3] is None or s[3] > dates[n])}
        seen = [u for u in use if u[1] in live and u[2] <= dates[n]]
        assert row == (sum(u[5] for u in seen) if seen else None, 1 if seen else None, len(live) or None)


def test_snapshots_share_one_build(spark, sf_dir):
    run = ScoringRun(Tables(spark, sf_dir))
    assert set(run.earlier) == set(snapshots.LAGS)
    files = [set(r.raw_features.inputFiles()) for r in run.earlier.values()]
    assert all(f == files[0] for f in files)
    history = targets.score_history(run).collect()
    assert {r.snapshot for r in history} == {*snapshots.LAGS, 0}
    assert ScoringRun(tables(spark, [account(1)])).earlier == {}


def test_spine_fills_silent_months(spark):
    t = tables(spark, [account(i) for i in range(1, 7)],
               [subscription(10 * i, i, "2024-01-15") for i in range(1, 5)] +
               [subscription(50, 5, "2024-01-15", end="2024-02-01"), subscription(60, 6, "2024-06-01")],
               [usage("a1", 10, "2024-01-20", 50), usage("a2", 10, "2024-02-20", 40), usage("a4", 10, "2024-04-20", 30),
                usage("b1", 20, "2024-02-01", 90), usage("b2", 20, "2024-03-01", 80), usage("b3", 20, "2024-04-01", 70),
                usage("c1", 30, "2023-11-01", 10), usage("c2", 30, "2024-04-02", 1000), usage("c3", 30, "2024-03-02", 2000),
                usage("e1", 50, "2024-04-01", 5)])
    spine = {}
    for r in usage_spine(t).collect():
        spine.setdefault(r.account_id, {})[r.month - 12 * 2024] = r.duration
    assert spine == {1: {0: 50, 1: 40, 2: 0, 3: 30}, 2: {0: 0, 1: 90, 2: 80, 3: 70},
                     3: {-2: 10, -1: 0, 0: 0, 1: 0, 2: 2000, 3: 1000}, 4: {0: 0, 1: 0, 2: 0, 3: 0}}
    got = {r.account_id: r for r in early_warning(t, q=0.8).collect()}
    # 1 rose from a silent March; 3 fell but stays above the percentile; 6 begins after the last month
    assert set(got) == {2, 4}
    assert (got[2].status, got[2].months_declining, got[2].months_silent, got[2].decline_pct) == ("declining", 2, 0, 12.5)
    assert (got[4].status, got[4].months_silent, got[4].duration, got[4].prev_duration) == ("silent", 4, 0, 0)
    assert early_warning(tables(spark, [])).count() == 0
    # nothing used at all: there is no latest month to judge by
    assert early_warning(tables(spark, [account(1)], [subscription(1, 1, "2024-01-01")])).count() == 0


def test_kpis_by_period(spark):
    t = tables(spark, [account(1, industry="HealthTech"), account(2, industry="EdTech"), account(3, industry=None)],
               [subscription(1, 1, "2024-01-10", mrr=200_000, tier="Pro", up=True), subscription(2, 2, "2024-01-11", up=True),
                subscription(3, 2, "2024-04-01", end="2024-05-02", mrr=70, down=True), subscription(4, 3, "2024-04-02", mrr=0),
                subscription(5, 3, "2024-05-01", mrr=10)])
    rows = {(r.period_type, r.period, r.industry, r.kpi): r for r in kpi_by_period(t).collect()}
    assert {k[1] for k in rows if k[0] == "month"} == {f"2024-0{m}" for m in range(1, 6)}   # quiet months too
    assert {k[1] for k in rows if k[0] == "quarter"} == {"2024-Q1", "2024-Q2"}
    assert {k[2] for k in rows} == {"HealthTech", "EdTech", "unknown", "All"}

    def at(*key):
        r = rows[key]
        return r.actual, r.target, r.met

    assert at("month", "2024-01", "All", "expansion_mrr") == (200100.0, 107854.0, True)
    assert at("quarter", "2024-Q1", "All", "expansion_mrr") == (200100.0, 323562.0, False)
    assert at("month", "2024-02", "All", "expansion_mrr") == (0.0, 107854.0, False)
    assert at("month", "2024-02", "All", "contraction_mrr") == (0.0, 459366.0, True)
    assert at("month", "2024-01", "HealthTech", "upgrade_conversion_pct") == (100.0, 12.0, True)
    assert at("month", "2024-01", "EdTech", "upgrade_conversion_pct") == (100.0, 8.0, False)
    assert at("month", "2024-03", "EdTech", "upgrade_conversion_pct") == (None, 8.0, None)
    assert at("quarter", "2024-Q1", "All", "pro_conversion_pct") == (100.0, 15.0, True)
    assert at("month", "2024-01", "All", "pro_conversion_pct") == (100.0, None, None)
    assert at("month", "2024-05", "EdTech", "churned_mrr") == (70.0, None, None)
    assert at("month", "2024-04", "unknown", "upgrade_conversion_pct")[0] is None    # its subscription is free
    assert kpi_by_period(tables(spark, [account(1)])).count() == 0


def test_tier_ratio(spark, sf_dir):
    run = ScoringRun.shared(Tables(spark, sf_dir))
    r = targets.tier_conversion_ratio(run).first()
    by = {x.outreach_priority[:6]: x for x in targets.conversion_by_tier(run).collect()}
    one, three = by["Tier 1"], by["Tier 3"]
    assert (r.tier1_pct, r.tier3_pct) == (one.conversion_rate_pct, three.conversion_rate_pct)
    if three.converted:
        assert r.ratio == pytest.approx(one.converted / one.labelled / (three.converted / three.labelled), abs=0.006)


def copy_tables(sf_dir, to):
    to.mkdir()
    for n in SOURCES:
        shutil.copy(f"{sf_dir}/{n}.parquet", to / f"{n}.parquet")
    return str(to)


def test_changed_files_give_fresh_answers(spark, sf_dir, tmp_path):
    import __spark_entry__ as entry
    ours = copy_tables(sf_dir, tmp_path / "t")
    query = entry.queries()["class_balance"]
    first = query(spark, ours)
    before = sorted(map(tuple, first.collect()))
    run = ScoringRun.shared(Tables(spark, ours))
    paths = [p.removeprefix("file:") for p in run.scope.paths]
    assert paths and all(map(os.path.exists, paths))
    assert ScoringRun.shared(Tables(spark, ours)) is run
    half = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 2 = 0").toPandas()
    time.sleep(0.05)
    half.to_parquet(f"{ours}/orders.parquet", coerce_timestamps="us")
    second = query(spark, ours)
    assert sorted(map(tuple, second.collect())) != before
    # the first result still reads its own tables; they go with it
    assert sorted(map(tuple, first.collect())) == before and all(map(os.path.exists, paths))
    del first
    gc.collect()
    assert not any(map(os.path.exists, paths))
    ScoringRun.clear_shared()


def test_manifest_sees_added_and_rewritten_files(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "a"))
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "b"))
    paths = [str(tmp_path / "a"), str(tmp_path / "b")]
    one = manifest(spark, paths)
    assert manifest(spark, paths) == one
    spark.range(1).coalesce(1).write.mode("append").parquet(paths[1])
    two = manifest(spark, paths)
    assert two != one and two[0] > one[0]
    time.sleep(0.05)
    part = next(f for f in os.listdir(paths[0]) if f.endswith(".parquet"))
    os.utime(f"{paths[0]}/{part}")
    assert manifest(spark, paths)[:2] == two[:2] and manifest(spark, paths) != two


def test_scope_counts_its_users(spark):
    scope = TableScope(spark)
    with scope:
        df = materialize(spark.range(3), "scoped")
    outside = materialize(spark.range(3), "free")
    (path,) = [p.removeprefix("file:") for p in scope.paths]
    held = scope.lend(df.where("id > 0"))
    scope.release()
    assert os.path.exists(path) and held.count() == 2
    del held
    gc.collect()
    assert not os.path.exists(path) and outside.count() == 3
