"""The usage trigger stream against a brute-force recomputation."""

import bisect
import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from arrlens.sources.fixtures import Tables
from arrlens.streaming.usage_stream import (TriggerRun, UsageStore, each_start, latest_runs, latest_windows, live_threshold,
                                            month_of, month_sketches, monthly_threshold, rolling_windows,
                                            run_usage_trigger, usage_stream)


def test_usage_stream_matches_brute_force(spark, sf_dir):
    got = usage_stream(spark, sf_dir).toPandas().set_index("account_id").sort_index()
    t = Tables(spark, sf_dir)
    thr = monthly_threshold(t).first()["threshold"]
    usage = (t.feature_usage.join(t.active_paid_subscriptions.select("subscription_id", "account_id"),
                                  "subscription_id")
             .select("account_id", "usage_date", "usage_duration_secs").toPandas())
    daily = usage.groupby(["account_id", "usage_date"])["usage_duration_secs"].sum()
    rows = []
    for (acct, day), dur in daily.items():
        for k in range(30):  # 30-day windows sliding by one day that contain `day`
            rows.append((acct, day - dt.timedelta(days=k), dur))
    win = pd.DataFrame(rows, columns=["account_id", "start", "d"]).groupby(["account_id", "start"])["d"].sum()
    over = win[win >= thr].reset_index()
    exp = over.groupby("account_id").agg(first_window_start=("start", "min"),
                                         windows_over=("d", "size"), peak_usage_duration=("d", "max"))
    assert list(got.index) == list(exp.index)
    assert (got["windows_over"].values == exp["windows_over"].values).all()
    assert (got["peak_usage_duration"].values == exp["peak_usage_duration"].values).all()
    starts = [pd.Timestamp(x).date() for x in got["first_window_start"]]
    assert starts == list(exp["first_window_start"])
    assert (abs(got["threshold"] - thr) < 1e-5).all()


def test_any_layout_and_order_gives_the_same_rows(spark, sf_dir, tmp_path):
    """One file, a directory of shuffled files, one or several files a batch."""
    import os
    want = sorted(map(tuple, usage_stream(spark, sf_dir).collect()))
    other = tmp_path / "tables"
    other.mkdir()
    for name in ("orders", "customer", "nation", "region", "events"):
        os.symlink(f"{sf_dir}/{name}.parquet", other / f"{name}.parquet")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").repartition(4, "l_partkey").write.parquet(str(other / "lineitem.parquet"))
    for files in (1, None):
        assert sorted(map(tuple, usage_stream(spark, str(other), max_files_per_trigger=files).collect())) == want


def _split_copy(spark, sf_dir, tmp_path, files):
    import os
    other = tmp_path / "tables"
    other.mkdir()
    for name in ("orders", "customer", "nation", "region", "events"):
        os.symlink(f"{sf_dir}/{name}.parquet", other / f"{name}.parquet")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").repartition(files, "l_partkey").write.parquet(
        str(other / "lineitem.parquet"))
    return str(other)


def test_compaction_changes_no_row(spark, sf_dir, tmp_path):
    want = sorted(map(tuple, usage_stream(spark, sf_dir).collect()))
    other = _split_copy(spark, sf_dir, tmp_path, 4)
    assert sorted(map(tuple, usage_stream(spark, other, max_files_per_trigger=1, compact_after=1).collect())) == want


def _totals(spark, rows):
    return spark.createDataFrame(rows, "account_id bigint, day int, duration bigint")


def _sums(df):
    out = {}
    for r in df.collect():
        out[r.account_id, r.day] = out.get((r.account_id, r.day), 0) + r.duration
    return out


def test_a_batch_reads_its_own_months_only(spark, tmp_path):
    """Twelve batches over five years of history: what a batch of one month
    reads depends on that month, not on the rest."""
    store = UsageStore(spark, str(tmp_path / "daily"), compact_after=3)
    day = 10_000
    _, months = store.add(_totals(spark, [(1, day + 30 * k, 5) for k in range(60)]), 0)
    assert len(months) > 55
    for b in range(1, 12):
        added, months = store.add(_totals(spark, [(1, day, b), (2, day, 1)]), b)
        assert len(months) == 1 and _sums(added) == {(1, day): b, (2, day): 1}
        part = store.read(months, b)
        assert all(f"/month={months[0]}/" in f for f in part.inputFiles())
        assert len({f.rsplit("/", 1)[0] for f in part.inputFiles()}) <= 3 + 2  # open batches and one sum
        assert _sums(part) == {(1, day): 5 + b * (b + 1) // 2, (2, day): b}
        store.compact(months, b)
        assert _sums(store.read(months, b)) == {(1, day): 5 + b * (b + 1) // 2, (2, day): b}
    assert sum(_sums(store.read(sorted({m + k for m in months for k in range(0, 60)}), 11)).values()) == 5 * 60 + 66 + 11


def test_replayed_batches_count_once(spark, tmp_path):
    """A batch written again, before and after its compaction, and a crash between the
    sum and the removal of what it replaces."""
    store = UsageStore(spark, str(tmp_path / "daily"), compact_after=1)
    rows = [(1, 500, 3), (1, 501, 4)]
    for b in (0, 1, 1):
        _, months = store.add(_totals(spark, rows), b)
    assert _sums(store.read(months, 1)) == {(1, 500): 6, (1, 501): 8}
    assert store.compact(months, 1) == months
    store.add(_totals(spark, rows), 1)     # the replay of the compacted batch
    assert _sums(store.read(months, 1)) == {(1, 500): 6, (1, 501): 8}
    store.add(_totals(spark, rows), 2)
    assert _sums(store.read(months, 2)) == {(1, 500): 9, (1, 501): 12}
    assert store.add(_totals(spark, []), 3)[1] == []


def test_live_threshold_rank_error(spark):
    """Measured on skewed totals with many ties, merged over months."""
    import random
    random.seed(5)
    rows = [(a, 400 + 30 * m, int(random.paretovariate(1.2) * 10)) for m in range(20) for a in range(4000)]
    totals = _totals(spark, rows).withColumn("month", month_of(F.col("day")))
    sketches = month_sketches(totals)
    assert sketches.count() == totals.select("month").distinct().count()
    values = sorted(r[0] for r in totals.groupBy("month", "account_id").agg(F.sum("duration")).select(
        F.col("sum(duration)")).collect())
    for q in (0.5, 0.9, 0.99):
        r = live_threshold(sketches, q).first()
        assert r.account_months == len(values)
        below, upto = bisect.bisect_left(values, r.threshold), bisect.bisect_right(values, r.threshold)
        error = max(0, below / len(values) - q, q - upto / len(values))
        assert error < 0.003, (q, error)


def test_alerts_follow_the_live_threshold(spark, sf_dir, tmp_path):
    run = run_usage_trigger(spark, sf_dir, out_dir=str(tmp_path / "run"))
    alerts = spark.read.parquet(run.alerts)
    thr = alerts.select("threshold").distinct().collect()
    assert len(thr) == 1
    want = latest_windows(spark, run).where(F.col("duration") >= thr[0][0]).count()
    assert alerts.count() == want > 0


def _brute_windows(rows, days=30):
    out = {}
    for acct, day, dur in rows:
        for s in range(day - days + 1, day + 1):
            out[acct, s] = out.get((acct, s), 0) + dur
    return out


def _windows(df):
    rows = [((r.account_id, r.start), r.duration) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def test_windows_come_in_runs_of_equal_sums(spark):
    """At most two rows per stored day, whatever the window's length; sums of 0 and
    days that cancel out are windows too, empty stretches are none."""
    rows = [(1, 100, 5), (1, 100, 2), (1, 103, 0), (1, 400, 7), (2, 100, 0), (3, 90, 4), (3, 91, -4), (3, 150, 1)]
    totals = _totals(spark, rows)
    runs = rolling_windows(totals, totals)
    assert runs.columns == ["account_id", "start", "until", "duration"]
    assert runs.count() <= 2 * len(rows)
    assert _windows(each_start(runs)) == _brute_windows(rows)
    wide = rolling_windows(totals, totals, 3000)
    assert wide.count() <= 2 * len(rows) and _windows(each_start(wide)) == _brute_windows(rows, 3000)
    # only the span of the updated days, with the totals that reach into it
    part = _windows(each_start(rolling_windows(_totals(spark, [(1, 103, 0)]), totals)))
    assert part == {k: v for k, v in _brute_windows(rows).items() if k[0] == 1 and 74 <= k[1] <= 103}


def test_latest_batch_decides_inside_its_span_only(spark, tmp_path):
    import random
    random.seed(3)
    run, known = TriggerRun(str(tmp_path / "w"), "", "", None), []
    for b in range(4):
        new = [(random.randint(1, 3), random.randint(-40, 300), random.randint(0, 9)) for _ in range(6)]
        known += new
        rolling_windows(_totals(spark, new), _totals(spark, known)).write.parquet(f"{run.windows}/batch_id={b}")
    want = _brute_windows(known)
    assert _windows(latest_windows(spark, run)) == want
    assert latest_runs(spark, run).selectExpr("sum(until - start + 1)").first()[0] == len(want)
