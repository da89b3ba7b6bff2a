"""Live usage trigger: rolling 30-day usage per account against a percentile
threshold.

History files come in any order, so no watermark could tell late rows from
early ones, and the stream keeps its totals in a store instead of operator state. Each
micro-batch adds its usage per account and day, one folder ``month=M/batch_id=N``
per month and batch: a replayed batch rewrites its own folders instead of counting
twice. From the store, the 30-day windows (one starting on every day) of the touched
accounts are rebuilt. A batch lists and reads the folders of the months within a
window's reach of its own days only, and a month with many batches is compacted
into one sum per account and day, so a batch costs what it brings and
touches, not what came before.

Two thresholds: the exact percentile of monthly usage is a batch job
(percentiles are not additive); the live one comes from one KLL sketch per month,
rebuilt for the touched months alone and merged over all months.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exact import dround_col
from ..functions.quantiles import exact_quantiles
from ..operators.features import usage_by_account_month
from ..session import configure, dealt, delete_on_exit, delete_path, list_paths, shared_dir
from ..sources.fixtures import Tables, usage_from_lineitem

WINDOW_DAYS = 30
COMPACT_AFTER = 8      # batches of a month that are kept apart
SKETCH_K = 2000        # size of a sketch; the rank error stays well below MAX_RANK_ERROR
MAX_RANK_ERROR = 0.01
BLOCK_DAYS = 32        # starts of an account that are compared between batches at once


def monthly_threshold(t: Tables, q: float = 0.9) -> DataFrame:
    """One-row table: the exact q-th percentile (interpolated) of usage
    duration per account and month."""
    monthly = usage_by_account_month(t.feature_usage, t.active_paid_subscriptions)
    return exact_quantiles(monthly, "duration", [q]).select(F.col("value").alias("threshold"))


def usage_source(t: Tables, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming usage rows from the table's files: a directory of part files,
    to which new ones may be added, or a single file."""
    path = f"{t.sf_dir}/lineitem.parquet"
    batch = t.spark.read.parquet(path)
    files = batch.inputFiles()
    reader = t.spark.readStream.schema(batch.schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if len(files) == 1 and files[0].rstrip("/").endswith("/lineitem.parquet"):
        return usage_from_lineitem(reader.option("pathGlobFilter", "lineitem.parquet").parquet(t.sf_dir))
    return usage_from_lineitem(reader.parquet(path))


def daily_totals(usage: DataFrame, mapping: DataFrame) -> DataFrame:
    """(account_id, day, duration): rows are summed per subscription and day
    before the join, so a hot subscription collapses in the tasks."""
    per_sub = (usage.groupBy("subscription_id", F.unix_date("usage_date").alias("day"))
               .agg(F.sum("usage_duration_secs").alias("duration")))
    return (dealt(per_sub, "subscription_id").join(mapping, "subscription_id")
            .groupBy("account_id", "day").agg(F.sum("duration").alias("duration")))


def rolling_windows(updated: DataFrame, stored: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """(account_id, start, until, duration): the windows that start on ``start`` to
    ``until`` hold ``duration``; all windows that hold an updated day, from all stored
    totals of the days that such windows can reach.

    A day's total enters with the window that starts ``days`` - 1 earlier and leaves with the one
    that starts a day later. The running sum over both changes in order of the
    starts is the windows' sum, so a stored day costs two rows, however long the windows are."""
    span = updated.groupBy("account_id").agg((F.min("day") - (days - 1)).alias("lo"), F.max("day").alias("hi"))
    daily = (dealt(stored.select("account_id", "day", "duration"), "account_id").join(span, "account_id")
             .where(F.col("day").between(F.col("lo"), F.col("hi") + (days - 1))))
    enters = F.struct(F.greatest("lo", F.col("day") - (days - 1)).alias("start"), F.col("duration").alias("change"),
                      F.lit(1).alias("held"))
    leaves = F.struct((F.col("day") + 1).alias("start"), (-F.col("duration")).alias("change"), F.lit(-1).alias("held"))
    changes = daily.select("account_id", "hi", F.explode(F.array(enters, leaves)).alias("c")).select(
        "account_id", "hi", "c.*").where(F.col("start") <= F.col("hi"))
    by_start = Window.partitionBy("account_id").orderBy("start")
    sums = changes.select("account_id", "start", (F.coalesce(F.lead("start").over(by_start), F.col("hi") + 1) - 1).alias("until"),
                          F.sum("change").over(by_start).alias("duration"),   # of all changes up to this start
                          F.sum("held").over(by_start).alias("held"))
    return sums.where("held > 0 AND until >= start").drop("held")


def each_start(runs: DataFrame, *also: str) -> DataFrame:
    """(account_id, start, duration): one row per window of the runs of equal ones."""
    return runs.select("account_id", F.explode(F.sequence("start", "until")).alias("start"), "duration", *also)


def month_of(day: Column) -> Column:
    """Months since year 0 of a day number."""
    d = F.date_from_unix_date(day)
    return (F.year(d) * 12 + F.month(d) - 1).cast("int")


class UsageStore:
    """Additive totals per account and day, by month: ``open/month=M/batch_id=N``
    from single batches, ``compact/month=M/upto=N`` the sum of all batches up to N."""

    OPEN = "account_id bigint, day int, duration bigint, month int, batch_id bigint"

    def __init__(self, spark: SparkSession, root: str, compact_after: int = COMPACT_AFTER):
        self.spark, self.root, self.compact_after = spark, root, compact_after

    def _write(self, df: DataFrame, folder: str, *by: str) -> None:
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
         .parquet(f"{self.root}/{folder}"))

    def _folders(self, folder: str, months: list[int], inner: str) -> dict[int, list[int]]:
        """Numbers of the inner folders per month, for these months only."""
        glob = f"{self.root}/{folder}/month={{{','.join(map(str, months))}}}/{inner}=*"
        out: dict[int, list[int]] = {}
        for path in list_paths(self.spark, glob):
            m, n = map(int, re.search(rf"month=(-?\d+)/{inner}=(\d+)$", path).groups())
            out.setdefault(m, []).append(n)
        return out

    def add(self, totals: DataFrame, batch_id: int) -> tuple[DataFrame, list[int]]:
        """Adds a batch's (account_id, day, duration); returns its rows and months."""
        path = f"{self.root}/incoming/batch_id={batch_id}"
        totals.withColumn("month", month_of(F.col("day"))).write.mode("overwrite").parquet(path)
        batch = self.spark.read.schema("account_id bigint, day int, duration bigint, month int").parquet(path)
        months = sorted(r[0] for r in batch.select("month").distinct().collect())
        if months:
            self._write(batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")), "open", "month", "batch_id")
        return batch, months

    def read(self, months: list[int], batch_id: int) -> DataFrame:
        """(account_id, day, duration, month) of these months from all batches up to ``batch_id``."""
        upto = {m: max([n for n in ns if n <= batch_id], default=-1)
                for m, ns in self._folders("compact", months, "upto").items()}
        paths = [f"{self.root}/open/month={m}/batch_id={n}" for m, ns in self._folders("open", months, "batch_id").items()
                 for n in sorted(ns) if upto.get(m, -1) < n <= batch_id]
        done = [f"{self.root}/compact/month={m}/upto={n}" for m, n in upto.items() if n >= 0]
        cols = ["account_id", "day", "duration", "month"]
        out = self.spark.createDataFrame([], self.OPEN).select(*cols)
        for folder, some in (("open", paths), ("compact", done)):
            if some:
                schema = self.OPEN if folder == "open" else self.OPEN.replace("batch_id", "upto")
                out = out.unionByName(self.spark.read.schema(schema).option("basePath", f"{self.root}/{folder}")
                                      .parquet(*some).select(*cols))
        return out

    def compact(self, months: list[int], batch_id: int) -> list[int]:
        """Sums the months of which more than ``compact_after`` batches lie
        apart, then drops what the sums replace. The reader ignores batches up to a sum, so a
        crash between the two steps, or a replay of this batch, changes nothing."""
        apart = self._folders("open", months, "batch_id")
        full = [m for m, ns in apart.items() if len(ns) > self.compact_after]
        if full:
            older = self._folders("compact", full, "upto")
            merged = (self.read(full, batch_id).groupBy("account_id", "day", "month")
                      .agg(F.sum("duration").alias("duration")))
            self._write(merged.withColumn("upto", F.lit(batch_id).cast("bigint")), "compact", "month", "upto")
            for m in full:
                for n in apart[m]:
                    if n <= batch_id:
                        delete_path(self.spark, f"{self.root}/open/month={m}/batch_id={n}")
                for n in older.get(m, []):
                    if n < batch_id:
                        delete_path(self.spark, f"{self.root}/compact/month={m}/upto={n}")
        return full


@dataclass
class TriggerRun:
    """Paths of a run: rebuilt windows by batch, in runs of equal sums (the latest batch
    holds a window's valid sum), live alerts by batch, one sketch per month, the store."""

    windows: str
    alerts: str
    sketches: str
    store: UsageStore


def month_sketches(stored: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """(month, sketch): KLL sketch of the accounts' usage in each month."""
    return (stored.groupBy("month", "account_id").agg(F.sum("duration").alias("duration"))
            .groupBy("month").agg(F.kll_sketch_agg_bigint("duration", k).alias("sketch")))


def live_threshold(sketches: DataFrame, q: float = 0.9) -> DataFrame:
    """(account_months, threshold): the q-th percentile of the merged sketches,
    a few kilobytes a month."""
    merged = sketches.agg(F.kll_merge_agg_bigint("sketch").alias("all"))
    return merged.select(F.kll_sketch_get_n_bigint("all").alias("account_months"),
                         F.kll_sketch_get_quantile_bigint("all", F.lit(float(q))).alias("threshold"))


def run_usage_trigger(spark: SparkSession, sf_dir: str, out_dir: str | None = None, q: float = 0.9,
                      available_now: bool = True, max_files_per_trigger: int | None = None,
                      compact_after: int = COMPACT_AFTER) -> TriggerRun:
    """Run the trigger job. With ``available_now`` the query processes what is
    there and stops; otherwise it keeps running on new files. Without
    ``out_dir`` the run's folders are removed when the driver ends."""
    configure(spark)
    t = Tables(spark, sf_dir)
    root = out_dir or shared_dir(spark, "usage_trigger", uuid.uuid4().hex[:12])
    if not out_dir:
        delete_on_exit(spark, root)
    run = TriggerRun(f"{root}/windows", f"{root}/alerts", f"{root}/sketches",
                     UsageStore(spark, f"{root}/daily", compact_after))
    mapping = t.active_paid_subscriptions.select("subscription_id", "account_id")

    def emit(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        store = UsageStore(session, run.store.root, compact_after)
        added, months = store.add(daily_totals(batch, mapping), batch_id)
        if not months:
            return
        reach = sorted({m + k for m in months for k in (-1, 0, 1)})  # a window spans two months at most
        stored = store.read(reach, batch_id)
        path = f"{run.windows}/batch_id={batch_id}"
        rolling_windows(added, stored).write.mode("overwrite").parquet(path)
        (month_sketches(stored.where(F.col("month").isin(months))).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(run.sketches))
        threshold = live_threshold(session.read.parquet(run.sketches), q).select("threshold").scalar()
        windows = session.read.schema("account_id bigint, start int, until int, duration bigint").parquet(path)
        (each_start(windows.where(F.col("duration") >= threshold)).withColumn("threshold", threshold)
         .write.mode("overwrite").parquet(f"{run.alerts}/batch_id={batch_id}"))
        store.compact(months, batch_id)

    writer = (usage_source(t, max_files_per_trigger).writeStream
              .option("checkpointLocation", f"{root}/stream").foreachBatch(emit))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    query = writer.start()
    if available_now:
        query.awaitTermination()
    return run


def latest_runs(spark: SparkSession, run: TriggerRun) -> DataFrame:
    """(account_id, start, until, duration): every window's valid sum, in runs of
    equal ones that follow each other. Runs are cut at multiples of BLOCK_DAYS; only
    in blocks that several batches wrote is the latest one looked up for each start."""
    runs = spark.read.schema("account_id bigint, start int, until int, duration bigint, batch_id bigint").parquet(run.windows)
    first = F.col("block") * BLOCK_DAYS
    pieces = runs.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK_DAYS).cast("int"),
                                                           F.floor(F.col("until") / BLOCK_DAYS).cast("int"))))
    pieces = pieces.select("account_id", "block", F.struct(
        "batch_id", F.greatest("start", first).alias("start"), F.least("until", first + (BLOCK_DAYS - 1)).alias("until"),
        "duration").alias("piece"))
    blocks = pieces.groupBy("account_id", "block").agg(
        F.collect_list("piece").alias("pieces"), (F.min("piece.batch_id") < F.max("piece.batch_id")).alias("several"))

    def valid(at: Column) -> Column:
        last = F.array_max(F.filter("pieces", lambda p: (p["start"] <= at) & (at <= p["until"])))  # batch_id comes first
        return F.struct(last["batch_id"].alias("batch_id"), at.alias("start"), at.alias("until"), last["duration"].alias("duration"))

    latest = F.filter(F.transform(F.sequence(first, first + (BLOCK_DAYS - 1)), valid), lambda p: p["batch_id"].isNotNull())
    return (blocks.select("account_id", F.explode(F.when(F.col("several"), latest).otherwise(F.col("pieces"))).alias("p"))
            .select("account_id", "p.start", "p.until", "p.duration"))


def latest_windows(spark: SparkSession, run: TriggerRun) -> DataFrame:
    """(account_id, start, duration): every window's valid sum."""
    return each_start(latest_runs(spark, run))


def usage_stream(spark: SparkSession, sf_dir: str, q: float = 0.9, max_files_per_trigger: int | None = None,
                 compact_after: int = COMPACT_AFTER) -> DataFrame:
    """Accounts whose usage of some 30 days reached the exact threshold, after a
    completed available-now run: start of the first such window, number of
    them, peak usage."""
    run = run_usage_trigger(spark, sf_dir, q=q, max_files_per_trigger=max_files_per_trigger,
                            compact_after=compact_after)
    threshold = monthly_threshold(Tables(spark, sf_dir), q).scalar()
    return (latest_runs(spark, run).where(F.col("duration") >= threshold).groupBy("account_id")
            .agg(F.date_from_unix_date(F.min("start")).alias("first_window_start"),
                 F.sum(F.col("until") - F.col("start") + 1).alias("windows_over"), F.max("duration").alias("peak_usage_duration"))
            .withColumn("threshold", dround_col(threshold, 6)))


def live_threshold_check(spark: SparkSession, sf_dir: str, q: float = 0.9,
                         max_files_per_trigger: int | None = None) -> DataFrame:
    """The live threshold next to the exact one after a completed run: number of
    account months, exact threshold, and whether the live one's rank is within MAX_RANK_ERROR
    of q (ties count on both sides)."""
    run = run_usage_trigger(spark, sf_dir, q=q, max_files_per_trigger=max_files_per_trigger)
    t = Tables(spark, sf_dir)
    monthly = usage_by_account_month(t.feature_usage, t.active_paid_subscriptions)
    sketches = spark.read.schema("sketch binary, month int").parquet(run.sketches)
    live = live_threshold(sketches, q).select("threshold").scalar()
    exact = monthly_threshold(t, q).scalar()
    x = F.col("duration")
    return monthly.agg(F.count(F.lit(1)).alias("account_months"), F.count_if(x < live).alias("below"),
                       F.count_if(x <= live).alias("upto")).select(
        "account_months", dround_col(exact, 6).alias("threshold"),
        ((F.col("below") <= (q + MAX_RANK_ERROR) * F.col("account_months")) &
         (F.col("upto") >= (q - MAX_RANK_ERROR) * F.col("account_months"))).alias("live_within_error"))
