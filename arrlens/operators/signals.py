"""Signal analysis on the account feature table: cohort comparisons, upgrade
rates by profile, distribution statistics, correlation with the label, and
usage-based triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import dround, dround_col, ratio_round
from ..functions.quantiles import exact_quantile_col, exact_quantile_cols, exact_quantiles
from ..sources.fixtures import Tables

LABEL = "has_upgraded"

COHORT_USAGE = ["total_usage_count", "unique_features_used", "total_usage_duration",
                "beta_feature_usage", "total_errors"]
COHORT_SUPPORT = ["avg_satisfaction", "n_tickets", "n_escalations", "avg_resolution_hours",
                  "n_urgent"]
COHORT_SEATS = ["total_seats", "total_mrr", "is_annual", "auto_renew"]
CORRELATION_FEATURES = ["total_mrr", "total_seats", "total_usage_count", "unique_features_used",
                        "total_usage_duration", "beta_feature_usage", "total_errors",
                        "n_tickets", "avg_satisfaction", "n_escalations", "avg_resolution_hours"]
BOX_METRICS = ["unique_features_used", "total_usage_count", "total_seats"]
PROFILE_DIMS = ["industry", "plan_tier", "referral_source"]


def _num(c: str):
    return F.col(c).cast("double")


def cohort_comparison(features: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean of each metric for upgraded vs not-upgraded accounts, and the
    relative difference in percent (NULL when the baseline mean is 0).

    One aggregation pass produces all means; the single row is unpivoted.
    Accounts with an unknown label belong to neither cohort.
    """
    lab = F.col(LABEL)
    aggs = []
    for m in metrics:
        aggs.append(F.avg(F.when(lab, _num(m))).alias(f"{m}__up"))
        aggs.append(F.avg(F.when(~lab, _num(m))).alias(f"{m}__not"))
    row = features.agg(*aggs)
    stacked = F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"{m}__up").alias("up"),
                 F.col(f"{m}__not").alias("not_up")) for m in metrics]))
    long = row.select(stacked)
    return long.select(
        "metric",
        dround("up", 4).alias("upgraded"),
        dround("not_up", 4).alias("not_upgraded"),
        dround("(up - not_up) / NULLIF(not_up, 0) * 100", 1).alias("diff_pct"))


def account_upgrade_rate(features: DataFrame, dims=PROFILE_DIMS) -> DataFrame:
    """Share of accounts with an upgrade per profile value (account level)."""
    long = (features.select(LABEL, *dims)
            .unpivot([LABEL], list(dims), "dimension", "value")
            .where(F.col("value").isNotNull() & F.col(LABEL).isNotNull()))
    agg = long.groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("accounts"),
        F.count_if(LABEL).alias("upgraded"))
    return agg.withColumn("upgrade_rate_pct", ratio_round("upgraded", "accounts", 1, 100))


def box_stats(features: DataFrame, metrics=BOX_METRICS) -> DataFrame:
    """Min, quartiles (linear interpolation) and max per cohort and metric.

    Quartiles come from ``exact_quantiles`` (bounded per-task state);
    count/min/max from one partially-aggregated group-by; the two small
    results (cohorts x metrics rows) are joined.
    """
    long = (features.where(F.col(LABEL).isNotNull())
            .select(F.col(LABEL).alias("upgraded"),
                    F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), _num(m).alias("v"))
                                       for m in metrics])))
            .where(F.col("v").isNotNull()))
    keys = ["upgraded", "metric"]
    simple = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("min"),
                                     F.max("v").alias("max"))
    q = (exact_quantiles(long, "v", [0.25, 0.5, 0.75], by=keys)
         .groupBy(*keys).pivot("q", [0.25, 0.5, 0.75]).agg(F.first("value")))
    q = q.toDF(*keys, "_q1", "_q2", "_q3")
    return simple.join(q, keys).select(
        "upgraded", "metric", "n", "min", dround("_q1", 6).alias("q1"),
        dround("_q2", 6).alias("median"), dround("_q3", 6).alias("q3"), "max")


def label_correlation(features: DataFrame, cols=CORRELATION_FEATURES) -> DataFrame:
    """Pearson correlation of each feature with the label (pairwise complete
    rows), as absolute value, weakest first, plus its sign."""
    y = F.col(LABEL).cast("double")
    row = features.agg(*[F.corr(_num(c), y).alias(c) for c in cols])
    long = row.unpivot([], list(cols), "feature", "r")
    return long.select("feature", dround("abs(r)", 6).alias("correlation"),
                       F.signum("r").alias("direction")).orderBy("correlation", "feature")


def label_correlation_top(features: DataFrame, k: int = 5, strong: float = 0.1) -> DataFrame:
    corr = label_correlation(features)
    return (corr.orderBy(F.desc("correlation"), "feature").limit(k)
                .withColumn("is_strong", F.col("correlation") > strong))


# --------------------------------------------------------------------------
# usage-based triggers
# --------------------------------------------------------------------------
def upgrade_by_usage_quartile(features: DataFrame, col: str = "total_usage_duration") -> DataFrame:
    """Upgrade rate per quartile of usage duration.

    Quartile edges are exact interpolated percentiles (``exact_quantiles``)
    bound as scalar subqueries; each account is then placed by comparison
    (right-closed bins, as quantile cuts do). No global ordering window.
    """
    base = features.where(F.col(col).isNotNull())
    edges = exact_quantile_cols(base, col, [0.25, 0.5, 0.75])
    x = _num(col)
    quartile = (1 + (x > edges[0]).cast("int") + (x > edges[1]).cast("int")
                + (x > edges[2]).cast("int"))
    agg = (base.withColumn("quartile", quartile).groupBy("quartile")
           .agg(F.count(F.lit(1)).alias("accounts"),
                F.min(col).alias("min_value"), F.max(col).alias("max_value"),
                F.count(LABEL).alias("labelled"), F.count_if(LABEL).alias("upgraded")))
    return agg.withColumn("upgrade_rate_pct", ratio_round("upgraded", "labelled", 1, 100))


def usage_p90_trigger(features: DataFrame, col: str = "total_usage_duration",
                      q: float = 0.9) -> DataFrame:
    """Accounts at or above the q-th percentile of usage duration."""
    base = features.where(F.col(col).isNotNull())
    thr = exact_quantile_col(base, col, q)
    return (base.where(_num(col) >= thr)
            .select("account_id", "account_name", "plan_tier", col,
                    dround_col(thr, 6).alias("threshold")))


def usage_decline(t: Tables) -> DataFrame:
    """Accounts whose latest month of usage duration fell below the previous
    month with usage (downgrade early warning). The lag window is partitioned
    by account over at most one row per month."""
    from .features import usage_by_account_month
    monthly = usage_by_account_month(t.feature_usage, t.active_paid_subscriptions)
    w = Window.partitionBy("account_id").orderBy("month")
    marked = (monthly.withColumn("prev_month", F.lag("month").over(w))
              .withColumn("prev_duration", F.lag("duration").over(w))
              .withColumn("next_month", F.lead("month").over(w)))
    return (marked.where(F.col("next_month").isNull() & (F.col("duration") < F.col("prev_duration")))
            .select("account_id", "month", "duration", "prev_month", "prev_duration",
                    ratio_round("prev_duration - duration", "prev_duration", 1, 100)
                    .alias("decline_pct")))
