"""Profiling and data-quality operators (table shapes, keys, dates, status)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import ratio_round
from ..sources.fixtures import Tables
from ..sources.schemas import UPSELL_TIERS

BUSINESS = ["accounts", "subscriptions", "feature_usage", "support", "churn_events"]

# child table, child key, parent table, parent key
FOREIGN_KEYS = [
    ("subscriptions", "account_id", "accounts", "account_id"),
    ("feature_usage", "subscription_id", "subscriptions", "subscription_id"),
    ("support", "account_id", "accounts", "account_id"),
    ("churn_events", "account_id", "accounts", "account_id"),
]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def row_counts(t: Tables) -> DataFrame:
    """Shape of each business table: rows and columns."""
    frames = []
    for name in BUSINESS:
        df = t.business(name)
        frames.append(df.agg(F.count(F.lit(1)).alias("n_rows"))
                        .select(F.lit(name).alias("table_name"), "n_rows",
                                F.lit(len(df.columns)).cast("bigint").alias("n_columns")))
    return _union(frames)


def foreign_keys(t: Tables) -> DataFrame:
    """Distinct keys per table and orphan keys per foreign key.

    Orphans are the set difference of distinct child keys and parent keys,
    computed as a left join of the two distinct key sets (one shuffle each).
    """
    root = (t.accounts_core.agg(F.count_distinct("account_id").alias("distinct_keys"))
            .select(F.lit("accounts").alias("table_name"), F.lit("account_id").alias("key_name"),
                    "distinct_keys", F.lit(None).cast("bigint").alias("orphans")))
    frames = [root]
    for child, ck, parent, pk in FOREIGN_KEYS:
        pdf = t.accounts_core if parent == "accounts" else t.business(parent)
        keys = t.business(child).select(F.col(ck).alias("k")).distinct()
        pkeys = pdf.select(F.col(pk).alias("k")).distinct().withColumn("_hit", F.lit(True))
        frames.append(
            keys.join(pkeys, "k", "left")
                .agg(F.count(F.lit(1)).alias("distinct_keys"),
                     F.count_if(F.col("_hit").isNull()).alias("orphans"))
                .select(F.lit(child).alias("table_name"), F.lit(ck).alias("key_name"),
                        "distinct_keys", "orphans"))
    return _union(frames)


def fanout(t: Tables) -> DataFrame:
    """Average children per parent, over parents with at least one child."""
    specs = [("subscriptions_per_account", t.subscriptions, "account_id"),
             ("usage_events_per_subscription", t.feature_usage, "subscription_id"),
             ("tickets_per_account", t.support, "account_id")]
    frames = []
    for rel, df, k in specs:
        per = df.where(F.col(k).isNotNull()).groupBy(k).agg(F.count(F.lit(1)).alias("n"))
        frames.append(per.agg(F.count(F.lit(1)).alias("parents"),
                              F.avg("n").alias("avg_children"))
                         .select(F.lit(rel).alias("relation"), "parents", "avg_children"))
    return _union(frames)


def date_ranges(t: Tables) -> DataFrame:
    """Min/max date of each table's event date."""
    specs = [("accounts", "signup_date", t.accounts),
             ("subscriptions", "start_date", t.subscriptions),
             ("feature_usage", "usage_date", t.feature_usage),
             ("support", "submitted_at", t.support),
             ("churn_events", "churn_date", t.churn_events)]
    frames = [df.agg(F.to_date(F.min(c)).alias("min_date"), F.to_date(F.max(c)).alias("max_date"))
                .select(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"),
                        "min_date", "max_date")
              for name, c, df in specs]
    return _union(frames)


def account_distribution(t: Tables, dims=("plan_tier", "industry", "referral_source")) -> DataFrame:
    """Value counts of account dimensions, null values dropped; the most
    frequent value of a dimension first.

    One scan: the dimensions are unpivoted to (dimension, value) rows and
    counted in a single partially-aggregated group-by.
    """
    long = t.accounts_core.select("account_id", *dims).unpivot(
        "account_id", list(dims), "dimension", "value")
    return (long.where(F.col("value").isNotNull())
                .groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n_accounts"))
                .orderBy("dimension", F.desc("n_accounts"), "value"))


def account_status(t: Tables) -> DataFrame:
    """Total, active, churned and trial accounts with shares."""
    agg = t.accounts_core.agg(
        F.count(F.lit(1)).alias("total_accounts"),
        F.count_if(~F.col("churn_flag")).alias("active_accounts"),
        F.count_if(F.col("churn_flag")).alias("churned_accounts"),
        F.count_if(F.col("is_trial")).alias("trial_accounts"))
    return agg.select("*",
                      ratio_round("active_accounts", "total_accounts", 1, 100).alias("active_pct"),
                      ratio_round("churned_accounts", "total_accounts", 1, 100).alias("churned_pct"),
                      ratio_round("trial_accounts", "total_accounts", 1, 100).alias("trial_pct"))


def reactivation_share(t: Tables) -> DataFrame:
    agg = t.churn_events.agg(F.count(F.lit(1)).alias("churn_events"),
                             F.count_if(F.col("is_reactivation")).alias("reactivations"))
    return agg.select("*", ratio_round("reactivations", "churn_events", 1, 100)
                      .alias("reactivation_pct"))


def active_accounts(t: Tables) -> DataFrame:
    return t.accounts.where(~F.col("churn_flag"))


def universe_filter():
    """Active accounts on a tier that has a higher tier to move to."""
    return ~F.col("churn_flag") & F.col("plan_tier").isin(*UPSELL_TIERS)


def expansion_universe(t: Tables, accounts: DataFrame | None = None) -> DataFrame:
    acc = t.accounts if accounts is None else accounts
    return acc.where(universe_filter())


def subscription_summary(t: Tables) -> DataFrame:
    """Subscription counts by state plus MRR range (trials included)."""
    s = t.subscriptions
    agg = s.agg(
        F.count(F.lit(1)).alias("total_subscriptions"),
        F.count_if(F.col("end_date").isNull()).alias("active_subscriptions"),
        F.count_if(F.col("churn_flag")).alias("churned_subscriptions"),
        F.count_if(F.col("upgrade_flag")).alias("upgraded_subscriptions"),
        F.count_if(F.col("downgrade_flag")).alias("downgraded_subscriptions"),
        F.min("mrr_amount").alias("min_mrr"),
        F.max("mrr_amount").alias("max_mrr"),
        F.avg("mrr_amount").alias("avg_mrr"))
    pct = [ratio_round(c, "total_subscriptions", 1, 100).alias(c.replace("_subscriptions", "_pct"))
           for c in ["active_subscriptions", "churned_subscriptions",
                     "upgraded_subscriptions", "downgraded_subscriptions"]]
    return agg.select("*", *pct)


def avg_mrr_by_tier(t: Tables) -> DataFrame:
    """Mean MRR per subscription tier, trials included, rounded to dollars, highest first."""
    return (t.subscriptions.where(F.col("plan_tier").isNotNull())
            .groupBy("plan_tier")
            .agg(F.sum("mrr_amount").alias("_s"), F.count("mrr_amount").alias("_n"))
            .select("plan_tier", ratio_round("_s", "_n", 0).alias("avg_mrr"))
            .orderBy(F.desc("avg_mrr"), "plan_tier"))


def null_audit(df: DataFrame) -> DataFrame:
    """Per-column null counts of ``df``, only columns with at least one null.

    One aggregation pass computes every count; the result row is unpivoted.
    """
    cols = df.columns
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return (counts.unpivot([], cols, "column_name", "null_count")
                  .where(F.col("null_count") > 0))
