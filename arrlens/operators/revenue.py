"""Recurring-revenue metrics: MRR/ARR, revenue mix, NRR, upgrade rates,
expansion opportunity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import ratio_round, scaled
from ..sources.fixtures import Tables
from ..sources.schemas import TIER_ORDER


def mrr_snapshot(t: Tables) -> DataFrame:
    """Current MRR and ARR from active paid subscriptions."""
    return (t.active_paid_subscriptions
            .agg(F.count(F.lit(1)).alias("active_subscriptions"),
                 F.sum("mrr_amount").alias("total_mrr"))
            .withColumn("total_arr", F.col("total_mrr") * 12))


def mrr_by_plan(t: Tables) -> DataFrame:
    """Revenue mix per tier. The grand total is a window over the (tiny)
    aggregated rows, never over raw subscriptions."""
    per = (t.active_paid_subscriptions.groupBy("plan_tier")
           .agg(F.sum("mrr_amount").alias("total_mrr"),
                F.count(F.lit(1)).alias("subscriptions")))
    grand = F.sum("total_mrr").over(Window.partitionBy())
    return (per.withColumn("_grand", grand)
               .select("plan_tier", "total_mrr",
                       ratio_round("total_mrr", "subscriptions", 0).alias("avg_mrr"),
                       "subscriptions",
                       ratio_round("total_mrr", "_grand", 1, 100).alias("pct_of_mrr")))


def monthly_mrr(t: Tables) -> DataFrame:
    """New MRR per start month (paid, ended included) and its running total."""
    per = (t.paid_subscriptions
           .groupBy(F.date_format("start_date", "yyyy-MM").alias("month"))
           .agg(F.sum("mrr_amount").alias("new_mrr")))
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.withColumn("cumulative_mrr", F.sum("new_mrr").over(w))


def _waterfall_aggs():
    mrr = F.col("mrr_amount")
    zero = F.lit(0).cast("bigint")
    return [F.sum(mrr).alias("starting_mrr"),
            F.sum(F.when(F.col("upgrade_flag"), mrr).otherwise(zero)).alias("expansion_mrr"),
            F.sum(F.when(F.col("churn_flag"), mrr).otherwise(zero)).alias("churned_mrr"),
            F.sum(F.when(F.col("downgrade_flag"), mrr).otherwise(zero)).alias("contraction_mrr")]


def _waterfall_finish(df: DataFrame, keys: list[str]) -> DataFrame:
    ending = (F.col("starting_mrr") + F.col("expansion_mrr") - F.col("churned_mrr")
              - F.col("contraction_mrr"))
    return (df.withColumn("ending_mrr", ending)
              .select(*keys, "starting_mrr", "expansion_mrr", "churned_mrr", "contraction_mrr",
                      "ending_mrr", ratio_round("ending_mrr", "starting_mrr", 1, 100).alias("nrr_pct")))


def nrr(t: Tables) -> DataFrame:
    """Net revenue retention waterfall over all paid subscriptions.

    The flags are not exclusive: one subscription can count as expansion,
    churn and contraction at once.
    """
    return _waterfall_finish(t.paid_subscriptions.agg(*_waterfall_aggs()), [])


def nrr_by_segment(t: Tables, dims=("industry", "plan_tier")) -> DataFrame:
    """NRR waterfall per account segment.

    Subscriptions are first rolled up per account (map-side combined, so a
    hot account costs one row per task), then joined to accounts and
    re-aggregated per (dimension, segment) after an unpivot.
    """
    per_acct = t.paid_subscriptions.groupBy("account_id").agg(*_waterfall_aggs())
    acc = t.accounts_core.select("account_id", *dims)
    long = (per_acct.join(acc, "account_id")
            .unpivot(["account_id", "starting_mrr", "expansion_mrr", "churned_mrr",
                      "contraction_mrr"], list(dims), "dimension", "segment")
            .where(F.col("segment").isNotNull()))
    agg = long.groupBy("dimension", "segment").agg(
        *[F.sum(c).alias(c) for c in ["starting_mrr", "expansion_mrr", "churned_mrr",
                                      "contraction_mrr"]])
    return _waterfall_finish(agg, ["dimension", "segment"])


def _rate(df: DataFrame, key: str) -> DataFrame:
    return (df.withColumn("upgrade_rate_pct", ratio_round("upgrades", "total", 1, 100))
              .select(key, "total", "upgrades", "upgrade_rate_pct"))


def upgrade_rate_by_plan(t: Tables) -> DataFrame:
    """Share of paid subscriptions flagged as upgraded, per subscription tier."""
    agg = (t.paid_subscriptions.where(F.col("plan_tier").isNotNull())
           .groupBy("plan_tier")
           .agg(F.count("subscription_id").alias("total"),
                F.count_if(F.col("upgrade_flag")).alias("upgrades")))
    return _rate(agg, "plan_tier")


def upgrade_rate_by_account_dim(t: Tables, dim: str) -> DataFrame:
    """Upgrade rate of paid subscriptions per account attribute.

    Pre-aggregates subscriptions per account before the join, so the join
    sees one row per account (no fan-out, no hot-key skew), then rolls up
    to the attribute. Subscriptions of unknown accounts and null attribute
    values are dropped.
    """
    per_acct = (t.paid_subscriptions.groupBy("account_id")
                .agg(F.count("subscription_id").alias("total"),
                     F.count_if(F.col("upgrade_flag")).alias("upgrades")))
    acc = t.accounts_core.select("account_id", dim).where(F.col(dim).isNotNull())
    agg = (per_acct.join(acc, "account_id").groupBy(dim)
           .agg(F.sum("total").alias("total"), F.sum("upgrades").alias("upgrades")))
    return _rate(agg, dim)


def tier_avg_mrr(t: Tables) -> DataFrame:
    """Mean MRR per tier over active paid subscriptions, rounded to dollars,
    with the tier's rank on the plan ladder and the next tier's mean."""
    rank = F.array_position(F.array(*[F.lit(x) for x in TIER_ORDER]), F.col("plan_tier"))
    per = (t.active_paid_subscriptions.where(F.col("plan_tier").isin(*TIER_ORDER))
           .groupBy("plan_tier")
           .agg(F.sum("mrr_amount").alias("_s"), F.count(F.lit(1)).alias("_n"))
           .select("plan_tier", rank.alias("tier_rank"),
                   ratio_round("_s", "_n", 0).alias("avg_mrr")))
    # At most three rows: an unpartitioned window is free here.
    return per.withColumn("next_avg_mrr", F.lead("avg_mrr").over(Window.orderBy("tier_rank")))


def tier_uplift(t: Tables) -> DataFrame:
    """Per-account monthly uplift of moving one tier up (Basic and Pro)."""
    return (tier_avg_mrr(t).where(F.col("next_avg_mrr").isNotNull())
            .select("plan_tier", "tier_rank",
                    (F.col("next_avg_mrr") - F.col("avg_mrr")).cast("bigint").alias("mrr_uplift")))


def expansion_opportunity(t: Tables) -> DataFrame:
    """Opportunity if every universe account moved one tier up, and the 15 %
    conversion target, per motion and in total."""
    from .profile import expansion_universe
    counts = (expansion_universe(t, t.accounts_core).groupBy("plan_tier")
              .agg(F.count(F.lit(1)).alias("accounts")))
    nxt = F.element_at(F.array(*[F.lit(x) for x in TIER_ORDER]), (F.col("tier_rank") + 1).cast("int"))
    motions = (tier_uplift(t).join(counts, "plan_tier")
               .select(F.concat_ws(" -> ", "plan_tier", nxt).alias("motion"),
                       F.col("accounts").cast("bigint").alias("accounts"),
                       F.col("mrr_uplift").alias("avg_mrr_uplift"),
                       (F.col("accounts") * F.col("mrr_uplift")).alias("opportunity_mrr")))
    total = motions.agg(F.lit("Total").alias("motion"),
                        F.sum("accounts").alias("accounts"),
                        F.lit(None).cast("bigint").alias("avg_mrr_uplift"),
                        F.sum("opportunity_mrr").alias("opportunity_mrr"))
    both = motions.unionByName(total)
    return both.select("motion", "accounts", "avg_mrr_uplift", "opportunity_mrr",
                       (F.col("opportunity_mrr") * 12).alias("opportunity_arr"),
                       scaled("opportunity_mrr", 15, 100).alias("target_mrr_15pct"),
                       scaled("opportunity_mrr", 180, 100).alias("target_arr_15pct"))

