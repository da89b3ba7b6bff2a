"""Target list and follow-up jobs on the scored expansion universe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import dround, ratio_round, scaled
from ..plans import sql_queries
from ..sources.fixtures import Tables
from . import revenue
from .scoring import ScoringRun

# Outreach priority per readiness band.
OUTREACH = {
    "Very High": "Tier 1 — Immediate outreach",
    "High": "Tier 2 — This quarter",
    "Medium": "Tier 3 — Next quarter",
    "Low": "Tier 4 — Monitor",
}
HIGH_BANDS = ["Very High", "High"]

TARGET_LIST_COLS = ["account_id", "account_name", "industry", "country", "plan_tier",
                    "total_mrr", "total_seats", "total_usage_count", "unique_features_used",
                    "avg_satisfaction", "expansion_readiness_score", "readiness_band",
                    "outreach_priority", "potential_mrr_uplift", "potential_arr_uplift"]


def outreach_priority(band):
    expr = F.lit(None).cast("string")
    for b, label in reversed(list(OUTREACH.items())):
        expr = F.when(band == b, label).otherwise(expr)
    return expr


def score_by_plan(run: ScoringRun) -> DataFrame:
    return (run.universe_scored.groupBy("plan_tier")
            .agg(F.count(F.lit(1)).alias("accounts"),
                 F.avg("expansion_readiness_score").alias("_a"))
            .select("plan_tier", "accounts", dround("_a", 1).alias("avg_score"))
            .orderBy(F.desc("avg_score"), "plan_tier"))


def with_uplift(run: ScoringRun) -> DataFrame:
    """Scored accounts with the tier uplift (computed from current MRR by
    tier, not hard-coded), its ARR, and the outreach priority.

    The uplift table has one row per tier with a higher tier (two rows), so
    the join is planned as a broadcast hash join by size.
    """
    up = revenue.tier_uplift(run.t).select("plan_tier", F.col("mrr_uplift").alias("potential_mrr_uplift"))
    return (run.scored_accounts.join(up, "plan_tier", "left")
            .withColumn("potential_arr_uplift", F.col("potential_mrr_uplift") * 12)
            .withColumn("outreach_priority", outreach_priority(F.col("readiness_band"))))


def target_uplift(run: ScoringRun) -> DataFrame:
    return with_uplift(run).select("account_id", "plan_tier", "readiness_band",
                                   "potential_mrr_uplift", "potential_arr_uplift",
                                   "outreach_priority")


def tier_summary(run: ScoringRun) -> DataFrame:
    return (with_uplift(run).where(F.col("outreach_priority").isNotNull())
            .groupBy("outreach_priority")
            .agg(F.count(F.lit(1)).alias("accounts"),
                 F.avg("expansion_readiness_score").alias("_a"),
                 F.sum("potential_mrr_uplift").alias("total_mrr_uplift"),
                 F.sum("potential_arr_uplift").alias("total_arr_uplift"))
            .select("outreach_priority", "accounts", dround("_a", 1).alias("avg_score"),
                    "total_mrr_uplift", "total_arr_uplift")
            .orderBy(F.desc("avg_score")))


def top_targets(run: ScoringRun, k: int = 20) -> DataFrame:
    return (with_uplift(run).where(F.col("readiness_band").isin(*HIGH_BANDS))
            .orderBy(F.desc("expansion_readiness_score"), "account_id").limit(k)
            .select("account_id",
                    F.col("account_name").alias("account"),
                    "industry", F.col("plan_tier").alias("plan"),
                    F.col("total_mrr").alias("current_mrr"),
                    F.col("total_seats").alias("seats"),
                    F.col("total_usage_count").alias("usage_count"),
                    F.col("unique_features_used").alias("features_used"),
                    F.col("expansion_readiness_score").alias("readiness_score"),
                    F.col("outreach_priority").alias("priority")))


def arr_opportunity(run: ScoringRun) -> DataFrame:
    """Addressable ARR overall, for tiers 1+2 and tier 1, and the 15 %
    conversion target of tiers 1+2 (as ARR and as MRR)."""
    band, arr = F.col("readiness_band"), F.col("potential_arr_uplift")
    agg = with_uplift(run).agg(
        F.sum(arr).alias("total_addressable_arr"),
        F.coalesce(F.sum(F.when(band.isin(*HIGH_BANDS), arr)), F.lit(0).cast("bigint")).alias("tier12_arr"),
        F.coalesce(F.sum(F.when(band == "Very High", arr)), F.lit(0).cast("bigint")).alias("tier1_arr"),
        F.count_if(band.isin(*HIGH_BANDS)).alias("tier12_accounts"),
        F.count_if(band == "Very High").alias("tier1_accounts"))
    return agg.select("*", scaled("tier12_arr", 15, 100).alias("tier12_target_arr_15pct"),
                      scaled("tier12_arr", 15, 1200).alias("tier12_target_mrr_15pct"))


def arr_by_plan(run: ScoringRun) -> DataFrame:
    return (with_uplift(run).groupBy("plan_tier")
            .agg(F.count(F.lit(1)).alias("accounts"),
                 F.avg("expansion_readiness_score").alias("_a"),
                 F.sum("potential_arr_uplift").alias("total_arr_potential"))
            .select("plan_tier", "accounts", dround("_a", 1).alias("avg_score"),
                    "total_arr_potential"))


def target_list(run: ScoringRun) -> DataFrame:
    return (with_uplift(run).select(*TARGET_LIST_COLS)
            .orderBy(F.desc("expansion_readiness_score"), "account_id"))


# --------------------------------------------------------------------------
# follow-up jobs described by the analysis
# --------------------------------------------------------------------------
def dual_top_overlap(run: ScoringRun, k: int = 20) -> DataFrame:
    """Accounts in both the model's and the SQL score's top-k lists."""
    model_top = (run.universe_scored.orderBy(F.desc("expansion_readiness_score"), "account_id")
                 .limit(k).select("account_id", "account_name", "expansion_readiness_score"))
    sql_top = sql_queries.top_targets(run.t, k).select("account_id", "sql_expansion_score")
    return model_top.join(sql_top, "account_id")


def tier_transitions(prev: ScoringRun, cur: ScoringRun) -> DataFrame:
    """Band movements between two snapshots scored with the same model and
    scaler; ``entered_tier1`` flags new Very High accounts."""
    a = prev.universe_scored.select("account_id", F.col("expansion_readiness_score").alias("prev_score"),
                                    F.col("readiness_band").alias("prev_band"))
    b = cur.universe_scored.select("account_id", F.col("expansion_readiness_score").alias("cur_score"),
                                   F.col("readiness_band").alias("cur_band"))
    j = a.join(b, "account_id", "full")
    return (j.where(~F.col("prev_band").eqNullSafe(F.col("cur_band")))
            .select("account_id", "prev_band", "cur_band", "prev_score", "cur_score",
                    dround("cur_score - prev_score", 1).alias("score_change"),
                    (F.coalesce(F.col("cur_band") == "Very High", F.lit(False))
                     & ~F.coalesce(F.col("prev_band") == "Very High", F.lit(False))).alias("entered_tier1")))


def score_history(run: ScoringRun) -> DataFrame:
    """(snapshot, readiness_band, accounts, avg_score) of the expansion universe as
    of each earlier date (days before the latest subscription start) and now
    (0): the accounts that had signed up and not churned by then."""
    out = None
    for n, r in sorted({**run.earlier, 0: run}.items(), reverse=True):
        part = (r.universe_scored.where("readiness_band IS NOT NULL").groupBy("readiness_band")
                .agg(F.count(F.lit(1)).alias("accounts"), F.avg("expansion_readiness_score").alias("_a"))
                .select(F.lit(n).alias("snapshot"), "readiness_band", "accounts", dround("_a", 1).alias("avg_score")))
        out = part if out is None else out.unionByName(part)
    return out


def conversion_by_tier(run: ScoringRun) -> DataFrame:
    """Observed upgrade rate per outreach priority (is the model ranking
    correctly? tier 1 should convert well above tier 3)."""
    s = run.universe_scored.withColumn("outreach_priority", outreach_priority(F.col("readiness_band")))
    return (s.where(F.col("outreach_priority").isNotNull())
            .groupBy("outreach_priority")
            .agg(F.count(F.lit(1)).alias("accounts"),
                 F.count(F.col("has_upgraded")).alias("labelled"),
                 F.count_if("has_upgraded").alias("converted"))
            .withColumn("conversion_rate_pct", ratio_round("converted", "labelled", 1, 100)))


def tier_conversion_ratio(run: ScoringRun, low: float = 2.0) -> DataFrame:
    """Conversion rate of tier 1 over tier 3 and whether it reaches ``low`` (the
    model ranks as it should); null where tier 3 has no conversion."""
    label = F.col("outreach_priority")
    c = conversion_by_tier(run)

    def one(band: str, col: str):
        return F.sum(F.when(label == OUTREACH[band], F.col(col)))

    agg = c.agg(one("Very High", "converted").alias("c1"), one("Very High", "labelled").alias("n1"),
                one("Medium", "converted").alias("c3"), one("Medium", "labelled").alias("n3"))
    ratio = ratio_round("c1 * n3", "c3 * n1", 2)
    return agg.select(ratio_round("c1", "n1", 1, 100).alias("tier1_pct"), ratio_round("c3", "n3", 1, 100).alias("tier3_pct"),
                      ratio.alias("ratio"), (ratio >= low).alias("ranks_well"))


def model_drift(run: ScoringRun, baseline_top: str = "total_usage_duration",
                min_auc: float = 0.60) -> DataFrame:
    """Retrain signal: hold-out AUC below ``min_auc``, or the top global
    contributor differing from the baseline's."""
    auc = run.auc().select("auc")
    top = (run.contribution_summary().orderBy(F.desc("mean_abs_contribution"), "feature")
           .limit(1).select(F.col("feature").alias("top_feature")))
    return (auc.select("auc", top.scalar().alias("top_feature"))
            .select("auc", (F.col("auc") < min_auc).alias("retrain"),
                    "top_feature", F.lit(baseline_top).alias("baseline_top_feature"),
                    (F.col("top_feature") != baseline_top).alias("top_feature_changed")))


# KPI targets from the analysis' production plan.
KPI_TARGETS = {
    "expansion_mrr_converted": 107854.0,
    "contraction_mrr": 459366.0,
    "nrr_pct": 100.0,
    "pro_to_enterprise_conversion_pct": 15.0,
}


def kpi_vs_target(t: Tables, targets: dict[str, float] | None = None) -> DataFrame:
    """Actual vs target for the monthly/quarterly KPIs.

    Expansion converted = expansion MRR; contraction should stay at or
    below its target; Pro -> Enterprise conversion = upgrade rate of Pro
    subscriptions. Targets are parameters (the analysis' figures by default).
    """
    tg = dict(KPI_TARGETS, **(targets or {}))
    n = revenue.nrr(t)
    pro = (revenue.upgrade_rate_by_plan(t).where(F.col("plan_tier") == "Pro")
           .select(F.col("upgrade_rate_pct").alias("pro")))
    row = n.select("*", pro.scalar().alias("pro"))
    rows = F.inline(F.array(
        F.struct(F.lit("expansion_mrr_converted").alias("kpi"), F.col("expansion_mrr").cast("double").alias("actual"),
                 F.lit(tg["expansion_mrr_converted"]).alias("target"), F.lit(True).alias("higher_is_better")),
        *[F.struct(F.lit(k).alias("kpi"), F.col(c).cast("double").alias("actual"),
                   F.lit(tg[k]).alias("target"), F.lit(hib).alias("higher_is_better"))
          for k, c, hib in [("contraction_mrr", "contraction_mrr", False),
                            ("nrr_pct", "nrr_pct", True),
                            ("pro_to_enterprise_conversion_pct", "pro", True)]]))
    long = row.select(rows)
    met = F.when(F.col("higher_is_better"), F.col("actual") >= F.col("target")) \
           .otherwise(F.col("actual") <= F.col("target"))
    return long.select("kpi", "actual", "target", met.alias("met"))


def tier_summary_formatted(run: ScoringRun) -> DataFrame:
    """Tier summary as displayed: uplift totals as '$1,234' strings."""
    from ..functions.exact import currency
    s = tier_summary(run)
    return s.select("outreach_priority", "accounts", "avg_score",
                    currency(F.col("total_mrr_uplift")).alias("total_mrr_uplift"),
                    currency(F.col("total_arr_uplift")).alias("total_arr_uplift"))


def snapshot_drift(prev: ScoringRun, cur: ScoringRun, min_auc: float = 0.60) -> DataFrame:
    """Drift between two snapshots scored with the same model and scaler:
    hold-out AUC and top global contributor of each; retrain when the
    current AUC falls below ``min_auc``, flag when the top contributor moved.
    """
    def top(run: ScoringRun):
        return (run.contribution_summary().orderBy(F.desc("mean_abs_contribution"), "feature")
                .limit(1).select("feature").scalar())

    prev_auc = prev.auc().select("auc").scalar()
    return (cur.auc().select(F.col("auc"), prev_auc.alias("prev_auc"),
                             top(cur).alias("top_feature"), top(prev).alias("prev_top_feature"))
            .select("auc", "prev_auc", (F.col("auc") < min_auc).alias("retrain"),
                    "top_feature", "prev_top_feature",
                    (F.col("top_feature") != F.col("prev_top_feature")).alias("top_feature_changed")))
