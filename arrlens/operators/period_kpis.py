"""Production KPIs per month and quarter against their targets.

Facts are summed per month and industry first; a period spine gives every
industry every month between the first and last, so quiet months show 0
instead of vanishing, and grouping sets roll the same small rows up to quarters
and to all industries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import ratio_round
from ..sources.fixtures import Tables
from .early_warning import month_index

# Targets of the analysis' production plan. MRR per month;
# conversion of Pro subscriptions per quarter; conversion in % by industry
# (the first is a floor, the second a ceiling).
MONTHLY_EXPANSION_MRR = 107854.0
MONTHLY_CONTRACTION_MRR = 459366.0
QUARTERLY_PRO_CONVERSION_PCT = 15.0
INDUSTRY_CONVERSION_PCT = {"HealthTech": (12.0, True), "EdTech": (8.0, False)}


def monthly_facts(t: Tables) -> DataFrame:
    """(month, industry, ...) sums over paid subscriptions: those started in
    the month, and the MRR of those that ended in it. Accounts without an industry
    count as 'unknown'."""
    s = t.paid_subscriptions.select("account_id", "start_date", "end_date", "plan_tier", "mrr_amount", "upgrade_flag",
                                    "downgrade_flag")
    zero = F.lit(0).cast("bigint")
    starts = s.select("account_id", month_index(F.col("start_date")).alias("month"), F.lit(1).cast("bigint").alias("started"),
                      F.col("upgrade_flag").cast("bigint").alias("upgraded"),
                      (F.col("plan_tier") == "Pro").cast("bigint").alias("pro_started"),
                      ((F.col("plan_tier") == "Pro") & F.col("upgrade_flag")).cast("bigint").alias("pro_upgraded"),
                      F.when(F.col("upgrade_flag"), F.col("mrr_amount")).otherwise(zero).alias("expansion_mrr"),
                      F.when(F.col("downgrade_flag"), F.col("mrr_amount")).otherwise(zero).alias("contraction_mrr"),
                      zero.alias("churned_mrr"))
    ends = s.where("end_date IS NOT NULL").select(
        "account_id", month_index(F.col("end_date")).alias("month"), *[zero.alias(c) for c in starts.columns[2:-1]],
        F.col("mrr_amount").alias("churned_mrr"))
    facts = [c for c in starts.columns if c not in ("account_id", "month")]
    # per account first: the accounts join is then one row per account and month
    per = (starts.unionByName(ends).where("month IS NOT NULL").groupBy("account_id", "month")
           .agg(*[F.sum(c).alias(c) for c in facts]))
    industry = t.accounts_core.select("account_id", F.coalesce("industry", F.lit("unknown")).alias("industry"))
    return per.join(industry, "account_id").groupBy("month", "industry").agg(*[F.sum(c).alias(c) for c in facts])


def period_facts(t: Tables) -> DataFrame:
    """(period_type, period, industry, ...): the facts per month and quarter, by
    industry and over all ('All'), periods without any included."""
    facts = monthly_facts(t)
    names = [c for c in facts.columns if c not in ("month", "industry")]
    lo, hi = facts.select(F.min("month")).scalar(), facts.select(F.max("month")).scalar()
    spine = facts.select("industry").distinct().select("industry", F.explode(F.sequence(lo, hi)).alias("month"))
    filled = spine.join(facts, ["industry", "month"], "left").select(
        "industry", "month", (F.floor(F.col("month") / 3)).cast("int").alias("quarter"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    c = [F.col("month"), F.col("quarter"), F.col("industry")]
    rolled = filled.groupingSets([[c[0]], [c[0], c[2]], [c[1]], [c[1], c[2]]], *c).agg(
        F.grouping("month").alias("by_quarter"), F.grouping("industry").alias("over_all"),
        *[F.sum(n).alias(n) for n in names])
    year = F.floor(F.coalesce(F.col("quarter") * 3, F.col("month")) / 12).cast("string")
    within = F.when(F.col("by_quarter") == 1, F.concat(F.lit("-Q"), F.col("quarter") % 4 + 1)).otherwise(
        F.concat(F.lit("-"), F.lpad((F.col("month") % 12 + 1).cast("string"), 2, "0")))
    return rolled.select(F.when(F.col("by_quarter") == 1, "quarter").otherwise("month").alias("period_type"),
                         F.concat(year, within).alias("period"),
                         F.when(F.col("over_all") == 1, "All").otherwise(F.col("industry")).alias("industry"), *names)


def kpi_by_period(t: Tables, industry_targets: dict[str, tuple[float, bool]] | None = None) -> DataFrame:
    """(period_type, period, industry, kpi, actual, target, met).

    Expansion and contraction MRR, and the conversion of Pro subscriptions, have targets
    over all industries (a quarter's MRR target is three months'; the Pro one is per
    quarter); conversion by industry has the industries' own. Rows without
    a target have ``met`` null, as has a rate without any subscription."""
    targets = INDUSTRY_CONVERSION_PCT if industry_targets is None else industry_targets
    f = period_facts(t)
    months = F.when(F.col("period_type") == "quarter", 3.0).otherwise(1.0)
    over_all, quarter = F.col("industry") == "All", F.col("period_type") == "quarter"
    none = F.lit(None).cast("double")
    floor_, ceiling = none, none
    for name, (value, at_least) in targets.items():
        hit = F.when(F.col("industry") == name, F.lit(float(value)))
        floor_, ceiling = (hit.otherwise(floor_), ceiling) if at_least else (floor_, hit.otherwise(ceiling))
    kpis = [
        ("expansion_mrr", F.col("expansion_mrr").cast("double"), F.when(over_all, MONTHLY_EXPANSION_MRR * months), none),
        ("contraction_mrr", F.col("contraction_mrr").cast("double"), none,
         F.when(over_all, MONTHLY_CONTRACTION_MRR * months)),
        ("churned_mrr", F.col("churned_mrr").cast("double"), none, none),
        ("upgrade_conversion_pct", ratio_round("upgraded", "started", 1, 100), floor_, ceiling),
        ("pro_conversion_pct", ratio_round("pro_upgraded", "pro_started", 1, 100),
         F.when(over_all & quarter, QUARTERLY_PRO_CONVERSION_PCT), none),
    ]
    rows = F.inline(F.array(*[
        F.struct(F.lit(k).alias("kpi"), actual.alias("actual"), F.coalesce(low, high).cast("double").alias("target"),
                 F.when(low.isNotNull(), actual >= low).when(high.isNotNull(), actual <= high).alias("met"))
        for k, actual, low, high in kpis]))
    return f.select("period_type", "period", "industry", rows).orderBy("period_type", "period", "industry", "kpi")
