"""Query registry: one callable per operator key, ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import profile, revenue
from ..functions.exact import dround_col
from ..session import configure
from ..sources.fixtures import Tables
from . import sql_queries

QueryFn = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Callable[[Tables], DataFrame]] = {}


def register(key: str, fn: Callable[[Tables], DataFrame]) -> None:
    _REGISTRY[key] = fn


def _wrap(fn: Callable[[Tables], DataFrame]) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        t = Tables(spark, sf_dir)
        df = fn(t)
        # results of the shared run keep its tables alive, should the sources change meanwhile
        return ScoringRun.shared(t).scope.lend(df) if "manifest" in t.__dict__ else df
    run.__doc__ = fn.__doc__
    return run


# profiling ---------------------------------------------------------------
register("profile_row_counts", profile.row_counts)
register("profile_fk", profile.foreign_keys)
register("profile_fanout", profile.fanout)
register("profile_date_ranges", profile.date_ranges)
register("account_distribution", profile.account_distribution)
register("account_status", profile.account_status)
register("reactivation_share", profile.reactivation_share)
register("expansion_universe", profile.expansion_universe)
register("subscription_summary", profile.subscription_summary)
register("avg_mrr_by_tier", profile.avg_mrr_by_tier)

# revenue ---------------------------------------------------------------------
register("mrr_snapshot", revenue.mrr_snapshot)
register("mrr_by_plan", revenue.mrr_by_plan)
register("monthly_mrr", revenue.monthly_mrr)
register("nrr", revenue.nrr)
register("nrr_by_segment", revenue.nrr_by_segment)
register("upgrade_rate_by_plan", revenue.upgrade_rate_by_plan)
register("upgrade_rate_by_industry", lambda t: revenue.upgrade_rate_by_account_dim(t, "industry"))
register("upgrade_rate_by_referral",
         lambda t: revenue.upgrade_rate_by_account_dim(t, "referral_source"))
register("expansion_opportunity", revenue.expansion_opportunity)

# SQL queries -------------------------------------------------------------------
register("sql_mrr_by_plan_month", sql_queries.mrr_by_plan_month)
register("sql_upgrade_by_segment", sql_queries.upgrade_by_segment)
register("sql_account_summary", sql_queries.account_summary)
register("sql_nrr", sql_queries.nrr)
register("sql_top_targets", sql_queries.top_targets)
register("mrr_month_pivot", sql_queries.mrr_month_pivot)


def queries() -> dict[str, QueryFn]:
    out = {k: _wrap(fn) for k, fn in _REGISTRY.items()}
    out.update(_STREAMING)
    return out


from pyspark.sql import functions as _F  # noqa: E402

# features, signals, model, scoring, targets ------------------------------------
from ..operators import features as _feat  # noqa: E402
from ..operators import model as _model  # noqa: E402
from ..operators import signals as _sig  # noqa: E402
from ..operators import targets as _tg  # noqa: E402
from ..operators.early_warning import early_warning  # noqa: E402
from ..operators.period_kpis import kpi_by_period  # noqa: E402
from ..operators.scoring import ScoringRun  # noqa: E402
from ..operators.sparse import SparseDesign  # noqa: E402

register("features_subscription",
         lambda t: _feat.subscription_signals(t.active_paid_subscriptions))
register("features_usage", lambda t: _feat.usage_signals(
    _feat.usage_by_account_feature(t.feature_usage, t.active_paid_subscriptions)))
register("features_support", lambda t: _feat.support_signals(t.support))
register("account_features", lambda t: ScoringRun.shared(t).features)
register("null_audit", lambda t: profile.null_audit(ScoringRun.shared(t).features))
register("cohort_usage", lambda t: _sig.cohort_comparison(ScoringRun.shared(t).features, _sig.COHORT_USAGE))
register("cohort_support",
         lambda t: _sig.cohort_comparison(ScoringRun.shared(t).features, _sig.COHORT_SUPPORT))
register("cohort_seats", lambda t: _sig.cohort_comparison(ScoringRun.shared(t).features, _sig.COHORT_SEATS))
register("account_upgrade_rate", lambda t: _sig.account_upgrade_rate(ScoringRun.shared(t).features))
register("box_stats", lambda t: _sig.box_stats(ScoringRun.shared(t).features))
register("label_correlation", lambda t: _sig.label_correlation(ScoringRun.shared(t).features))
register("label_correlation_top5", lambda t: _sig.label_correlation_top(ScoringRun.shared(t).features))
register("upgrade_by_usage_quartile",
         lambda t: _sig.upgrade_by_usage_quartile(ScoringRun.shared(t).features))
register("usage_p90_trigger", lambda t: _sig.usage_p90_trigger(ScoringRun.shared(t).universe_features))
register("usage_decline", _sig.usage_decline)
register("early_warning", early_warning)
register("kpi_by_period", kpi_by_period)

# model ------------------------------------------------------------------------
register("class_balance", lambda t: ScoringRun.shared(t).features.where("has_upgraded IS NOT NULL")
         .groupBy("has_upgraded").count().withColumnRenamed("count", "accounts"))
register("one_hot", lambda t: ScoringRun.shared(t).encoded)
register("train_test_split", lambda t: ScoringRun.shared(t).labelled.select("account_id", "has_upgraded", "is_test"))
register("class_weights", lambda t: _model.class_weights(ScoringRun.shared(t).train))
register("standardized_features", lambda t: ScoringRun.shared(t).standardized())
register("linear_score", lambda t: ScoringRun.shared(t).test_scores())
register("auc", lambda t: ScoringRun.shared(t).auc())
register("classification_report", lambda t: ScoringRun.shared(t).classification_report())
register("roc_curve", lambda t: ScoringRun.shared(t).roc_curve())
register("contribution_summary", lambda t: ScoringRun.shared(t).contribution_summary())
register("engagement_score", lambda t: ScoringRun.shared(t).engagement_score())


def _lr_fit(t):
    run = ScoringRun.shared(t)
    return _model.coefficient_table(t.spark, run.fitted(), run.names)


def _lr_coefficients(t):
    """Top-5 positive and top-5 negative fitted coefficients."""
    from pyspark.sql import functions as F
    tab = _lr_fit(t).where("feature <> 'intercept'")
    pos = tab.where("coefficient > 0").orderBy(F.desc("coefficient"), "feature").limit(5)
    neg = tab.where("coefficient < 0").orderBy("coefficient", "feature").limit(5)
    both = pos.withColumn("direction", F.lit("increases")).unionByName(neg.withColumn("direction", F.lit("decreases")))
    return both.orderBy(F.desc("abs_coefficient"), "feature")


def _lr_scored(t):
    """Universe scored with the coefficients fitted on this data."""
    run = ScoringRun.shared(t)
    return ScoringRun(t, model=run.fitted(), reference=run).scored_accounts


def _design(t):
    """The session's sparse design of the shared feature table."""
    run = ScoringRun.shared(t)
    if not hasattr(run, "sparse_design"):
        run.sparse_design = SparseDesign(run.features)
    return run.sparse_design


def _lr_gradient(t):
    """Size of the penalised objective's gradient at the fitted point, per input (0 at the optimum)."""
    design = _design(t)
    g = design.gradient(design.fit())
    return g.select("feature", dround_col(_F.abs("gradient"), 6).alias("abs_gradient"))


register("category_dictionary", lambda t: _design(t).dictionary.select(
    "cat", "value", "idx", "n_train", dround_col(_F.col("mean"), 6).alias("mean"),
    dround_col(_F.col("std"), 6).alias("std")))
register("sparse_features", lambda t: _design(t).entries())
register("lr_gradient", _lr_gradient)
register("lr_fit", _lr_fit)
register("lr_coefficients", _lr_coefficients)
register("lr_scored_accounts", _lr_scored)

# scoring ------------------------------------------------------------------------
register("universe_features", _feat.universe_features)
register("readiness_score", lambda t: ScoringRun.shared(t).readiness_score())
register("readiness_band", lambda t: ScoringRun.shared(t).readiness_bands())
register("contributions", lambda t: ScoringRun.shared(t).contributions())
register("top_reasons", lambda t: ScoringRun.shared(t).top_reasons())
register("score_distribution", lambda t: ScoringRun.shared(t).score_distribution())
register("top_scored", lambda t: ScoringRun.shared(t).top_scored(10))
register("score_histogram", lambda t: ScoringRun.shared(t).score_histogram())
register("scored_accounts", lambda t: ScoringRun.shared(t).scored_accounts.orderBy(
    _F.desc("expansion_readiness_score"), "account_id"))

# target list ----------------------------------------------------------------------
register("score_by_plan", lambda t: _tg.score_by_plan(ScoringRun.shared(t)))
register("target_uplift", lambda t: _tg.target_uplift(ScoringRun.shared(t)))
register("tier_summary", lambda t: _tg.tier_summary(ScoringRun.shared(t)))
register("top_targets", lambda t: _tg.top_targets(ScoringRun.shared(t)))
register("arr_opportunity", lambda t: _tg.arr_opportunity(ScoringRun.shared(t)))
register("arr_by_plan", lambda t: _tg.arr_by_plan(ScoringRun.shared(t)))
register("target_list", lambda t: _tg.target_list(ScoringRun.shared(t)))
register("dual_top_overlap", lambda t: _tg.dual_top_overlap(ScoringRun.shared(t)))


def _transitions(t):
    cur = ScoringRun.shared(t)
    return _tg.tier_transitions(cur.earlier[180], cur)


register("tier_transitions", _transitions)
register("score_history", lambda t: _tg.score_history(ScoringRun.shared(t)))
register("tier_conversion_ratio", lambda t: _tg.tier_conversion_ratio(ScoringRun.shared(t)))
register("conversion_by_tier", lambda t: _tg.conversion_by_tier(ScoringRun.shared(t)))
register("model_drift", lambda t: _tg.model_drift(ScoringRun.shared(t)))
register("kpi_vs_target", _tg.kpi_vs_target)


# streaming --------------------------------------------------------------------------
def _usage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.usage_stream import usage_stream
    configure(spark)
    return usage_stream(spark, sf_dir)


def _usage_live_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.usage_stream import live_threshold_check
    configure(spark)
    return live_threshold_check(spark, sf_dir)


_STREAMING = {"usage_stream": _usage_stream, "usage_live_threshold": _usage_live_threshold}
register("tier_summary_formatted", lambda t: _tg.tier_summary_formatted(ScoringRun.shared(t)))


def _snapshot_drift(t):
    cur = ScoringRun.shared(t)
    return _tg.snapshot_drift(cur.earlier[180], cur)


register("snapshot_drift", _snapshot_drift)
