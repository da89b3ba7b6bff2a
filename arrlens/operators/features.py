"""Account feature table: one row per account with subscription, usage and
support signals (the model's input).

One builder serves every population: all accounts (training), the expansion
universe (scoring, with the id set applied *before* aggregation as a
left-semi join) and as-of snapshots (for score movements over time).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantile_col, exact_quantiles
from ..sources.fixtures import Tables

SUB_COLS = ["total_mrr", "avg_mrr", "max_mrr", "total_seats", "avg_seats", "n_subscriptions",
            "has_upgraded", "has_downgraded", "is_annual", "auto_renew"]
USAGE_COLS = ["total_usage_count", "avg_usage_count", "total_usage_duration",
              "unique_features_used", "total_errors", "beta_feature_usage"]
SUPPORT_COLS = ["n_tickets", "avg_satisfaction", "avg_resolution_hours", "n_escalations",
                "n_urgent"]
SUB_INPUTS = ["mrr_amount", "seats", "upgrade_flag", "downgrade_flag", "billing_frequency", "auto_renew_flag"]
USAGE_INPUTS = ["feature_name", "usage_count", "usage_duration_secs", "error_count", "is_beta_feature"]
SUPPORT_INPUTS = ["ticket_id", "satisfaction_score", "resolution_time_hours", "escalation_flag", "priority"]
ZERO_FILL = ["total_usage_count", "unique_features_used", "total_errors", "beta_feature_usage",
             "n_tickets", "n_escalations", "n_urgent"]
MEDIAN_FILL = ["avg_satisfaction", "avg_resolution_hours"]
ACCOUNT_COLS = ["account_id", "account_name", "industry", "country", "referral_source",
                "plan_tier", "signup_date", "is_trial", "churn_flag"]
FEATURE_COLS = ACCOUNT_COLS + SUB_COLS + USAGE_COLS + SUPPORT_COLS


@dataclass(frozen=True)
class Snapshot:
    """Which data a feature build sees.

    ``as_of``: ISO date; subscriptions started, usage recorded and tickets
    submitted after it are ignored, and a subscription is active if it had
    not ended by then. ``None`` means the current state (active = no end
    date).
    """

    as_of: str | None = None
    lag_days: int | None = None

    @property
    def current(self) -> bool:
        return self.as_of is None and self.lag_days is None

    def cutoff(self, t: Tables) -> Column:
        """The as-of date; with ``lag_days`` it is that many days before the
        latest subscription start (a scalar subquery, evaluated once)."""
        if self.as_of is not None:
            return F.to_date(F.lit(self.as_of))
        latest = t.subscriptions.select(F.max("start_date")).scalar()
        return F.date_sub(latest, self.lag_days)


def _active_paid(t: Tables, snap: Snapshot) -> DataFrame:
    s = t.subscriptions.where(F.col("mrr_amount") > 0)
    if snap.current:
        return s.where(F.col("end_date").isNull())
    d = snap.cutoff(t)
    return s.where((F.col("start_date") <= d) &
                   (F.col("end_date").isNull() | (F.col("end_date") > d)))


def _usage(t: Tables, snap: Snapshot) -> DataFrame:
    u = t.feature_usage
    if not snap.current:
        u = u.where(F.col("usage_date") <= snap.cutoff(t))
    return u


def _support(t: Tables, snap: Snapshot) -> DataFrame:
    s = t.support
    if not snap.current:
        s = s.where(F.to_date("submitted_at") <= snap.cutoff(t))
    return s


def _restrict(df: DataFrame, population: DataFrame | None) -> DataFrame:
    if population is None:
        return df
    return df.join(population.select("account_id"), "account_id", "left_semi")


def subscription_signals(active_paid: DataFrame, by=("account_id",)) -> DataFrame:
    """Per-account aggregates over active paid subscriptions."""
    return active_paid.groupBy(*by).agg(
        F.sum("mrr_amount").alias("total_mrr"),
        F.avg("mrr_amount").alias("avg_mrr"),
        F.max("mrr_amount").alias("max_mrr"),
        F.coalesce(F.sum("seats"), F.lit(0)).alias("total_seats"),
        F.avg("seats").alias("avg_seats"),
        F.count("subscription_id").alias("n_subscriptions"),
        F.bool_or("upgrade_flag").alias("has_upgraded"),
        F.bool_or("downgrade_flag").alias("has_downgraded"),
        F.bool_or(F.col("billing_frequency") == "annual").alias("is_annual"),
        F.bool_or("auto_renew_flag").alias("auto_renew"))


def usage_sums(rows: DataFrame, by=("account_id",)) -> DataFrame:
    """Sums of usage rows per (account, feature); an empty sum is 0."""
    return (rows.groupBy(*by, "feature_name")
            .agg(F.count("usage_count").alias("n_counted"),
                 *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in [
                     ("usage_count", "usage_count"), ("usage_duration_secs", "usage_duration"),
                     ("error_count", "errors")]], F.count_if("is_beta_feature").alias("beta")))


def usage_by_account_feature(usage: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Usage of the given subscriptions per (account, feature).

    Usage rows are near unique per (subscription, feature, month), so nothing
    is gained by summing them before the join: the needed columns join the
    wanted subscriptions at once (one exchange of the usage rows, split by AQE
    where a subscription is hot), and the sums are combined in the tasks. Per
    (account, feature) the distinct-feature count becomes a plain count.
    """
    subs = subscriptions.select("subscription_id", "account_id")
    return usage_sums(usage.select("subscription_id", *USAGE_INPUTS).join(subs, "subscription_id"))


def usage_by_account_month(usage: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(account_id, month, duration) of the given subscriptions' usage."""
    subs = subscriptions.select("subscription_id", "account_id")
    return (usage.select("subscription_id", F.date_format("usage_date", "yyyy-MM").alias("month"),
                         "usage_duration_secs")
            .join(subs, "subscription_id").groupBy("account_id", "month")
            .agg(F.sum("usage_duration_secs").alias("duration")))


def usage_signals(per_feature: DataFrame, by=("account_id",)) -> DataFrame:
    """Per-account usage aggregates from the (account, feature) roll-up."""
    return (per_feature.groupBy(*by).agg(
        F.sum("usage_count").alias("total_usage_count"),
        F.sum("n_counted").alias("_counted"),
        F.sum("usage_duration").alias("total_usage_duration"),
        F.count("feature_name").alias("unique_features_used"),
        F.sum("errors").alias("total_errors"),
        F.sum("beta").alias("beta_feature_usage"))
        .withColumn("avg_usage_count", F.try_divide(F.col("total_usage_count"), F.col("_counted")))
        .drop("_counted"))


def support_signals(support: DataFrame, by=("account_id",)) -> DataFrame:
    return support.groupBy(*by).agg(
        F.count("ticket_id").alias("n_tickets"),
        F.avg("satisfaction_score").alias("avg_satisfaction"),
        F.avg("resolution_time_hours").alias("avg_resolution_hours"),
        F.count_if("escalation_flag").alias("n_escalations"),
        F.count_if(F.col("priority") == "urgent").alias("n_urgent"))


def median_col(df: DataFrame, c: str) -> Column:
    """Median of ``c`` over ``df`` (mean of the two middle values, as pandas
    does) as a scalar subquery, evaluated once."""
    return exact_quantile_col(df, c, 0.5, median=True)


def medians(df: DataFrame, cols: list[str]) -> dict[str, Column]:
    """Medians of several columns from one quantile pipeline (unpivoted)."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"),
                                                 F.col(c).cast("double").alias("v"))
                                        for c in cols])))
    res = exact_quantiles(long, "v", [0.5], by=["metric"], median=True)
    m = res.select(F.map_from_entries(F.collect_list(F.struct("metric", "value")))).scalar()
    return {c: m[F.lit(c)] for c in cols}


def raw_features(t: Tables, population: DataFrame | None = None,
                 snap: Snapshot = Snapshot()) -> DataFrame:
    """Accounts (or ``population``) left-joined to the three signal tables."""
    active_paid = _restrict(_active_paid(t, snap), population)
    usage = usage_by_account_feature(_usage(t, snap), active_paid)
    base = population if population is not None else t.accounts
    return (base.select(*ACCOUNT_COLS)
            .join(subscription_signals(active_paid), "account_id", "left")
            .join(usage_signals(usage), "account_id", "left")
            .join(support_signals(_restrict(_support(t, snap), population)), "account_id", "left")
            .select(*FEATURE_COLS))


def fill_features(raw: DataFrame) -> DataFrame:
    """Zero-fill count signals; median-fill satisfaction and resolution time,
    with medians taken over the same table after the joins."""
    meds = medians(raw, MEDIAN_FILL)
    out = []
    for c in FEATURE_COLS:
        if c in ZERO_FILL:
            out.append(F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c))
        elif c in MEDIAN_FILL:
            out.append(F.coalesce(F.col(c), meds[c]).alias(c))
        else:
            out.append(F.col(c))
    return raw.select(*out)


def _maybe_materialize(df: DataFrame, materialize: bool) -> DataFrame:
    if not materialize:
        return df
    from ..session import materialize as _m
    return _m(df)


def account_features(t: Tables, snap: Snapshot = Snapshot(), materialize: bool = True) -> DataFrame:
    """Master feature table over all accounts (churned included).

    The joined raw table is checkpointed (it is read again by the median
    subqueries and by every consumer); pass ``materialize=False`` to keep
    everything lazy.
    """
    return fill_features(_maybe_materialize(raw_features(t, None, snap), materialize))


def universe_features(t: Tables, snap: Snapshot = Snapshot(), materialize: bool = True) -> DataFrame:
    """Feature table rebuilt for the expansion universe only; fills use
    medians over the universe (as the scoring step of the analysis does)."""
    from .profile import expansion_universe
    raw = raw_features(t, expansion_universe(t), snap)
    return fill_features(_maybe_materialize(raw, materialize))

