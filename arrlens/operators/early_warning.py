"""Downgrade early warning on a calendar spine.

Usage per account and month only has rows for months with usage, so an account
that falls silent just stops having rows. The spine gives every account with an active
paid subscription one row per calendar month, from the month its first such
subscription began to the latest month with usage anywhere, and months without
usage count as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import dround_col, ratio_round
from ..functions.quantiles import exact_quantile_col
from ..sources.fixtures import Tables


def month_index(date: Column) -> Column:
    """Months since year 0."""
    return (F.year(date) * 12 + F.month(date) - 1).cast("int")


def month_text(index: Column) -> Column:
    return F.date_format(F.make_date(F.floor(index / 12).cast("int"), index % 12 + 1, F.lit(1)), "yyyy-MM")


def monthly_usage(t: Tables) -> DataFrame:
    """(account_id, month, duration) over the active paid subscriptions, summed per
    subscription and month before accounts are known."""
    subs = t.active_paid_subscriptions.select("subscription_id", "account_id")
    return (t.feature_usage.select("subscription_id", month_index(F.col("usage_date")).alias("month"),
                                   "usage_duration_secs")
            .join(subs, "subscription_id").where("month IS NOT NULL").groupBy("account_id", "month")
            .agg(F.sum("usage_duration_secs").alias("duration")))


def usage_spine(t: Tables, monthly: DataFrame | None = None) -> DataFrame:
    """(account_id, month, duration): every calendar month of every account with
    an active paid subscription, 0 where nothing was used. Usage before the
    first subscription's month widens the account's spine."""
    monthly = monthly_usage(t) if monthly is None else monthly
    last = monthly.select(F.max("month")).scalar()
    since = t.active_paid_subscriptions.groupBy("account_id").agg(
        F.min(month_index(F.col("start_date"))).alias("first"))
    # the account's own rows and its bounds meet in one aggregation, so the spine needs no join
    both = monthly.select("account_id", "month", "duration", F.col("month").alias("first")).unionByName(
        since.select("account_id", "first"), allowMissingColumns=True)
    per = both.groupBy("account_id").agg(
        F.min("first").alias("first"),
        F.map_from_entries(F.collect_list(F.when(F.col("month").isNotNull(), F.struct("month", "duration")))).alias("used"))
    spine = per.where(F.col("first") <= last).select(
        "account_id", "used", F.explode(F.sequence(F.col("first"), last)).alias("month"))
    return spine.select("account_id", "month", F.coalesce(F.col("used")[F.col("month")], F.lit(0)).alias("duration"))


def early_warning(t: Tables, q: float = 0.9) -> DataFrame:
    """Accounts to call, as of the latest month with usage anywhere.

    ``silent``: no usage in that month (``months_silent`` calendar months in a
    row; for an account that never used anything, since it subscribed).
    ``declining``: usage fell against the previous calendar month and lies below the exact
    q-th percentile of usage per account and month (heavy users that dip
    are left alone); ``months_declining`` counts the months of unbroken fall."""
    monthly = monthly_usage(t)
    threshold = exact_quantile_col(monthly, "duration", q)
    by_account = Window.partitionBy("account_id").orderBy("month")   # one row per month
    rows = usage_spine(t, monthly).withColumn("previous", F.lag("duration").over(by_account))
    fell = F.coalesce(F.col("duration") < F.col("previous"), F.lit(False))
    now = rows.groupBy("account_id").agg(
        F.max("month").alias("month"), F.max_by("duration", "month").alias("duration"),
        F.max_by("previous", "month").alias("prev_duration"),
        (F.max("month") - F.max(F.when(~fell, F.col("month")))).alias("months_declining"),
        (F.max("month") - F.coalesce(F.max(F.when(F.col("duration") > 0, F.col("month"))),
                                     F.min("month") - 1)).alias("months_silent"))
    status = (F.when(F.col("months_silent") > 0, "silent")
              .when((F.col("months_declining") > 0) & (F.col("duration") < threshold), "declining"))
    return (now.withColumn("status", status).where(F.col("status").isNotNull())
            .select("account_id", "status", month_text(F.col("month")).alias("month"), "duration", "prev_duration",
                    ratio_round("prev_duration - duration", "prev_duration", 1, 100).alias("decline_pct"),
                    "months_declining", "months_silent", dround_col(threshold, 6).alias("threshold"))
            .orderBy(F.desc("months_silent"), F.desc("decline_pct"), "account_id"))
