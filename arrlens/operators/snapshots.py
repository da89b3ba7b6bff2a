"""Feature tables as of several past dates, built in one pass.

Every record has a validity interval: a subscription from its start to its
end, an account from its signup on, with a status that holds from one churn or
reactivation event to the next; usage and tickets count from their day on. Each record
is dealt to its account's task once and copied there to the snapshot dates inside its
interval (an as-of join against a handful of literal dates), and all further grouping
carries the snapshot as a key. So the tables are read, joined and shuffled once for all dates.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import dealt
from ..sources.fixtures import Tables
from . import features as FE

LAGS = (360, 270, 180, 90)   # days before the latest subscription start


def lag_dates(t: Tables, lags=LAGS) -> dict[int, dt.date]:
    """Snapshot number (its lag) to date; empty without subscriptions."""
    latest = t.subscriptions.agg(F.max("start_date")).first()[0]
    return {n: latest - dt.timedelta(days=n) for n in lags} if latest else {}


def copied(df: DataFrame, dates: dict[int, dt.date], valid) -> DataFrame:
    """``df`` once per date for which ``valid(date)`` holds, with ``snapshot`` and
    ``snapshot_date``."""
    all_dates = F.array(*[F.struct(F.lit(n).alias("snapshot"), F.lit(d).alias("snapshot_date"))
                          for n, d in sorted(dates.items())])
    at = F.explode(F.filter(all_dates, lambda s: F.coalesce(valid(s["snapshot_date"]), F.lit(False)))).alias("at")
    return df.select("*", at).select(*df.columns, "at.*")


def status_intervals(t: Tables) -> DataFrame:
    """(account_id, valid_from, valid_to, churned): an account's states, half-open.

    With events, it is active until the first one, and each event holds until
    the next (of several on one day the last by id); a reactivation ends a
    churn. Without any dated event, today's flag holds throughout. ``valid_from`` null
    is open; so is ``valid_to``."""
    daily = (t.churn_events.where("churn_date IS NOT NULL").groupBy("account_id", "churn_date")
             .agg(F.max_by("is_reactivation", "churn_event_id").alias("back")))
    by_account = Window.partitionBy("account_id").orderBy("churn_date")   # one row per day with an event
    states = daily.select("account_id", F.col("churn_date").alias("valid_from"),
                          F.lead("churn_date").over(by_account).alias("valid_to"), (~F.col("back")).alias("churned"))
    before = daily.groupBy("account_id").agg(F.min("churn_date").alias("valid_to")).select(
        "account_id", F.lit(None).cast("date").alias("valid_from"), "valid_to", F.lit(False).alias("churned"))
    none = F.lit(None).cast("date")
    plain = t.accounts_core.join(before.select("account_id"), "account_id", "left_anti").select(
        "account_id", none.alias("valid_from"), none.alias("valid_to"), F.col("churn_flag").alias("churned"))
    return states.unionByName(before).unionByName(plain)


def accounts_asof(t: Tables, dates: dict[int, dt.date]) -> DataFrame:
    """Accounts that had signed up by each date, with their churn flag of that date."""
    status = copied(status_intervals(t), dates,
                    lambda d: (F.col("valid_from").isNull() | (F.col("valid_from") <= d)) &
                    (F.col("valid_to").isNull() | (F.col("valid_to") > d)))
    own = t.accounts.select(*[c for c in FE.ACCOUNT_COLS if c != "churn_flag"])
    return (own.join(status.select("account_id", "snapshot", "snapshot_date", F.col("churned").alias("churn_flag")),
                     "account_id")
            .where(F.col("signup_date") <= F.col("snapshot_date")))


def holds_at(d) -> Column:
    """Whether the interval from ``valid_from`` up to, not including, ``valid_to`` (null: open) holds date ``d``."""
    return (F.col("valid_from") <= d) & (F.col("valid_to").isNull() | (F.col("valid_to") > d))


def dealt_and_copied(df: DataFrame, dates: dict[int, dt.date]) -> DataFrame:
    """The rows with ``valid_from`` and ``valid_to`` at each date that they hold.
    They are dealt by account as they are and copied after that, so that neither the
    shuffle nor a sum before it grows with the number of dates; the sums by
    snapshot and account that follow need no further shuffle."""
    some = reduce(lambda a, b: a | b, [holds_at(F.lit(d)) for d in dates.values()])
    return copied(dealt(df.where(some), "account_id"), dates, holds_at)


def raw_features(t: Tables, dates: dict[int, dt.date]) -> DataFrame:
    """The raw feature table of every date, with its number in ``snapshot``."""
    by = ["snapshot", "account_id"]
    last = F.lit(max(dates.values()))
    paid = t.subscriptions.where((F.col("mrr_amount") > 0) & (F.col("start_date") <= last)).withColumns(
        {"valid_from": F.col("start_date"), "valid_to": F.col("end_date")})
    active = dealt_and_copied(paid.select("account_id", "subscription_id", "valid_from", "valid_to", *FE.SUB_INPUTS), dates)
    used = (t.feature_usage.where(F.col("usage_date") <= last).select("subscription_id", "usage_date", *FE.USAGE_INPUTS)
            .join(paid.select("subscription_id", "account_id", "valid_from", "valid_to"), "subscription_id")
            .withColumn("valid_from", F.greatest("valid_from", "usage_date")))
    usage = FE.usage_sums(dealt_and_copied(used.select("account_id", "valid_from", "valid_to", *FE.USAGE_INPUTS), dates), by)
    tickets = t.support.where(F.to_date("submitted_at") <= last).withColumns(
        {"valid_from": F.to_date("submitted_at"), "valid_to": F.lit(None).cast("date")})
    support = dealt_and_copied(tickets.select("account_id", "valid_from", "valid_to", *FE.SUPPORT_INPUTS), dates)
    return (accounts_asof(t, dates)
            .join(FE.subscription_signals(active, by), by, "left")
            .join(FE.usage_signals(usage, by), by, "left")
            .join(FE.support_signals(support, by), by, "left")
            .select("snapshot", *FE.FEATURE_COLS))
