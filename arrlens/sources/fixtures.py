"""The five business tables as views over the driver's Parquet tables.

The analysis reads accounts, subscriptions, feature usage, support tickets and
churn events. The test data ships TPC-H-style tables instead, so each business
table is a projection of one driver table (plus fixed-size dimension joins for
accounts). All expressions are plain column arithmetic, so Catalyst pushes
filters and column pruning through them into the Parquet scans.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _tier(expr: Column) -> Column:
    return (F.when(expr == 0, "Basic").when(expr == 1, "Pro").otherwise("Enterprise"))


def _floor_long(expr: Column) -> Column:
    return F.floor(expr).cast("bigint")


def usage_from_lineitem(li: DataFrame) -> DataFrame:
    """feature_usage rows from lineitem rows (batch or streaming frame)."""
    part = F.col("l_partkey")
    return li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    part.cast("string"), F.col("l_suppkey").cast("string")).alias("usage_id"),
        F.col("l_orderkey").alias("subscription_id"),
        F.to_date("l_shipdate").alias("usage_date"),
        F.concat(F.lit("feature_"), (part % 40).cast("string")).alias("feature_name"),
        F.col("l_quantity").cast("bigint").alias("usage_count"),
        _floor_long(F.col("l_extendedprice") / 10).alias("usage_duration_secs"),
        F.when(F.col("l_returnflag") == "R", (F.col("l_linenumber") % 3).cast("bigint"))
         .otherwise(F.lit(0).cast("bigint")).alias("error_count"),
        (part % 40 >= 36).alias("is_beta_feature"),
    )


SOURCES = ("customer", "nation", "region", "orders", "lineitem", "events")


class Tables:
    """Lazy access to driver tables and the business views built on them.

    Nothing is read until an action runs; every property is a plan fragment.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    @cached_property
    def manifest(self) -> tuple:
        """Which files the tables are made of, when this object was first asked."""
        from ..session import manifest
        return manifest(self.spark, [f"{self.sf_dir}/{n}.parquet" for n in SOURCES])

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- accounts ---------------------------------------------------------
    @cached_property
    def accounts(self) -> DataFrame:
        return self.accounts_with(signup=True)

    @cached_property
    def accounts_core(self) -> DataFrame:
        """accounts without signup_date: skips the orders aggregation."""
        return self.accounts_with(signup=False)

    def accounts_with(self, signup: bool) -> DataFrame:
        c = self.raw("customer")
        # nation (25 rows) and region (5 rows) are fixed-size dimension tables.
        n = F.broadcast(self.raw("nation").select("n_nationkey", "n_name", "n_regionkey"))
        r = F.broadcast(self.raw("region").select("r_regionkey", "r_name"))
        df = (c.join(n, c.c_nationkey == n.n_nationkey)
               .join(r, n.n_regionkey == r.r_regionkey))
        key = F.col("c_custkey")
        cols = [
            key.alias("account_id"),
            F.col("c_name").alias("account_name"),
            F.col("c_mktsegment").alias("industry"),
            F.col("n_name").alias("country"),
            F.when(key % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("r_name"))
             .alias("referral_source"),
            _tier(key % 3).alias("plan_tier"),
        ]
        if signup:
            first = (self.raw("orders").groupBy("o_custkey")
                     .agg(F.to_date(F.min("o_orderdate")).alias("signup_date")))
            df = df.join(first, key == first.o_custkey, "left")
            cols.append(F.col("signup_date"))
        else:
            cols.append(F.lit(None).cast("date").alias("signup_date"))
        cols += [
            (key % 10 == 3).alias("is_trial"),
            (F.col("c_acctbal") < 1000).alias("churn_flag"),
        ]
        return df.select(*cols)

    # -- subscriptions ----------------------------------------------------
    @cached_property
    def subscriptions(self) -> DataFrame:
        o = self.raw("orders")
        k, cust = F.col("o_orderkey"), F.col("o_custkey")
        ended = (F.col("o_orderstatus") == "F") & (k % 3 == 0)
        tier_code = (k + cust) % 3
        multiplier = F.when(tier_code == 0, 1).when(tier_code == 1, 3).otherwise(10)
        return o.select(
            k.alias("subscription_id"),
            cust.alias("account_id"),
            F.to_date("o_orderdate").alias("start_date"),
            F.when(ended, F.date_add(F.to_date("o_orderdate"), 90)).alias("end_date"),
            _tier(tier_code).alias("plan_tier"),
            F.when(k % 10 == 7, F.lit(0).cast("bigint"))
             .otherwise(_floor_long(F.col("o_totalprice") / 500) * multiplier)
             .alias("mrr_amount"),
            (1 + (k * 7) % 60).alias("seats"),
            F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "annual")
             .otherwise("monthly").alias("billing_frequency"),
            (k % 5 != 0).alias("auto_renew_flag"),
            ((k * 13) % 100 < 4 + _floor_long(F.col("o_totalprice") / 50000)).alias("upgrade_flag"),
            ((k * 17) % 100 < 4).alias("downgrade_flag"),
            ended.alias("churn_flag"),
        )

    # -- feature usage ----------------------------------------------------
    @cached_property
    def feature_usage(self) -> DataFrame:
        return usage_from_lineitem(self.raw("lineitem"))

    # -- support tickets --------------------------------------------------
    @cached_property
    def support(self) -> DataFrame:
        ev = self.raw("events").where(F.col("event_type") == "error")
        eid = F.col("event_id")
        bucket = _floor_long(eid / 10)
        pr = bucket % 7
        hours = _floor_long(F.col("value"))
        return ev.select(
            eid.alias("ticket_id"),
            (F.col("user_id") * 10 + eid % 10).alias("account_id"),
            F.col("ts").alias("submitted_at"),
            (F.col("ts") + F.make_dt_interval(hours=hours.cast("int"))).alias("closed_at"),
            hours.alias("resolution_time_hours"),
            F.when(pr == 0, "urgent").when(pr == 1, "high").when(pr == 2, "medium")
             .otherwise("low").alias("priority"),
            F.when(bucket % 4 == 0, F.lit(None).cast("double"))
             .otherwise((1 + bucket % 5).cast("double")).alias("satisfaction_score"),
            (F.col("value") > 100).alias("escalation_flag"),
        )

    # -- churn events -----------------------------------------------------
    @cached_property
    def churn_events(self) -> DataFrame:
        ev = self.raw("events").where(F.col("event_type") == "view")
        eid = F.col("event_id")
        return ev.select(
            eid.alias("churn_event_id"),
            (F.col("user_id") * 10 + eid % 10).alias("account_id"),
            F.to_date("ts").alias("churn_date"),
            (_floor_long(eid / 10) % 10 == 0).alias("is_reactivation"),
            F.when(eid % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("props"))
             .alias("feedback_text"),
        )

    def business(self, name: str) -> DataFrame:
        return getattr(self, name)

    # Paid / active subscription subsets used throughout the analysis.
    @property
    def paid_subscriptions(self) -> DataFrame:
        return self.subscriptions.where(F.col("mrr_amount") > 0)

    @property
    def active_paid_subscriptions(self) -> DataFrame:
        return self.subscriptions.where((F.col("mrr_amount") > 0) & F.col("end_date").isNull())


class FrameTables(Tables):
    """Business tables given directly as DataFrames (hand-written test frames,
    or tables loaded by ``readers.read_csv_tables``)."""

    def __init__(self, spark: SparkSession, **frames: DataFrame):
        self.spark = spark
        self.sf_dir = ""
        self._frames = frames

    accounts = property(lambda self: self._frames["accounts"])
    accounts_core = property(lambda self: self._frames["accounts"])
    subscriptions = property(lambda self: self._frames["subscriptions"])
    feature_usage = property(lambda self: self._frames["feature_usage"])
    support = property(lambda self: self._frames["support"])
    churn_events = property(lambda self: self._frames["churn_events"])
