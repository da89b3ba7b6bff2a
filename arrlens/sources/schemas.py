"""Explicit schemas of the five business tables and the fixed vocabularies.

Types follow the data model of the analysis: ids and integral money/duration
amounts are BIGINT so that sums are exact, flags are BOOLEAN, dates are DATE.
"""

from pyspark.sql import types as T

ACCOUNTS = T.StructType([
    T.StructField("account_id", T.LongType(), False),
    T.StructField("account_name", T.StringType()),
    T.StructField("industry", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("referral_source", T.StringType()),
    T.StructField("plan_tier", T.StringType()),
    T.StructField("signup_date", T.DateType()),
    T.StructField("is_trial", T.BooleanType()),
    T.StructField("churn_flag", T.BooleanType()),
])

SUBSCRIPTIONS = T.StructType([
    T.StructField("subscription_id", T.LongType(), False),
    T.StructField("account_id", T.LongType()),
    T.StructField("start_date", T.DateType()),
    T.StructField("end_date", T.DateType()),
    T.StructField("plan_tier", T.StringType()),
    T.StructField("mrr_amount", T.LongType()),
    T.StructField("seats", T.LongType()),
    T.StructField("billing_frequency", T.StringType()),
    T.StructField("auto_renew_flag", T.BooleanType()),
    T.StructField("upgrade_flag", T.BooleanType()),
    T.StructField("downgrade_flag", T.BooleanType()),
    T.StructField("churn_flag", T.BooleanType()),
])

FEATURE_USAGE = T.StructType([
    T.StructField("usage_id", T.StringType(), False),
    T.StructField("subscription_id", T.LongType()),
    T.StructField("usage_date", T.DateType()),
    T.StructField("feature_name", T.StringType()),
    T.StructField("usage_count", T.LongType()),
    T.StructField("usage_duration_secs", T.LongType()),
    T.StructField("error_count", T.LongType()),
    T.StructField("is_beta_feature", T.BooleanType()),
])

SUPPORT = T.StructType([
    T.StructField("ticket_id", T.LongType(), False),
    T.StructField("account_id", T.LongType()),
    T.StructField("submitted_at", T.TimestampNTZType()),
    T.StructField("closed_at", T.TimestampNTZType()),
    T.StructField("resolution_time_hours", T.LongType()),
    T.StructField("priority", T.StringType()),
    T.StructField("satisfaction_score", T.DoubleType()),
    T.StructField("escalation_flag", T.BooleanType()),
])

CHURN_EVENTS = T.StructType([
    T.StructField("churn_event_id", T.LongType(), False),
    T.StructField("account_id", T.LongType()),
    T.StructField("churn_date", T.DateType()),
    T.StructField("is_reactivation", T.BooleanType()),
    T.StructField("feedback_text", T.StringType()),
])

SCHEMAS = {
    "accounts": ACCOUNTS,
    "subscriptions": SUBSCRIPTIONS,
    "feature_usage": FEATURE_USAGE,
    "support": SUPPORT,
    "churn_events": CHURN_EVENTS,
}

# Fixed values of the analysis.
# Plan ladder, lowest first; Enterprise has no higher tier.
TIER_ORDER = ["Basic", "Pro", "Enterprise"]
UPSELL_TIERS = ["Basic", "Pro"]
