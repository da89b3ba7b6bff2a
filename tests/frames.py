"""Hand-written business tables for edge-case tests."""

import datetime as dt

from arrlens.sources.fixtures import FrameTables
from arrlens.sources.schemas import ACCOUNTS, CHURN_EVENTS, FEATURE_USAGE, SUBSCRIPTIONS, SUPPORT

D = dt.date(2024, 1, 1)
TS = dt.datetime(2024, 1, 1, 12, 0)


def acc(i, tier="Basic", industry="A", referral="R1", churn=False):
    return (i, f"Co_{i}", industry, "X", referral, tier, D, False, churn)


def sub(sid, aid, mrr=100, tier="Basic", ended=False, up=False, down=False, churn=False,
        seats=1, annual=False, renew=True):
    return (sid, aid, D, D if ended else None, tier, mrr, seats, "annual" if annual else "monthly",
            renew, up, down, churn)


def use(uid, sid, feat="f1", count=1, dur=10, err=0, beta=False):
    return (uid, sid, D, feat, count, dur, err, beta)


def ticket(tid, aid, sat=None, hours=1, prio="low", esc=False):
    return (tid, aid, TS, TS, hours, prio, sat, esc)


def tables(spark, accounts, subscriptions=(), usage=(), tickets=(), churn=()):
    return FrameTables(
        spark,
        accounts=spark.createDataFrame(list(accounts), ACCOUNTS),
        subscriptions=spark.createDataFrame(list(subscriptions), SUBSCRIPTIONS),
        feature_usage=spark.createDataFrame(list(usage), FEATURE_USAGE),
        support=spark.createDataFrame(list(tickets), SUPPORT),
        churn_events=spark.createDataFrame(list(churn), CHURN_EVENTS),
    )
