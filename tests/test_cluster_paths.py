"""The large-cluster code paths give the same results: no broadcast joins
(sort-merge everywhere), more shuffle partitions, no exchange reused."""

import pytest

import __spark_entry__ as entry
from arrlens.operators.scoring import ScoringRun
from oracle_harness import compare, duck

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "11",
    "spark.sql.exchange.reuse": "false",
}
KEYS = ["account_features", "box_stats", "upgrade_by_usage_quartile", "usage_p90_trigger",
        "sql_account_summary", "sql_upgrade_by_segment", "scored_accounts", "tier_transitions",
        "auc", "usage_decline", "snapshot_drift"]


@pytest.fixture(scope="module")
def cluster_like(spark):
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    ScoringRun.clear_shared()
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)
    ScoringRun.clear_shared()


@pytest.mark.parametrize("key", KEYS)
def test_key_on_cluster_paths(cluster_like, sf_dir, key):
    ok, msg = compare(entry.queries()[key](cluster_like, sf_dir), duck(sf_dir), entry.oracle_sql()[key])
    assert ok, msg


def test_no_broadcast_in_cluster_plan(cluster_like, sf_dir):
    plan = entry.queries()["sql_account_summary"](cluster_like, sf_dir) \
        ._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
