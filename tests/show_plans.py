"""Print physical plans of key queries in the large-cluster shape
(broadcast joins disabled) as markdown: ``python tests/show_plans.py > PLANS.md``."""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from arrlens.session import build_session  # noqa: E402

KEYS = ["nrr", "upgrade_rate_by_industry", "sql_upgrade_by_segment", "sql_account_summary",
        "sql_top_targets", "account_features", "box_stats", "scored_accounts", "auc",
        "usage_decline", "tier_transitions"]


def tree(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = []
    for ln in plan.splitlines():
        ln = re.sub(r"#\d+L?", "", ln)
        ln = re.sub(r"\[plan_id=\d+\]", "", ln)
        ln = re.sub(r"Location: InMemoryFileIndex\(1 paths\)\[file:[^\]]*/", "Location: [", ln)
        lines.append(ln[:220])
    return "\n".join(lines)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", shuffle_partitions=200, extra={
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"})
    spark.sparkContext.setLogLevel("ERROR")
    qs = entry.queries()
    print("# Physical plans (cluster shape: broadcast joins disabled, 200 shuffle partitions)\n")
    print("Generated by `python tests/show_plans.py`. Keys that read the session's")
    print("materialised tables (usage rollup, feature table) show a Parquet scan of them.\n")
    for k in KEYS:
        df = qs[k](spark, sf_dir)
        print(f"## {k}\n\n```\n{tree(df)}\n```\n")


if __name__ == "__main__":
    main()
