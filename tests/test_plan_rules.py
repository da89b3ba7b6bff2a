"""Plan rule over every registered key: an unpartitioned window (a single
task) only ever runs over aggregated rows, never directly over a scan."""

import re

import pytest

import __spark_entry__ as entry
from arrlens.plans import registry

SKIP = {"lr_fit", "lr_coefficients", "lr_scored_accounts", "usage_stream"}


def _groups(text: str) -> list[str]:
    """Top-level [...] groups of a plan node's argument string."""
    out, depth, start = [], 0, None
    for i, ch in enumerate(text):
        if ch == "[":
            if depth == 0:
                start = i + 1
            depth += 1
        elif ch == "]":
            depth -= 1
            if depth == 0:
                out.append(text[start:i])
    return out


def window_is_partitioned(line: str) -> bool:
    """``Window [exprs], [partitionSpec], [orderSpec]``; an empty partition
    spec prints as ``[]``."""
    groups = _groups(line[line.index("Window ") + len("Window "):])
    return len(groups) >= 3 and groups[1].strip() != ""


def unpartitioned_windows_over_raw_rows(plan: str) -> list[str]:
    lines = plan.splitlines()
    bad = []
    for i, ln in enumerate(lines):
        if "Window [" not in ln or window_is_partitioned(ln):
            continue
        depth = len(ln) - len(ln.lstrip(" :+-"))
        for below in lines[i + 1:]:
            d = len(below) - len(below.lstrip(" :+-"))
            if d <= depth:
                break
            if "Aggregate" in below:
                break
            if "Scan" in below:
                bad.append(ln.strip()[:120])
                break
    return bad


def test_detector_on_known_shapes():
    part = "+- Window [lag(m#1, -1, null) windowspecdefinition(a#2, m#1 ASC NULLS FIRST, x)], [a#2], [m#1 ASC NULLS FIRST]"
    unpart = "+- Window [sum(n#3) windowspecdefinition(s#4 ASC NULLS FIRST, x) AS w#5], [], [s#4 ASC NULLS FIRST]"
    assert window_is_partitioned(part) and not window_is_partitioned(unpart)
    raw = f"{unpart}\n   +- Sort [s#4 ASC NULLS FIRST]\n      +- FileScan parquet [s#4]"
    agg = f"{unpart}\n   +- Sort [s#4 ASC NULLS FIRST]\n      +- HashAggregate(keys=[s#4])\n         +- FileScan parquet [s#4]"
    assert unpartitioned_windows_over_raw_rows(raw) and not unpartitioned_windows_over_raw_rows(agg)


@pytest.mark.parametrize("key", sorted(set(registry.queries()) - SKIP))
def test_unpartitioned_windows_sit_on_aggregates(spark, sf_dir, key):
    df = entry.queries()[key](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert unpartitioned_windows_over_raw_rows(plan) == []
