"""Long posting lists of the near-dedup operator: members that are there by chance."""

from __future__ import annotations

import os
import random

import numpy as np

from arrlens.llm import near_dedup
from arrlens.session import shared_dir

FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def chance_documents(n=240, near=4, seed=5):
    """Texts of one small vocabulary, which share many shingles but are not similar, and near copies of some."""
    rng = random.Random(seed)
    texts = [[f"w{rng.randrange(30)}" for _ in range(200)] for _ in range(n)]
    copies = [[*t[:100], f"x{i}", *t[101:]] for i, t in enumerate(texts[:near])]
    return [(i, " ".join(t)) for i, t in enumerate(texts + copies)]


def test_members_by_chance_cost_no_text_and_no_shingle(spark, monkeypatch):
    """Only texts with a partner in a list are read again or go to the last step; working tables and the
    setting for shuffle files go with the call."""
    count, stage = {}, near_dedup.staged

    def counted(df, name):
        out = stage(df, name)
        count[name] = max(count.get(name, 0), out.count())
        return out
    monkeypatch.setattr(near_dedup, "staged", counted)
    tables = shared_dir(spark, "arrlens-tables").removeprefix("file:")
    before = set(os.listdir(tables)) if os.path.isdir(tables) else set()
    own = spark.conf.get(FREED, None)
    docs = spark.createDataFrame(chance_documents(), "doc_id long, text string")
    result = near_dedup.near_duplicates(docs, 2)
    left = sorted(x.removeprefix("llm-").rsplit("-", 1)[0] for x in set(os.listdir(tables)) - before)
    assert left == ["classes", "documents", "labels"]
    assert spark.conf.get(FREED, None) == own
    got = {r["doc_id"]: r["component_id"] for r in result.collect()}
    assert got == {i: i if i < 240 else i - 240 for i in range(244)}
    assert count["prefixes"] > 240 * 10 and count["members"] == 244   # nearly all values are shared
    assert count["bodies"] <= 16 and count.get("open", 0) <= 16


def test_partners_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    members, lists = {}, []
    for p, n in enumerate((2, 7, 64, 65, 130, 300)):
        for k in range(n):
            node = p * 1000 + k
            code = rng.integers(0, 6, near_dedup.COORDINATES)
            if k % 9 == 8:      # like the one before, more or less
                code = np.where(rng.random(len(code)) < 0.4, members[node - 1][1], code)
            members[node] = (int(rng.integers(70, 100)), code)
            lists.append((p, node, 1, n, node if k % 18 else node // 1000))
    nodes = spark.createDataFrame([(i, s, [int(v) for v in c]) for i, (s, c) in members.items()],
                                  "node long, n_shingles long, codes array<tinyint>")
    frame = spark.createDataFrame(lists, "posting long, node long, weight long, n long, component long")
    want = {}
    for p, x, _, _, cx in lists:
        want[p, x] = any(
            p == q and cx != cy and (members[x][1] == members[y][1]).sum() >= 20 and
            100 * min(members[x][0], members[y][0]) >= 80 * max(members[x][0], members[y][0]) for q, y, _, _, cy in lists)
    for size in (10, 10000):    # rows a batch: lists go over several ones, and several are in one
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        own = spark.conf.get(key)
        spark.conf.set(key, size)
        try:
            rows = near_dedup.with_partners(frame, nodes, 20, 80).collect()
            some = near_dedup.with_partners(frame, nodes, 20, 80, 100).collect()
        finally:
            spark.conf.set(key, own)
        assert sorted((r["posting"], r["node"]) for r in rows) == sorted(k for k, v in want.items() if v)
        # longer lists than are tested stay whole
        assert sorted((r["posting"], r["node"]) for r in some) == sorted(k for k, v in want.items() if v or k[0] >= 4)
    assert 0 < len(rows) < len(lists) / 2
