"""Language identification, ranked lexical search, periodic runs; the packing islands."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrlens.llm import language_id as LI
from arrlens.llm import lexical_search as LS
from arrlens.llm import packing as P
from arrlens.llm import periodic_runs as PR
from arrlens.llm.common import table

DOCS = "doc_id long, text string, lang string, held_out boolean, score double, n long, terms string"


def docs_frame(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, True, 9.0, 5, "x") for i, t, lang in rows], DOCS)


# -- 13: periodic runs ---------------------------------------------------------------
def plain_runs(words, least=12):
    """All maximal runs by trying every period."""
    out = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i + q - s
            part = words[s:s + length]
            if length >= max(least, 2 * q) and not any(
                    all(a == b for a, b in zip(part, part[r:])) for r in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(3)
    seen = 0
    for _ in range(1500):
        n, k = rng.choice([0, 1, 11, 12, 13, 40, 90]), rng.choice([1, 2, 3, 30])
        words = [b"w%d" % rng.randrange(k) for _ in range(n)]
        if n > 12 and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randrange(1, n)
            words = [words[a + (i - a) % p] if i >= a and a + (i - a) % p < n else words[i] for i in range(n)]
        for least in (12, 2, 5):
            want = plain_runs(words, least)
            seen += len(want)
            assert PR.find_runs(words, least) == want
    assert seen > 3000


def test_run_finder_is_near_linear():
    """One word, a Fibonacci word and random pairs: the hard cases for a walk up the link tree."""
    import time
    a, b = [0], [1]
    while len(a) < 30000:
        a, b = a + b, a
    rng = random.Random(1)
    for words in ([7] * 30000, a[:30000], [rng.randrange(2) for _ in range(30000)]):
        t = time.process_time()
        found = PR.squares_to_runs(words)
        assert time.process_time() - t < 15 and len(found) < len(words)   # fewer runs than words, as is known
    assert PR.squares_to_runs([7] * 30000) == [(0, 30000, 1)]


def by_hand(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    return (doc_id, len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4),
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(kept).encode()).hexdigest())


def test_op13_on_documents(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    got = {r.doc_id: tuple(r) for r in PR.op13_periodic_runs(spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    short = [i for i, t in docs.items() if len(t or "") < 6000]
    assert len(short) > 100 and sum(got[i][1] for i in short) > 10
    for i in short:
        assert got[i] == by_hand(i, docs[i])


def test_runs_edge_cases(spark):
    loop = " ".join(["ab cd ef"] * 6)
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t ", "x"), (None, loop, "x"), (4, loop, "x"), (4, loop, "x"),
            (5, "a " * 200_000, "x"), (6, "é b " * 30, "x"), (-7, loop + " " + loop.replace("ab", "AB"), "x")]
    docs = docs_frame(spark, rows)
    got = sorted(map(tuple, PR.runs(docs).collect()), key=str)
    want = [(None, 0, 18, 3), (4, 0, 18, 3), (4, 0, 18, 3), (5, 0, 200_000, 1), (6, 0, 30, 1), (-7, 0, 18, 3), (-7, 16, 20, 3)]
    assert got == sorted(want, key=str)       # a no-break space is no blank
    s = PR.summaries(docs, words=PR.periodic_tail)
    assert s.count() == len(rows) and s.where("doc_id BETWEEN 1 AND 3").where("n_runs > 0 OR start IS NOT NULL").count() == 0
    assert [tuple(r) for r in s.where("doc_id = 3").collect()] == [by_hand(3, "")]
    assert [tuple(r) for r in s.where("doc_id IS NULL").collect()] == [by_hand(None, loop)]
    out = PR.collapse_runs(docs)
    assert out.columns == docs.columns
    kept = {(r.doc_id, r.text) for r in out.collect()}
    assert {(1, None), (2, ""), (3, " \n\t "), (4, "ab cd ef"), (5, "a")} <= kept
    assert PR.runs(docs.limit(0)).count() == PR.summaries(docs.limit(0)).count() == 0


# -- 12: ranked lexical search -------------------------------------------------------
def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, top=10):
    """Every document scored for every item."""
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, t) for i, t in own if t]
    n_docs, total = len(own), sum(len(t) for _, t in own)
    df = {}
    for _, t in own:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in wanted.items():
        scored = []
        for i, t in own:
            m = 100 - 90 + (90 * len(t) * n_docs) // total
            s = 0
            for x in ts:
                tf = t.count(x)
                if tf:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                    s += w * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scored)[:top])]
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_search_equals_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(60)] + ["Ünï", "東京", "A1", "a1"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(300)]
    docs += [(300 + i, docs[5][1]) for i in range(25)]            # ties, by doc_id
    docs += [(7, docs[9][1]), (7, docs[9][1]), (None, docs[9][1]), (400, None), (401, ""), (402, "... !"),
             (403, "w1 " * 50_000)]
    items = [(k, " ".join(rng.choices(words, k=8))) for k in range(12)] + [
        (20, docs[5][1]), (21, "W1, w1; nothing"), (22, None), (23, "?"), (24, "unseen terms"), (None, "w2 w3"),
        (25, "w4"), (25, "w5 w6"), (25, "w4")]
    frame = docs_frame(spark, [(i, t, "x") for i, t in docs]).repartition(5)
    bench = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, rank int, term string")
    want = in_order(plain_search(docs, items))
    assert in_order(map(tuple, LS.search(frame, bench).collect())) == want
    assert in_order(map(tuple, LS.search(frame, bench, block_terms=20).collect())) == want   # several passes
    assert in_order(map(tuple, LS.search(frame, bench, top=3).collect())) == in_order(plain_search(docs, items, 3))


def test_search_empty_tables(spark):
    docs, items = docs_frame(spark, [(1, "a b", "x")]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert LS.search(docs.limit(0), items).count() == 0
    assert LS.search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in LS.search(docs, items).collect()] == plain_search([(1, "a b")], [(1, "a")])
    docs = docs_frame(spark, [(1, "a b", "x"), (2, "c", "x")])
    assert [tuple(r)[:3] for r in LS.search(docs, items).collect()] == [(1, 1, 1)]


def random_tree(rng, n=1500, width=400, topics=30):
    start, col, x = [0], [], []
    for _ in range(n):
        base = 12 * rng.integers(topics)
        own = np.unique(np.concatenate([base + rng.integers(0, 12, 8), rng.integers(0, width, 3)]) % width)
        col.append(own)
        x.append(rng.integers(1, 900_000, len(own)))
        start.append(start[-1] + len(own))
    w = rng.integers(0, 9000, width).astype(np.int64)
    keep = [w[c] > 0 for c in col]
    col, x = [c[k] for c, k in zip(col, keep)], [v[k] for v, k in zip(x, keep)]
    start = np.concatenate([[0], np.cumsum([len(c) for c in col])])
    return start, np.concatenate(col), np.concatenate(x), w


def test_tree_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    start, col, x, w = random_tree(rng)
    n, root = len(start) - 1, np.sqrt(w.astype(float))
    tree = LS.BallTree(np.arange(n), start, col, x, root, leaf_rows=8)
    assert sorted(tree.ids) == list(range(n)) and tree.nodes[0] == (0, n)
    scored = 0
    for _ in range(60):
        base = 12 * rng.integers(30)
        q = np.unique(np.concatenate([base + np.arange(6), rng.integers(0, 400, 2)]) % 400)
        q = q[w[q] > 0]
        dense = np.zeros(len(w), np.int64)
        dense[q] = w[q]
        exact = np.add.reduceat(dense[col] * x, start[:-1])
        # no document scores more than any ball it is in allows
        at = tree.place[q]
        here = at >= 0
        ball = root[q][here] @ tree.centre[at[here]] + math.sqrt(w[q][here].sum()) * tree.radius
        axes = w[q][here].astype(float) @ tree.reach[at[here]]
        for k, (a, b) in enumerate(tree.nodes):
            top = exact[tree.ids[a:b]].max()
            assert top <= ball[k] * (1 + LS.SLACK) + 1 and top <= axes[k] * (1 + LS.SLACK) + 1
        heap = []
        scored += tree.search(q, w[q], root[q], heap, 10)
        order = sorted(((int(s), -i) for i, s in enumerate(exact) if s > 0), reverse=True)[:10]
        assert sorted(heap, reverse=True) == order
    assert scored < 0.35 * 60 * n      # most subtrees are never opened


def test_op12_uses_whole_tables(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    assert in_order(map(tuple, LS.op12_lexical_search(spark, sf_dir).collect())) == in_order(plain_search(docs, items))


# -- 11: language identification -----------------------------------------------------
def test_op11_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = LI.op11_language_id(spark, sf).join(
        table(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and len(held) > 200
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98
    sure = [r for r in held if not r.rejected]
    assert len(sure) > 0.9 * len(held) and sum(r.lang_pred != r.lang for r in sure) <= 0.02 * len(sure)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_ignores_the_held_out_rows_and_other_columns(spark):
    """The model is the same whatever the held-out rows' languages say, and
    predictions do not read lang."""
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    a = LI.train(docs)
    b = LI.train(docs.withColumn("lang", F.when(fold, "zz").otherwise(F.col("lang"))))
    assert a.langs == b.langs and "zz" not in b.langs and np.array_equal(a.table, b.table)
    c = LI.identify(docs.drop("lang"), a)
    assert c.columns == ["doc_id", "held_out", "lang_pred", "score", "rejected"]
    assert sorted(map(tuple, c.collect())) == sorted(map(tuple, LI.identify(docs, a).collect()))


def test_language_edge_cases(spark):
    train = [(i, t, lang) for i in range(60) for t, lang in (("the cat and the dog sat", "en"), ("der Hund und die Katze", "de"))]
    train = [(2 * k + (lang == "de"), f"{t} {'abcdefghij'[k % 10] * 3}", lang) for k, (_, t, lang) in enumerate(train)]
    rows = train + [(None, None, "en"), (None, "the dog", None), (7001, "", "en"), (7002, "12 — 34!", "de"), (7003, None, None),
                    (7004, "the cat " * 200_000, None), (7004, "der Hund", None), (7004, "der Hund", None), (7005, "日本語", None)]
    docs = docs_frame(spark, rows)
    model = LI.train(docs)
    assert model.langs == ["de", "en"]
    out = LI.identify(docs, model).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.rejected))
    assert by[7001] == by[7002] == by[7003] == [("und", True)]
    assert sorted(by[None]) == [("en", False), ("und", True)] or [x[0] for x in sorted(by[None])] == ["en", "und"]
    assert sorted(x[0] for x in by[7004]) == ["de", "de", "en"]
    (pred, rejected), = by[7005]
    assert pred in ("de", "en") and rejected        # nothing in it was learned
    # nothing to learn from, one language only, an empty table
    none = LI.train(docs.where("doc_id > 7002"))
    assert none.langs == [] and {r.lang_pred for r in LI.identify(docs, none).collect()} == {"und"}
    one = LI.train(docs.where("lang = 'en'"))
    assert one.langs == ["en"] and {r.lang_pred for r in LI.identify(docs, one).collect()} == {"und", "en"}
    assert LI.identify(docs.limit(0), model).count() == 0


def test_subwords_are_the_grams_of_words():
    """Against plain grams of blank-padded words, by their number and their equality."""
    def plain(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower())
        padded = f" {words} "
        return sorted(padded[i:i + n] for n in LI.GRAMS for i in range(len(padded) - n + 1)
                      for g in [padded[i:i + n]] if any(c != " " for c in g) and " " not in g[1:-1])

    for text in ("", "a", "Ab c1d", "Straße über 東京", "x" * 50, "don't stop-it  now"):
        got = np.sort(np.concatenate(LI.subwords(text)))
        assert len(got) == len(plain(text)), text
        assert len(np.unique(got)) <= len(set(plain(text)))
    whole = "ein Satz über alles " * 3000
    want = np.bincount(np.concatenate(LI.subwords(whole)), minlength=LI.BUCKETS)
    old, LI.PIECE = LI.PIECE, 97
    try:   # pieces change nothing
        assert np.array_equal(np.bincount(np.concatenate(LI.subwords(whole)), minlength=LI.BUCKETS), want)
    finally:
        LI.PIECE = old


def test_fit_lowers_the_loss_and_calibration_keeps_its_promise():
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 300)
    bags = [(np.unique(rng.integers(0, 50, 20) + 1000 * c).astype(np.int32), None) for c in y]
    bags = [(a, np.full(len(a), 1 / len(a), np.float32)) for a, _ in bags]
    emb, w, b = LI.fit(bags, y, 3)
    z = np.array([x @ (emb @ w)[a] + b for a, x in bags])
    assert (z.argmax(axis=1) == y).mean() == 1.0 and not emb[5000:].any()
    # a third of the answers is noise: the temperature flattens, and the rest is rejected
    logits = np.concatenate([8 * np.eye(3)[y], 2 * rng.normal(size=(150, 3))])
    truth = np.concatenate([y, rng.integers(0, 3, 150)])
    temp, low = LI.calibrate(logits, truth, max_error=0.02)
    p = np.exp(logits / temp) / np.exp(logits / temp).sum(axis=1, keepdims=True)
    sure = p.max(axis=1) >= low
    assert sure.sum() >= 280 and (p.argmax(axis=1) != truth)[sure].mean() <= 0.02


# -- 5: islands where best fit is not the best -----------------------------------------
def triplets(seed, n=40):
    rng, out = random.Random(seed), []
    for _ in range(n):
        a = rng.randint(380, 490)
        b = rng.randint(250, (1000 - a) // 2)
        out += [a, b, 1000 - a - b]
    return sorted(out, reverse=True)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_crossover_saves_bins(seed):
    lengths = triplets(seed)
    first = P.Bins(lengths, 1000)
    first.best_fit(range(len(lengths)))
    best = P.evolve(lengths, 1000, [], random.Random(seed), population=8, generations=60)
    assert sorted(i for b in best for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 1000 for b in best)
    assert len(best) <= len(first.items) - 4 and len(best) <= 42     # 40 is the least


def test_solve_sends_only_unfinished_blocks_to_the_islands(spark):
    easy = spark.range(200).select(F.col("id").alias("item"), F.lit(500).cast("long").alias("length"))
    out = P.solve(easy, 1, 1000)
    assert out.count() == 200 and out.groupBy("block", "bin").count().where("count <> 2").count() == 0
    hard = spark.createDataFrame(list(enumerate(triplets(5))), "item long, length long")
    out = P.solve(hard, 1, 1000)
    first = P.Bins(triplets(5), 1000)
    first.best_fit(range(120))
    assert out.count() == 120 and out.select("block", "bin").distinct().count() < len(first.items)
    assert out.groupBy("block", "bin").agg(F.sum("length").alias("s")).where("s > 1000").count() == 0


def test_chunk_cache_is_bounded(sf_dir):
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    small, large = P.Encoder(path, 60_000), P.Encoder(path)
    rng = random.Random(1)
    for _ in range(30):
        text = " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(200))
        assert small.encode(text) == large.encode(text) == large.whole(text)
        assert len(small.chunks) + len(small.chunks.old) < 600 + 2 * 200


# -- 1: long conversations ----------------------------------------------------------------
def test_chat_spans_are_linear_in_turns(spark):
    """Five thousand turns: work per turn does not grow with the turns before it (but for the
    expanded contexts themselves, which are not built here)."""
    import time

    from arrlens.llm import chat_format as C
    n = 5000
    rows = spark.range(n).select(
        (F.col("id") % 2 - 9).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 4 < 2, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t "), "id").alias("text"))
    rows = rows.withColumn("conv_id", F.lit(3))
    t = time.time()
    r = C.format_conversations(rows).select("formatted", "examples").first()
    assert time.time() - t < 60
    assert len(r.examples) == n // 2
    for e in (r.examples[0], r.examples[777], r.examples[-1]):
        assert r.formatted[e.loss_start:e.loss_end] == e.reply
        assert r.formatted[:e.loss_start].count(C.END) == e.context_turns


# -- 6: pairs ----------------------------------------------------------------------------
@pytest.mark.parametrize("n_good,n_bad", [(20, 1), (1, 2), (20, 7919), (16000, 7919), (300, 2 * 7919), (8000, 8000)])
def test_every_row_is_in_a_pair(n_good, n_bad):
    """Also where the number of bad rows is a multiple of the usual stride."""
    from arrlens.llm import quality as Q
    good, bad = Q.pair_numbers(n_good, n_bad)
    assert len(good) == len(bad) == max(n_good, n_bad) * Q.PAIRS_PER_ROW
    assert len(np.unique(good)) == n_good and len(np.unique(bad)) == n_bad


# -- tokenising for packing ---------------------------------------------------------------
def test_a_word_is_encoded_once_whatever_marks_close_it():
    import public_tokenizers
    e = P.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [f"first straightforward{m} end" for m in ["", ",", ".", "!?", ").", "_", "'s,", "',", "«,", "²;"]]
    texts += ["x\nstraightforward, y", "", "straightforward", "\n", "two  spaces, here", "a, b ", "don't, l_m. 3,"]
    assert e.encode_all(texts) == [e.whole(t) for t in texts] == [e.encode(t) for t in texts]
    closed = [c for c in e.chunks if c.startswith("straightforward") and not set(c) & set("'\u00ab\u00b2")]
    assert closed == ["straightforward"]


def test_slices_hold_every_text_once(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(P, "SLICE_CHARS", 10)
    for lengths in ([], [3], [50], [0, 0, 0], [4, 4, 4, 50, 1, 9, 1, 0]):
        batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in lengths], pa.string())], ["text"])
        parts = [p["text"].to_pylist() for p in P._slices(batch)]
        assert [t for p in parts for t in p] == ["x" * n for n in lengths]
        assert all(p and (len(p) == 1 or sum(map(len, p)) <= 10) for p in parts)
