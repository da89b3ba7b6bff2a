"""Training-data operators against brute force, SQL, round trips and held-out accuracy."""

import base64
import collections
import hashlib
import json
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from arrlens.llm import chat_format, decontaminate, fingerprint, html_extract, near_dedup, packing, quality
from arrlens.llm import queries, secret_scan, sharding, toxicity

MID = "/root/testdata/sf0.01"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def table(sf, name):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def documents(sf_dir):
    return {d["doc_id"]: d["text"] or "" for d in table(sf_dir, "documents")}


DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, label string, own long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, ties, repeated rows, a very long text, clashing column names."""
    long = " ".join(f"word{i % 7919}" for i in range(60_000))
    data = [(1, None, "en", "s", None), (2, "", "en", None, 0), (3, "  \n\t ", None, "s", 5), (4, "one", "en", "s", 3),
            (5, "same text of five words", "en", "s", 23), (5, "same text of five words", "en", "s", 23),
            (6, "same text of five words", "en", "s", 23), (None, "same text of five words", "en", "s", 23),
            (None, None, None, None, None), (7, long, "en", "s", len(long)), (8, "ünï code \U0001f600 text", "xx", "s", 1)]
    return spark.createDataFrame([(*r, 0.5, 9, "x", 3) for r in data], DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize("key", sorted(queries.oracle_sql()))
def test_oracle(spark, sf_dir, key):
    got = queries.queries()[key](spark, sf_dir).toPandas()
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    want = con.sql(queries.oracle_sql()[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    as_rows = lambda f: sorted(map(tuple, f[cols].astype(str).values.tolist()))
    assert as_rows(got) == as_rows(want)


# 1 chat formatting

def test_chat_round_trip_and_spans(spark):
    nasty = ["", "\\", "a\\", "### ", "</turn>", "\\### Assistant: </turn> ok", "#### x: y\n### User: </turn>\n", "a: b",
             "\\\\</turn>\n### Assistant: hi", "x" * 50_000 + "\\", "\U0001f600"]
    roles = ["user", "assistant", "system", "tool", "Us: er\\", "### ", "", "=x", None, "assistant", "User"]
    data = [(1, i, r, t, 0) for i, (r, t) in enumerate(zip(roles, nasty))]
    data += [(1, 1, "assistant", "tie", 0), (None, None, "user", None, 0), (2, 0, "user", "no reply", 0)] * 1
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, formatted int")
    out = chat_format.format_conversations(df)
    by = {r["conv_id"]: r for r in rows(chat_format.digests(out))}
    assert set(by) == {1, 2, None}
    for conv in by:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x, _ in data if c == conv))
        replies = [t[3] for t in turns if t[2] == "assistant"]
        assert by[conv]["n_turns"] == len(turns)
        assert by[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest()
        assert by[conv]["loss_sha256"] == hashlib.sha256("".join(replies).encode()).hexdigest()
        assert by[conv]["loss_chars"] == sum(map(len, replies)) and by[conv]["n_examples"] == len(replies)
    whole = {r["conv_id"]: r["formatted"] for r in rows(out)}
    examples = rows(chat_format.prefix_targets(out))
    assert len(examples) == 3
    for e in examples:
        assert whole[1].startswith(e["text"]) and e["text"].endswith("</turn>\n")
        assert e["text"][e["loss_start"]:e["loss_end"]] == e["reply"]
        assert e["text"][:e["loss_start"]].endswith("### Assistant: ")
        assert len(re.findall(chat_format.TURN, e["text"])) == e["context_turns"] + 1


def test_digests_read_the_loss_out_of_the_expanded_examples(spark):
    from pyspark.sql import functions as F
    data = [(1, 0, "user", "ask"), (1, 1, "assistant", "re\\ply ### one"), (1, 2, "user", "more"), (1, 3, "assistant", "two"),
            (2, 0, "user", "no reply")]
    right = chat_format.format_conversations(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    loss = lambda df: {r["conv_id"]: (r["loss_chars"], r["loss_sha256"], r["n_examples"])
                       for r in rows(chat_format.digests(df))}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert loss(right) == {1: (17, sha("re\\ply ### onetwo"), 2), 2: (0, sha(""), 0)}
    for field, by in (("loss_start", 1), ("loss_end", -1)):  # a wrong mask must show
        wrong = right.withColumn("examples", F.transform("examples", lambda e: e.withField(field, e[field] + by)))
        assert loss(wrong)[1] != loss(right)[1]


def test_chat_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert rows(chat_format.digests(chat_format.format_conversations(df))) == []


# 2 and 6 classifiers

@pytest.mark.parametrize("module, query, label, fold, at_least", [
    (toxicity, queries.op2_toxicity, "toxic", (3, 1), 0.93), (quality, queries.op6_quality, "quality", (4, 2), 0.97)])
def test_held_out_accuracy(spark, module, query, label, fold, at_least):
    labels = {r["doc_id"]: r[label] for r in table(MID, "labels")}
    got = rows(query(spark, MID))
    assert len(got) == len(table(MID, "documents"))
    right = []
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % fold[0] == fold[1])
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        if r["held_out"] and r["doc_id"] in labels:
            right.append(labels[r["doc_id"]] == r["predicted"])
    assert len(right) > 50 and np.mean(right) >= at_least


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifier_edges(spark, odd, empty, module, label):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 1), (4, 0, 0), (5, 1, 1), (None, 1, 1), (7, None, None), (4, 0, 0)],
                                 "doc_id long, quality int, toxic int")
    for labels in (none, some):
        model = module.train(odd, labels)
        got = rows(module.score(odd, model))
        assert len(got) == 11 and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
        assert rows(module.score(empty, model)) == []
    assert rows(module.score(odd, module.train(empty, some)))


def test_sample_is_bounded_when_a_labelled_id_repeats(spark):
    from pyspark.sql import functions as F

    from arrlens.llm.common import labelled_sample
    ids = [i for i in range(1, 400) if zlib.crc32(str(i).encode()) % 4 != 2][:200]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    hot = spark.range(3000).select(F.lit(ids[0]).alias("doc_id"), F.lit("text of one id").alias("text"))
    sample = lambda d, n: [r["text"] for r in labelled_sample(d, labels, "quality", 4, 2, n).collect()]
    got = sample(docs.unionByName(hot), 1000)
    assert sorted(got) == sorted([f"text {i}" for i in ids] + ["text of one id"])  # repeated rows once
    many = spark.range(20_000).select(F.lit(ids[0]).alias("doc_id"), F.concat(F.lit("other "), "id").alias("text"))
    assert 900 < len(sample(docs.unionByName(many), 1000)) < 1100  # other texts of the id: about the bound


def test_identity_swap_is_penalised():
    """A group's name that goes with the label by chance loses its weight."""
    index = {"scum": 0, "muslims": 1, "jews": 2, "fine": 3}
    data = []
    for i in range(200):
        bad = i % 2
        words = {"scum"} if bad else {"fine"}
        if bad and i % 4 == 1 or i % 16 == 0:
            words.add("muslims")
        ids = lambda w: sorted(index[x] for x in w if x in index)
        data.append((ids(words), [ids(t) for t in toxicity.twins(words)], bad))
    assert toxicity.twins({"fine"}) == [] and toxicity.twins({"fine", "muslims"}) == [{"fine", "jews"}, {"fine"}]
    _, free = toxicity.fit_logistic(data, 4, penalty=0.0)
    _, held = toxicity.fit_logistic(data, 4, penalty=5.0)
    assert abs(held[1]) < abs(free[1]) / 3 and held[0] > 1


def test_bradley_terry_orders_pairs():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, quality.WIDTH))
    truth = x[:, 0] - 2 * x[:, 1]
    y = (truth > np.quantile(truth, 0.3)).astype(int)
    m = quality.fit_bradley_terry(x, y)
    s = m.scores(x)
    assert np.mean((s >= 0.7) == y) > 0.97
    assert abs(np.mean(s < 0.7) - 0.3) < 0.01  # the quantile of the bad share


# 3 secrets

def slow_spans(text):
    base = []
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for kind, p, ok in (("assign", pattern, lambda m: len(m[2]) >= 6),
                        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
                        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)):
        base += [(m.start(), ("assign", "access", "hex").index(kind), m.end(), kind) for m in p.finditer(text) if ok(m)]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(base))


def der(*parts):
    body = b"".join(parts)
    return b"\x30\x82" + len(body).to_bytes(2, "big") + body


def test_secrets_against_plain_patterns(spark, sf_dir, documents):
    for r in rows(queries.op3_secret_scan(spark, sf_dir)):
        base = slow_spans(documents[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert r["n_assign"] + r["n_access"] + r["n_hex"] == (base.count(",") + 1 if base else 0)
        assert r["spans"] == base or r["n_confirmed"]


def test_structural_confirmation():
    b64 = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    jwt = f"{b64(json.dumps({'alg': 'HS256', 'typ': 'JWT'}).encode())}.{b64(b'{}')}.{b64(b'x' * 32)}"
    fake = f"{b64(b'not json at all, but long')}.abcdef.abcdef"
    key = der(b"\x02\x01\x00", b"\x02\x82\x01\x00" + b"\x7f" * 256, b"\x02\x03\x01\x00\x01")
    blob = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", b"\x11" * 32))
    text = lambda s: f"Ünd {s} end"
    kinds = lambda s: [secret_scan.KINDS[k] for _, k, _ in secret_scan.find_spans(text(s))]
    assert kinds(jwt) == ["jwt"] and kinds(fake) == []
    assert kinds(base64.b64encode(key).decode()) == ["der"]
    assert kinds(base64.b64encode(key[:-1]).decode()) == []
    assert "der" in kinds(key.hex()) and "der" not in kinds(key[:-1].hex())
    pem = f"-----BEGIN PRIVATE KEY-----\n{base64.encodebytes(key).decode()}-----END PRIVATE KEY-----"
    assert kinds(pem) == ["pem"] and kinds(pem.replace("M", "A", 1)) != ["pem"]
    assert kinds(base64.b64encode(blob).decode()) == ["ssh"]
    assert kinds("token:token:abcdefgh") == [] and kinds("PASSWORD = 'abcdef'") == ["assign"]
    assert kinds("paſſword=abcdef") == []
    assert secret_scan.redact(text("token=abcdefgh")) == "Ünd [SECRET] end"
    assert secret_scan.redact(text('token = "' + "ab12" * 8)) == "Ünd [SECRET] end"


def test_armoured_keys_with_headers_and_escaped_line_ends():
    key = der(b"\x02\x01\x00", b"\x02\x82\x01\x00" + b"\x7f" * 256, b"\x02\x03\x01\x00\x01")
    lines = base64.encodebytes(key).decode()
    plain = f"-----BEGIN PRIVATE KEY-----\n{lines}-----END PRIVATE KEY-----\n"
    legacy = ("-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B2C3D4E5F60718293A4B5C6D7E8F9\n\n"
              f"{base64.encodebytes(bytes(range(256)) * 3).decode()}-----END RSA PRIVATE KEY-----\n")
    for pem in (plain, legacy, legacy.replace("\n", "\r\n"), legacy.replace("\n", "\r")):
        for written in (pem, json.dumps(pem), json.dumps(json.dumps(pem)), json.dumps(pem).replace("/", "\\/"),
                        json.dumps(pem).replace("=", "\\u003d")):
            text = f'Ünd {{"private_key": {written}, "x": 1}}'
            spans = [(a, b) for a, k, b in secret_scan.find_spans(text) if secret_scan.KINDS[k] == "pem"]
            assert spans == [(text.index("-----BEGIN"), text.rindex("KEY-----") + 8)]
            assert "BEGIN" not in secret_scan.redact(text) and lines[:40] not in secret_scan.redact(text)
    one = base64.b64encode(key).decode()
    assert [k for _, k, _ in secret_scan.find_spans(json.dumps(f"key\n{one}\nend"))] == [secret_scan.KINDS.index("der")]
    # a mark without its end neither hides the next key nor is one; prose between marks is none
    assert len(secret_scan.find_spans("-----BEGIN PRIVATE KEY-----\ncut-off\n" + plain)) == 1
    assert len(secret_scan.find_spans("-----BEGIN X-----BEGIN PRIVATE KEY-----" + plain[27:])) == 1
    assert secret_scan.find_spans("-----BEGIN PRIVATE KEY-----\nput-it: here, well-kept\n-----END PRIVATE KEY-----") == []
    assert secret_scan.find_spans("-----BEGIN A-----x" * 20_000 + "-----END B-----" * 20_000) == []


def test_secrets_edges(spark, odd, empty):
    got = rows(secret_scan.scan(odd))
    assert len(got) == 11 and all(r["spans"] == "" for r in got)
    assert rows(secret_scan.scan(empty)) == [] and rows(secret_scan.redact_documents(empty)) == []
    assert sorted(map(str, rows(secret_scan.redact_documents(odd)))) == sorted(map(str, rows(odd)))


# 4 decontamination

def slow_distance(pattern, text):
    """Semi-global edit distance by the plain table."""
    col = list(range(len(pattern) + 1))
    best = col[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(col[i] + (p != c), col[i + 1] + 1, new[i] + 1))
        col = new
        best = min(best, col[-1])
    return best


def test_myers_and_pigeonhole_against_plain_distance():
    rng = np.random.default_rng(5)
    letters = "abcde "
    words = lambda n: "".join(rng.choice(list(letters), n))
    items = decontaminate.Items([(i, words(60), 4) for i in range(12)])
    found = items.automaton()
    for _ in range(40):
        n, item, k = items.rows[rng.integers(12)]
        changed = list(item)
        for _ in range(rng.integers(0, 7)):
            at = rng.integers(len(changed))
            changed[at:at + 1] = [[], ["z"], ["z", changed[at]]][rng.integers(3)]
        text = words(150) + "".join(changed) + words(80)
        got = {items.rows[m][0]: d for m, d, _ in decontaminate.matches(text, items, found)}
        want = {i: slow_distance(t, text) for i, t, _ in items.rows}
        assert got == {i: d for i, d in want.items() if d <= 4}


def test_decontaminate_query(spark, sf_dir, documents):
    items = {r["item_id"]: decontaminate.normalise(r["text"]) for r in table(sf_dir, "benchmark")}
    texts = {i: decontaminate.normalise(t) for i, t in documents.items()}
    exact = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    got = rows(queries.op4_decontaminate(spark, sf_dir))
    assert exact and {(r["doc_id"], r["item_id"]) for r in got if r["distance"] == 0} == exact
    for r in got:
        assert r["distance"] <= r["budget"]


def test_decontaminate_edges_and_blocks(spark, odd, empty, sf_dir):
    bench = spark.createDataFrame([(1, "same text of five words"), (2, None), (None, "Same text OF five words!"), (3, "a"),
                                   (1, "same text of five words")], "item_id long, text string")
    got = rows(decontaminate.search(odd, bench))
    assert len(got) == 8 and all(r["distance"] == 0 for r in got)
    assert decontaminate.keep_clean(odd, bench).count() == 7
    assert rows(decontaminate.search(empty, bench)) == [] and rows(decontaminate.search(odd, bench.limit(0))) == []
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one, many = (sorted(map(str, rows(decontaminate.search(docs, items, block_bytes=b)))) for b in (10 ** 9, 2000))
    assert one == many


def test_short_items_are_found_as_whole_words(spark):
    bench = spark.createDataFrame([(1, "Who wrote it?"), (2, "北京是中国的首都吗"), (3, "???"), (4, "art"), (5, "東京")],
                                  "item_id long, text string")
    texts = ["who wrote it", "I ask: who  wrote IT, then?", "who wrote items", "unwho wrote it", "who wrote at", "问：北京是中国的首都吗？",
             "我想知道北京是中国的首都吗", "北京是中国的首都", "start", "art", "art start", "start art", "in東京to", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(decontaminate.search(docs, bench))
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(0, 1), (1, 1), (5, 2), (6, 2), (9, 4), (10, 4), (11, 4), (12, 5)}
    assert len(got) == 8 and all(r["budget"] == r["distance"] == 0 for r in got)
    for r in got:
        text = decontaminate.normalise(texts[r["doc_id"]])[:r["match_end"]]
        assert len(text[-r["item_chars"]:]) == r["item_chars"] and text.endswith(("who wrote it", "吗", "art", "東京"))
    clean = [2, 3, 4, 7, 8, 13, 14]
    for size in (10 ** 9, 20):  # one block, several
        assert sorted(r["doc_id"] for r in rows(decontaminate.keep_clean(docs, bench, block_bytes=size))) == clean


def test_blocks_of_items_are_staged_one_by_one(spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"item number {i} of a benchmark with many items") for i in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x item number {i} of a benchmark with many items y") for i in range(50)], "doc_id long, text string")
    order, blocks, stage = [], decontaminate.item_blocks, decontaminate.staged

    def reading(*args):
        for items in blocks(*args):
            order.append("read")
            yield items

    monkeypatch.setattr(decontaminate, "item_blocks", reading)
    monkeypatch.setattr(decontaminate, "staged", lambda df, name: (order.append("write"), stage(df, name))[1])
    got = decontaminate.search(docs, bench, block_bytes=600)
    assert len(order) > 4 and order == ["read", "write"] * (len(order) // 2)
    assert "MapInArrow" not in got._jdf.queryExecution().toString()  # no block is left in the plan
    assert {(r["doc_id"], r["item_id"]) for r in rows(got) if r["distance"] == 0} == {(i, i) for i in range(40)}


# 5 packing

def check_packing(got, texts, capacity=1024):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    per, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        per[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(per) == set(texts)
    for doc_id, text in texts.items():
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [2], dtype="<u4")
        pieces = sorted(per[doc_id], key=lambda r: r["piece"])
        at = 0
        for k, p in enumerate(pieces):
            assert (p["piece"], p["start"]) == (k, at)
            assert p["ids_crc32"] == zlib.crc32(ids[at:at + p["length"]].tobytes())
            assert p["length"] == capacity or k == 0
            at += p["length"]
        assert at == len(ids) and (len(pieces) == 1) == (len(ids) <= capacity)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r["length"] for r in got) // capacity)


def test_packing(spark, sf_dir, documents):
    n, least = check_packing(rows(queries.op5_packing(spark, sf_dir)), documents)
    assert n <= least * 1.01 + 1


def test_encoder_equals_tokenizer():
    import public_tokenizers
    e = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " ", "a", " a", "a ", "a\n", "\na", "it's we'll  two  spaces", "line\n\nline", "tab\there", "x \ny", "ä ö\nü",
             "end<|endoftext|>mid <|endoftext|>", "nbsp\xa0here", "\x85", "€ 5 \U0001f600", "²½ 3¾x", "a b\nc d " * 50, "'s 'S",
             "a, b. c!? d... (e) [f] g's h'' i,\nj; k\nl_m n-o p.q r.s. $t %u% v&&& w### ª, ²."]
    assert [e.encode(t) for t in texts] == [e.whole(t) for t in texts]


def test_packing_edges(spark, odd, empty):
    got = rows(packing.pack_documents(odd))
    assert sum(r["piece"] == 0 for r in got) == 11
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    assert rows(packing.pack_documents(empty)) == []


def test_genetic_packing_is_whole_and_no_worse_than_best_fit():
    import random
    rng = random.Random(2)
    lengths = [rng.choice([510, 340, 260, 700, 330, 180, 90, 430, 514]) + rng.randrange(5) for _ in range(500)]
    start = packing.Bins(lengths, 1024)
    start.best_fit(range(500))
    best = packing.evolve(lengths, 1024, [], random.Random(1), generations=20)
    assert sorted(i for b in best for i in b) == list(range(500))
    assert all(sum(lengths[i] for i in b) <= 1024 for b in best)
    assert -(-sum(lengths) // 1024) <= len(best) <= len(start.items)


# 7 extraction

def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_extraction_query(spark, sf_dir):
    import html
    pages = {p["page_id"]: p["html"] for p in table(sf_dir, "pages")}
    for r in rows(queries.op7_html_extract(spark, sf_dir)):
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        parts = re.split(r"</?(?:p|h1)\b[^>]*>", re.sub(r"<br>|</?b>", " ", article))
        parts = [" ".join(html.unescape(p).split()) for p in parts]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("extra", [
    '<nav><a href="/">Home</a></nav>', '<header><p>Site name, slogan.</p></header>', "<footer>&copy; us. All rights.</footer>",
    '<aside class="sidebar"><p>Related, more, things.</p></aside>', '<div class="cookie-notice"><p>We use cookies, ok?</p></div>',
    '<div id="ad-1">Buy now, cheap, today!</div>', "<form><p>Your name, please.</p><input></form>", "<script>var a='</p>';</script>",
    '<section class="comments"><p>Great, great post! I, too, think so.</p></section>', "<!-- <p>no, never.</p> -->", ""])
@pytest.mark.parametrize("shape", ["article", "div"])
def test_boilerplate_goes(extra, shape):
    text = "<h1>Head &amp; line</h1><p>First one,  of\n many. <b>Bold</b>ly said, it is.</p><p>Second one, of two; long enough.</p>"
    whole = page(f'{extra}<{shape} class="post">{text}</{shape}>{extra}')
    assert html_extract.main_text(whole) == "Head & line\nFirst one, of many. Boldly said, it is.\nSecond one, of two; long enough."


HEAD = "<h1>Head line</h1>"
PARTS = [f"Part {i} of the story tells, at some length, what was seen; it ends here, in full." for i in range(5)]
STORY = HEAD + "".join(f"<p>{p}</p>" for p in PARTS)
WHOLE = "\n".join(["Head line", *PARTS])


@pytest.mark.parametrize("body", [
    f'<div class="story">{STORY}</div>' + '<article><h2><a href="/x">Six things</a></h2><a href="/x">Read more</a></article>' * 6,
    f'<main>{STORY}<ul><li><a href="/a">One more page</a></li><li><a href="/b">And another</a></li></ul></main>',
    f'<main><div>{STORY}</div><div><a href="/a">Home</a> <a href="/b">News of today</a></div></main>',
    f'<article>{STORY}<div><ul>{"<li><a href=/a>See also this, and that.</a></li>" * 9}</ul></div></article>',
    f'<div>{STORY}</div><ul><li><a href="/a">Elsewhere</a></li></ul>',
    f'<article><div>{HEAD}<div>{STORY[len(HEAD):]}</div></div></article>'])
def test_path_ratios_decide_with_and_without_story_tags(body):
    assert html_extract.main_text(page(body)) == WHOLE


def test_short_parts_of_the_story_stay():
    text = html_extract.main_text(page(
        f'<main>{STORY}<h2>Parts</h2><ul><li>2 eggs</li><li><a href="/m">milk</a> and flour</li></ul><p>Mix.</p></main>'))
    assert text == WHOLE + "\nParts\n2 eggs\nmilk and flour\nMix."


@pytest.mark.parametrize("inner", [f"<article>{STORY}</article>", f'<div class="story">{STORY}</div>', f"<main>{STORY}</main>",
                                   f'<div>{STORY}</div>'.replace("h1", "h2")])
@pytest.mark.parametrize("wrapper", ["div class='layout has-sidebar'", "div id=page class='navbar-fixed'", "div class=sidebar",
                                     "form id=aspnetForm method=post", "div class='ads social'", "fieldset"])
def test_marked_wrappers_keep_the_story(wrapper, inner):
    menu = '<div class="sidebar"><p>Related, more, things.</p></div><form><p>Your name, please.</p></form>'
    assert html_extract.main_text(page(f"<{wrapper}>{menu}{inner}{menu}</{wrapper.split()[0]}>")) == WHOLE


@pytest.mark.parametrize("name", ["legal-analysis", "social-policy", "legal", "notice", "comment-on-law"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_marked_sections_of_prose_stay(name, tag):
    part = f'<section class="{name}"><h2>Under it</h2><p>{PARTS[0]}</p><p>{PARTS[1]}</p></section>'
    got = html_extract.main_text(page(f"<{tag}>{STORY}{part}</{tag}>"))
    assert got == "\n".join([WHOLE, "Under it", *PARTS[:2]])


@pytest.mark.parametrize("extra", [
    '<section class="comments">' + f'<article class="comment"><p>{"I, too, think so; yes. " * 9}</p></article>' * 9 + "</section>",
    f'<div class="share-buttons">{"<a href=/s>Share</a> " * 9}</div>', '<div class="my-navbar-fixed"><a href="/">Home</a></div>',
    f'<div class="ad">{"Buy now, cheap, today! " * 40}</div>'])
def test_marked_parts_beside_a_story_go(extra):
    assert html_extract.main_text(page(f"<article>{STORY}</article>{extra}")) == WHOLE


def test_extraction_edges(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>open &lt;b&gt; 1 < 2, yes.", "x"),
                                (1, "u", "plain", "x"), (1, "u", "<div " + "a" * 100_000, "x")],
                               "page_id long, url string, html string, text string")
    got = rows(html_extract.extract(df))
    assert sorted(r["text"] for r in got) == ["", "", "", "open <b> 1 < 2, yes.", "plain"]
    assert rows(html_extract.extract(df.limit(0))) == []


# 8 near duplicates

def slow_components(texts, size, similarity=80):
    """Plain comparison of all pairs of shingle sets."""
    sets = {}
    for i, t in texts.items():
        w = t.encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
        w = re.findall(rb"[^\x20\x09-\x0d]+", w)
        sets[i] = {tuple(w[k:k + size]) for k in range(max(len(w) - size + 1, 1))} if w else set()
    up = {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if len(sets[a]) * 100 < similarity * len(sets[b]):
                break
            both = len(sets[a] & sets[b])
            if both * 100 >= similarity * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_against_all_pairs(spark, sf_dir, documents, size):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(near_dedup.near_duplicates(docs, size))}
    assert got == slow_components(documents, size)


def test_chains_hot_groups_and_shared_passages(spark):
    """A chain of copies each changed a little more, many copies of one text,
    and unlike texts around one passage."""
    rng = np.random.default_rng(7)
    word = lambda: "w" + str(rng.integers(10 ** 9))
    base = [word() for _ in range(120)]
    texts, at = {}, list(base)
    for i in range(30):
        at = at[4:] + [word() for _ in range(4)]
        texts[i] = " ".join(at)
    for i in range(100, 160):
        copy = list(base)
        copy[rng.integers(120)] = word()
        texts[i] = " ".join(copy).upper()
    passage = [word() for _ in range(70)]
    for i in range(200, 260):
        texts[i] = " ".join([word() for _ in range(40)] + passage)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(near_dedup.near_duplicates(df, 2))}
    assert got == slow_components(texts, 2)


def test_near_duplicates_edges(spark, odd, empty):
    got = rows(near_dedup.near_duplicates(odd, 2))
    assert len(got) == 11
    for r in got:
        if r["n_shingles"] == 0:
            assert r["component_id"] == r["doc_id"] and r["kept"]
    assert [r["component_id"] for r in got if r["n_shingles"] == 4] == [5] * 4
    assert rows(near_dedup.near_duplicates(empty, 2)) == []
    kept = rows(near_dedup.keep_first(odd, 2))
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 1, 2, 3, 4, 5, 7, 8]
    assert kept[0].keys() == rows(odd)[0].keys()


# 9 sharding

def test_sharding(spark, sf_dir, documents):
    got = rows(queries.op9_sharding(spark, sf_dir))
    held = collections.defaultdict(list)
    for r in got:
        raw = documents[r["doc_id"]].encode()
        slot = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:8], 16) % sharding.SLOTS
        assert (r["size"], r["text_crc32"], r["virtual_slot"]) == (len(raw) + 16, zlib.crc32(raw), slot)
        assert r["shard"] == slot % 40 and r["grown_shard"] in (r["shard"], 40)
        held[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in held.values()) and len(got) == len(documents)


def test_slot_maps(spark):
    one = sharding.first_map(spark, 40)
    two = sharding.grow(one, 40)
    old, new = ({r["virtual_slot"]: r["shard"] for r in rows(m)} for m in (one, two))
    assert all(new[s] in (old[s], 40) for s in old) and len(new) == sharding.SLOTS
    n = collections.Counter(new.values())
    assert 90 <= min(n.values()) and max(n.values()) <= 110
    third = sharding.grow(two, 41)
    assert {r["version"] for r in rows(third)} == {3}
    # by bytes: shard 0's slots are heavy; versions go up and every slot keeps one place
    sized = spark.range(sharding.SLOTS).selectExpr("cast(id as int) virtual_slot", "if(id % 40 = 0, 1000, 100) slot_bytes",
                                                   "1 slot_rows")
    by_bytes = rows(sharding.rebalance(one, sized, 40))
    load = collections.Counter()
    for r in by_bytes:
        load[r["shard"]] += 1000 if r["virtual_slot"] % 40 == 0 else 100
    mean = sum(load.values()) / 40
    assert len({r["virtual_slot"] for r in by_bytes}) == len(by_bytes) == sharding.SLOTS
    assert max(load.values()) <= mean * 1.05 + 1000


def test_stored_maps_are_used(spark, sf_dir, tmp_path):
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), str(tmp_path / "map")
    first = sharding.first_map(spark, 5)
    sharding.save_map(first, path)
    sharding.save_map(sharding.rebalance(sharding.load_map(spark, path), sharding.slot_bytes(sharding.sized_rows(docs)), 5), path)
    held = lambda version=None: {r["virtual_slot"]: (r["version"], r["shard"])
                                 for r in rows(sharding.load_map(spark, path, version))}
    new, old = held(), held(1)
    assert len(new) == len(old) == sharding.SLOTS and {v for v, _ in new.values()} == {2} and {v for v, _ in old.values()} == {1}
    got = rows(sharding.assign(docs, 5, sharding.load_map(spark, path)))
    assert len(got) == docs.count() and all((r["version"], r["shard"]) == new[r["virtual_slot"]] for r in got)
    assert any(r["shard"] != old[r["virtual_slot"]][1] for r in got)
    for shard in range(5):
        places = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert places == list(range(len(places)))
    with pytest.raises(Exception, match="exist"):
        sharding.save_map(first, path)


def test_sharding_edges(spark, odd, empty):
    got = rows(sharding.assign(odd, 3))
    assert len(got) == 11 and all(r["size"] >= 16 and r["shard"] in (0, 1, 2) for r in got)
    held = collections.defaultdict(list)
    for r in got:
        held[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in held.values())
    assert rows(sharding.assign(empty, 3)) == []


# 10 fingerprints

def signed(x):
    return x - 2 ** 64 if x >= 2 ** 63 else x


def slow_fingerprint(text):
    import xxhash
    lanes, n = [0] * fingerprint.LANES, 0
    h = lambda data, seed: xxhash.xxh64(data, seed=seed % 2 ** 64).intdigest()
    for p in (x.strip(" ") for x in text.split("\n")):
        if p:
            n += 1
            a, b = h(p.encode(), 42), h(p.encode(), h(b"arrlens", 42))
            for j in range(fingerprint.LANES):
                v = h(j.to_bytes(4, "little"), h(b.to_bytes(8, "little"), h(a.to_bytes(8, "little"), 42)))
                if v % 2 ** (j // fingerprint.WIDTH) == 0:
                    lanes[j] = (lanes[j] + (v >> 32)) % fingerprint.MODULUS
    return hashlib.sha256(",".join(map(str, [n, *lanes])).encode()).hexdigest()


@pytest.mark.parametrize("buckets", [1, 4, 37])
def test_fingerprints(spark, sf_dir, documents, buckets):
    spark.conf.set("spark.sql.shuffle.partitions", str(buckets))
    try:
        got = {r["doc_id"]: r for r in rows(queries.op10_fingerprint(spark, sf_dir))}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    ids = sorted(documents)
    assert sorted(got) == ids
    for k, i in enumerate(ids):
        text, after = documents[i], documents[ids[(k + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if k % 20 == 0:
            assert got[i]["fingerprint"] == slow_fingerprint(text)
            assert got[i]["edited_fingerprint"] == slow_fingerprint(edited)
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    mean = lambda c: np.mean([r[c] for r in got.values()])
    assert mean("near_edited") > mean("near_next") + 0.1


def test_fingerprint_is_homomorphic(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("b\na\nc", "a\nb", "c"), ("x", "", "x")], "whole string, part string, piece string")
    fp = fingerprint.fingerprint
    same = df.select((fingerprint.insert(fp(F.col("part")), F.col("piece")) == fp(F.col("whole"))).alias("i"),
                     (fingerprint.delete(fp(F.col("whole")), F.col("piece")) == fp(F.col("part"))).alias("d"),
                     (fingerprint.likeness(fp(F.col("whole")), fp(F.col("whole")))).alias("one"))
    assert [tuple(r) for r in same.collect()] == [(True, True, 1.0)] * 2


def test_likeness_follows_the_shared_paragraphs(spark):
    from pyspark.sql import functions as F
    pairs = []
    for n in (20, 400, 5000):
        for share in (0.0, 0.5, 0.9):
            kept = int(n * share)
            a = "\n".join(f"paragraph {n} {i}" for i in range(n))
            b = "\n".join(f"paragraph {n} {i}" if i < kept else f"other {n} {share} {i}" for i in range(n))
            pairs.append((n, share, a, b))
    df = spark.createDataFrame(pairs, "n int, share double, a string, b string")
    got = df.select("n", "share", fingerprint.likeness(fingerprint.fingerprint(F.col("a")), fingerprint.fingerprint(F.col("b")))
                    .alias("near")).collect()
    for r in got:
        assert abs(r["near"] - r["share"]) < 0.35


@pytest.mark.parametrize("unshared, both", [(40, 40), (100, 200), (400, 4000), (10_000, 10_000)])
def test_likeness_error(unshared, both):
    draw = np.random.default_rng(1)
    level = np.array([(1 - 2.0 ** -lv) ** unshared for lv in range(fingerprint.LEVELS)])
    equal = draw.binomial(fingerprint.WIDTH, level, (20_000, fingerprint.LEVELS)).sum(axis=1)
    table = np.array([fingerprint.unshared(i) for i in range(fingerprint.LANES + 1)])
    error = np.maximum(0, 1 - table[equal] / both) - (1 - unshared / both)
    low, high, top = np.percentile(error, [5, 95, 99])
    part = unshared / both
    assert low > -0.26 * part and high < 0.21 * part and top < 0.3 * part and abs(np.median(error)) < 0.03


def test_likeness_of_single_pairs(spark):
    from pyspark.sql import functions as F
    data = [(k, "\n".join(f"a {k} {i}" for i in range(20)), "\n".join(f"a {k} {i}" if i < kept else f"b {k} {i}" for i in range(20)), kept / 20)
            for k in range(60) for kept in (0, 10, 18)]
    df = spark.createDataFrame(data, "k int, a string, b string, share double")
    near = df.select("share", fingerprint.likeness(fingerprint.fingerprint(F.col("a")), fingerprint.fingerprint(F.col("b"))))
    errors = [abs(r[1] - r[0]) for r in near.collect()]
    assert max(errors) < 0.35 and np.percentile(errors, 90) < 0.17


def test_fingerprint_edges(spark, odd, empty):
    got = rows(fingerprint.fingerprints(odd))
    assert len(got) == 11
    assert len({r["fingerprint"] for r in got if r["n_chars"] == 23}) == 1
    assert rows(fingerprint.fingerprints(empty)) == []
    one = rows(fingerprint.fingerprints(odd.where("doc_id = 4")))
    assert len(one) == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"ono").hexdigest()


# the pipeline

def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir)
        assert docs.columns == before.columns
        seen[name] = (rows(before), rows(docs))
    model = quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {r["doc_id"] for r in rows(quality.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), model)) if r["predicted"]}
    assert {r["doc_id"] for r in seen["quality classifier"][1]} == good
    before, after = seen["near-dedup"]
    parts = slow_components({r["doc_id"]: r["text"] or "" for r in before}, 5)
    assert {r["doc_id"] for r in after} == {i for i, (_, c) in parts.items() if i == c}
    before, after = seen["decontamination"]
    items = [decontaminate.normalise(r["text"]) for r in table(sf_dir, "benchmark")]
    left = {r["doc_id"] for r in after}
    for r in before:
        text = decontaminate.normalise(r["text"])
        if any(x in text for x in items):
            assert r["doc_id"] not in left
    before, after = seen["secret scan"]
    texts = {r["doc_id"]: r["text"] for r in before}
    assert len(before) == len(after)
    for r in after:
        assert slow_spans(r["text"] or "") == "" and r["n_chars"] == len(r["text"])
        assert r["text"] == texts[r["doc_id"]] or slow_spans(texts[r["doc_id"]])
    check_packing(rows(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)), {r["doc_id"]: r["text"] or "" for r in after})


def test_pipeline_stages_on_odd_rows(spark, odd, empty, sf_dir):
    import corpus_pipeline
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, sf_dir).count() > 0
        assert stage(spark, empty, sf_dir).count() == 0


def test_expected_equal_falls():
    values = [fingerprint.expected_equal(d) for d in (0, 1, 10, 100, 1000)]
    assert values == sorted(values, reverse=True) and values[0] == pytest.approx(fingerprint.LANES)
    assert not math.isnan(values[-1])
