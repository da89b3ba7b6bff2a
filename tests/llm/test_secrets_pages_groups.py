"""Decoded secrets and public keys, deep pages and link lists, groups of near copies, kept rows."""

import base64
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from arrlens.llm import html_extract, near_dedup, secret_scan, sharding


def tlv(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def number(n):
    return tlv(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


BIG = number(int.from_bytes(bytes(range(1, 129)), "big"))
RSA_OID = tlv(6, bytes.fromhex("2a864886f70d010101"))
ALGORITHM = tlv(0x30, RSA_OID, tlv(5))
RSA = tlv(0x30, number(0), BIG, number(65537), *[BIG] * 6)
PKCS8 = tlv(0x30, number(0), ALGORITHM, tlv(4, RSA))
EC = tlv(0x30, number(1), tlv(4, bytes(range(32))), tlv(0xA0, tlv(6, bytes.fromhex("2a8648ce3d030107"))))
ENCRYPTED = tlv(0x30, tlv(0x30, RSA_OID, tlv(0x30, tlv(4, b"salt" * 4), number(2048))), tlv(4, bytes(range(256))))
PUBLIC = tlv(0x30, ALGORITHM, tlv(3, b"\0" + tlv(0x30, BIG, number(65537))))
RSA_PUBLIC = tlv(0x30, BIG, number(65537))
CERTIFICATE = tlv(0x30, tlv(0x30, tlv(0xA0, number(2)), number(77), ALGORITHM, PUBLIC), ALGORITHM, tlv(3, b"\0" + bytes(64)))
DIGEST = tlv(0x30, tlv(0x30, tlv(6, bytes.fromhex("608648016503040201")), tlv(5)), tlv(4, bytes(32)))


def pem(label, data):
    return f"-----BEGIN {label}-----\n{base64.encodebytes(data).decode()}-----END {label}-----\n"


def found(text):
    spans = secret_scan.find_spans(text)
    return [(secret_scan.KINDS[k], text[a:b]) for a, k, b in spans if k > 2]


@pytest.mark.parametrize("data", [RSA, PKCS8, EC, ENCRYPTED])
def test_private_structures(data):
    assert secret_scan.der_is_private(data) and not secret_scan.der_is_private(data[:-1])
    one = base64.b64encode(data).decode()
    assert found(f"see {one} there") == [("der", one)]
    armoured = pem("PRIVATE KEY", data)
    assert found(f"see\n{armoured}there") == [("pem", armoured[:-1])]


@pytest.mark.parametrize("data", [PUBLIC, RSA_PUBLIC, CERTIFICATE, DIGEST])
def test_public_structures_are_no_secrets(data):
    assert secret_scan.der_is_whole(data) and not secret_scan.der_is_private(data)
    for text in (base64.b64encode(data).decode(), pem("CERTIFICATE", data), pem("PUBLIC KEY", data), data.hex().upper(),
                 base64.encodebytes(data).decode()):
        assert found(f"see {text} there") == []
        if not secret_scan.HEX.search(text):  # runs of hex digits are a base kind whatever they encode
            assert secret_scan.redact(f"see {text}") == f"see {text}"


def test_ssh_public_key_lines_are_no_secrets():
    parts = lambda *xs: b"".join(len(x).to_bytes(4, "big") + x for x in xs)
    public = base64.b64encode(parts(b"ssh-ed25519", b"\x11" * 32)).decode()
    assert found(f"ssh-ed25519 {public} me@host") == []
    private = base64.b64encode(secret_scan.MAGIC + parts(b"none", b"none", b"") + b"\0\0\0\1" + parts(b"x" * 51, b"y" * 99)).decode()
    assert found(f"put {private} here") == [("ssh", private)]


def test_encoded_one_level_deeper():
    url = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    token = f"{url(json.dumps({'alg': 'HS256'}).encode())}.{url(b'{}')}.{url(b'x' * 32)}"
    armoured = pem("RSA PRIVATE KEY", RSA).encode()
    one = base64.b64encode(armoured).decode()
    assert found(f"tls.key: {one}\nmore: words") == [("pem", one)]
    one = base64.b64encode(token.encode()).decode()
    assert found(f"auth {one}, then") == [("jwt", one)]
    wrapped = base64.encodebytes(PKCS8).decode().strip()
    assert found(f"lines\n\n{wrapped}\n\nend") == [("der", wrapped)]
    assert found(f"lines\n{wrapped}\nend") == [("der", wrapped)]
    escaped = json.dumps(wrapped)[1:-1]
    assert found(f'"{escaped}"') == [("der", escaped)]
    assert ("der", RSA.hex().upper()) in found(f"hex {RSA.hex().upper()} end")
    assert ("pem", armoured.hex()) in found(f"hex {armoured.hex()} end")
    one = url(PKCS8)
    assert "-" in url(bytes([251] * 3)) and found(f"id {one} end") == [("der", one)]
    quoted = "".join("> " + line + "\n" for line in pem("PRIVATE KEY", PKCS8).splitlines())
    assert found("he wrote:\n" + quoted) == [("pem", quoted[2:-1])]
    # neither a third level, nor text that merely looks encoded
    twice = base64.b64encode(base64.b64encode(armoured)).decode()
    assert found(twice) == [] and found("a/long/path/of/many/words/that/are/no/key " * 50) == []


def test_long_runs_of_lines_are_read_once():
    text = ("QUJD" * 19 + "\n") * 40_000
    start = time.time()
    assert found(text) == []
    assert time.time() - start < 20


def test_deep_pages_take_linear_time():
    story = "<p>" + "One more sentence of the story, with commas, and a full stop. " * 5 + "</p>"
    for page in ("<div>" * 60_000 + story, ("<div>" + "</p>") * 30_000 + story, "<div><li>" * 20_000 + story):
        start = time.time()
        assert html_extract.main_text(page).startswith("One more sentence")
        assert time.time() - start < 20


def test_link_lists_of_the_story_stay():
    prose = "".join(f"<p>Paragraph {i} tells, at some length, what happened; it ends here. And goes on.</p>" for i in range(6))
    sources = "<h2>Sources</h2><ul><li><a href='/a'>First report of it</a></li><li><a href='/b'>Second one</a></li></ul>"
    aside = "<ul class='related'><li><a href='/c'>Read this too</a></li></ul>"
    outside = "<ul><li><a href='/d'>Home</a></li><li><a href='/e'>News</a></li></ul>"
    text = html_extract.main_text(f"<body>{outside}<article><h1>Title</h1>{prose}{sources}{aside}</article>{outside}</body>")
    assert text.split("\n")[0] == "Title" and text.endswith("Sources\nFirst report of it\nSecond one")
    assert "Home" not in text and "Read this too" not in text


def near_group(n, seed=1, words=80):
    """Copies of one text, each with some of its words exchanged: many pairs are just too far apart."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(words)]
    out = []
    for i in range(n):
        own = list(base)
        for j in rng.sample(range(words), rng.randrange(0, 7)):
            own[j] = f"x{rng.randrange(10 ** 9)}"
        out.append((i, " ".join(own)))
    return out


def test_parities_bound_the_difference():
    rng, hashes = random.Random(2), near_dedup._WordHashes()
    for size in (5, 80, 3000):
        for edits in (0, 1, size // 10, size):
            words = [f"a{rng.randrange(10 ** 6)}" for _ in range(size)]
            other = [f"b{i}" if i < edits else w for i, w in enumerate(words)]
            x, y = (near_dedup.shingle_set(" ".join(t), 2, hashes) for t in (words, other))
            a, b = (near_dedup.parities(s) for s in (x, y))
            bits = sum(bin(int(u) & near_dedup._M).count("1") for u in a ^ b)
            assert bits <= len(set(x.tolist()) ^ set(y.tolist()))
            assert (bits == 0) == (edits == 0)


def test_last_step_is_exact_and_grows_with_links(spark):
    """All similar pairs come out of the shingle join, in blocks as well, and few others do."""
    hashes, made = near_dedup._WordHashes(), []
    for n in (150, 600):
        sets = {i: near_dedup.shingle_set(t, 2, hashes) for i, t in near_group(n)}
        frame = spark.createDataFrame(
            [(i, i, [int(v) for v in s.view("int64")], [int(v) for v in near_dedup.parities(s)]) for i, s in sets.items()],
            "node long, component long, shingles array<long>, parities array<long>")
        plain = {i: set(s.tolist()) for i, s in sets.items()}
        want = {(a, b) for a in plain for b in plain if a < b and
                100 * len(plain[a] & plain[b]) >= 80 * len(plain[a] | plain[b])}
        for block in (near_dedup.BLOCK, 64):
            got = {(r["a"], r["b"]) for r in near_dedup.shingle_pairs(frame, 80, block).collect()}
            assert want <= got and len(got) <= 1.3 * len(want) + 50
        made.append((n, len(want), len(got)))
    assert 0 < made[0][1] < 150 * 149 / 2  # some pairs are too far apart


def test_keep_first_keeps_columns_of_any_name_and_one_known_row(spark):
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame(
        [(1, text, "b", 5, "k", 1), (1, text, "a", 6, "k", 2), (1, text, "c", 7, "k", 3), (2, text, "a", 8, "k", 4),
         (3, "quite another text, of other words than those", "z", 9, "k", 5)],
        "doc_id int, text string, __key string, __kept int, text_key string, row int")
    got = near_dedup.keep_first(docs)
    assert got.schema.names == docs.schema.names
    assert sorted((r["doc_id"], r["__key"], r["__kept"]) for r in got.collect()) == [(1, "a", 6), (3, "z", 9)]


def test_slot_maps_are_stored_edited_and_read_back(spark, tmp_path):
    path = str(tmp_path / "maps")
    now, grown = sharding.stored_versions(spark, path, 7)
    assert sorted(p.name for p in (tmp_path / "maps").iterdir() if p.name.startswith("version")) == ["version=1", "version=2"]
    old = {r["virtual_slot"]: r["shard"] for r in now.collect()}
    new = {r["virtual_slot"]: r["shard"] for r in grown.collect()}
    assert len(old) == len(new) == sharding.SLOTS and max(new.values()) == 7
    assert all(new[s] in (old[s], 7) for s in old) and {r["version"] for r in grown.collect()} == {2}
    again, grown_again = sharding.stored_versions(spark, path, 7)  # nothing is written twice
    assert {r["virtual_slot"]: r["shard"] for r in again.collect()} == old
    assert {r["virtual_slot"]: r["shard"] for r in grown_again.collect()} == new
    with pytest.raises(ValueError):
        sharding.stored_versions(spark, path, 3)
    eight, nine = sharding.stored_versions(spark, path, 8)  # the next edit starts from the stored one
    assert {r["virtual_slot"]: r["shard"] for r in eight.collect()} == new
    assert {r["version"] for r in nine.collect()} == {3}


def test_hot_rows_are_counted_before_they_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 16)
    hot = spark.range(1000).selectExpr("cast(5 as long) doc_id", "'same text' text", "id as size", "'x' sub", "'y' copies")
    null = spark.range(300).selectExpr("cast(null as long) doc_id", "concat('text ', id % 100) text", "id as size", "'x' sub", "'y' copies")
    rest = spark.range(200).selectExpr("id + 10 doc_id", "concat('t', id) text", "id as size", "'x' sub", "'y' copies")
    got = sharding.assign(hot.union(null).union(rest), 3).collect()
    assert len(got) == 1500
    for shard in range(3):
        places = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert places == list(range(len(places)))
    assert sum(r["doc_id"] == 5 for r in got) == 1000 and sum(r["doc_id"] is None for r in got) == 300
    assert len({r["shard"] for r in got if r["doc_id"] is None}) == 1


def test_no_row_is_made_of_hubs_in_the_own_component(spark):
    """A large group of copies that is one component already meets only the hubs of others."""
    from arrlens.llm.near_dedup import _hubs, _open_hub_pairs
    rows = [(p, n, 0 if n < 300 else n) for p in range(5) for n in range(p, 303)]
    lists = spark.createDataFrame(rows, "posting long, node long, component long")
    got = _open_hub_pairs(lists, 1)
    hubs = {r.posting: r.hubs for r in _hubs(lists, "component", turn=1).collect()}
    want = sorted((min(n, h.node), max(n, h.node)) for p, n, c in rows for h in hubs[p] if h.component != c)
    assert sorted(map(tuple, got.collect())) == want
    assert "explode(filter(hubs" in got._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_a_large_near_group_grow_with_its_members(spark, monkeypatch):
    """A node meets the hubs of one list a round, not of all its lists, and hubs lie where most of the
    group links to them: few pairs of each member, however large the group."""
    hashes, asked = near_dedup._WordHashes(), []
    for name in ("likely", "confirmed"):
        def counted(pairs, *args, own=getattr(near_dedup, name)):
            pairs = near_dedup.staged(pairs, "counted")
            asked[-1] += pairs.count()
            return own(pairs, *args)
        monkeypatch.setattr(near_dedup, name, counted)
    for n in (250, 1000):
        asked.append(0)
        group = near_group(n, seed=3)
        docs = spark.createDataFrame(group, "doc_id long, text string")
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, 2).collect()}
        plain = [set(near_dedup.shingle_set(t, 2, hashes).tolist()) for _, t in group]
        want = list(range(n))

        def root(i):
            while want[i] != i:
                i = want[i]
            return i
        for a in range(n):
            for b in range(a + 1, n):
                if 100 * len(plain[a] & plain[b]) >= 80 * len(plain[a] | plain[b]):
                    x, y = sorted((root(a), root(b)))
                    want[y] = x
        assert got == {i: root(i) for i in range(n)}
        assert asked[-1] <= 20 * n
