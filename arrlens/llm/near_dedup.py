"""MinHash near-duplicate detection by a signature-coordinate inverted join.

Every class of equal texts is posted under each of its K coordinate values. A
pair of similarity >= 0.8 agrees in at least T of the K coordinates but with
probability below 10^-5. So:

* skip: a value posted once collides with nothing; a class with fewer than T
  shared values cannot reach T collisions and is dropped;
* prefix: two classes with T collisions share one of their first m - T + 1
  values in rarest-first order (m: number of shared values), so only those are
  posted for the join;
* partners: of a longer posting list, only members stay that collide T times with
  a member of another component, tested list by list on seven bits of each value. So
  no text or shingle is read or moved for members that are there by chance;
* merging: what is already in one component is not paired again. Each short
  posting list pairs all its members; of the longer ones, a node first takes
  its longest only and meets that list's few hubs, the members whose values
  most others share: they lie in the middle of a group, and most of it links to
  them. Of the lists that still hold several components, a node then takes one
  a round, the shortest first, and meets its hubs of other components, as long
  as a round closes some of them. So a round makes at most HUBS pairs of a node.
  Pairs are kept from T collisions of the whole signatures on, and a link is
  confirmed on the full shingle sets.

Members of lists that stay open then meet by their shingles themselves: two
similar sets share one of their rarest n - ceil(0.8 n) + 1 shingles, so a
passage that many documents share pairs nobody. What follows the first shared
shingle in either set bounds the intersection, so a pair is made only by
shingles early enough in both. Sets of which PARITY_BITS parities differ in
more places than similar sets have unshared shingles are no pair either, so
that near copies too far apart make none. Texts of one of these pairs are compared
for each two components first, and of the others if that did not join them. This
last step is exact.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import TableScope, shuffles_freed
from .common import id_and_text, in_slices, staged, table

COORDINATES = 48
_LOW = 63               # the low bits of a posting name its coordinate
MIN_COLLISIONS = 24     # P(Bin(48, 0.8) < 24) is about 10^-6
SIMILARITY = 80         # percent
SHORT = 6               # members of a posting list that are all paired at once
HUBS = 4                # members of a longer list that all others are paired with first
OPEN_SHARE = 0.98       # hub rounds go on while each leaves at most this share of the components
PARITY_BITS = 1024      # parities of a shingle set: the top bits of a shingle choose one
BLOCK = 2048            # members of a shingle's list that one key of the pair join holds
TESTED = 4096           # members of a posting list up to which each is asked for a partner
CACHE_WORDS = 150_000
_M = (1 << 64) - 1


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit constants per coordinate (the second odd), from sha256 of its number."""
    digest = [hashlib.sha256(f"coordinate {i}".encode()).digest() for i in range(n)]
    return (np.array([int.from_bytes(d[:8], "little") for d in digest], dtype=np.uint64),
            np.array([int.from_bytes(d[8:16], "little") | 1 for d in digest], dtype=np.uint64))


_XOR, _MUL = _constants(COORDINATES)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) < CACHE_WORDS:
            self[word] = h
        return h


def shingle_set(text: str, size: int, hashes: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles. Words are
    runs without ASCII white space, A-Z lower-cased; a shorter text is one
    shingle; without words there is none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(len(words) - size + 1, 1)
    out = np.full(n, min(len(words), size), dtype=np.uint64)
    for i in range(min(size, len(words))):
        out = (out ^ h[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """K postings: the minimum under each coordinate's hash, its low bits
    replaced by the coordinate's number."""
    best = np.full(COORDINATES, _M, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        part = (shingles[None, at:at + 4096] ^ _XOR[:, None]) * _MUL[:, None]
        best = np.minimum(best, part.min(axis=1))
    return ((best & ~np.uint64(_LOW)) | np.arange(COORDINATES, dtype=np.uint64)).view(np.int64)


def _sign(size: int):
    def sign(batches):
        hashes = _WordHashes()
        for batch in in_slices(batches):
            n, flat, offsets = [], [], [0]
            for text in batch["text"].to_pylist():
                s = shingle_set(text, size, hashes)
                n.append(len(s))
                if len(s):
                    flat.append(signature(s))
                offsets.append(offsets[-1] + (COORDINATES if len(s) else 0))
            if len(hashes) >= CACHE_WORDS:
                hashes.clear()
            values = np.concatenate(flat) if flat else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_key"], pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))],
                ["doc_id", "text_key", "n_shingles", "signature"])
    return sign


def _sets(size: int):
    def sets(batches):
        hashes = _WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                s = [shingle_set(t, size, hashes).view(np.int64) for t in part["text"].to_pylist()]
                if len(hashes) >= CACHE_WORDS:
                    hashes.clear()
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in s])]).astype(np.int32)
                values = np.concatenate(s) if s else np.empty(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part["node"], part["component"], pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                     pa.array([parities(x) for x in s], pa.list_(pa.int64()))],
                    ["node", "component", "shingles", "parities"])
    return sets


def parities(shingles: np.ndarray) -> np.ndarray:
    """PARITY_BITS bits: of each value of the shingles' top bits, whether an odd
    number of shingles has it. Two sets differ in at least as many shingles as
    their parities differ in bits."""
    top = (shingles.view(np.uint64) >> np.uint64(65 - PARITY_BITS.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(top, minlength=PARITY_BITS) & 1).astype(np.uint8)).view(np.int64)


def _differing(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, PARITY_BITS // 64)),
               F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def _compare(size: int, similarity: int):
    def compare(batches):
        hashes = _WordHashes()
        last, y = None, None  # rows of one b follow each other
        for batch in in_slices(batches):
            links = []
            for i in range(batch.num_rows):
                b = batch["b"][i].as_py()
                if b != last:
                    last, y = b, shingle_set(batch["tb"][i].as_py(), size, hashes)
                x = shingle_set(batch["ta"][i].as_py(), size, hashes)
                both = len(np.intersect1d(x, y, assume_unique=True))
                links.append(both * 100 >= similarity * (len(x) + len(y) - both))
            if len(hashes) >= CACHE_WORDS:
                hashes.clear()
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(links, pa.bool_()))
    return compare


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with the md5 of their text: equal texts are one class."""
    return id_and_text(docs).withColumn("text_key", F.md5(F.col("text").cast("binary")))


def prefix_postings(nodes: DataFrame, min_collisions: int = MIN_COLLISIONS) -> DataFrame:
    """(node, weight, posting): the rarest m - T + 1 of the m values that a node
    shares. ``weight``: how often others share them, largest in the middle of a group."""
    posted = nodes.select("node", F.explode("signature").alias("posting"))
    shared = posted.groupBy("posting").agg(F.count("*").alias("n")).where("n > 1")
    own = posted.join(shared, "posting").groupBy("node").agg(
        F.collect_list(F.struct("n", "posting")).alias("own"))  # at most K entries
    own = own.where(F.size("own") >= min_collisions)
    first = F.slice(F.array_sort("own"), F.lit(1), F.size("own") - (min_collisions - 1))
    weight = F.aggregate("own", F.lit(0).cast("long"), lambda total, e: total + e["n"])
    return own.select("node", weight.alias("weight"), F.explode(first).alias("p")).select("node", "weight", "p.posting")


def sizes_agree(a: Column, b: Column, similarity: int) -> Column:
    return F.least(a, b) * 100 >= similarity * F.greatest(a, b)


def shingle_pairs(members: DataFrame, similarity: int, block: int = BLOCK) -> DataFrame:
    """Distinct pairs (a, b) of ``members`` (node, shingles, parities, component) of
    different components that share a shingle of both prefixes, rarest first.
    The first one that a pair shares has the whole intersection at or after it
    in both sets: rows whose places leave too little room cannot be the first
    shared shingle of a similar pair. Nor is a pair similar whose parities
    differ in too many bits."""
    posted = members.select("node", F.size("shingles").alias("n_shingles"), "component",
                            F.explode("shingles").alias("posting"))
    shared = posted.groupBy("posting").agg(F.count("*").alias("n"), F.min("component").alias("lo"),
                                           F.max("component").alias("hi"))
    own = posted.join(shared.where("n > 1"), "posting").groupBy("node", "n_shingles", "component").agg(
        F.array_sort(F.collect_list(F.struct("n", "posting", (F.col("lo") < F.col("hi")).alias("open")))).alias("own"))
    # shingles that nobody else has come first and need no posting
    prefix = F.col("n_shingles") - F.ceil(F.col("n_shingles") * similarity / 100) + 1
    left = (prefix - (F.col("n_shingles") - F.size("own"))).cast("int")
    own = own.where(left > 0).select("node", "n_shingles", "component", F.size("own").alias("n_own"),
                                     F.posexplode(F.slice("own", F.lit(1), left)).alias("at", "p"))
    own = own.where("p.open").select("node", "n_shingles", "component", "p.posting",
                                     (F.col("n_own") - F.col("at")).alias("room"))
    own = staged(own.join(members.select("node", "parities"), "node"), "shingle-prefixes")
    # a long list is dealt into blocks, so that no key holds it whole on both sides
    dealt = own.groupBy("posting").agg(F.ceil(F.count("*") / block).alias("blocks"), F.count("*").alias("n")).where("n > 1")
    own = own.join(dealt.drop("n"), "posting")
    x = own.select("posting", F.pmod(F.xxhash64("node"), "blocks").alias("block"), F.col("node").alias("x"),
                   F.col("n_shingles").alias("nx"), F.col("component").alias("cx"), F.col("room").alias("rx"),
                   F.col("parities").alias("px"))
    y = own.select("posting", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
                   F.col("node").alias("y"), F.col("n_shingles").alias("ny"), F.col("component").alias("cy"),
                   F.col("room").alias("ry"), F.col("parities").alias("py"))
    room = F.least("rx", "ry") * (100 + similarity) >= similarity * (F.col("nx") + F.col("ny"))
    # J >= s: at most (1 - s) / (1 + s) of the shingles of both are not shared
    near = _differing("px", "py") * (100 + similarity) <= (100 - similarity) * (F.col("nx") + F.col("ny"))
    pairs = x.join(y, ["posting", "block"]).where((F.col("cx") < F.col("cy")) & room &
                                                  sizes_agree(F.col("nx"), F.col("ny"), similarity) & near)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def codes(signature: str) -> Column:
    """Seven bits of each value: they can only count too many collisions."""
    return F.transform(signature, lambda v: F.shiftright(v, 6).bitwiseAND(F.lit(127)).cast("tinyint"))


def likely(pairs: DataFrame, members: DataFrame, min_collisions: int, similarity: int) -> DataFrame:
    """The pairs (a, b) of ``members`` (node, n_shingles, codes) with sets of like
    size and at least T collisions of their whole signatures."""
    both = pairs.join(members.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("codes").alias("sa")), "a") \
        .join(members.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("codes").alias("sb")), "b")
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda e: e))
    return both.where(sizes_agree(F.col("na"), F.col("nb"), similarity) & (same >= min_collisions)).select("a", "b")


def confirmed(pairs: DataFrame, bodies: DataFrame, shingle_words: int, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar:
    100 * intersection >= similarity * union."""
    both = pairs.join(bodies.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a") \
        .join(bodies.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(_compare(shingle_words, similarity), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for all nodes with a
    link. Every step takes the smallest label around a node and then jumps to
    that label's label, so chains shorten by half at least."""
    both = staged(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = staged(both.groupBy("a").agg(F.min("b").alias("m"))
                   .select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("component").alias("m"))
        step = label.join(near, label["node"] == near["a"]).select(
            "node", "component", F.least("component", "m").alias("new"))
        jump = label.select(F.col("node").alias("at"), F.col("component").alias("further"))
        step = staged(step.join(jump, step["new"] == jump["at"]).select(
            "node", F.least("new", "further").alias("component"),
            (F.least("new", "further") < F.col("component")).alias("changed")), "labels")
        label = step.select("node", "component")
        if not step.where("changed").limit(1).count():
            return label


def _by_length(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings of the lists with 2 to SHORT members, and of the longer ones
    with their number ``n`` of members."""
    n = postings.groupBy("posting").agg(F.count("*").alias("n"))
    return (postings.join(n.where((F.col("n") > 1) & (F.col("n") <= SHORT)).select("posting"), "posting"),
            postings.join(n.where(F.col("n") > SHORT), "posting"))


def _all_pairs(short: DataFrame) -> DataFrame:
    """All pairs of the members of lists that have at most SHORT."""
    lists = short.groupBy("posting").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    firsts = lists.select("nodes", F.posexplode("nodes").alias("i", "a"))
    return firsts.select("a", F.explode(F.slice("nodes", F.col("i") + 2, F.lit(SHORT))).alias("b"))


def have_partner(sizes: np.ndarray, component: np.ndarray, own: np.ndarray, min_collisions: int,
                 similarity: int) -> np.ndarray:
    """Of each member of one list, whether another one of another component has a set
    of like size and at least T of the same codes (``own``: a row of each member)."""
    out = np.zeros(len(sizes), dtype=bool)
    by_place = np.ascontiguousarray(own.T)
    left, mine = np.arange(len(sizes)), by_place
    for at in range(0, len(sizes), 64):     # who has found a partner is not compared with further members
        part = slice(at, at + 64)
        same = np.zeros((len(sizes[part]), len(left)), dtype=np.uint8)
        for code, others in zip(by_place[:, part], mine):
            same += code[:, None] == others[None, :]
        y, x = np.nonzero(same >= min_collisions)
        y, x = y + at, left[x]
        agree = np.minimum(sizes[x], sizes[y]) * 100 >= similarity * np.maximum(sizes[x], sizes[y])
        out[x[agree & (component[x] != component[y])]] = True
        if out[left].any():
            left = left[~out[left]]
            mine = np.ascontiguousarray(by_place[:, left])
        if not len(left):
            break
    return out


def _test_partners(min_collisions: int, similarity: int, tested: int):
    def test(batches):
        rest = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = pa.Table.from_batches([batch])
                rest = new if rest is None else pa.concat_tables([rest, new])
            if rest is None or not rest.num_rows:
                continue
            posting = rest["posting"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], posting[1:] != posting[:-1]]))
            ends = np.append(starts[1:], len(posting))
            if batch is not None and rest["n"][int(starts[-1])].as_py() <= tested:
                starts, ends = starts[:-1], ends[:-1]   # the last list may go on in the next batch
            if not len(starts):
                continue
            done = rest.slice(0, int(ends[-1])).combine_chunks()
            rest = rest.slice(int(ends[-1]))
            n, sizes, component = (done[c].to_numpy() for c in ("n", "n_shingles", "component"))
            own = done["codes"].combine_chunks().flatten().to_numpy().reshape(len(n), COORDINATES)
            stay = np.ones(len(n), dtype=bool)
            for a, b in zip(starts.tolist(), ends.tolist()):
                if n[a] <= tested:
                    stay[a:b] = have_partner(sizes[a:b], component[a:b], own[a:b], min_collisions, similarity)
            yield from done.select(["posting", "node", "weight", "n", "component"]).filter(pa.array(stay)).to_batches()
        pa.default_memory_pool().release_unused()
    return test


def with_partners(lists: DataFrame, members: DataFrame, min_collisions: int, similarity: int,
                  tested: int = TESTED) -> DataFrame:
    """The postings of ``lists`` (posting, node, weight, n, component) whose node has a
    partner in the list: a member of another component with a set of like size and at least
    T collisions. A similar pair shares a list, so both of it stay there. Lists of more than
    ``tested`` members stay whole, dealt in parts, so that no task holds one."""
    rows = lists.join(members, "node").select("posting", "node", "weight", "n", "component", "n_shingles", "codes")
    part = F.when(F.col("n") > tested, F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / tested))).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("part", part).repartition("posting", "part").sortWithinPartitions("posting").drop("part")
    return rows.mapInArrow(_test_partners(min_collisions, similarity, tested),
                           "posting long, node long, weight long, n long, component long")


def _hubs(lists: DataFrame, *carried: str, turn: int = 0) -> DataFrame:
    """(posting, hubs): each list is dealt into parts by a hash of the node (other
    ones in each turn), and of each part the member of most ``weight`` (if lists have
    it) is a hub, so that lists with many members in common choose alike."""
    weight = F.col("weight") if "weight" in lists.columns else F.lit(0)
    at = F.xxhash64("node", F.lit(turn))
    rank = F.struct(weight.alias("weight"), at.alias("at"), F.struct("node", *carried).alias("hub"))
    return lists.groupBy("posting").agg(F.array_compact(F.array(*[
        F.max(F.when(F.pmod(at, F.lit(HUBS)) == i, rank))["hub"] for i in range(HUBS)])).alias("hubs"))


def _ordered(node: str, hub: str) -> list[Column]:
    return [F.least(node, hub).alias("a"), F.greatest(node, hub).alias("b")]


def _hub_pairs(long: DataFrame) -> DataFrame:
    """Each node with the hubs of its longest list."""
    own = long.groupBy("node").agg(F.max(F.struct("n", "posting"))["posting"].alias("posting"))
    pairs = own.join(_hubs(long), "posting").select("node", F.explode("hubs.node").alias("hub"))
    return pairs.where("node != hub").select(*_ordered("node", "hub"))


def _open_lists(postings: DataFrame, label: DataFrame | None) -> DataFrame:
    """The postings of the lists that hold several components, with the node's ``component``."""
    if label is None:
        named = postings.withColumn("component", F.col("node"))
    else:
        named = postings.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = named.groupBy("posting").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    return named.join(several.select("posting"), "posting")


def _one_list_each(lists: DataFrame, turn: int) -> DataFrame:
    """(node, component, posting): of the open lists of each node, at most K, the
    shortest in the first turn, the next one in the next (at the end the longest)."""
    own = lists.groupBy("node", "component").agg(F.array_sort(F.collect_list(F.struct("n", "posting"))).alias("own"))
    return own.select("node", "component", F.element_at("own", F.least(F.lit(turn), F.size("own")))["posting"].alias("posting"))


def _open_hub_pairs(lists: DataFrame, turn: int, asking: DataFrame | None = None) -> DataFrame:
    """The members of open lists (or only the postings ``asking``) with those of the
    list's hubs of this turn that are in other components."""
    met = (lists if asking is None else asking).join(_hubs(lists, "component", turn=turn), "posting")
    others = F.filter("hubs", lambda h: h["component"] != F.col("component"))   # before a row is made of any
    return met.select("node", F.explode(others).alias("hub")).select(*_ordered("node", "hub.node"))


def _between(pairs: DataFrame, label: DataFrame | None) -> DataFrame:
    """(a, b, ca, cb): the pairs of different components."""
    if label is None:
        return pairs.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb"))
    out = pairs
    for x in ("a", "b"):
        own = label.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
        out = out.join(own, x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))
    return out.where("ca != cb").select("a", "b", "ca", "cb")


def _one_pair_each(pairs: DataFrame) -> DataFrame:
    """One of the pairs of each two components."""
    two = pairs.groupBy(F.least("ca", "cb").alias("lo"), F.greatest("ca", "cb").alias("hi"))
    return two.agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")


def _bodies(keyed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the given classes, from one document of each."""
    none = F.lit(-2 ** 63)
    texts = keyed.withColumn("rid", F.coalesce("doc_id", none))
    wanted = nodes.select("node", "text_key", F.coalesce("rep", none).alias("rid"))
    # repeated rows of one id and text are alike; the join has dealt them by these keys already
    return texts.join(wanted, ["text_key", "rid"]).dropDuplicates(["text_key", "rid"]).select("node", "text")


def find_components(docs: DataFrame, shingle_words: int, similarity: int = SIMILARITY,
                    min_collisions: int = MIN_COLLISIONS) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(signed documents, classes, components of the classes that have links). Signatures,
    postings and texts go when they are not needed any more, as do the shuffle files of each step."""
    spark, keyed = docs.sparkSession, _keyed(docs)
    whole, working = TableScope(spark), TableScope(spark)
    with shuffles_freed(spark):
        with whole:
            signed = staged(keyed.mapInArrow(
                _sign(shingle_words), "doc_id long, text_key string, n_shingles long, signature array<long>"), "signed")
            nodes = staged(signed.groupBy("text_key").agg(
                F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"),
                F.first("signature").alias("signature")).withColumn("node", F.monotonically_increasing_id()), "classes")
        with working:
            postings = staged(prefix_postings(nodes.where("n_shingles > 0"), min_collisions), "prefixes")
            members = staged(nodes.join(postings.select("node").distinct(), "node")
                             .select("node", "n_shingles", codes("signature").alias("codes")), "members")
        signed = staged(signed.drop("signature"), "documents")
        nodes = staged(nodes.drop("signature"), "classes")
        whole.release()
        with working:
            label = _linked(keyed, nodes, postings, members, shingle_words, similarity, min_collisions)
        label = label if label is None else staged(label, "labels")
        working.release()
    return signed, nodes, label


def _linked(keyed: DataFrame, nodes: DataFrame, postings: DataFrame, members: DataFrame, shingle_words: int,
            similarity: int, min_collisions: int) -> DataFrame | None:
    """(node, component) of the classes that have links, None if there are none."""
    short, long = _by_length(postings)
    alone = with_partners(long.withColumn("component", F.col("node")), members, min_collisions, similarity)
    few, long = _by_length(staged(alone.select("node", "weight", "posting"), "long-lists"))
    long = staged(long, "long-lists")

    def probable(pairs: DataFrame) -> DataFrame:
        return staged(likely(pairs.distinct(), members, min_collisions, similarity), "likely")

    pairs = probable(_all_pairs(short).union(_all_pairs(few)).union(_hub_pairs(long)))
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(long.select("node")).distinct()
    bodies = staged(_bodies(keyed, nodes.join(asked, "node")), "bodies")

    links, label = None, None

    def link(pairs: DataFrame) -> None:
        nonlocal links, label
        found = staged(confirmed(pairs, bodies, shingle_words, similarity), "links")
        if found.limit(1).count():
            links = found if links is None else links.unionByName(found)
            label = components(links)

    def still_open() -> tuple[DataFrame, int]:
        lists = staged(with_partners(_open_lists(long, label), members, min_collisions, similarity), "open-lists")
        return lists, lists.select("component").distinct().count()

    link(pairs)
    lists, n = still_open()
    turn, before = 0, None
    while n and (before is None or n <= OPEN_SHARE * before):
        turn, before = turn + 1, n
        link(probable(_open_hub_pairs(lists, turn, _one_list_each(lists, turn))))
        lists, n = still_open()
    if n:
        rest = bodies.join(lists.select("node", "component").distinct(), "node").select("node", "component", "text")
        sets = rest.mapInArrow(_sets(shingle_words),
                               "node long, component long, shingles array<long>, parities array<long>")
        near = staged(shingle_pairs(staged(sets, "open"), similarity), "likely")
        first = staged(_one_pair_each(_between(near, label)), "likely")
        link(first)
        link(staged(_between(near.join(first, ["a", "b"], "left_anti"), label).select("a", "b"), "likely"))
    return label


def near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity: int = SIMILARITY,
                    min_collisions: int = MIN_COLLISIONS) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id (the smallest
    doc_id reachable over links, its own included), kept.

    Null text counts as empty; texts without words have no shingles, no links
    and their own id as component. Equal texts are linked like any others;
    repeated rows give repeated results, and null ids count only where a
    component has no other (then it is null and its rows are kept). An empty
    table gives no rows; other columns are ignored. Texts are read whole.
    Memory per task is bounded by one document and the codes of one list of TESTED members."""
    return _classified(docs, shingle_words, similarity, min_collisions).drop("text_key")


def _classified(docs: DataFrame, shingle_words: int, similarity: int, min_collisions: int) -> DataFrame:
    signed, nodes, label = find_components(docs, shingle_words, similarity, min_collisions)
    named = nodes.where("n_shingles > 0")
    if label is None:
        named = named.withColumn("component", F.col("node"))
    else:
        named = named.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = named.join(smallest, "component").select("text_key", "component_id", F.lit(True).alias("has"))
    out = signed.select("doc_id", "text_key", "n_shingles").join(of_class, "text_key", "left")
    component: Column = F.when(F.col("has"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"), "text_key")


def keep_first(docs: DataFrame, shingle_words: int = 5, similarity: int = SIMILARITY,
               min_collisions: int = MIN_COLLISIONS) -> DataFrame:
    """The rows of ``docs``, all columns, of one document of each group: the
    one with the smallest doc_id, and of its repeated rows (one id and text) the one whose other columns
    come first as JSON. Rows with null
    ids are kept where their whole group has none, one of each text; so are
    all texts without words."""
    kept = _classified(docs, shingle_words, similarity, min_collisions).where("kept").select("doc_id", "text_key").distinct()
    # the row as one column, so that no column of the caller's meets one of these names
    rest = [c for c in docs.columns if c.lower() not in ("doc_id", "text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("id"),
                       F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("key"), F.struct("*").alias("row"),
                       F.to_json(F.struct(F.col("text").isNull(), *rest)).alias("rank"))
    own = rows.join(kept, rows["id"].eqNullSafe(kept["doc_id"]) & (rows["key"] == kept["text_key"]), "left_semi")
    return own.groupBy("id", "key").agg(F.min_by("row", "rank").alias("row")).select("row.*")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
         ELSE list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n, sh FROM s),
c AS (SELECT min(doc_id) AS node, any_value(n) AS n, any_value(list_sort(sh)) AS sh FROM n WHERE n > 0
      GROUP BY list_sort(sh)),
u AS (SELECT node, n, unnest(sh) AS g FROM c),
f AS (SELECT g, count(*) AS df FROM u GROUP BY g),
r AS (SELECT u.node, u.n, u.g, row_number() OVER (PARTITION BY u.node ORDER BY f.df, u.g) AS k FROM u JOIN f USING (g)),
p AS (SELECT node, n, g FROM r WHERE k <= n - ceil(0.8 * n) + 1),
cand AS (SELECT DISTINCT a.node AS a, b.node AS b FROM p a JOIN p b ON a.g = b.g AND a.node < b.node
         AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
e AS (SELECT a, b FROM (SELECT cand.a, cand.b, x.n AS na, y.n AS nb, len(list_intersect(x.sh, y.sh)) AS i
      FROM cand JOIN c x ON x.node = cand.a JOIN c y ON y.node = cand.b) WHERE 100 * i >= 80 * (na + nb - i)),
d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
t(node, reach) AS (SELECT node, node FROM c UNION SELECT t.node, d.b FROM t JOIN d ON d.a = t.reach),
m AS (SELECT node, min(reach) AS component_id FROM t GROUP BY node)
SELECT n.doc_id, n.n AS n_shingles, coalesce(m.component_id, n.doc_id) AS component_id,
       n.doc_id = coalesce(m.component_id, n.doc_id) AS kept
FROM n LEFT JOIN c ON n.n > 0 AND c.sh = list_sort(n.sh) LEFT JOIN m ON m.node = c.node
"""
