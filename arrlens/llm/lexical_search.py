"""Ranked lexical search with an exact sparse ball tree.

A document is a sparse vector over the terms that the test items use:
x_t = (10^9 * tf) div (1000 * tf + 8 * m). An item is the vector of its terms'
weights w_t, and its score of a document is the inner product. With both
sides scaled by sqrt(w_t) the product stays, and by Cauchy-Schwarz no document of a
ball (centroid c, radius r) scores more than q.c + |q| r. In thousands of sparse
dimensions that alone prunes little, so a ball also keeps its radius r_t along every
axis: no document scores more than the sum of q_t (c_t + r_t), which sees only the item's
own terms. Every task packs its documents into trees of balls, visits the subtrees best bound
first, stops at the first bound below the 10th best score, and scores the documents of
the leaves it reaches in 64-bit integers. Bounds are rounded up, so nothing is lost.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

TOP = 10
BLOCK_TERMS = 100_000       # (item, term) pairs that are searched in one pass; more items make more passes
TREE_VALUES = 600_000       # vector entries of one tree
TREE_ROWS = 2_048           # and documents
LEAF_ROWS = 12
SALTS = 64                  # groups of partitions that are merged first
NODE_VALUES = 4_000_000     # centroid coordinates held at once
SLACK = 1e-9                # relative rounding allowance; the sums' own error is below 1e-11

# ASCII: letters to lower case, all but letters and digits to blanks; other bytes stay.
_TERMS = bytes((b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32)
               for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return (text or b"").translate(_TERMS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n: int, n_docs: int, total: int) -> int:
    return 100 - 90 + (90 * n * n_docs) // total


class BallTree:
    """Balls over the rows of a sparse matrix (``start``, ``col``, ``x`` of row
    i: start[i] to start[i + 1]); rows are reordered so that a node is a
    stretch of rows. ``root[t]`` is sqrt(w_t)."""

    def __init__(self, ids: np.ndarray, start: np.ndarray, col: np.ndarray, x: np.ndarray, root: np.ndarray,
                 leaf_rows: int = LEAF_ROWS):
        self.width = len(root)
        self.terms, col = np.unique(col, return_inverse=True)  # only the terms that occur here
        scale = root[self.terms]
        y = x * scale[col]
        sizes = np.diff(start)
        norm2 = np.add.reduceat(y * y, start[:-1])
        order = np.arange(len(ids))
        nodes, todo = [], [(0, len(ids))]  # [first, end) of each node's rows
        self.children: list[int] = []
        while todo:  # breadth first: the children of a node stand together
            nxt = []
            for a, b in todo:
                nodes.append((a, b))
                if b - a <= leaf_rows:
                    self.children.append(0)
                    continue
                rows = order[a:b]
                far = self._far_from(rows[0], rows, start, sizes, col, y, norm2, len(scale))
                one = rows[int(np.argmax(far))]
                d1 = self._far_from(one, rows, start, sizes, col, y, norm2, len(scale))
                two = rows[int(np.argmax(d1))]
                d2 = self._far_from(two, rows, start, sizes, col, y, norm2, len(scale))
                by = np.argsort(d1 - d2, kind="stable")
                cut = int(np.count_nonzero(d1 < d2))
                if not (b - a) // 8 <= cut <= (b - a) - (b - a) // 8:
                    cut = (b - a) // 2  # ties and outliers: halves
                order[a:b] = rows[by]
                self.children.append(-1)
                nxt += [(a, a + cut), (a + cut, b)]
            todo = nxt
        k = 1
        for i, c in enumerate(self.children):
            if c:
                self.children[i] = k
                k += 2
        self.nodes = nodes
        take = np.concatenate([np.arange(start[r], start[r + 1]) for r in order]) if len(order) else order
        self.ids, self.col, self.x = ids[order], col[take], x[take]
        self.start = np.concatenate([[0], np.cumsum(sizes[order])])
        y, norm2 = y[take], norm2[order]
        row_of = np.repeat(np.arange(len(order)), sizes[order])
        # per term (row) and node: centroid in scaled, centroid plus radius along the axis in plain coordinates
        self.centre = np.zeros((len(scale), len(nodes)))
        self.reach = np.zeros((len(scale), len(nodes)))
        self.radius = np.zeros(len(nodes))
        for i, (a, b) in enumerate(nodes):
            s, e = self.start[a], self.start[b]
            c = np.bincount(self.col[s:e], weights=y[s:e], minlength=len(scale)) / (b - a)
            dot = np.bincount(row_of[s:e] - a, weights=y[s:e] * c[self.col[s:e]], minlength=b - a)
            c2 = float(c @ c)
            # squared distances, with an allowance for the cancellation
            d2 = np.maximum(norm2[a:b] - 2 * dot + c2, 0.0) + SLACK * (norm2[a:b] + c2)
            self.centre[:, i], self.radius[i] = c, math.sqrt(float(d2.max()))
            high = np.zeros(len(scale), np.int64)
            np.maximum.at(high, self.col[s:e], self.x[s:e])
            self.reach[:, i] = high  # below 2^53: exact
        self.place = np.full(self.width, -1, np.int64)
        self.place[self.terms] = np.arange(len(self.terms))

    @staticmethod
    def _far_from(pivot, rows, start, sizes, col, y, norm2, width):
        p = np.zeros(width)
        p[col[start[pivot]:start[pivot + 1]]] = y[start[pivot]:start[pivot + 1]]
        lengths = sizes[rows]
        ends = np.cumsum(lengths)
        first = ends - lengths
        take = np.arange(ends[-1]) + np.repeat(start[rows] - first, lengths)
        return norm2[rows] - 2 * np.add.reduceat(y[take] * p[col[take]], first) + norm2[pivot]

    def search(self, q_terms: np.ndarray, q_weights: np.ndarray, q_root: np.ndarray, heap: list, top: int) -> int:
        """Adds this tree's documents to ``heap``, the item's ``top`` best
        (score, -doc_id) so far; returns the number of documents scored."""
        at = self.place[q_terms]
        here = at >= 0
        at, w = at[here], q_weights[here]
        if not len(at):
            return 0
        # terms that no document of the tree has add nothing: the item is cut to the others
        norm = math.sqrt(float(w.sum()))
        ball = q_root[here] @ self.centre[at] + norm * self.radius
        axes = w.astype(np.float64) @ self.reach[at]
        bound = np.minimum(ball, axes) * (1 + SLACK) + 1
        dense = np.zeros(len(self.terms), np.int64)
        dense[at] = w
        queue, scored = [(-bound[0], 0)], 0
        while queue:
            b, node = heapq.heappop(queue)
            if len(heap) == top and -b < heap[0][0]:
                break
            child = self.children[node]
            if child:
                for c in (child, child + 1):
                    if len(heap) < top or bound[c] >= heap[0][0]:
                        heapq.heappush(queue, (-min(bound[c], -b), c))
                continue
            first, end = self.nodes[node]
            s, e = self.start[first], self.start[end]
            scores = np.add.reduceat(dense[self.col[s:e]] * self.x[s:e], self.start[first:end] - s)
            scored += end - first
            low = heap[0][0] if len(heap) == top else 1
            for r in np.flatnonzero(scores >= max(low, 1)):
                entry = (int(scores[r]), -int(self.ids[first + r]))
                if len(heap) < top:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
        return scored


def _bytes(column) -> list:
    return column.cast(pa.binary()).to_pylist()


def _item_terms(batches):
    for batch in batches:
        pairs = sorted({(i, t) for i, text in zip(batch["item_id"].to_pylist(), _bytes(batch["text"]))
                        for t in terms_of(text)}, key=lambda p: (p[0] is None, p[0] or 0, p[1]))
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()),
                                          pa.array([p[1] for p in pairs], pa.binary()).cast(pa.string())],
                                         ["item_id", "term"])


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term); rows of one id make one item."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.where("text IS NOT NULL").mapInArrow(_item_terms, "item_id long, term string").distinct()


def _vectors(vocabulary: list[str]):
    def vectors(batches):
        number = {t.encode(): i for i, t in enumerate(vocabulary)}
        for batch in batches:
            ids, n, cols, tfs, ends = [], [], [], [], [0]
            for doc_id, text in zip(batch["doc_id"].to_pylist(), _bytes(batch["text"])):
                terms = terms_of(text)
                if not terms:
                    continue
                tf: dict[int, int] = {}
                for t in map(number.get, terms):
                    if t is not None:
                        tf[t] = tf.get(t, 0) + 1
                ids.append(doc_id)
                n.append(len(terms))
                cols += tf.keys()
                tfs += tf.values()
                ends.append(len(cols))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(cols, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], ["doc_id", "n", "terms", "tf"])
    return vectors


def vectors(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, terms, tf) of every document row with a term: all its terms
    counted, those of the vocabulary listed by number. A null id becomes the
    largest long, so that it sorts last."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2 ** 63 - 1)).alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_vectors(vocabulary), "doc_id long, n long, terms array<int>, tf array<long>")


def _blocks(batches, weights, n_docs, total):
    """Row batches of at most TREE_ROWS documents and about TREE_VALUES entries
    as (ids, start, col, x), documents without weighted terms left out."""
    held, values = [], 0
    for batch in batches:
        ids = batch["doc_id"].to_numpy(zero_copy_only=False)
        n = batch["n"].to_numpy(zero_copy_only=False)
        start = batch["terms"].offsets.to_numpy().astype(np.int64)
        col = batch["terms"].values.to_numpy(zero_copy_only=False)[start[0]:start[-1]]
        tf = batch["tf"].values.to_numpy(zero_copy_only=False)[start[0]:start[-1]]
        start = start - start[0]
        m = np.array([length_factor(int(v), n_docs, total) for v in n], dtype=np.int64)
        x = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, np.diff(start)))
        useful = weights[col] > 0
        kept = np.concatenate([[0], np.cumsum(useful)])[start]
        col, x, sizes = col[useful].astype(np.int64), x[useful], np.diff(kept)
        some = sizes > 0
        ids, sizes = ids[some], sizes[some]
        ends, a = np.cumsum(sizes), 0
        while a < len(ids):
            base = ends[a - 1] if a else 0
            b = int(np.searchsorted(ends, base + TREE_VALUES - values, side="right"))
            b = min(max(b, a + 1), len(ids), a + TREE_ROWS - sum(len(h[0]) for h in held))
            held.append((ids[a:b], sizes[a:b], col[base:ends[b - 1]], x[base:ends[b - 1]]))
            values += int(ends[b - 1] - base)
            a = b
            if values >= TREE_VALUES or a < len(ids) or sum(len(h[0]) for h in held) >= TREE_ROWS:
                yield _joined(held)
                held, values = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    ids, sizes, col, x = (np.concatenate(c) for c in zip(*held))
    return ids, np.concatenate([[0], np.cumsum(sizes)]), col, x


def _searcher(items, weights: list[int], n_docs: int, total: int, top: int):
    def search(batches):
        w = np.array(weights, np.int64)
        root = np.sqrt(w.astype(np.float64))
        heaps = [[] for _ in items]
        queries = [np.array([t for t in terms if w[t] > 0], np.int64) for _, terms in items]
        for ids, start, col, x in _blocks(batches, w, n_docs, total):
            # larger leaves where many terms would make the nodes' coordinates too many
            leaf = max(LEAF_ROWS, 4 * len(ids) * len(np.unique(col)) // NODE_VALUES)
            tree = BallTree(ids, start, col, x, root, leaf)
            for heap, q in zip(heaps, queries):
                if len(q):
                    tree.search(q, w[q], root[q], heap, top)
        found = [(i, -d, s) for (i, _), heap in zip(items, heaps) for s, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)],
                                         ["item_id", "doc_id", "score"])
    return search


def _best(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` best rows of every item, first within groups of partitions."""
    order = [F.desc("score"), F.col("doc_id")]
    some = found.withColumn("salt", F.spark_partition_id() % SALTS)
    first = Window.partitionBy("item_id", "salt").orderBy(*order)
    some = some.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select(
        "item_id", "rank", F.when(F.col("doc_id") < 2 ** 63 - 1, F.col("doc_id")).alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents with a
    score above 0, ties by doc_id, a null doc_id last. Rows of one item_id make one item, a
    null id among them; repeated documents count and rank one by one; items
    and documents without a term, null or empty texts and empty tables give no
    rows; other columns are ignored. Items are searched in blocks of about
    ``block_terms`` terms by the hash of their id (an item is never cut): per block one pass
    that counts terms and one over the written vectors."""
    pairs = staged(item_terms(items), "item-terms")
    n_blocks = pairs.count() // block_terms + 1
    out = None
    for b in range(n_blocks):
        part = _best(_search_block(docs, pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b), top), top)
        part = staged(part, "search") if n_blocks > 1 else part
        out = part if out is None else out.unionByName(part)
    return out


def _search_block(docs: DataFrame, pairs: DataFrame, top: int) -> DataFrame:
    rows = pairs.collect()  # about block_terms of them
    vocabulary = sorted({r["term"] for r in rows})
    number = {t: i for i, t in enumerate(vocabulary)}
    by_item: dict[int | None, list[int]] = {}
    for r in rows:
        by_item.setdefault(r["item_id"], []).append(number[r["term"]])
    items = sorted(((i, sorted(t)) for i, t in by_item.items()), key=lambda e: (e[0] is None, e[0] or 0))
    vecs = staged(vectors(docs, vocabulary), "term-vectors")
    n_docs, total = vecs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r["t"]: r["df"] for r in vecs.select(F.explode("terms").alias("t")).groupBy("t").agg(
        F.count("*").alias("df")).collect()}  # one row per term of the block
    weights = [weight(n_docs, df.get(i, 0)) for i in range(len(vocabulary))]
    return vecs.where(F.size("terms") > 0).mapInArrow(
        _searcher(items, weights, n_docs, total, top), "item_id long, doc_id long, score long")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
lens AS (SELECT row_id, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
stats AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS total FROM lens),
tf AS (SELECT row_id, term, count(*)::BIGINT AS tf
       FROM (SELECT row_id, unnest(terms) AS term FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM benchmark WHERE text IS NOT NULL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
      FROM (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term), stats),
scored AS (
  SELECT item_id, row_id, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // total))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN lens USING (row_id), stats
  GROUP BY item_id, row_id, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank,
         doc_id, score FROM scored WHERE score > 0)
SELECT item_id::BIGINT AS item_id, rank, doc_id::BIGINT AS doc_id, score FROM ranked WHERE rank <= 10
"""


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
