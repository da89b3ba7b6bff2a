"""Periodic runs of words, found with a suffix automaton and link-cut access.

The words of a text are appended one by one to a suffix automaton. The suffix
links form a tree; its paths are kept in splay trees (preferred paths), and all
states of a path share one colour: the end of their last occurrence. Appending
word i accesses the path from the new state to the root. Each segment met on
the way has an old colour j and a longest suffix of L words: these L words end
at j and at i, and no longer suffix does. If i - j <= L, the L + i - j words up to i
have the period i - j: a square, whose left end is already final. It is extended to
the right once, and the whole path takes the colour i.

Because j is the last occurrence, i - j is the smallest period of the stretch.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MIN_LENGTH = 12   # words of the shortest run
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


def squares_to_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``words`` with length >= 2 * period,
    in order of discovery. Near-linear in the number of words; the state is some
    hundred bytes a word."""
    n = len(words)
    # suffix automaton; state 1 is the root, 0 stands for none
    size, link, step = [0, 0], [0, 0], [None, {}]
    # splay trees of the preferred paths: children, parent (of a root: the path's parent state), colour (at roots)
    left, right, up, colour = [0, 0], [0, 0], [0, 0], [-1, -1]
    last, runs, known = 1, [], {}

    def splay(x):
        while True:
            p = up[x]
            if not p:
                return
            if left[p] == x:
                on_left = True
            elif right[p] == x:
                on_left = False
            else:
                return
            g = up[p]
            if g and left[g] == p:
                side = -1
            elif g and right[g] == p:
                side = 1
            else:
                side = 0
                colour[x] = colour[p]  # x becomes the root
            if side and (side < 0) == on_left:  # zig-zig: the parent turns first
                gg = up[g]
                if gg and left[gg] == g:
                    left[gg] = x
                elif gg and right[gg] == g:
                    right[gg] = x
                else:
                    colour[x] = colour[g]
                if on_left:
                    b, c = right[p], right[x]
                    left[g], right[p], left[p], right[x] = b, g, c, p
                else:
                    b, c = left[p], left[x]
                    right[g], left[p], right[p], left[x] = b, g, c, p
                if b:
                    up[b] = g
                if c:
                    up[c] = p
                up[x], up[p], up[g] = gg, x, p
                continue
            if on_left:
                c = right[x]
                left[p], right[x] = c, p
            else:
                c = left[x]
                right[p], left[x] = c, p
            if c:
                up[c] = p
            up[p], up[x] = x, g
            if side < 0:
                left[g] = x
            elif side > 0:
                right[g] = x

    for i in range(n):
        w = words[i]
        cur = len(size)
        size.append(size[last] + 1)
        step.append({})
        left.append(0)
        right.append(0)
        colour.append(i)
        p = last
        while p and w not in step[p]:
            step[p][w] = cur
            p = link[p]
        if not p:
            to = 1
        else:
            q = step[p][w]
            if size[p] + 1 == size[q]:
                to = q
            else:
                to = cur + 1  # a copy of q that keeps its shorter words
                size.append(size[p] + 1)
                step.append(dict(step[q]))
                link.append(0)  # in cur's place; set below
                link.append(link[q])
                link[q] = to
                while p and step[p].get(w) == q:
                    step[p][w] = to
                    p = link[p]
                # it goes right above q on q's path and has q's colour
                splay(q)
                a = left[q]
                left[q] = to
                left.append(a)
                right.append(0)
                colour.append(-1)
                up.append(to)
                up.append(q)
                if a:
                    up[a] = to
        if to == cur + 1:
            link[cur] = to
        else:
            link.append(to)
            up.append(to)
        # access: one path from the new state to the root, coloured i
        u, below = to, cur
        while u:
            splay(u)
            j = colour[u]
            if j >= 0:
                d = i - j
                if d <= size[u] and known.get(d, -1) < i:
                    start, e = i - size[u] - d + 1, i + 1
                    while e < n and words[e] == words[e - d]:
                        e += 1
                    known[d] = e - 1
                    runs.append((start, e - start, d))
            if right[u]:
                colour[right[u]] = j  # the part below leaves this path
            right[u] = below
            up[below] = u
            below, u = u, up[u]
        colour[below] = i
        last = cur
    return runs


def repeated_stretches(words: list[bytes], min_length: int) -> list[tuple[int, int]]:
    """[start, end) of the stretches outside of which no run of ``min_length`` or
    more can lie: a run of length l >= max(min_length, 2q) repeats l - q >= min_length / 2
    words in a row at distance q, so all its words are in grams of that many
    words which occur twice. Equal hashes only add words."""
    n, k = len(words), max(min_length // 2, 1)
    if n < min_length:
        return []
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    gram = h[:n - k + 1].copy()
    for t in range(1, k):
        gram *= np.uint64(_MIX[t % len(_MIX)])
        gram += h[t:n - k + 1 + t]
    order = np.sort(gram)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return []
    at = np.searchsorted(twice, gram)
    hit = twice[np.minimum(at, len(twice) - 1)] == gram
    change = np.zeros(n + 1, np.int32)
    where = np.flatnonzero(hit)
    np.add.at(change, where, 1)
    np.add.at(change, where + k, -1)
    inside = np.concatenate([[0], (np.cumsum(change[:n]) > 0).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(inside))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2]) if b - a >= min_length]


def find_runs(words: list[bytes], min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of at least
    max(min_length, 2 * period) words, by start and period."""
    out = []
    for a, b in repeated_stretches(words, min_length):
        numbers: dict[bytes, int] = {}
        part = [numbers.setdefault(w, len(numbers)) for w in words[a:b]]
        out += [(a + s, length, q) for s, length, q in squares_to_runs(part) if length >= min_length]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def words_of(text: bytes | None) -> list[bytes]:
    """Maximal stretches without blanks, tabs and line ends (of the UTF-8 text)."""
    return (text or b"").split()


def plain_words(doc_id: int | None, text: bytes | None) -> list[bytes]:
    return words_of(text)


def periodic_tail(doc_id: int | None, text: bytes | None) -> list[bytes]:
    """The words of a document; in a tenth of the documents, chosen by the
    crc32 of the id, those from word a on repeat with a period. A null id
    changes nothing."""
    words = words_of(text)
    n = len(words)
    if n and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            unit = words[a:a + p]
            words = words[:a] + (unit * ((n - a) // p + 1))[:n - a]
    return words


def _bytes(column) -> list:
    return column.cast(pa.binary()).to_pylist()


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _run_rows(words_fn, min_length):
    def rows(batches):
        for batch in batches:
            found = [(doc_id, s, length, q)
                     for doc_id, text in zip(batch["doc_id"].to_pylist(), _bytes(batch["text"]))
                     for s, length, q in find_runs(words_fn(doc_id, text), min_length)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(4)],
                                             ["doc_id", "start", "length", "period"])
    return rows


def runs(docs: DataFrame, min_length: int = MIN_LENGTH, words=plain_words) -> DataFrame:
    """(doc_id, start, length, period) of every run of every whole text, in
    words from 0. A null text has no words; texts without runs give no rows; a
    null doc_id stays null; repeated rows give repeated results; an empty table
    gives no rows; other columns, whatever their names, are ignored."""
    return _rows(docs).mapInArrow(_run_rows(words, min_length),
                                  "doc_id long, start long, length long, period long")


def _collapser(min_length):
    def collapse(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = []
            for text in _bytes(batch.column(at)):
                words = words_of(text)
                found = find_runs(words, min_length)
                texts.append(b" ".join(kept_words(words, found)) if found else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.binary()).cast(pa.string()))
    return collapse


def collapse_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """The rows of ``docs``, all columns; a text with runs keeps each run's first
    period only, its words joined by one blank. Other texts, null and empty
    ones among them, stay as they are."""
    return docs.mapInArrow(_collapser(min_length), docs.schema)


SUMMARY = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
           "runs_sha256 string, collapsed_sha256 string")
_TYPES = [pa.int64()] * 6 + [pa.string()] * 2


def _summariser(words_fn, min_length):
    def summarise(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), _bytes(batch["text"])):
                words = words_fn(doc_id, text)
                found = find_runs(words, min_length)
                top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
                digest = hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest()
                kept = hashlib.sha256(b" ".join(kept_words(words, found))).hexdigest()
                rows.append((doc_id, len(found), *(top + (1000 * top[1] // top[2],) if top else (None,) * 4),
                             digest, kept))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)],
                                             [c.split()[0] for c in SUMMARY.split(", ")])
    return summarise


def summaries(docs: DataFrame, min_length: int = MIN_LENGTH, words=plain_words) -> DataFrame:
    """One row per document row: the number of runs, the longest run (ties: least
    start, then period; null without runs), and digests of the runs and of the
    words that stay. Null, empty, repeated and other rows as in ``runs``. One
    narrow pass; a task holds one text's words and the automaton of its longest repeated stretch."""
    return _rows(docs).mapInArrow(_summariser(words, min_length), SUMMARY)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(table(spark, sf_dir, "documents"), words=periodic_tail)
