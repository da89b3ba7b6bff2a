"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-case words joined by one space. A test item of m
characters may differ by k = floor(m * error_rate) edits; cut into k + 1
pieces, at least one piece must then occur unchanged. Exact piece hits come
from one Aho-Corasick automaton, and Myers' bit-parallel distance verifies the
window around each hit. Items under MIN_CHARS characters have no budget and must be
whole words of the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, staged, table

ERROR_RATE = 0.08
MIN_CHARS = 20              # normalised items shorter than this are searched without edits, as whole words
BLOCK_BYTES = 8_000_000     # item text that one automaton holds; more items make more blocks
WORD = re.compile(r"\w+")
# Scripts written without spaces: Thai to Myanmar, Khmer, kana and Han, with their extensions.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf"
                      "\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def normalise(text: str | None) -> str:
    return " ".join(WORD.findall((text or "").lower()))


def myers(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the best substring of ``text`` within ``budget`` edits
    of ``pattern``, the leftmost end among equals; None if there is none."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, dist, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            dist += 1
        elif mh & top:
            dist -= 1
        ph, mh = ph << 1 & full, mh << 1 & full  # row 0 is free: a match may start anywhere
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if dist <= budget and (best is None or dist < best[0]):
            best = (dist, j + 1)
    return best


@dataclass
class Items:
    """A block of test items: normalised texts, budgets and their pieces."""
    rows: list[tuple[int, str, int]]

    @classmethod
    def of(cls, rows, error_rate: float) -> "Items":
        out = [(i, t, int(len(t) * error_rate) if len(t) >= MIN_CHARS else 0)
               for i, t in ((i, normalise(t)) for i, t in rows) if t]
        return cls(sorted(set(out), key=lambda r: (r[0] is None, r[0] or 0, r[1])))

    def automaton(self) -> ahocorasick.Automaton | None:
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k) in enumerate(self.rows):
            cuts = [len(text) * p // (k + 1) for p in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(text[a:b], []).append((n, a))
        if not pieces:
            return None
        found = ahocorasick.Automaton()
        for piece, where in pieces.items():
            found.add_word(piece, (len(piece), where))
        found.make_automaton()
        return found


def at_word_edges(text: str, lo: int, hi: int) -> bool:
    """Whether text[lo:hi] cuts no word; scripts without spaces have no edges to keep."""
    return all(0 in (a, len(text) - a) or " " in text[a - 1:a + 1] or UNSPACED.search(text, a - 1, a + 1)
               for a in (lo, hi))


def matches(text: str, items: Items, found: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(item number, distance, end in the normalised text) of every item in
    ``text``, its best place each."""
    windows: dict[int, list[list[int]]] = {}
    short: dict[int, int] = {}
    for end, (size, where) in found.iter(text):
        for n, offset in where:
            _, item, k = items.rows[n]
            if len(item) < MIN_CHARS and k == 0:
                if n not in short and at_word_edges(text, end + 1 - size, end + 1):
                    short[n] = end + 1
                continue
            lo, hi = end + 1 - size - offset - k, end + 1 + len(item) - offset - size + k
            own = windows.setdefault(n, [])
            if own and own[-1][0] <= lo <= own[-1][1]:
                own[-1][1] = max(own[-1][1], hi)
            else:
                own.append([lo, hi])
    out = [(n, 0, end) for n, end in short.items()]
    for n, spans in windows.items():
        _, item, k = items.rows[n]
        exact = text.find(item)
        if exact >= 0:
            out.append((n, 0, exact + len(item)))
            continue
        best = None
        for lo, hi in spans:
            lo = max(lo, 0)
            got = myers(item, text[lo:hi], k)
            if got and (best is None or (got[0], lo + got[1]) < best):
                best = (got[0], lo + got[1])
        if best:
            out.append((n, *best))
    return sorted(out)


SCHEMA = "doc_id long, item_id long, item_chars int, budget int, distance int, match_end long"
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
_NAMES = ["doc_id", "item_id", "item_chars", "budget", "distance", "match_end"]


def _search(items: Items):
    def search(batches):
        found = items.automaton()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                for n, distance, end in matches(normalise(text), items, found) if found else ():
                    item_id, item, k = items.rows[n]
                    rows.append((doc_id, item_id, len(item), k, distance, end))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], _NAMES)
    return search


def _item_rows(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")


def block_count(benchmark: DataFrame, block_bytes: int) -> int:
    total = _item_rows(benchmark).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(total // block_bytes) + 1


def item_blocks(benchmark: DataFrame, error_rate: float, n: int):
    """The test items in ``n`` blocks: the only part that is sent to all tasks,
    so its size is bounded however many there are."""
    rows = _item_rows(benchmark)
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield Items.of([(r["item_id"], r["text"]) for r in part.collect()], error_rate)


def search(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, item_chars, budget, distance, match_end) for every
    document row and test item within the item's budget anywhere in the whole
    text; ``match_end`` counts characters of the normalised text. Items under
    20 normalised characters must occur unchanged as whole words. Null texts
    and items, items without a word and empty tables match nothing; null ids
    stay null; repeated rows give repeated results; other columns are ignored.
    One narrow pass over the documents per block."""
    texts = id_and_text(docs)
    return _by_block(benchmark, error_rate, block_bytes, lambda items: texts.mapInArrow(_search(items), SCHEMA))


def _by_block(benchmark: DataFrame, error_rate: float, block_bytes: int, run) -> DataFrame:
    """Union of ``run`` of all blocks. If there are several, each result is
    written before the next block is read: the driver holds one block."""
    n, out = block_count(benchmark, block_bytes), None
    for items in item_blocks(benchmark, error_rate, n):
        part = run(items)
        part = staged(part, "decontaminate") if n > 1 else part
        out = part if out is None else out.unionByName(part)
    return out


def _cleaner(items: Items):
    def clean(batches):
        found = items.automaton()
        for batch in batches:
            texts = batch["text"].to_pylist()
            yield batch.filter(pa.array([not (found and matches(normalise(t), items, found)) for t in texts],
                                        pa.bool_()))
    return clean


def _dirty(items: Items):
    def dirty(batches):
        found = items.automaton()
        for batch in batches:
            keys = [k for k, t in zip(batch["key"].to_pylist(), batch["text"].to_pylist())
                    if found and matches(normalise(t), items, found)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], ["dirty_text"])
    return dirty


def keep_clean(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item. One narrow
    pass for one block of items; with several, the hashes of the texts that
    hold an item are written block by block and their documents left out."""
    n = block_count(benchmark, block_bytes)
    if n == 1:
        return docs.mapInArrow(_cleaner(next(item_blocks(benchmark, error_rate, n))), docs.schema)
    key = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    keyed = docs.select(key.alias("key"), "text")
    dirty = _by_block(benchmark, error_rate, block_bytes,
                      lambda items: keyed.mapInArrow(_dirty(items), "dirty_text string").distinct())
    return docs.join(dirty, key == dirty["dirty_text"], "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
