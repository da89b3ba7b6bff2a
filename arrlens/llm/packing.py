"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Pieces are dealt by hash into blocks of bounded size. Each block is evolved by
several islands (tasks): a solution is a set of bins, crossover injects whole
well-filled bins of one parent into the other, drops the bins that hold
duplicates and best-fits the displaced pieces. After an epoch each island's
elite solution migrates to the next island of its block. Before that, rounds of
plain best-fit keep what they fill (nearly) completely, and the poorly filled bins of
all blocks are dissolved and dealt again to fewer blocks: the islands work on what is left,
where bins can still be saved, and skip blocks that already meet the lower bound of bins.
"""

from __future__ import annotations

import bisect
import functools
import random
import string
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_and_text, staged, table

CAPACITY = 1024
END_ID = 2
BLOCK_PIECES = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 6
CACHE_BYTES = 240_000_000   # of a Python worker's chunk cache, estimated
ENTRY_BYTES = 200           # of a cached chunk beside its text and ids
SLICE_CHARS = 4_000_000     # of texts whose chunks are looked up together
_MARKS = "".join(c for c in string.punctuation if c != "'")
# white space that does not simply separate two words of one line or two lines
_ODD = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the
    others for the characters from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Chunks(dict):
    """Ids of chunks without closing marks, each with the space that stands before
    it (a chunk that starts with a newline has none). A word alone is one piece of
    the pre-tokenizer, so the merges are asked at once."""

    def __init__(self, tokenizer, max_bytes: int = CACHE_BYTES):
        super().__init__()
        # two generations: a full one becomes the old one, and what is used again moves on
        self.old, self.held, self.limit = {}, 0, max_bytes // 2
        self.tokenizer, self.model, self.letters = tokenizer, tokenizer.model, _byte_letters()
        self.marks = functools.lru_cache(maxsize=10_000)(self.encode)

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, text: str) -> bytes:
        if text.isascii():
            letters = text.replace(" ", self.letters[32])
        else:
            letters = text.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.word(" " + chunk) if chunk.isalpha() else self.new(chunk)
        self[chunk] = ids
        self.held += len(chunk) + len(ids) + ENTRY_BYTES
        return ids

    def age(self) -> None:
        if self.held > self.limit:
            self.old, self.held = dict(self), 0
            self.clear()

    def new(self, chunk: str) -> bytes:
        if chunk[:1] == "\n":
            return self.marks("\n") + self.word(chunk[1:]) if chunk[1:].isalpha() else self.encode(chunk)
        return self.encode(" " + chunk)

    def of(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk: of what ends in a letter or digit and of the marks after
        it, which the pre-tokenizer parts (an apostrophe may be of a contraction)."""
        self.age()
        marks = self.marks
        return [self[chunk] if bare is chunk or not bare[-1:].isalnum() else self[bare] + marks(chunk[len(bare):])
                for chunk, bare in zip(chunks, [c.rstrip(_MARKS) for c in chunks])]


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes. The byte-level
    BPE splits text before every single space and around every single newline.
    The distinct chunks of many texts are looked up once, in a bounded cache,
    and put together by their numbers. Any other white space, text beyond
    Latin-1 and text with a special token's string go through the tokenizer whole."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks = _Chunks(self.tokenizer, cache_bytes)

    def whole(self, text: str) -> bytes:
        return self.chunks.encode(text)

    def _is_plain(self, text: str) -> bool:
        if any(x in text for x in _ODD) or any(x in text for x in self.special):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None if t and self._is_plain(t) else self.whole(t) for t in texts]
        plain = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(plain, self._plain([texts[i] for i in plain]) if plain else []):
            out[i] = ids
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        parts = pc.split_pattern(pa.array([t.replace("\n", " \n") for t in texts], pa.large_string()), " ")
        bounds = parts.offsets.to_numpy()
        coded = parts.flatten().dictionary_encode()
        number = coded.indices.to_numpy().copy()
        chunks = coded.dictionary.to_pylist()
        # the first chunk of a text has no space before it
        number[bounds[:-1]] = np.arange(len(chunks), len(chunks) + len(texts))
        ids = self.chunks.of(chunks) + [self.whole(t.replace("\n", " ").split(" ", 1)[0]) for t in texts]
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        start = np.cumsum(n) - n
        own = n[number]
        ends = np.cumsum(own)
        # ids of all chunks in order: each chunk's run of places in ``flat``
        places = np.repeat(start[number] - (ends - own), own)
        places += np.arange(len(places))
        cuts = np.concatenate([[0], ends[bounds[1:] - 1]]).tolist()
        joined = flat[places].tobytes()
        return [joined[4 * a:4 * b] for a, b in zip(cuts, cuts[1:])]


@functools.lru_cache(maxsize=1)
def _encoder(path: str, cache_bytes: int) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path, cache_bytes)


def cut(ids: bytes, capacity: int) -> list[tuple[int, bytes]]:
    """(start, ids) of the pieces; only the first piece may be shorter than ``capacity``."""
    n = len(ids) // 4
    if n <= capacity:
        return [(0, ids)]
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(a, ids[4 * a:4 * b]) for a, b in zip(starts, [*starts[1:], n])]


def _slices(batch: pa.RecordBatch):
    """Parts of the batch with at least one text and else at most SLICE_CHARS characters."""
    begin, held = 0, 0
    for i, n in enumerate(pc.utf8_length(batch["text"]).to_pylist()):
        if i > begin and held + n > SLICE_CHARS:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _tokenise(path: str, capacity: int, cache_bytes: int, keep_cache: bool):
    def tokenise(batches):
        encoder = _encoder(path, cache_bytes) if keep_cache else Encoder(path, cache_bytes)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            for part in _slices(batch):
                rows = []
                for doc_id, ids in zip(part["doc_id"].to_pylist(), encoder.encode_all(part["text"].to_pylist())):
                    for k, (start, piece) in enumerate(cut(ids + end, capacity)):
                        rows.append((doc_id, k, start, len(piece) // 4, zlib.crc32(piece)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], t) for i, t in
                     enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])
    return tokenise


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, cache_bytes: int = CACHE_BYTES,
              keep_cache: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all documents, in one narrow
    pass. A worker's chunk cache holds about ``cache_bytes``; ``keep_cache`` lets the
    next task of the worker go on with it."""
    return id_and_text(docs).mapInArrow(_tokenise(path, capacity, cache_bytes, keep_cache),
                                        "doc_id long, piece int, start long, length long, ids_crc32 long")


# Bins of one block: lists of item numbers, with their free room.

class Bins:
    def __init__(self, lengths, capacity):
        self.lengths, self.capacity = lengths, capacity
        self.items: list[list[int]] = []
        self.room: list[tuple[int, int]] = []   # sorted (free, bin)

    def open(self, items: list[int]) -> None:
        free = self.capacity - sum(self.lengths[i] for i in items)
        bisect.insort(self.room, (free, len(self.items)))
        self.items.append(items)

    def best_fit(self, items) -> None:
        """Longest first, each into the fullest bin that still has room for it."""
        for i in sorted(items, key=lambda i: (-self.lengths[i], i)):
            n = self.lengths[i]
            at = bisect.bisect_left(self.room, (n, -1))
            if at == len(self.room):
                bisect.insort(self.room, (self.capacity - n, len(self.items)))
                self.items.append([i])
            else:
                free, b = self.room.pop(at)
                self.items[b].append(i)
                bisect.insort(self.room, (free - n, b))


def fitness(bins: list[list[int]], lengths, capacity: int) -> tuple[int, float]:
    """Fewer bins, then fuller ones (mean squared fill)."""
    return -len(bins), sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(a: list[list[int]], b: list[list[int]], lengths, capacity: int, rng: random.Random) -> list[list[int]]:
    """Bins of ``b``, the fuller the likelier, go whole into ``a``."""
    inject = [x for x in b if rng.random() < (sum(lengths[i] for i in x) / capacity) ** 8 * 0.5]
    taken = {i for x in inject for i in x}
    child = Bins(lengths, capacity)
    displaced = []
    for x in a:
        if taken.isdisjoint(x):
            child.open(x)
        else:
            displaced += [i for i in x if i not in taken]
    for x in inject:
        child.open(list(x))
    # the emptiest bins are dissolved too, so that their pieces can meet the displaced ones
    for free, n in child.room[-max(2, len(child.items) // 50):]:
        displaced += child.items[n]
        child.items[n] = []
    left = Bins(lengths, capacity)
    for x in refill([x for x in child.items if x], displaced, lengths, capacity, rng):
        left.open(x)
    left.best_fit(displaced)
    return left.items


def refill(bins: list[list[int]], displaced: list[int], lengths, capacity: int, rng: random.Random) -> list[list[int]]:
    """Each bin in random order gives up one or two of its pieces for one displaced
    piece, or one for two, where that fills it better; ``displaced`` then holds the
    pieces given up, which are smaller or fewer and easier to place."""
    out = [list(x) for x in bins]
    order = list(range(len(out)))
    rng.shuffle(order)
    loose = sorted((lengths[i], i) for i in displaced)
    for n in order:
        x = out[n]
        free = capacity - sum(lengths[i] for i in x)
        if not free or not loose:
            continue
        best = None  # (free room left, pieces out, pieces in)
        gives = [(i,) for i in x] + [(i, k) for a, i in enumerate(x) for k in x[a + 1:a + 9]]
        for give in gives[:40]:
            size = sum(lengths[i] for i in give)
            at = bisect.bisect_right(loose, (size + free, 1 << 62)) - 1
            if at >= 0 and loose[at][0] > size and (best is None or size + free - loose[at][0] < best[0]):
                best = (size + free - loose[at][0], give, (loose[at],))
            if len(give) == 1:  # two small ones for one; the larger from the middle of what fits
                for k in range(max(at - 8, 0), at + 1):
                    rest = size + free - loose[k][0]
                    other = bisect.bisect_right(loose, (rest, 1 << 62)) - 1
                    if other == k:
                        other -= 1
                    if other >= 0 and loose[k][0] + loose[other][0] > size and (
                            best is None or rest - loose[other][0] < best[0]):
                        best = (rest - loose[other][0], give, (loose[k], loose[other]))
            if best and not best[0]:
                break
        if best:
            _, give, take = best
            for i in give:
                x.remove(i)
                bisect.insort(loose, (lengths[i], i))
            for entry in take:
                loose.remove(entry)
                x.append(entry[1])
    displaced[:] = [i for _, i in loose]
    return out


def evolve(lengths: list[int], capacity: int, seeds: list[list[list[int]]], rng: random.Random,
           population: int = POPULATION, generations: int = GENERATIONS) -> list[list[int]]:
    """The best solution found; ends early at the lower bound of bins."""
    least = -(-sum(lengths) // capacity)
    pool = [s for s in seeds if s]
    start = Bins(lengths, capacity)
    start.best_fit(range(len(lengths)))
    pool.append(start.items)
    rank = lambda s: fitness(s, lengths, capacity)
    while len(pool) < population and len(min(pool, key=len)) > least:
        mixed = Bins(lengths, capacity)  # pieces in random order make other solutions to cross with
        order = list(range(len(lengths)))
        rng.shuffle(order)
        head = len(order) // 4
        for k in range(0, head, 64):
            mixed.best_fit(order[k:min(k + 64, head)])
        mixed.best_fit(order[head:])
        pool.append(mixed.items)
    for _ in range(generations):
        pool.sort(key=rank, reverse=True)
        if len(pool[0]) <= least:
            break
        a, b = pool[0], pool[rng.randrange(1, len(pool))] if len(pool) > 1 else pool[0]
        children = [crossover(a, b, lengths, capacity, rng), crossover(b, a, lengths, capacity, rng)]
        pool = sorted(pool + children, key=rank, reverse=True)[:population]
    return max(pool, key=rank)


def _island(capacity: int, seed: int):
    def run(key, tab):
        block, island = key[0].as_py(), key[1].as_py()
        tab = tab.sort_by([("length", "descending"), ("item", "ascending")])
        lengths, items = tab["length"].to_pylist(), tab["item"].to_pylist()
        seeds = []
        for name in ("own", "immigrant"):
            groups: dict[int, list[int]] = {}
            for i, b in enumerate(tab[name].to_pylist()):
                if b is not None:
                    groups.setdefault(b, []).append(i)
            if groups:
                seeds.append(list(groups.values()))
        bins = evolve(lengths, capacity, seeds, random.Random(f"{seed}-{block}-{island}"))
        return _solution(block, island, items, lengths, bins, capacity)
    return run


def _solution(block: int, island: int, items: list[int], lengths: list[int], bins: list[list[int]],
              capacity: int) -> pa.Table:
    where, fill = [0] * len(lengths), [0] * len(lengths)
    for n, b in enumerate(bins):
        total = sum(lengths[i] for i in b)
        for i in b:
            where[i], fill[i] = n, total
    count, squares = fitness(bins, lengths, capacity)
    m = len(lengths)
    return pa.table([pa.array([block] * m, pa.int64()), pa.array([island] * m, pa.int32()),
                     pa.array(items, pa.int64()), pa.array(lengths, pa.int64()), pa.array(where, pa.int32()),
                     pa.array(fill, pa.int64()), pa.array([-count] * m, pa.int32()),
                     pa.array([-(-sum(lengths) // capacity)] * m, pa.int32()), pa.array([squares] * m, pa.float64())],
                    ["block", "island", "item", "length", "bin", "fill", "bins", "least", "squares"])


_SOLUTION = "block long, island int, item long, length long, bin int, fill long, bins int, least int, squares double"


def _first_fit(capacity: int):
    def run(key, tab):
        tab = tab.sort_by([("length", "descending"), ("item", "ascending")])
        lengths = tab["length"].to_pylist()
        bins = Bins(lengths, capacity)
        bins.best_fit(range(len(lengths)))
        return _solution(key[0].as_py(), -1, tab["item"].to_pylist(), lengths, bins.items, capacity)
    return run


def solve(items: DataFrame, blocks: int, capacity: int, islands: int = ISLANDS, epochs: int = EPOCHS,
          seed: int = 1) -> DataFrame:
    """(block, item, length, bin, fill): the best-fit solution of the blocks where
    it meets the lower bound of bins, the best island's solution of the others.
    Without islands, the best-fit solution of all."""
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(blocks)))
    fitted = staged(dealt.groupBy("block").applyInArrow(_first_fit(capacity), _SOLUTION), "packing-fit")
    cols = ["block", "item", "length", "bin", "fill"]
    open_blocks = fitted.where("bins > least")
    if not islands or open_blocks.isEmpty():
        return fitted.select(*cols)
    start = open_blocks.select("block", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), "item",
                               "length", F.col("bin").alias("own"), F.lit(None).cast("int").alias("immigrant"))
    elite = None
    for epoch in range(epochs):
        if elite is not None:  # the elite of island i goes on there and on island i + 1
            own = elite.select("block", "island", "item", "length", F.col("bin").alias("own"))
            moved = elite.select("block", ((F.col("island") + 1) % islands).alias("island"), "item",
                                 F.col("bin").alias("immigrant"))
            start = own.join(moved, ["block", "island", "item"])
        elite = staged(start.groupBy("block", "island").applyInArrow(_island(capacity, seed * 100 + epoch), _SOLUTION),
                       "packing-elite")
    best = elite.groupBy("block").agg(F.max(F.struct(-F.col("bins"), "squares", -F.col("island"))).alias("b"))
    best = best.select("block", (-F.col("b")["col3"]).alias("island"))
    return fitted.where("bins <= least").select(*cols).unionByName(
        elite.join(best, ["block", "island"]).select(*cols))


def pack(pieces: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES, islands: int = ISLANDS,
         rounds: int = 3) -> DataFrame:
    """``pieces`` with the (round, block, bin) each one is packed into. Full pieces stand alone. Rounds of
    ``solve`` follow; in all but the last, by best-fit alone, a block keeps only its bins
    that are (nearly) full, and the rest is packed again among fewer blocks."""
    pieces = staged(pieces.withColumn("item", F.monotonically_increasing_id()), "packing-pieces")
    rest = pieces.where(F.col("length") < capacity).select("item", "length")
    done = pieces.where(F.col("length") >= capacity).select("item", F.lit(0).alias("round"), F.col("item").alias("block"),
                                                            F.lit(0).alias("bin"))
    blocks = None
    for r in range(1, rounds + 1):
        n = rest.count()
        if not n:
            break
        blocks = max(1, -(-n // block_pieces)) if blocks is None or n < block_pieces * blocks else blocks
        last = r == rounds or blocks == 1
        solved = solve(rest, blocks, capacity, islands if last else 0, seed=r)
        placed = solved if last else solved.where(F.col("fill") >= capacity - 2)
        done = done.unionByName(placed.select("item", F.lit(r).alias("round"), "block", "bin"))
        if last:
            break
        rest = solved.where(F.col("fill") < capacity - 2).select("item", "length")
    return pieces.join(done, "item")


def sequences(packed: DataFrame) -> DataFrame:
    """Number the sequences and give each piece its offset there."""
    place = Window.partitionBy("round", "block", "bin").orderBy(F.desc("length"), "item")
    # round and bin are small; a block number of round 0 is an item number
    number = F.when(F.col("round") == 0, F.col("block") * 2).otherwise(
        ((F.col("block") * 8 + F.col("round")) * 65536 + F.col("bin")) * 2 + 1)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"),
                         (F.sum("length").over(place) - F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY,
                   cache_bytes: int = CACHE_BYTES, keep_cache: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset. Null and empty texts are one piece holding the end id; repeated
    rows and rows with null ids are packed like any other (a row, not its id,
    is what is packed); an empty table gives no rows; other columns are
    ignored. ``path`` names the tokenizer's file."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.json")
    return sequences(pack(pieces_of(docs, path, capacity, cache_bytes, keep_cache), capacity))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
