"""Homomorphic multiset fingerprints of documents (DataFrame functions only).

Each paragraph is hashed into a wide vector; a document's fingerprint is the
sum of its paragraphs' vectors, lane by lane modulo 2^32. The order of the
paragraphs does not matter, and a paragraph is inserted or deleted by adding
or subtracting its vector. Lanes come in levels: lanes of level l take part
in a paragraph's vector with probability 2^-l. Level 0 alone (1024 bits) makes
equality safe; how many lanes of two fingerprints agree tells how many
paragraphs the documents do not share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_and_text, table

LEVELS, WIDTH = 16, 32
LANES = LEVELS * WIDTH
MODULUS = 2 ** 32
MAX_BUCKETS = 4096


def paragraphs(text: Column) -> Column:
    """Lines of the text; trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, "\n"), lambda p: F.trim(p)), lambda p: p != "")


def key(paragraph: Column) -> Column:
    """128 bits that stand for a paragraph, hashed once."""
    return F.struct(F.xxhash64(paragraph).alias("a"), F.xxhash64(F.lit("arrlens"), paragraph).alias("b"))


def vector(k: Column) -> Column:
    """LANES numbers below MODULUS from a paragraph's key."""
    hashes = F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda j: F.xxhash64(k["a"], k["b"], j))
    masks = F.lit([2 ** (i // WIDTH) - 1 for i in range(LANES)]).cast("array<bigint>")
    return F.zip_with(hashes, masks, lambda h, m: F.when(h.bitwiseAND(m) == 0, F.shiftrightunsigned(h, 32))
                      .otherwise(F.lit(0).cast("long")))


def fingerprint(text: Column) -> Column:
    """Struct of ``lanes`` (long array) and ``n`` (number of paragraphs)."""
    masks = F.lit([2 ** (i // WIDTH) - 1 for i in range(LANES)]).cast("array<bigint>")

    def entry(k: Column, mask: Column, j: Column) -> Column:
        h = F.xxhash64(k["a"], k["b"], j)
        return F.when(h.bitwiseAND(mask) == 0, F.shiftrightunsigned(h, 32)).otherwise(F.lit(0).cast("long"))

    def total(ps: Column) -> Column:  # lane by lane: the sum of the vectors' entries
        return F.transform(masks, lambda mask, j: F.aggregate(
            ps, F.lit(0).cast("long"), lambda acc, k: acc + entry(k, mask, j)) % MODULUS)

    # an array of one, so that the text is split and hashed once and not for every lane
    whole = F.transform(F.array(F.transform(paragraphs(text), key)), lambda ps: F.struct(
        total(ps).alias("lanes"), F.size(ps).cast("long").alias("n")))
    return F.get(whole, F.lit(0))


def insert(fp: Column, paragraph: Column) -> Column:
    return F.struct(F.zip_with(fp["lanes"], vector(key(F.trim(paragraph))), lambda x, y: (x + y) % MODULUS).alias("lanes"),
                    (fp["n"] + 1).alias("n"))


def delete(fp: Column, paragraph: Column) -> Column:
    return F.struct(F.zip_with(fp["lanes"], vector(key(F.trim(paragraph))), lambda x, y: (x - y + MODULUS) % MODULUS)
                    .alias("lanes"), (fp["n"] - 1).alias("n"))


def expected_equal(d: float) -> float:
    """Lanes expected to agree when d paragraphs differ."""
    return sum(WIDTH * (1 - 2.0 ** -lv) ** d for lv in range(LEVELS))


def unshared(equal: int) -> int:
    """The number of unshared paragraphs, up to 100,000, for which the expected
    number of agreeing lanes is nearest to ``equal``."""
    lo, hi = 0, 100_000
    while hi - lo > 1:
        d = (lo + hi) // 2
        lo, hi = (d, hi) if expected_equal(d) > equal else (lo, d)
    return min((lo, hi), key=lambda d: abs(expected_equal(d) - equal))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else 1 - d / (paragraphs of both), at least 0,
    with the number d of unshared paragraphs estimated from the equal lanes."""
    equal = F.size(F.filter(F.zip_with(a["lanes"], b["lanes"], lambda x, y: x == y), lambda e: e))
    d = F.element_at(F.lit([unshared(i) for i in range(LANES + 1)]), equal + 1)
    both = F.greatest(a["n"] + b["n"], F.lit(1))
    return F.when(a["lanes"] == b["lanes"], F.when(a["n"] == b["n"], 1.0).otherwise(0.0)).otherwise(
        F.greatest(F.lit(0.0), 1 - F.greatest(d, F.lit(1)) / both))


def digest(fp: Column) -> Column:
    return F.sha2(F.concat_ws(",", fp["n"].cast("string"), F.transform(fp["lanes"], lambda x: x.cast("string"))), 256)


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, text and fingerprint of each document with those of the next one
    by (doc_id, text), null ids first; the last one's next is the first. Documents are dealt into id
    ranges by literal bounds (approximate quantiles; any bounds give the same
    rows), each range is ordered on its own, and the first document of a range
    also goes, as a guest, to the end of the range before it."""
    spark = docs.sparkSession
    rows = id_and_text(docs)
    n = buckets or min(MAX_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n).alias("q")).first()["q"] \
        if n > 1 else None
    cuts = sorted(set(cuts or []))
    at = F.coalesce(F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c <= F.col("doc_id"))), F.lit(0)) \
        if cuts else F.lit(0)
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(at))
    # one row per range: the ids only decide, texts break ties
    first = rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("f"))
    ring = Window.orderBy("bucket")  # one row per range
    first = first.select("f", F.lag("bucket").over(ring).alias("before"),
                         F.max("bucket").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
                         .alias("last"))
    guests = first.select("f.doc_id", "f.text", F.coalesce("before", "last").alias("bucket"), F.lit(1).alias("guest"))
    # dealt and ordered first, so that only texts are shuffled and sorted
    dealt = rows.withColumn("guest", F.lit(0)).unionByName(guests).repartition("bucket")
    dealt = dealt.sortWithinPartitions("bucket", "guest", "doc_id", "text").withColumn("own", fingerprint(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("guest", "doc_id", "text")
    dealt = dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("next", F.lead("own").over(order))
    return dealt.where("guest = 0").select("doc_id", "text", "own", "next_text", "next")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document row: fingerprints of the text and of its edited
    text (the last floor(n/2) code points replaced by the first as many, or
    all, of the next document), and both likenesses. Null text counts as
    empty; null ids come first in the order; equal rows follow each other; a
    single document is its own next; an empty table gives no rows; other
    columns are ignored."""
    half = F.floor(F.length("text") / 2).cast("int")
    rows = with_next(docs).withColumn(
        "edited", F.concat(F.left(F.col("text"), F.length("text") - half), F.left(F.col("next_text"), half)))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       "own", fingerprint(F.col("edited")).alias("changed"), "next")
    return rows.select("doc_id", "n_chars", "edited_sha256", digest(F.col("own")).alias("fingerprint"),
                       digest(F.col("changed")).alias("edited_fingerprint"),
                       likeness(F.col("own"), F.col("changed")).alias("near_edited"),
                       likeness(F.col("own"), F.col("next")).alias("near_next"),
                       F.col("own.n").alias("n_paragraphs"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
