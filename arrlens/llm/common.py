"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and read it back: lineage is
    cut and lost executors cost only the tasks that were running."""
    return materialize(df, f"llm-{name}")


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns every text operator reads: ``doc_id`` as long and
    ``text`` (null: empty). Any other column, whatever its name, is left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def in_slices(batches, rows: int = 256):
    """The batches in parts of few rows, so that a worker holds the Python values of one
    part at a time; what Arrow no longer needs goes back to the system at the end of the task."""
    import pyarrow as pa
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int,
                    max_rows: int) -> DataFrame:
    """(text, label) of the labelled documents outside the held-out fold, about
    ``max_rows`` of them at most, chosen by the hash of their id. Only the ids
    and labels of the sample, whose number ``max_rows`` bounds, are broadcast.
    Repeated rows count once; if ids with several texts still bring more rows,
    the hash of id and text chooses among them. The rows are staged."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
             .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) &
                    ~held_out(F.col("doc_id"), modulus, remainder))
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    n = known.count()
    if n > max_rows:
        share = int(2 ** 31 * max_rows / n)
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(2 ** 31)) < share)
    rows = id_and_text(docs).join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id", "text"])
    rows = staged(rows, f"{label}-sample")
    n = rows.count()
    if n > max_rows:
        share = int(2 ** 31 * max_rows / n)
        rows = rows.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("row")), F.lit(2 ** 31)) < share)
    return rows.select("text", "label")
