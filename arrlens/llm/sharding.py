"""Sharding over fixed virtual slots (DataFrame functions only).

The id's hash picks one of ``SLOTS`` virtual slots for good; a versioned map
says which shard holds a slot. Resharding edits the map and moves whole slots,
never single records. The law of the query is ``key``: id and shard count
decide, and one more shard takes slots only into itself.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import delete_on_exit, shared_dir
from .common import id_and_text, table

SLOTS = 4096
SUBSLOTS = 256      # a slot's rows are numbered in so many independent groups
SHARDS = 40
COPIES = 65_536      # rows that one element of a list of copies is expanded into


def virtual_slot(doc_id: Column, slots: int = SLOTS) -> Column:
    """From the md5 of the id as text; a null id goes to slot 0."""
    h = F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return F.coalesce(h % slots, F.lit(0)).cast("int")


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1 of the slot-to-shard map: slots dealt out in turn."""
    if shards < 1 or shards > slots:
        raise ValueError(f"between 1 and {slots} shards are possible")
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("virtual_slot"),
                                     (F.col("id") % shards).cast("int").alias("shard"))


def save_map(slot_map: DataFrame, path: str) -> None:
    """Store a map under ``path`` with its version; a stored version is never overwritten."""
    version = slot_map.agg(F.max("version")).first()[0]
    slot_map.select("virtual_slot", "shard").coalesce(1).write.parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The stored map of this version, or else the latest one."""
    stored = spark.read.parquet(path)
    version = version or stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version).select("version", "virtual_slot", "shard")


def grow(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version with shard number ``shards`` added: every old shard
    gives its highest slots, so that the new one holds its even share."""
    by_shard = Window.partitionBy("shard")
    held = slot_map.withColumn("rank", F.row_number().over(by_shard.orderBy(F.desc("virtual_slot")))) \
        .withColumn("held", F.count("*").over(by_shard))
    # floor(held * (s + 1) / (s + 1)^2) slots each; the shard number spreads the remainders
    give = F.floor((F.col("held") + F.col("shard") % (shards + 1)) / (shards + 1))
    return held.select((F.col("version") + 1).alias("version"), "virtual_slot",
                       F.when(F.col("rank") <= give, shards).otherwise(F.col("shard")).cast("int").alias("shard"))


def slot_bytes(sized: DataFrame) -> DataFrame:
    """Rows and bytes of every slot (added up in the tasks before the shuffle)."""
    return sized.groupBy("virtual_slot").agg(F.sum("size").alias("slot_bytes"), F.count("*").alias("slot_rows"))


def rebalance(slot_map: DataFrame, bytes_of: DataFrame, shards: int, tolerance: float = 0.05) -> DataFrame:
    """The next version of the map by bytes: each shard over the mean keeps its
    slots from the smallest up to (1 + tolerance) x mean, and the rest of its
    slots fill the room of the others, largest slot first in shard order. Works
    on the ``SLOTS`` map rows only, whatever the corpus' size."""
    sized = slot_map.join(bytes_of, "virtual_slot", "left").withColumn(
        "b", F.coalesce("slot_bytes", F.lit(0)))
    mean = sized.agg((F.sum("b") / shards).alias("mean"))
    sized = sized.crossJoin(F.broadcast(mean))  # one row
    up = Window.partitionBy("shard").orderBy("b", "virtual_slot")
    sized = sized.withColumn("upto", F.sum("b").over(up))
    stays = sized.where(F.col("upto") <= (1 + tolerance) * F.col("mean"))
    moves = sized.where(F.col("upto") > (1 + tolerance) * F.col("mean"))
    room = (slot_map.select("shard").distinct().join(stays.groupBy("shard").agg(F.max("upto").alias("used")), "shard", "left")
            .crossJoin(F.broadcast(mean))
            .withColumn("room", F.greatest(F.col("mean") - F.coalesce("used", F.lit(0)), F.lit(0.0))))
    order = Window.orderBy("shard")   # one row per shard
    room = room.withColumn("hi", F.sum("room").over(order)).withColumn("lo", F.col("hi") - F.col("room"))
    queue = Window.orderBy(F.desc("b"), "virtual_slot")     # at most SLOTS rows
    moves = moves.withColumn("at", F.sum("b").over(queue) - F.col("b") / 2)
    total = room.agg(F.max("hi").alias("all"))
    moves = moves.crossJoin(F.broadcast(total)).withColumn("at", F.least(F.col("at"), F.col("all") - 1e-6))
    placed = moves.join(F.broadcast(room.select(F.col("shard").alias("to"), "lo", "hi")),
                        (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")), "left")
    return stays.select((F.col("version") + 1).alias("version"), "virtual_slot", "shard").unionByName(
        placed.select((F.col("version") + 1).alias("version"), "virtual_slot",
                      F.coalesce("to", "shard").cast("int").alias("shard")))


def sized_rows(docs: DataFrame) -> DataFrame:
    """Per row its size (UTF-8 bytes of the text plus 16), text crc32 and slot."""
    rows = id_and_text(docs)
    return rows.select("doc_id", (F.octet_length("text") + 16).cast("long").alias("size"),
                       F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
                       virtual_slot(F.col("doc_id")).alias("virtual_slot"))


def assign(docs: DataFrame, shards: int = SHARDS, slot_map: DataFrame | None = None,
           grown_map: DataFrame | None = None) -> DataFrame:
    """One row per document row with its shard, its place ``slot`` there
    (gapless from 0, ordered by virtual slot) and the shard it has with one
    more (``grown_shard``), by ``slot_map`` if it is given (its shards numbered
    below ``shards``), else by version 1, and by ``grown_map`` or else the next
    version. Null texts have no bytes; null ids share virtual slot 0; repeated
    rows are placed one after the other; an empty table gives no rows; other
    columns are ignored. Texts are never shuffled; equal rows are counted before
    the shuffle and written out again after it, the others are numbered in
    SLOTS x SUBSLOTS groups, so no task holds a whole shard or a hot id."""
    spark = docs.sparkSession
    old = first_map(spark, shards) if slot_map is None else slot_map
    new = (grow(old, shards) if grown_map is None else grown_map).select(
        "virtual_slot", F.col("shard").alias("grown_shard"))
    maps = F.broadcast(old.join(new, "virtual_slot"))  # SLOTS rows
    rows = sized_rows(docs).groupBy("doc_id", "size", "text_crc32", "virtual_slot").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("sub", (F.col("text_crc32") % SUBSLOTS).cast("int"))
    counts = rows.groupBy("virtual_slot", "sub").agg(
        F.sum("copies").alias("n"), F.sum(F.col("size") * F.col("copies")).alias("bytes"))
    # at most SLOTS x SUBSLOTS rows: the first place of each group in its shard
    order = Window.partitionBy("shard").orderBy("virtual_slot", "sub")
    first = counts.join(maps, "virtual_slot").withColumn("first", F.sum("n").over(order) - F.col("n"))
    first = first.withColumn("slot_bytes", F.sum("bytes").over(Window.partitionBy("virtual_slot")))
    place = Window.partitionBy("virtual_slot", "sub").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("before", F.sum("copies").over(place) - F.col("copies"))
    out = numbered.join(first.drop("n", "bytes"), ["virtual_slot", "sub"])
    # copies in parts, so that no list of them is long
    out = out.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    out = out.withColumn("copy", F.explode(F.sequence("part", F.least(F.col("part") + COPIES, "copies") - 1)))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("first") + F.col("before") + F.col("copy")).cast("long").alias("slot"), "grown_shard",
        "virtual_slot", "slot_bytes", "version")


def stored_versions(spark: SparkSession, path: str, shards: int) -> tuple[DataFrame, DataFrame]:
    """The map for ``shards`` shards and the next version with one more, both as
    stored under ``path``; what is not there yet is made from the version before
    it and stored first."""
    try:
        latest = spark.read.parquet(path).agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        save_map(first_map(spark, shards), path)
        latest = 1
    now = load_map(spark, path, latest)
    held = now.agg(F.countDistinct("shard")).first()[0]
    if held == shards + 1 and latest > 1:  # the edit was stored by an earlier call
        now, latest = load_map(spark, path, latest - 1), latest - 1
    elif held != shards:
        raise ValueError(f"the stored map has {held} shards, not {shards}")
    else:
        save_map(grow(now, shards), path)
    return now, load_map(spark, path, latest + 1)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "arrlens-tables", f"slot-maps-{uuid.uuid4().hex[:12]}")
    delete_on_exit(spark, path)
    now, grown = stored_versions(spark, path, SHARDS)
    return assign(table(spark, sf_dir, "documents"), SHARDS, now, grown)
