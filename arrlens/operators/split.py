"""Stratified train/test split: exactly a fifth of every class, chosen by hash.

The order of the md5 of "<account_id>-<seed>" decides. The hash of the last
test row of a class is an order statistic, found by refining a histogram: count the
class' rows per next four hex digits, keep the digits that the wanted rank falls
into, and go on inside them. Each level is one partially aggregated count of at most
65,536 groups a class, so no task ever sorts or holds a class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLIT_SEED = 42
DIGITS = 4      # hex digits per level
LEVELS = 3      # 48 bits; rows that share them with the last test row join it


def split_key(id_col: str = "account_id") -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{SPLIT_SEED}")))


def wanted_sql(n: str) -> str:
    """A fifth of n rows, rounded half up."""
    return f"FLOOR((2 * {n} + 5) / 10)"


def stratified_cuts(labelled: DataFrame, label: str, id_col: str = "account_id") -> dict[int, str]:
    """Per class the last hash prefix that belongs to the test set ("" for
    none). Rows without a label or id are left out."""
    rows = labelled.select(F.col(label).cast("int").alias("c"), split_key(id_col).alias("k")).where(
        "c IS NOT NULL AND k IS NOT NULL")
    found: dict[int, tuple[str, int]] = {}
    for level in range(LEVELS):
        part = rows
        if level:
            inside = F.lit(False)
            for c, (prefix, _) in found.items():
                inside = inside | ((F.col("c") == c) & F.col("k").startswith(prefix))
            part = rows.where(inside)
        counts = part.groupBy("c", F.substring("k", level * DIGITS + 1, DIGITS).alias("d")).agg(
            F.count(F.lit(1)).alias("n"))
        upto = Window.partitionBy("c").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
        ranked = counts.withColumn("upto", F.sum("n").over(upto)).withColumn(
            "total", F.sum("n").over(Window.partitionBy("c")))
        if level:
            rank = F.element_at(F.create_map(*[F.lit(v) for c, (_, r) in found.items() for v in (c, r)]), F.col("c"))
        else:
            rank = F.expr(wanted_sql("total"))
        hit = ranked.withColumn("rank", rank.cast("long")).where("rank > upto - n AND rank <= upto")
        # one row per class
        found = {r["c"]: (found.get(r["c"], ("", 0))[0] + r["d"], r["rank"] - (r["upto"] - r["n"]))
                 for r in hit.collect()}
        if not found:
            break
    return {c: prefix for c, (prefix, _) in found.items()}


def in_test(cuts: dict[int, str], label: str, id_col: str = "account_id") -> Column:
    """Whether a row is in the test set of ``stratified_cuts``; false without label or id."""
    prefix = F.substring(split_key(id_col), 1, DIGITS * LEVELS)
    out = F.lit(False)
    for c, cut in cuts.items():
        out = F.when(F.col(label).cast("int") == c, prefix <= F.lit(cut)).otherwise(out)
    return F.coalesce(out, F.lit(False))
