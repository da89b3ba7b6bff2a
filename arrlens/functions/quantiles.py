"""Exact quantiles without gathering an unbounded column in one task.

Spark's ``percentile``/``median`` aggregates are exact but merge a map of all
distinct values in a single final task for each group; ``percentile_approx``
is bounded but approximate. ``exact_quantiles`` has one path for all sizes and
takes no action on the driver:

1. count rows per distinct value (partial aggregation; a value held by a
   third of the rows is one row with a large count);
2. put every value into a bucket that only the value decides (its sign and
   logarithm, in steps of 2^(1/1024)), which keeps the values' order, and take
   running counts inside each bucket;
3. turn per-bucket totals into offsets (a window over a group's buckets) and
   join them back. As a bucket depends on nothing but the value, both sides
   agree however often Spark evaluates them;
4. keep the (at most two) values whose cumulative-count interval covers the
   target ranks floor(pos) and ceil(pos), pos = q * (n - 1), and interpolate
   linearly: lo + (pos - floor(pos)) * (hi - lo). ``median`` mode returns
   (lo + hi) / 2, the mean of the two middle values (pandas' median).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


STEPS = 1024            # buckets per power of two
ORIGIN = 1100 * STEPS   # above every double's exponent


def _bucket(x: Column) -> Column:
    """A whole number that never falls as ``x`` rises; infinities have buckets of
    their own beyond all others."""
    finite = F.floor(F.log2(F.abs(x)) * STEPS) + ORIGIN
    size = F.when(F.abs(x) == float("inf"), 4 * ORIGIN).otherwise(finite)
    return F.when(x == 0, 0).when(x > 0, size).otherwise(-size).cast("bigint")


def exact_quantiles(df: DataFrame, col: str | Column, qs: Sequence[float],
                    by: Sequence[str] = (), median: bool = False) -> DataFrame:
    """Rows (*by, q, value) for each group of ``by`` and each q in ``qs``. Nulls
    and NaN do not count; infinities do, as the least and greatest values."""
    by = list(by)
    x = (F.col(col) if isinstance(col, str) else col).cast("double")
    base = df.select(*by, x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    ranged = (base.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("c"))
              .withColumn("pid", _bucket(F.col("x"))))

    local = ranged.withColumn("cum_local", F.sum("c").over(
        Window.partitionBy("pid", *by).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    totals = ranged.groupBy("pid", *by).agg(F.sum("c").alias("pc"))
    offsets = (totals
               .withColumn("offset", F.coalesce(F.sum("pc").over(
                   Window.partitionBy(*by).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)))
               .withColumn("n", F.sum("pc").over(Window.partitionBy(*by)))
               .select("pid", *by, "offset", "n"))
    ranked = (local.join(offsets, ["pid", *by])
              .withColumn("cum_hi", F.col("offset") + F.col("cum_local"))
              .withColumn("cum_lo", F.col("cum_hi") - F.col("c")))

    targets = F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q")
    with_q = ranked.select(*by, "x", "cum_lo", "cum_hi", "n", targets)
    pos = F.col("q") * (F.col("n") - 1)
    r_lo, r_hi = F.floor(pos), F.ceil(pos)
    covers_lo = (F.col("cum_lo") <= r_lo) & (r_lo < F.col("cum_hi"))
    covers_hi = (F.col("cum_lo") <= r_hi) & (r_hi < F.col("cum_hi"))
    picked = (with_q.where(covers_lo | covers_hi)
              .groupBy(*by, "q")
              .agg(F.max(F.when(covers_lo, F.col("x"))).alias("lo"),
                   F.max(F.when(covers_hi, F.col("x"))).alias("hi"),
                   F.max(pos - r_lo).alias("d")))
    if median:
        value = (F.col("lo") + F.col("hi")) / 2
    else:
        value = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(
            F.col("lo") + F.col("d") * (F.col("hi") - F.col("lo")))
    return picked.select(*by, "q", value.alias("value"))


def exact_quantile_col(df: DataFrame, col: str | Column, q: float, median: bool = False) -> Column:
    """One quantile of a whole column as a scalar subquery (evaluated once)."""
    return exact_quantiles(df, col, [q], median=median).select("value").scalar()


def exact_quantile_cols(df: DataFrame, col: str | Column, qs: Sequence[float]) -> list[Column]:
    """Several quantiles of one column, one pipeline, as scalar subqueries."""
    res = exact_quantiles(df, col, qs)
    st = res.select(F.map_from_entries(F.collect_list(F.struct("q", "value"))).alias("m")).scalar()
    return [st[F.lit(float(q))] for q in qs]
