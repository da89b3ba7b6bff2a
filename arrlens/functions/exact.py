"""Rounding and ratio helpers that give the same double in every SQL engine.

Spark rounds a double through its shortest decimal rendering, other engines
scale by 10^n in binary first, so ``ROUND(x, 1)`` can differ on near-ties.
Two portable forms are used instead, each written once as SQL text and used
both in Spark (``F.expr``) and in the oracle queries:

* ``ratio_round``: round(num * scale / den, digits) half away from zero for
  integer-valued num/den, computed in doubles with one division and a floor:
  exact while the scaled operands stay below 2**53, and beyond that no integer
  product can overflow (the result is a double either way).
* ``dround``: for general doubles, cast to DECIMAL with six guard digits
  (this absorbs binary noise identically in both engines), round in decimal,
  cast back to DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_round_sql(num: str, den: str, digits: int, scale: int = 1) -> str:
    m = scale * 10 ** digits
    n, d = f"({num})", f"({den})"
    x = f"((CAST({2 * m} AS DOUBLE) * ABS({n}) + ABS({d})) / (CAST(2 AS DOUBLE) * ABS({d})))"
    whole = f"(CASE WHEN {x} < 9e15 THEN CAST(FLOOR({x}) AS DOUBLE) ELSE {x} END)"  # larger doubles are whole
    return (f"(CASE WHEN {d} = 0 OR {d} IS NULL OR {n} IS NULL THEN CAST(NULL AS DOUBLE) "
            f"ELSE CAST(SIGN({n}) * SIGN({d}) * {whole} AS DOUBLE) / {10 ** digits} END)")


def ratio_round(num: str, den: str, digits: int, scale: int = 1) -> Column:
    return F.expr(ratio_round_sql(num, den, digits, scale))


def dround_sql(x: str, digits: int) -> str:
    guard = digits + 6
    return (f"CAST(ROUND(CAST(({x}) AS DECIMAL(38,{guard})), {digits}) AS DOUBLE)")


def dround(x: str, digits: int) -> Column:
    return F.expr(dround_sql(x, digits))


def scaled_sql(x: str, num: int, den: int) -> str:
    """x * num / den for an integer x: one exact product, one IEEE division."""
    return f"(CAST(({x}) * {num} AS DOUBLE) / {den})"


def scaled(x: str, num: int, den: int) -> Column:
    return F.expr(scaled_sql(x, num, den))


def dround_col(c: Column, digits: int) -> Column:
    """Column form of ``dround`` for expressions that are not plain SQL text."""
    from pyspark.sql.types import DecimalType
    return F.round(c.cast(DecimalType(38, digits + 6)), digits).cast("double")


def currency(c: Column) -> Column:
    """'$1,234' display string (whole dollars, thousands separators)."""
    return F.concat(F.lit("$"), F.format_number(c, 0))
