"""Readers and sinks for the raw business tables.

Raw exports are CSV files with a header. Columns are found by name and given
declared types (no inference pass over the data), dates are parsed once at
ingestion, and intermediate tables go to Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import SCHEMAS


def csv_schema(name: str) -> T.StructType:
    """Types of a raw export: ids are strings, hours are doubles, the rest as
    in the business tables."""
    def kind(f: T.StructField) -> T.DataType:
        if f.name.endswith("_id"):
            return T.StringType()
        return T.DoubleType() if f.name == "resolution_time_hours" else f.dataType

    return T.StructType([T.StructField(f.name, kind(f), True) for f in SCHEMAS[name].fields])


def _raw_csv(spark: SparkSession, name: str, path: str) -> DataFrame:
    """The export's columns by their header names, as strings."""
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    missing = [f.name for f in SCHEMAS[name].fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{name}: the export at {path} has no column {', '.join(missing)}")
    return raw


def _parsed(f: T.StructField, date_format: str | None, timestamp_format: str | None):
    c = F.trim(F.col(f"`{f.name}`"))
    if isinstance(f.dataType, (T.DateType, T.TimestampNTZType)):
        fmt = date_format if isinstance(f.dataType, T.DateType) else timestamp_format
        stamp = F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)
        return stamp.cast(f.dataType)
    return F.col(f"`{f.name}`") if isinstance(f.dataType, T.StringType) else c.try_cast(f.dataType)


def read_csv_table(spark: SparkSession, name: str, path: str, date_format: str | None = None,
                   timestamp_format: str | None = None) -> DataFrame:
    """Read one raw business table from CSV: columns are found by header name,
    whatever their order; other columns are left out, missing ones raise. A cell
    that does not parse becomes NULL; ``corrupt_cells`` counts those."""
    schema = csv_schema(name)
    return _raw_csv(spark, name, path).select(
        *[_parsed(f, date_format, timestamp_format).alias(f.name) for f in schema.fields])


def corrupt_cells(spark: SparkSession, name: str, path: str, date_format: str | None = None,
                  timestamp_format: str | None = None) -> DataFrame:
    """(column, cells): how many filled cells of each column do not parse."""
    raw = _raw_csv(spark, name, path)
    fields = csv_schema(name).fields
    row = raw.agg(*[F.count_if((F.trim(F.col(f"`{f.name}`")) != "") &
                               _parsed(f, date_format, timestamp_format).isNull()).alias(f.name) for f in fields])
    return row.unpivot([], [f.name for f in fields], "column", "cells")


def read_csv_tables(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    return {name: read_csv_table(spark, name, p) for name, p in paths.items()}


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                fmt: str = "parquet") -> None:
    """Overwrite a table at ``path`` (Parquet by default, CSV with header optional)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def register_views(tables: dict[str, DataFrame]) -> None:
    """Expose frames to SQL under their business names (session scoped)."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def list_tables(spark: SparkSession) -> DataFrame:
    """Catalog listing, the equivalent of SHOW TABLES."""
    return spark.sql("SHOW TABLES")
