"""Local stand-in for the driver's correctness gate.

Runs a Spark query and its DuckDB oracle on the same Parquet tables and
compares row count, column names and the multiset of row values.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET enable_progress_bar = false")
    for t in ["region", "nation", "customer", "orders", "lineitem", "events"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(v) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, bool):
        return int(v)
    return v


def _key(row):
    return tuple((0, "") if x is None else (1, str(type(x).__name__), x) if not isinstance(x, (int, float))
                 else (1, "num", float(x)) for x in row)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
                 "timestamp": "TIMESTAMP WITH TIME ZONE"}


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    s_types = dict(spark_df.dtypes)
    s_cols = spark_df.columns
    s_rows = [tuple(_norm(r[c]) for c in s_cols) for r in spark_df.collect()]
    cur = con.execute(sql)
    d_cols = [d[0] for d in cur.description]
    d_rows = [tuple(_norm(v) for v in r) for r in cur.fetchall()]
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={s_cols} duck={d_cols}"
    d_types = {d[0]: str(d[1]) for d in cur.description}
    bad_types = {c: (t, d_types[c]) for c, t in s_types.items()
                 if SPARK_TO_DUCK.get(t, t) != d_types[c]}
    if bad_types:
        return False, f"types differ: {bad_types}"
    order = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    d_index = [d_cols.index(s_cols[i]) for i in order]
    s_sorted = sorted((tuple(r[i] for i in order) for r in s_rows), key=_key)
    d_sorted = sorted((tuple(r[i] for i in d_index) for r in d_rows), key=_key)
    if len(s_sorted) != len(d_sorted):
        return False, f"row count spark={len(s_sorted)} duck={len(d_sorted)}"
    bad = [(a, b) for a, b in zip(s_sorted, d_sorted) if a != b]
    if bad:
        names = [s_cols[i] for i in order]
        a, b = bad[0]
        diff = {n: (x, y) for n, x, y in zip(names, a, b) if x != y}
        return False, f"{len(bad)} rows differ, first: {diff}"
    return True, f"{len(s_sorted)} rows"
