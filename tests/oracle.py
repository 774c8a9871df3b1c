"""Comparing a Spark result with DuckDB's on the same tables."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize() if v else 0)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    rel = con.sql(sql)
    if sorted(rel.columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(rel.columns)}"
    kinds = {"bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"}}
    kinds |= {"timestamp_ntz": {"TIMESTAMP"}, "date": {"DATE"}}
    theirs = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for name, kind in spark_df.dtypes:
        if theirs[name] not in kinds.get(kind, {theirs[name]}):
            return f"type of {name}: {kind} vs {theirs[name]}"
    a = rows_of(spark_df.columns, spark_df.collect())
    b = rows_of(rel.columns, rel.fetchall())
    if a == b:
        return None
    return f"{sum(a.values())} vs {sum(b.values())} rows; ours only {list((a - b).items())[:3]}; theirs only {list((b - a).items())[:3]}"
