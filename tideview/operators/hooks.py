"""User hooks on the feed."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideview.sources.change import ROW_TYPES

# Columns a hook may set besides those of the change itself.
HOOK_COLUMNS = {"suppressed": "boolean", "topic": "string", "partition_string": "string"}


def with_hook(
    df: DataFrame,
    fn: Callable,
    types: Iterable[str] = ROW_TYPES,
    *,
    pandas: bool = False,
) -> DataFrame:
    """Run a hook over changes of the given types; other changes pass by it.

    ``fn`` maps a DataFrame of changes to one of the same columns, or, with ``pandas``, one
    pandas batch to another inside tasks. It sees the change columns and ``suppressed``,
    ``topic`` and ``partition_string``. Rows it marks as suppressed stay in the feed, so that
    progress moves past them, until ``drop_suppressed``.
    """
    for name, dtype in HOOK_COLUMNS.items():
        if name not in df.columns:
            default = F.lit(False) if dtype == "boolean" else F.lit(None).cast(dtype)
            df = df.withColumn(name, default)
    mine = F.col("type").isin(*types)
    seen, rest = df.filter(mine), df.filter(~mine)
    if pandas:
        out = seen.mapInPandas(_each_batch(fn), df.schema)
    else:
        out = fn(seen)
    missing = set(df.columns) - set(out.columns)
    if missing:
        raise ValueError(f"the hook dropped columns: {', '.join(sorted(missing))}")
    out = out.select(*[F.col(f"`{c}`").cast(df.schema[c].dataType).alias(c) for c in df.columns])
    return out.unionAll(rest)


def _each_batch(fn: Callable[[pd.DataFrame], pd.DataFrame]):
    def run(batches):
        for pdf in batches:
            yield fn(pdf)

    return run


def heartbeat_hook(df: DataFrame, fn: Callable) -> DataFrame:
    """A hook that sees heartbeats only."""
    return with_hook(df, fn, ("heartbeat",))


def ddl_hook(df: DataFrame, fn: Callable) -> DataFrame:
    """A hook that sees schema changes only."""
    from tideview.operators.schema_history import SCHEMA_EVENT_TYPES

    return with_hook(df, fn, SCHEMA_EVENT_TYPES)


def drop_suppressed(df: DataFrame) -> DataFrame:
    """Take suppressed rows out of the output; apply it after transactions are assembled."""
    return df.filter(~F.coalesce("suppressed", F.lit(False)))


def put(image: str, name: str, value) -> Column:
    """``data``, ``old`` or ``extra`` with one entry set."""
    v = value if isinstance(value, Column) else F.lit(value)
    kept = F.map_filter(F.coalesce(image, F.create_map().cast("map<string,string>")), lambda k, _: k != F.lit(name))
    return F.map_concat(kept, F.create_map(F.lit(name), v.cast("string")))
