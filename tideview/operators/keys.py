"""Row keys, identities, dead letters and output partitioning of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideview.sources.feed import _render, bare_columns, json_text


def row_key(df: DataFrame, fmt: str = "hash", tables: dict[str, T.StructType] | None = None) -> DataFrame:
    """Add ``row_key``: the change's key as JSON.

    ``hash``: ``{"database":..,"table":..,"pk.<col>":..}``, with a random ``_uuid`` when the
    table has no key. ``array``: ``[database, table, [{col: value}, ..]]``.
    """
    bare = bare_columns(tables or {})
    pairs = F.transform(
        _pk(),
        lambda k: F.concat(
            json_text(F.concat(F.lit("pk." if fmt == "hash" else ""), F.lower(k))), F.lit(":"), _value(k, bare)
        ),
    )
    names = [json_text(F.col("database")), json_text(F.col("table"))]
    if fmt == "hash":
        fresh = F.concat(F.lit('"_uuid":"'), F.uuid(), F.lit('"'))
        ids = F.when(F.size(_pk()) == 0, fresh).otherwise(F.array_join(pairs, ","))
        key = F.concat(F.lit('{"database":'), names[0], F.lit(',"table":'), names[1], F.lit(","), ids, F.lit("}"))
    elif fmt == "array":
        objects = F.transform(pairs, lambda p: F.concat(F.lit("{"), p, F.lit("}")))
        key = F.concat(F.lit("["), names[0], F.lit(","), names[1], F.lit(",["), F.array_join(objects, ","), F.lit("]]"))
    else:
        raise ValueError("fmt must be hash or array")
    return df.withColumn("row_key", key)


def row_identity(df: DataFrame) -> DataFrame:
    """Add ``row_identity``: the key values joined into one short text, for partitioning."""
    return df.withColumn("row_identity", identity())


def identity() -> Column:
    joined = F.array_join(F.transform(_pk(), lambda k: F.col("data")[k]), "")
    return (
        F.when(F.size(_pk()) == 0, F.concat("database", "table"))
        .when(F.length(joined) == 0, F.lit("None"))
        .otherwise(joined)
    )


def dead_letters(df: DataFrame, reason: str | Column, tables: dict[str, T.StructType] | None = None) -> DataFrame:
    """Skeleton rows for changes that could not be delivered: names, type, reason, key values."""
    bare = bare_columns(tables or {})
    why = reason if isinstance(reason, Column) else F.lit(reason)
    pairs = F.transform(_pk(), lambda k: F.concat(json_text(k), F.lit(":"), _value(k, bare)))
    return df.select(
        F.concat(
            F.lit('{"database":'), json_text(F.col("database")), F.lit(',"table":'), json_text(F.col("table")),
            F.lit(',"type":'), json_text(F.col("type")), F.lit(',"reason":'), json_text(why),
            F.lit(',"data":{'), F.array_join(pairs, ","), F.lit("}}"),
        ).alias("value")
    )


# Fixed names: what changes can be partitioned by.
PARTITION_BY = ("database", "table", "primary_key", "transaction_id", "thread_id", "column", "random")
FALLBACKS = ("database", "table", "primary_key", "transaction_id")


def partition_key(by: str = "database", columns: list[str] | None = None, fallback: str | None = None) -> Column:
    """The text a change is partitioned by. ``column`` joins the values of ``columns`` found in
    the row and uses ``fallback`` when none of them has a value."""
    if by not in PARTITION_BY:
        raise ValueError(f"partition by one of {', '.join(PARTITION_BY)}")
    if by == "column":
        if not columns:
            raise ValueError("partitioning by column needs the columns")
        if fallback not in FALLBACKS:
            raise ValueError(f"partitioning by column needs a fallback, one of {', '.join(FALLBACKS)}")
        joined = F.concat(*[F.coalesce(F.col("data")[c], F.lit("")) for c in columns])
        return F.when(F.length(joined) > 0, joined).otherwise(partition_key(fallback))
    return {
        "database": lambda: F.col("database"),
        "table": lambda: F.col("table"),
        "primary_key": identity,
        "transaction_id": lambda: F.col("xid").cast("string"),
        "thread_id": lambda: F.col("thread_id").cast("string"),
        "random": F.uuid,
    }[by]()


def partition_changes(
    df: DataFrame,
    by: str = "database",
    columns: list[str] | None = None,
    fallback: str | None = None,
    n: int | None = None,
) -> DataFrame:
    """Add ``partition_key`` and, when ``n`` is given, ``partition`` (0..n-1) for the writer.

    The partition number is a column, so a writer can use it as the target partition without
    one task having to hold a whole partition of a few hot keys.
    """
    out = df.withColumn("partition_key", partition_key(by, columns, fallback))
    if n is not None:
        out = out.withColumn("partition", F.pmod(F.xxhash64("partition_key"), F.lit(n).cast("bigint")))
    return out


def _pk() -> Column:
    return F.coalesce("primary_key_columns", F.array().cast("array<string>"))


def _value(k: Column, bare: Column | None) -> Column:
    return F.coalesce(_render(F.col("data")[k], F.col("table"), k, bare), F.lit("null"))
