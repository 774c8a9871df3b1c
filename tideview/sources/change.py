"""The change row: its schema, positions, and conversion between text values and typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideview.functions.crypt import base64_text

POSITION = "struct<file:string,file_seq:bigint,offset:bigint>"

_TEXT, _LONG, _TEXT_MAP = T.StringType(), T.LongType(), T.MapType(T.StringType(), T.StringType())

# Fixed names: the fields of a change row, in writing order.
CHANGE = (
    T.StructType()
    .add("database", _TEXT)
    .add("table", _TEXT)
    .add("type", _TEXT)
    .add("ts", _LONG)
    .add("ts_ms", _LONG)
    .add("xid", _LONG)
    .add("xoffset", _LONG)
    .add("commit", T.BooleanType())
    .add("position", T.StructType().add("file", _TEXT).add("file_seq", _LONG).add("offset", _LONG))
    .add("gtid", _TEXT)
    .add("server_id", _LONG)
    .add("thread_id", _LONG)
    .add("schema_id", _LONG)
    .add("query", _TEXT)
    .add("comment", _TEXT)
    .add("primary_key_columns", T.ArrayType(_TEXT))
    .add("data", _TEXT_MAP)
    .add("old", _TEXT_MAP)
    .add("extra", _TEXT_MAP)
)

ROW_TYPES = ("insert", "update", "delete")


def as_changes(df: DataFrame) -> DataFrame:
    """Complete a partial set of change columns with NULLs, in ``CHANGE`` order."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in CHANGE.fields
        ],
        *[F.col(f"`{c}`") for c in df.columns if c not in CHANGE.names],
    )


def position_struct(file: Column, offset: Column) -> Column:
    """(file, file_seq, offset); the sequence number is the numeric end of the file name."""
    seq = F.regexp_extract(file, r"(\d+)$", 1)
    return F.struct(
        file.alias("file"),
        seq.try_cast("bigint").alias("file_seq"),
        offset.cast("bigint").alias("offset"),
    ).cast(POSITION)


def parse_position(text: Column) -> Column:
    """``file:offset`` text to a position; NULL when it is not of that form."""
    file = F.regexp_extract(text, r"^(.*):(\d+)$", 1)
    offset = F.regexp_extract(text, r"^(.*):(\d+)$", 2).try_cast("bigint")
    return F.when(offset.isNotNull(), position_struct(file, offset))


POSITION_KEY = f"""struct(position.file_seq AS file_seq, position.offset AS offset,
    coalesce(ts_ms, ts * 1000) AS ts_ms, xid AS xid, coalesce(xoffset, {2**63 - 1}L) AS xoffset)"""


def position_key() -> Column:
    """Sort key of a change: file number, offset, then place in the transaction.

    The closing row of a transaction may carry no ``xoffset``; it sorts last. Feeds without
    positions fall back to time and transaction order.
    """
    return F.expr(POSITION_KEY)


def after_position(df: DataFrame, position: tuple[int, int] | None) -> DataFrame:
    """Rows newer than ``(file_seq, offset)``; rows without a position are kept."""
    if position is None:
        return df
    seq, offset = position
    p = F.col("position")
    newer = (p["file_seq"] > seq) | ((p["file_seq"] == seq) & (p["offset"] > offset))
    return df.filter(F.coalesce(newer, F.lit(True)))


def after_positions(df: DataFrame, positions: DataFrame) -> DataFrame:
    """Rows newer than the stored position of their server.

    ``positions``: (server_id, file_seq, offset), one row per server. Servers without a stored
    position keep all their rows.
    """
    stored = positions.select(
        F.col("server_id").alias("_server"), F.col("file_seq").alias("_seq"), F.col("offset").alias("_offset")
    )
    p = F.col("position")
    newer = (p["file_seq"] > F.col("_seq")) | ((p["file_seq"] == F.col("_seq")) & (p["offset"] > F.col("_offset")))
    return (
        df.join(stored, F.col("server_id") == F.col("_server"), "left")
        .filter(F.col("_server").isNull() | F.coalesce(newer, F.lit(True)))
        .drop("_server", "_seq", "_offset")
    )


# -- text <-> typed ------------------------------------------------------------------------


def text_of(col: Column, dtype: T.DataType) -> Column:
    """A typed value as change-row text."""
    if isinstance(dtype, T.StringType):
        return col
    if isinstance(dtype, T.BinaryType):
        return base64_text(col)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(col)
    return col.cast("string")


def typed_sql(text: str, dtype: T.DataType) -> str:
    """SQL for change-row text (itself SQL) as a typed value; NULL when it does not fit."""
    kind = dtype.simpleString()
    if isinstance(dtype, T.StringType):
        return text
    if isinstance(dtype, T.BinaryType):
        return f"unbase64({text})"
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return f"from_json({text}, '{kind}')"
    if isinstance(dtype, T.IntegralType):
        # booleans arrive as words, whole numbers may arrive as 1.0 or 1E3; 1.7 or yes do not fit
        whole = f"try_cast({text} AS decimal(38,0))"
        is_whole = f"try_cast({text} AS decimal(38,18)) = cast({whole} AS decimal(38,18))"
        return (
            f"coalesce(try_cast({text} AS {kind}), CASE WHEN {is_whole} THEN try_cast({whole} AS {kind}) END, "
            f"CASE lower({text}) WHEN 'true' THEN cast(1 AS {kind}) WHEN 'false' THEN cast(0 AS {kind}) END)"
        )
    return f"try_cast({text} AS {kind})"


def entry_sql(image: str, name: str) -> str:
    """SQL for one column's text in a map image."""
    return f"{image}[{literal(name)}]"


def literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted(name: str) -> str:
    """A SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def image_map(df_schema: T.StructType, prefix: str = "") -> Column:
    """All columns of a table as a ``map<string,string>`` image."""
    entries = []
    for f in df_schema.fields:
        entries += [F.lit(f.name), text_of(F.col(f"{prefix}`{f.name}`"), f.dataType)]
    return F.create_map(*entries)


def typed_changes(changes: DataFrame, table: str, schema: T.StructType, image: str = "data") -> DataFrame:
    """Changes of one table with the image's values as typed columns.

    Columns: ``_change`` (the whole change row as a struct) and one column per field of
    ``schema``, named as in the table. ``image`` is ``data`` (after) or ``before``, the image
    before an update: ``old`` laid over ``data``.
    """
    rows = changes.filter(F.col("table") == table)
    rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_change"))
    return rows.select("_change", *typed_image("_change", schema, image)).alias(table)


def typed_image(change: str, schema: T.StructType, image: str = "data") -> list[Column]:
    out = []
    for f in schema.fields:
        text = entry_sql(f"{change}.data", f.name)
        if image == "before":
            had = f"map_contains_key({change}.old, {literal(f.name)})"
            text = f"CASE WHEN {had} THEN {entry_sql(f'{change}.old', f.name)} ELSE {text} END"
        out.append(F.expr(f"{typed_sql(text, f.dataType)} AS {quoted(f.name)}"))
    return out


def unfit_sql(image: str, schema: T.StructType) -> str:
    """SQL for the values of an image that do not fit their column, as array<struct<column, type, value>>."""
    parts = []
    for f in schema.fields:
        if not isinstance(f.dataType, T.StringType):
            text = entry_sql(image, f.name)
            bad = f"{text} IS NOT NULL AND {typed_sql(text, f.dataType)} IS NULL"
            named = f"struct({literal(f.name)} AS column, {literal(f.dataType.simpleString())} AS type, {text} AS value)"
            parts.append(f"CASE WHEN {bad} THEN {named} END")
    if not parts:
        return "cast(array() AS array<struct<column:string,type:string,value:string>>)"
    return f"filter(array({', '.join(parts)}), x -> x IS NOT NULL)"


def unfit_values(changes: DataFrame, table: str, schema: T.StructType) -> DataFrame:
    """Row changes of a table that hold values which do not fit their column, as change columns and ``unfit``: array<struct<column,
    type, value>>. Such values are read as NULL."""
    rows = changes.filter((F.col("table") == table) & F.col("type").isin(*ROW_TYPES))
    return rows.withColumn("unfit", F.expr(unfit_sql("data", schema))).filter(F.size("unfit") > 0)
