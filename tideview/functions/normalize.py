"""Values of a source database brought to Spark types, column by column.

Every conversion is one native expression chosen by the declared type, so a table is
normalised in a single projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideview.functions.crypt import base64_text

ZERO_DATE = "0000-00-00"
ZERO_DATETIME = "0000-00-00 00:00:00"
# The raw value that stands for a zero date.
ZERO_RAW = -(2**63)

# Bits of the integer types.
INT_BITS = {"tinyint": 8, "smallint": 16, "mediumint": 24, "int": 32}

# Names of declared types that mean another type.
TYPE_ALIASES = {
    "character": "char",
    "nchar": "char",
    "nvarchar": "varchar",
    "varying": "varchar",
    "bool": "tinyint",
    "boolean": "tinyint",
    "int1": "tinyint",
    "int2": "smallint",
    "int3": "mediumint",
    "middleint": "mediumint",
    "int4": "int",
    "integer": "int",
    "int8": "bigint",
    "serial": "bigint",
    "float4": "float",
    "real": "double",
    "float8": "double",
    "numeric": "decimal",
    "fixed": "decimal",
    "long": "mediumtext",
}
# Character types under the BYTE attribute.
BYTE_TYPES = {
    "char": "binary",
    "character": "binary",
    "varchar": "varbinary",
    "varying": "varbinary",
    "tinytext": "tinyblob",
    "text": "blob",
    "mediumtext": "mediumblob",
    "longtext": "longblob",
    "long": "mediumblob",
}
# Types named after LONG.
LONG_TYPES = {"varchar": "mediumtext", "varbinary": "mediumblob", "binary": "mediumtext"}
# Spark type of each declared type.
SPARK_TYPES = {
    "tinyint": "bigint",
    "smallint": "bigint",
    "mediumint": "bigint",
    "int": "bigint",
    "bigint": "bigint",
    "tinytext": "string",
    "text": "string",
    "mediumtext": "string",
    "longtext": "string",
    "varchar": "string",
    "char": "string",
    "tinyblob": "binary",
    "blob": "binary",
    "mediumblob": "binary",
    "longblob": "binary",
    "binary": "binary",
    "varbinary": "binary",
    "geometry": "binary",
    "geometrycollection": "binary",
    "linestring": "binary",
    "multilinestring": "binary",
    "multipoint": "binary",
    "multipolygon": "binary",
    "polygon": "binary",
    "point": "binary",
    "float": "float",
    "double": "double",
    "decimal": "decimal",
    "date": "date",
    "datetime": "timestamp_ntz",
    "timestamp": "timestamp_ntz",
    "time": "string",
    "year": "int",
    "enum": "string",
    "set": "array<string>",
    "bit": "decimal(20,0)",
    "json": "string",
}
# Java charset of each declared charset.
CHARSETS = {
    "utf8": "UTF-8",
    "utf8mb3": "UTF-8",
    "utf8mb4": "UTF-8",
    "latin1": "windows-1252",
    "ascii": "windows-1252",
    "ucs2": "UTF-16",
    "utf16": "UTF-16",
    "ujis": "EUC-JP",
}
_BASIC_CHARSETS = ("UTF-8", "UTF-16")


@dataclass(frozen=True)
class SourceColumn:
    """One column as declared at the source. ``length`` is the fraction digits of time types,
    ``precision`` and ``scale`` those of decimals, ``labels`` those of enum and set."""

    name: str
    type: str
    signed: bool = True
    labels: tuple[str, ...] = ()
    charset: str | None = None
    length: int = 0
    precision: int = 38
    scale: int = 18


@dataclass(frozen=True)
class TableSchema:
    database: str
    table: str
    columns: tuple[SourceColumn, ...]


def plain_type(declared: str, length: int | None = None, *, long: bool = False, byte: bool = False) -> str:
    """The type a declared name stands for. ``length`` sizes text and blob."""
    t = declared.lower()
    if byte:
        if t not in BYTE_TYPES:
            raise ValueError(f"no byte form of type {declared}")
        t = BYTE_TYPES[t]
    if long and t in LONG_TYPES:
        return LONG_TYPES[t]
    if t in ("text", "blob") and length is not None:
        sized = ((2**8, "tiny"), (2**16, ""), (2**24, "medium"))
        return next((p for limit, p in sized if length < limit), "long") + t
    return TYPE_ALIASES.get(t, t)


def spark_type(declared: str, precision: int = 38, scale: int = 18) -> str:
    t = SPARK_TYPES.get(plain_type(declared))
    if t is None:
        raise ValueError(f"unsupported column type {declared}")
    return f"decimal({precision},{scale})" if t == "decimal" else t


def plain_types(columns: DataFrame, type_column: str = "type", length_column: str | None = None) -> DataFrame:
    """Add ``plain_type`` and ``spark_type`` to rows that describe columns."""
    name = F.lower(type_column)
    aliases = F.create_map(*[F.lit(x) for kv in TYPE_ALIASES.items() for x in kv])
    plain = F.coalesce(aliases[name], name)
    if length_column is not None:
        n = F.col(length_column)
        size = F.when(n < 2**8, "tiny").when(n < 2**16, "").when(n < 2**24, "medium").otherwise("long")
        plain = F.when(name.isin("text", "blob") & n.isNotNull(), F.concat(size, name)).otherwise(plain)
    kinds = F.create_map(*[F.lit(x) for kv in SPARK_TYPES.items() for x in kv])
    return columns.withColumn("plain_type", plain).withColumn("spark_type", kinds[F.col("plain_type")])


# -- single conversions --------------------------------------------------------------------


def unsigned(col: Column, bits: int) -> Column:
    """A signed raw value read as unsigned: below zero, add 2^bits."""
    if bits == 64:
        v = col.cast("decimal(20,0)")
        return F.when(v < 0, (v + F.lit(str(2**64)).cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(v)
    v = col.cast("bigint")
    return F.when(v < 0, v + 2**bits).otherwise(v)


def bit_value(col: Column) -> Column:
    """Little-endian bytes, up to eight, as a number."""
    digits = F.transform(F.sequence(F.lit(1), F.octet_length(col)), lambda i: F.hex(col.substr(i, F.lit(1))))
    text = F.array_join(F.reverse(digits), "")
    return F.when(F.octet_length(col) > 0, F.conv(text, 16, 10).try_cast("decimal(20,0)")).when(
        col.isNotNull(), F.lit(0).cast("decimal(20,0)")
    )


def decoded(col: Column, charset: str | None) -> Column:
    """Bytes to text. Charsets beyond the Unicode ones need ``spark.sql.legacy.javaCharsets``."""
    java = CHARSETS.get((charset or "utf8").lower())
    if java is None:
        raise ValueError(f"unsupported charset {charset}")
    return F.decode(col, java)


def needs_java_charsets(charset: str | None) -> bool:
    return CHARSETS.get((charset or "utf8").lower()) not in _BASIC_CHARSETS


def date_text(col: Column, dtype: T.DataType, zero_dates_as_null: bool) -> Column:
    """Dates as text: raw micros, text or dates in; zero dates stay text or become NULL."""
    zero = F.lit(None).cast("string") if zero_dates_as_null else F.lit(ZERO_DATE)
    if isinstance(dtype, T.StringType):
        return F.when(col == ZERO_DATE, zero).otherwise(col)
    if isinstance(dtype, T.LongType):
        return F.when(col == ZERO_RAW, zero).otherwise(F.date_format(_ntz(col), "yyyy-MM-dd"))
    return F.date_format(col, "yyyy-MM-dd")


def date_value(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.DateType):
        return col
    if isinstance(dtype, T.StringType):
        return F.when(col != ZERO_DATE, col.try_cast("date"))
    if isinstance(dtype, T.LongType):
        return F.when(col != ZERO_RAW, _ntz(col).cast("date"))
    return col.cast("date")


def _ntz(micros: Column) -> Column:
    """Micros since 1970 as a timestamp without zone, whatever the session's zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = F.floor(micros / F.lit(1000000).cast("decimal(10,0)")).cast("bigint")
    rest = micros - seconds * 1000000
    return epoch + F.make_dt_interval(secs=(seconds.cast("decimal(18,6)") + rest.cast("decimal(18,6)") / 1000000).cast("decimal(18,6)"))


def datetime_value(col: Column, dtype: T.DataType, is_timestamp: bool) -> Column:
    """Date-times as timestamps without zone; zero values become NULL."""
    if isinstance(dtype, T.LongType):
        zero = (col == ZERO_RAW) | ((col == 0) if is_timestamp else F.lit(False))
        return F.when(~zero, _ntz(col))
    if isinstance(dtype, T.StringType):
        return F.when(~col.startswith(ZERO_DATE), col.try_cast("timestamp_ntz"))
    return col.cast("timestamp_ntz")


def datetime_text(
    col: Column, dtype: T.DataType, digits: int, *, is_timestamp: bool = False, zero_dates_as_null: bool = False
) -> Column:
    """Date-times as text with exactly ``digits`` fraction digits, cut and not rounded."""
    whole = F.date_format(datetime_value(col, dtype, is_timestamp), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    out = F.substring(whole, 1, 19 if digits == 0 else 20 + digits)
    if zero_dates_as_null:
        return out
    zero = ZERO_DATETIME + ("." + "0" * digits if digits else "")
    is_zero = F.lit(False)
    if isinstance(dtype, T.LongType):
        is_zero = (col == ZERO_RAW) | ((col == 0) if is_timestamp else F.lit(False))
    elif isinstance(dtype, T.StringType):
        is_zero = col.startswith(ZERO_DATE)
    return F.when(is_zero, F.lit(zero)).otherwise(out)


def time_text(col: Column, digits: int) -> Column:
    """Raw micros as ``[-]HH:mm:ss[.f]``; sign kept, hours may exceed 24, fraction cut."""
    micros = F.abs(col.cast("bigint"))
    seconds = F.floor(micros / F.lit(1000000).cast("decimal(10,0)")).cast("bigint")
    clock = F.format_string(
        "%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60,
    )
    out = F.concat(F.when(col < 0, "-").otherwise(""), clock)
    if digits == 0:
        return out
    fraction = F.substring(F.lpad((micros % 1000000).cast("string"), 6, "0"), 1, digits)
    return F.concat(out, F.lit("."), fraction)


def enum_label(col: Column, dtype: T.DataType, labels: tuple[str, ...]) -> Column:
    """Enum index from 1 to its label, 0 to NULL; text passes. Other indexes give NULL."""
    if isinstance(dtype, T.StringType):
        return col
    i = col.cast("int")
    return F.when((i > 0) & (i <= len(labels)), F.try_element_at(F.array(*[F.lit(x) for x in labels]), i))


def set_labels(col: Column, dtype: T.DataType, labels: tuple[str, ...]) -> Column:
    """Set bit mask to the list of its labels, in label order; ``a,b`` text is split."""
    if isinstance(dtype, T.StringType):
        return F.split(col, ",")
    mask = col.cast("bigint")
    members = F.array(
        *[F.when(F.shiftright(mask, i).bitwiseAND(F.lit(1).cast("bigint")) == 1, F.lit(x)) for i, x in enumerate(labels)]
    )
    return F.when(mask.isNotNull(), F.filter(members, lambda x: x.isNotNull()))


def year_value(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.year(col)
    return col.try_cast("int") if isinstance(dtype, T.StringType) else col.cast("int")


# -- whole tables --------------------------------------------------------------------------


def convert(col: Column, dtype: T.DataType, c: SourceColumn) -> Column:
    """One column's conversion, chosen by its declared type and by how it arrives."""
    t = plain_type(c.type)
    target = spark_type(t, c.precision, c.scale)
    if t in INT_BITS or t == "bigint":
        raw = col.cast("int") if isinstance(dtype, T.BooleanType) else col
        raw = raw.try_cast("decimal(20,0)" if t == "bigint" and not c.signed else "bigint")
        return raw if c.signed else unsigned(raw, INT_BITS.get(t, 64))
    if t in ("enum", "set"):
        return (enum_label if t == "enum" else set_labels)(col, dtype, c.labels)
    if t == "bit":
        return bit_value(col) if isinstance(dtype, T.BinaryType) else col.cast("bigint").try_cast("decimal(20,0)")
    if t == "date":
        return date_value(col, dtype)
    if t in ("datetime", "timestamp"):
        v = datetime_value(col, dtype, t == "timestamp")
        return v if c.length >= 6 else _cut(v, c.length)
    if t == "time":
        return time_text(col, c.length) if isinstance(dtype, T.IntegralType) else col.cast("string")
    if t == "year":
        return year_value(col, dtype)
    if t == "json":
        return F.when(F.try_parse_json(col).isNotNull(), col)
    if SPARK_TYPES[t] == "string":
        return decoded(col, c.charset) if isinstance(dtype, T.BinaryType) else col.cast("string")
    if t.startswith(("geometry", "multi", "line", "poly", "point")):
        # the first four bytes are the reference system's number, the rest is WKB
        return F.when(F.octet_length(col) > 4, col.substr(F.lit(5), F.octet_length(col)))
    if SPARK_TYPES[t] == "binary":
        return col.cast("binary")
    return col.try_cast(target)


def _cut(ts: Column, digits: int) -> Column:
    text = F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.substring(text, 1, 19 if digits == 0 else 20 + digits).try_cast("timestamp_ntz")


def normalize_columns(
    df: DataFrame, schema: TableSchema, *, zero_dates_as_null: bool = True, keep_bad: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Bring a raw table to Spark types: (converted rows, rejects).

    Rejects have one row (database, table, column, type, value) for each value that could not be
    converted; such a value is NULL in the result, and with ``keep_bad=False`` its row is left
    out. Zero dates are not rejects. ``zero_dates_as_null=False`` keeps dates and date-times as
    text, since Spark dates have no zero.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    by_name = {c.name: c for c in schema.columns}

    def out(name: str) -> Column:
        col = F.col(f"`{name}`")
        if name not in by_name:
            return col
        c = by_name[name]
        t = plain_type(c.type)
        if not zero_dates_as_null and t == "date":
            return date_text(col, types[name], False)
        if not zero_dates_as_null and t in ("datetime", "timestamp"):
            return datetime_text(col, types[name], c.length, is_timestamp=t == "timestamp")
        return convert(col, types[name], c)

    def failed(c: SourceColumn) -> Column:
        col, t = F.col(f"`{c.name}`"), plain_type(c.type)
        nothing = F.lit(False)
        if t == "enum" and not isinstance(types[c.name], T.StringType):
            nothing = col.cast("int") == 0
        elif t in ("date", "datetime", "timestamp"):
            if isinstance(types[c.name], T.LongType):
                nothing = (col == ZERO_RAW) | ((col == 0) if t == "timestamp" else F.lit(False))
            elif isinstance(types[c.name], T.StringType):
                nothing = col.startswith(ZERO_DATE)
        return col.isNotNull() & out(c.name).isNull() & ~nothing

    present = [c for c in schema.columns if c.name in types]
    report = F.array(
        *[
            F.when(
                failed(c),
                F.struct(
                    F.lit(schema.database).alias("database"),
                    F.lit(schema.table).alias("table"),
                    F.lit(c.name).alias("column"),
                    F.lit(c.type).alias("type"),
                    (base64_text(F.col(f"`{c.name}`")) if isinstance(types[c.name], T.BinaryType) else F.col(f"`{c.name}`").cast("string")).alias("value"),
                ),
            )
            for c in present
        ]
    )
    rejects = df.select(F.explode(F.filter(report, lambda r: r.isNotNull())).alias("r")).select("r.*")
    good = df
    if not keep_bad:
        bad = F.lit(False)
        for c in present:
            bad = bad | F.coalesce(failed(c), F.lit(False))
        good = df.filter(~bad)
    return good.select(*[out(n).alias(n) for n in df.columns]), rejects
