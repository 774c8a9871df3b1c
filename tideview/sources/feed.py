"""Reading and writing change feeds as JSON lines."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideview.functions import crypt
from tideview.functions.names import to_camel_case
from tideview.sources.change import CHANGE, as_changes, parse_position

# Fixed names: text fields of a JSON change row besides data and old.
_SCALARS = (
    "database", "table", "type", "ts", "ts_ms", "xid", "xoffset", "commit", "position", "gtid",
    "server_id", "thread_id", "schema_id", "query", "comment",
)
_NEEDS_ESCAPE = r"""[\x00-\x1f"\\]"""
# Fixed names: fields a row must have, in the order they are checked.
_REQUIRED = ("type", "database", "table", "ts", "data")
# Fixed names: an extra attribute must not take one of these.
PROTECTED_NAMES = frozenset(
    [
        "commit", "data", "database", "gtid", "old", "position", "primary_key", "primary_key_columns", "query",
        "server_id", "table", "thread_id", "ts", "xid", "type", "_uuid", "comment",
    ]
)


def read_changes(
    spark: SparkSession,
    path: str,
    *,
    streaming: bool = False,
    key: str | None = None,
    nested: str = "text",
    options: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Read JSON lines under ``path`` as (changes, rejects).

    Both frames share one scan definition; rejects are rows with (value, reason).
    ``options`` go to the reader, for example ``maxFilesPerTrigger`` for back-pressure.
    """
    reader = spark.readStream if streaming else spark.read
    return parse_changes(reader.options(**(options or {})).text(path), key=key, nested=nested)


def parse_changes(
    lines: DataFrame, *, key: str | None = None, nested: str = "text", carry: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """Parse a ``value`` column of JSON text into (changes, rejects).

    Values keep their text form, decimals to 38 digits. ``nested`` says what becomes of
    values that are objects or arrays: ``text`` keeps their JSON text (json and set columns),
    ``skip`` leaves them out of the images. ``carry`` names input columns to keep.
    """
    return split_parsed(parse_lines(lines, key=key, nested=nested, carry=carry), carry)


def split_parsed(parsed: DataFrame, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(changes, rejects) from the rows of ``parse_lines``."""
    changes = as_changes(parsed.filter(F.col("reason").isNull()).select("row.*", *carry))
    return changes, parsed.filter(F.col("reason").isNotNull()).select("value", "reason", *carry)


def parse_lines(
    lines: DataFrame, *, key: str | None = None, nested: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per line: (row, reason, value, <carry>). ``reason`` and ``value``, the text
    itself, are given only for lines that are rejected."""
    if nested not in ("text", "skip"):
        raise ValueError("nested must be text or skip")
    fields = [T.StructField(n, T.StringType()) for n in _SCALARS]
    fields += [T.StructField(n, T.VariantType()) for n in ("data", "old")]
    fields += [
        T.StructField("primary_key_columns", T.ArrayType(T.StringType())),
        T.StructField("encrypted", T.StructType.fromDDL("iv string, bytes string")),
        T.StructField("_broken", T.StringType()),
    ]
    how = {"columnNameOfCorruptRecord": "_broken"}
    df = _once(lines, F.col("value"), "value", carry)
    df = _once(df, F.from_json("value", T.StructType(fields), how), "j", ("value", *carry))
    if key is not None:
        # decrypted fields are laid over the row's own
        opened = crypt.decrypt_text(F.col("j.encrypted.bytes"), F.col("j.encrypted.iv"), key)
        hidden = F.when(F.col("j.encrypted").isNotNull(), F.from_json(opened, T.StructType(fields), how))
        df = _once(df, hidden, "h", ("value", "j", *carry))
        merged = [
            F.when(F.col("h").isNotNull(), F.coalesce(f"h.{f.name}", f"j.{f.name}")).otherwise(F.col(f"j.{f.name}")).alias(f.name)
            for f in fields
        ]
        df = df.select("value", *carry, F.struct(*merged).alias("j"))

    known = [*_SCALARS, "data", "old", "primary_key_columns", "encrypted", "_broken"]
    j = {n: F.col(f"j.{n}") for n in known}
    images = F.struct(_image(j["data"], nested).alias("data"), _image(j["old"], nested).alias("old"))
    df = _once(df, images, "images", ("value", "j", *carry))
    data, old = F.col("images.data"), F.col("images.old")
    reason = F.when(j["_broken"].isNotNull() | F.col("j").isNull(), F.lit("broken JSON"))
    for n in _REQUIRED:
        missing = j[n].isNull() | (F.is_variant_null(j[n]) if n == "data" else F.lit(False))
        reason = reason.when(missing, F.lit(f"{n} is required"))
    ts = j["ts"].try_cast("bigint")
    reason = (
        reason.when(ts.isNull(), F.lit("ts is not a number"))
        .when(data.isNull(), F.lit("data is not an object"))
        .when(j["old"].isNotNull() & ~F.is_variant_null(j["old"]) & old.isNull(), F.lit("old is not an object"))
    )
    row = {n: j[n] for n in _SCALARS}
    row["ts"] = ts
    row["ts_ms"] = F.coalesce(j["ts_ms"].try_cast("bigint"), ts * 1000)
    for n in ("xid", "xoffset", "server_id", "thread_id", "schema_id"):
        row[n] = j[n].try_cast("bigint")
    row["commit"] = F.coalesce(j["commit"].try_cast("boolean"), F.lit(False))
    row["position"] = parse_position(j["position"])
    row["primary_key_columns"] = j["primary_key_columns"]
    row["data"] = data
    row["old"] = F.coalesce(old, F.create_map().cast("map<string,string>"))
    row["extra"] = _extras(F.col("value"), known)
    out = F.struct(
        F.struct(*[v.cast(CHANGE[n].dataType).alias(n) for n, v in row.items()]).alias("row"), reason.alias("reason")
    )
    done = _once(df, out, "r", ("value", *carry))
    return done.select("r.row", "r.reason", F.when(F.col("r.reason").isNotNull(), F.col("value")).alias("value"), *carry)


def _once(df: DataFrame, col: Column, name: str, keep: tuple[str, ...]) -> DataFrame:
    """Add a costly column behind a generator of one row.

    The optimizer copies a column's expression into every filter and field that uses it; it
    does not do so across a generator, so JSON is parsed and text opened once per line.
    """
    return df.select(*keep, F.explode(F.array(col)).alias(name))


def _image(v: Column, nested: str) -> Column:
    if nested == "text":
        return F.try_variant_get(v, "$", "map<string,string>")
    plain = F.map_filter(
        F.try_variant_get(v, "$", "map<string,variant>"),
        lambda k, x: x.isNull() | ~F.schema_of_variant(x).rlike("^(OBJECT|ARRAY)"),
    )
    return F.transform_values(plain, lambda k, x: F.try_variant_get(x, "$", "string"))


def _extras(value: Column, known: list[str]) -> Column:
    """Top-level fields beyond the fixed ones are extra attributes. Only lines that have some are parsed again for them."""
    names = F.array(*[F.lit(n) for n in [*known, "primary_key", "_uuid"]])
    every = F.from_json(value, T.MapType(T.StringType(), T.StringType()))
    some = F.map_filter(every, lambda k, v: ~F.array_contains(names, k))
    none = F.size(F.array_except(F.json_object_keys(value), names)) == 0
    return F.when(none, F.create_map().cast("map<string,string>")).otherwise(some)


def with_extra(df: DataFrame, *, comment: str | None = None, **attributes) -> DataFrame:
    """Add extra attributes (values or Columns) to every row, and a comment if given."""
    taken = sorted(set(attributes) & PROTECTED_NAMES)
    if taken:
        raise ValueError(f"protected names cannot be used for extra attributes: {', '.join(taken)}")
    if attributes:
        entries = []
        for name, v in attributes.items():
            entries += [F.lit(name), (v if isinstance(v, Column) else F.lit(v)).cast("string")]
        added = F.create_map(*entries)
        names = F.array(*[F.lit(n) for n in attributes])
        kept = F.map_filter(
            F.coalesce("extra", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(names, k)
        )
        df = df.withColumn("extra", F.map_concat(kept, added))
    return df if comment is None else df.withColumn("comment", F.lit(comment))


# -- writing -------------------------------------------------------------------------------


@dataclass(frozen=True)
class OutputOptions:
    """Which parts of a change row are written. ``tables`` gives the schemas that decide
    which values are written as bare numbers, booleans or JSON; other values are text."""

    query: bool = True
    commit_info: bool = True
    xoffset: bool = False
    position: bool = False
    gtid: bool = False
    server_id: bool = False
    thread_id: bool = False
    schema_id: bool = False
    primary_keys: bool = False
    primary_key_columns: bool = False
    nulls: bool = True
    ts_ms: bool = False
    exclude_columns: tuple[str, ...] = ()
    naming: str = "none"
    encrypt: str = "none"  # none | data | all
    secret_key: str | None = None
    tables: dict[str, T.StructType] = field(default_factory=dict)


def to_change_json(df: DataFrame, options: OutputOptions | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Write changes as JSON text in a ``value`` column.

    The text is put together from fragments; a NULL fragment is a field that is left out.
    """
    from tideview.operators.filters import drop_columns

    o = options or OutputOptions()
    if o.encrypt not in ("none", "data", "all") or (o.encrypt != "none" and not o.secret_key):
        raise ValueError("encrypt must be none, data or all, with a secret key unless none")
    if o.naming not in ("none", "underscore_to_camelcase"):
        raise ValueError(f"unknown naming {o.naming}")
    name = to_camel_case if o.naming == "underscore_to_camelcase" else (lambda n: n)
    if o.exclude_columns:
        # key values are written before columns are dropped
        df = drop_columns(df.withColumn("_data", F.col("data")), ",".join(o.exclude_columns))
    else:
        df = df.withColumn("_data", F.col("data"))

    def text_field(col: str) -> Column:
        return _pair(name(col), json_text(F.col(f"`{col}`")))

    def number_field(col: str) -> Column:
        return _pair(name(col), F.col(f"`{col}`").cast("string"))

    bare = bare_columns(o.tables)
    pos = F.col("position")
    parts = [text_field("database"), text_field("table")]
    if o.query:
        parts.append(text_field("query"))
    parts += [text_field("type"), number_field("ts")]
    if o.ts_ms:
        parts.append(number_field("ts_ms"))
    if o.commit_info:
        parts.append(number_field("xid"))
        if o.xoffset:
            parts.append(F.when(~F.coalesce("commit", F.lit(False)), number_field("xoffset")))
        parts.append(F.when(F.col("commit"), _pair(name("commit"), F.lit("true"))))
    if o.position:
        parts.append(_pair(name("position"), json_text(F.concat(pos["file"], F.lit(":"), pos["offset"].cast("string")))))
    if o.gtid:
        parts.append(text_field("gtid"))
    for n, on in (("server_id", o.server_id), ("thread_id", o.thread_id), ("schema_id", o.schema_id)):
        if on:
            parts.append(number_field(n))
    parts.append(_pair("comment", json_text(F.col("comment"))))
    extra = _entries(F.col("extra"), lambda e: json_text(e["value"]), True, lambda k: k)
    parts.append(F.when(F.length(extra) > 0, extra))
    if o.primary_keys:
        values = F.transform(
            "primary_key_columns",
            lambda k: F.coalesce(_render(F.col("_data")[k], F.col("table"), k, bare), F.lit("null")),
        )
        parts.append(_pair(name("primary_key"), F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))))
    if o.primary_key_columns:
        parts.append(_pair(name("primary_key_columns"), F.to_json("primary_key_columns")))

    rename = camel_key if o.naming == "underscore_to_camelcase" else (lambda k: k)

    def image(col: str) -> Column:
        body = _entries(F.col(col), lambda e: _render(e["value"], F.col("table"), e["key"], bare), o.nulls, rename)
        return _pair(name(col), F.concat(F.lit("{"), body, F.lit("}")))

    images = [
        F.coalesce(image("data"), F.lit(f'"{name("data")}":{{}}')),
        F.when(F.coalesce(F.size("old"), F.lit(0)) > 0, image("old")),
    ]
    if o.encrypt == "data":
        # each row's images go into one sealed object
        hidden = F.concat(F.lit("{"), F.concat_ws(",", *images), F.lit("}"))
        images = [_pair("encrypted", crypt.encrypted_object(hidden, o.secret_key))]
    whole = F.concat(F.lit("{"), F.concat_ws(",", *parts, *images), F.lit("}"))
    if o.encrypt == "all":
        whole = F.concat(F.lit('{"encrypted":'), crypt.encrypted_object(whole, o.secret_key), F.lit("}"))
    return df.select(*carry, whole.alias("value"))


def bare_columns(tables: dict[str, T.StructType]) -> Column | None:
    """``table.column`` names whose text is valid JSON as it stands."""
    names = [
        f"{t}.{f.name}"
        for t, schema in tables.items()
        for f in schema.fields
        if isinstance(f.dataType, (T.NumericType, T.BooleanType, T.ArrayType, T.MapType, T.StructType))
        or f.metadata.get("json")
    ]
    return F.array(*[F.lit(n) for n in names]) if names else None


def json_text(col: Column) -> Column:
    """A string as a quoted JSON string; NULL stays NULL.

    Only text with a quote, a backslash or a control character needs the JSON writer.
    """
    inside = F.to_json(F.array(col))
    escaped = F.substring(inside, F.lit(2), F.length(inside) - 2)
    return F.when(col.rlike(_NEEDS_ESCAPE), escaped).otherwise(F.concat(F.lit('"'), col, F.lit('"')))


def camel_key(k: Column) -> Column:
    from tideview.functions.names import camel_case

    return camel_case(k)


def _render(value: Column, table: Column, key: Column, bare: Column | None) -> Column:
    if bare is None:
        return json_text(value)
    # NaN and infinities have no bare JSON form
    is_bare = F.array_contains(bare, F.concat(table, F.lit("."), key)) & ~value.isin("NaN", "Infinity", "-Infinity")
    return F.when(is_bare, value).otherwise(json_text(value))


def _pair(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'"{name}":'), value)


def _entries(m: Column, render, nulls: bool, rename) -> Column:
    kept = m if nulls else F.map_filter(m, lambda k, v: v.isNotNull())
    pairs = F.transform(
        F.map_entries(kept),
        lambda e: F.concat(json_text(rename(e["key"])), F.lit(":"), F.coalesce(render(e), F.lit("null"))),
    )
    return F.array_join(pairs, ",")


def write_changes(
    df: DataFrame, path: str, options: OutputOptions | None = None, mode: str = "append", *, by_file: bool = False
) -> None:
    """Write changes as JSON lines; ``by_file`` makes a folder for each log file, in which places are found fast."""
    if not by_file:
        to_change_json(df, options).write.mode(mode).text(path)
        return
    lines = to_change_json(df.withColumn("file_seq", F.col("position.file_seq")), options, carry=("file_seq",))
    lines.write.mode(mode).partitionBy("file_seq").text(path)


def parse_schema_events(lines: DataFrame) -> DataFrame:
    """Schema events among JSON lines, with the columns of one, and ts, sql and old."""
    from tideview.operators.schema_history import COLUMN_DEF, SCHEMA_EVENT_TYPES

    fields = "type string, database string, `table` string, charset string, ts bigint, sql string, position string"
    table = f"struct<database:string,`table`:string,charset:string,columns:array<{COLUMN_DEF}>>"
    mine = lines.filter(F.get_json_object("value", "$.type").isin(*SCHEMA_EVENT_TYPES))
    j = mine.select(F.from_json("value", f"{fields}, def {table}, old {table}").alias("j")).select("j.*")
    return j.select(
        parse_position(F.col("position")).alias("position"),
        "type",
        "database",
        "table",
        F.col("def.database").alias("new_database"),
        F.col("def.table").alias("new_table"),
        F.coalesce("charset", "def.charset").alias("charset"),
        F.col("def.columns").alias("def"),
        F.col("old.columns").alias("old"),
        "ts",
        "sql",
    )
