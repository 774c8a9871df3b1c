"""Schemas as data: snapshots, differences, deltas, versions and their lookup by position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideview.operators.filters import Rule, feed_filter, parse_rules
from tideview.operators.ordered import SLOT, last_known

# One row per column of a table definition.
COLUMN_DEF = (
    "struct<name:string,position:int,type:string,charset:string,signed:boolean,labels:array<string>,"
    "length:int,pk_position:int>"
)
SCHEMA_COLUMNS = (
    T.StructType()
    .add("database", T.StringType())
    .add("table", T.StringType())
    .add("name", T.StringType())
    .add("position", T.IntegerType())
    .add("type", T.StringType())
    .add("charset", T.StringType())
    .add("signed", T.BooleanType())
    .add("labels", T.ArrayType(T.StringType()))
    .add("length", T.IntegerType())
    .add("pk_position", T.IntegerType())
)
# Fixed names: kinds of schema events.
SCHEMA_EVENT_TYPES = (
    "table-create",
    "table-alter",
    "table-drop",
    "database-create",
    "database-alter",
    "database-drop",
)
# Columns of a schema event: position (as in a change row), type, database, table,
# new_database, new_table, charset and def (an array of COLUMN_DEF).


def schema_rows(
    spark: SparkSession, tables: dict[str, DataFrame], database: str, keys: dict[str, list[str]] | None = None
) -> DataFrame:
    """A schema snapshot of DataFrames, one row per column."""
    rows = []
    for t, df in tables.items():
        pk = (keys or {}).get(t, [])
        for i, f in enumerate(df.schema.fields):
            rows.append(
                (database, t, f.name, i, f.dataType.simpleString(), f.metadata.get("charset"), True,
                 f.metadata.get("labels"), f.metadata.get("length"), pk.index(f.name) if f.name in pk else None)
            )
    return spark.createDataFrame(rows, SCHEMA_COLUMNS)


def schema_rows_jdbc(spark: SparkSession, jdbc: dict, database: str) -> DataFrame:
    """The same snapshot from a database's ``information_schema``."""
    from tideview.sources.tables import read_table

    name = database.replace("'", "''")
    query = (
        "SELECT c.TABLE_SCHEMA, c.TABLE_NAME, c.COLUMN_NAME, c.ORDINAL_POSITION, c.DATA_TYPE, c.COLUMN_TYPE, "
        "c.CHARACTER_SET_NAME, c.DATETIME_PRECISION, k.ORDINAL_POSITION AS PK_POSITION "
        "FROM information_schema.COLUMNS c LEFT JOIN information_schema.KEY_COLUMN_USAGE k "
        "ON k.TABLE_SCHEMA = c.TABLE_SCHEMA AND k.TABLE_NAME = c.TABLE_NAME AND k.COLUMN_NAME = c.COLUMN_NAME "
        f"AND k.CONSTRAINT_NAME = 'PRIMARY' WHERE c.TABLE_SCHEMA = '{name}'"
    )
    raw = read_table(spark, {"jdbc": {**jdbc, "query": query}})
    labels = F.transform(
        F.regexp_extract_all("COLUMN_TYPE", F.lit("'((?:[^']|'')*)'")), lambda x: F.replace(x, F.lit("''"), F.lit("'"))
    )
    return raw.select(
        F.col("TABLE_SCHEMA").alias("database"),
        F.col("TABLE_NAME").alias("table"),
        F.col("COLUMN_NAME").alias("name"),
        (F.col("ORDINAL_POSITION") - 1).cast("int").alias("position"),
        F.col("DATA_TYPE").alias("type"),
        F.col("CHARACTER_SET_NAME").alias("charset"),
        (~F.col("COLUMN_TYPE").contains("unsigned")).alias("signed"),
        F.when(F.col("DATA_TYPE").isin("enum", "set"), labels).alias("labels"),
        F.col("DATETIME_PRECISION").cast("int").alias("length"),
        (F.col("PK_POSITION") - 1).cast("int").alias("pk_position"),
    )


# -- differences ---------------------------------------------------------------------------


def schema_diff(
    a: DataFrame,
    b: DataFrame,
    *,
    databases: tuple[DataFrame, DataFrame] | None = None,
    tables: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Differences of two snapshots: (database, table, column, difference, a_value, b_value).

    A table found on one side only is one row; otherwise each column gives a row per
    property that differs. Column names are compared without case, as the source does. ``databases`` are both sides'
    (database, charset): a database found on one side only is one row, without its tables. ``tables`` are both sides'
    (database, table, charset), for tables without columns and the charsets of tables.

    The sides are one set of tagged rows, brought together once by table; a table's columns are compared as arrays.
    """
    column = T.StructType([f for f in SCHEMA_COLUMNS.fields if f.name not in ("database", "table")])
    parts = []
    for side, columns, listed in (("a", a, tables and tables[0]), ("b", b, tables and tables[1])):
        tag, none = F.lit(side).alias("side"), F.lit(None).cast("string").alias("charset")
        parts.append(columns.select("database", "table", tag, none, F.struct(*column.names).cast(column).alias("col")))
        if listed is not None:
            parts.append(listed.select("database", "table", tag, F.col("charset"), F.lit(None).cast(column).alias("col")))
    on = lambda side: F.col("side") == side
    held = reduce(DataFrame.unionAll, parts).groupBy("database", "table").agg(
        *[F.collect_list(F.when(on(x), F.col("col"))).alias(f"{x}_cols") for x in "ab"],
        *[F.coalesce(F.max(on(x)), F.lit(False)).alias(f"in_{x}") for x in "ab"],
        *[F.max(F.when(on(x), F.col("charset"))).alias(f"{x}_charset") for x in "ab"],
    )
    out = []
    if databases is not None:
        both = [df.select("database", F.lit(x).alias("side"), "charset") for x, df in zip("ab", databases)]
        known = both[0].unionAll(both[1]).groupBy("database").agg(
            *[F.max(on(x)).alias(f"in_{x}") for x in "ab"], *[F.max(F.when(on(x), F.col("charset"))).alias(f"{x}_charset") for x in "ab"]
        )
        # small next to the columns: one row for each database
        lone = known.filter(~F.col("in_a") | ~F.col("in_b")).select(F.col("database").alias("_lone"))
        held = held.join(lone, F.col("database") == F.col("_lone"), "left_anti")
        found = F.array(_missing("database"), _differs("database charset", F.col("a_charset"), F.col("b_charset"), F.col("in_a") & F.col("in_b")))
        out.append(known.select("database", F.lit(None).cast("string").alias("table"), F.inline(F.filter(found, lambda x: x.isNotNull()))))
    found = F.concat(
        F.array(
            _missing("table"),
            _differs("primary key", _pk("a_cols"), _pk("b_cols"), F.col("in_a") & F.col("in_b")),
            _differs("table charset", F.col("a_charset"), F.col("b_charset"), F.col("in_a") & F.col("in_b")),
        ),
        F.when(F.col("in_a") & F.col("in_b"), _column_differences()).otherwise(F.array().cast(_DIFFERENCES)),
    )
    out.append(held.select("database", "table", F.inline(F.filter(found, lambda x: x.isNotNull()))))
    return reduce(DataFrame.unionAll, out)


_DIFFERENCE = "struct<column:string,difference:string,a_value:string,b_value:string>"
_DIFFERENCES = f"array<{_DIFFERENCE}>"


def _difference(cond: Column, what: Column, column: Column | None = None, a: Column | None = None, b: Column | None = None) -> Column:
    none = F.lit(None)
    values = [x if x is not None else none for x in (column, what, a, b)]
    return F.when(cond, F.struct(*[v.cast("string").alias(n) for v, n in zip(values, ("column", "difference", "a_value", "b_value"))]))


def _missing(what: str) -> Column:
    side = F.when(~F.col("in_b"), F.lit(f"missing {what} in b")).when(~F.col("in_a"), F.lit(f"missing {what} in a"))
    return _difference(side.isNotNull(), side)


def _differs(what: str, a: Column, b: Column, cond: Column, column: Column | None = None) -> Column:
    return _difference(cond & ~a.eqNullSafe(b), F.lit(what), column, a, b)


def _pk(columns: str) -> Column:
    keys = F.array_sort(F.transform(F.filter(columns, lambda c: c["pk_position"].isNotNull()), lambda c: F.struct(c["pk_position"], c["name"])))
    return F.array_join(F.transform(keys, lambda k: k["name"]), ",")


def _column_differences() -> Column:
    by_name = [F.map_from_entries(F.transform(f"{x}_cols", lambda c: F.struct(F.lower(c["name"]), c))) for x in "ab"]
    names = F.array_union(F.map_keys(by_name[0]), F.map_keys(by_name[1]))

    def compared(n: Column) -> Column:
        x, y = F.try_element_at(by_name[0], n), F.try_element_at(by_name[1], n)
        name = F.coalesce(x["name"], y["name"])
        missing = F.when(y["name"].isNull(), F.lit("missing column in b")).when(x["name"].isNull(), F.lit("missing column in a"))
        same_type = missing.isNull() & (x["type"] == y["type"])
        shown = lambda p: (F.array_join(x[p], ","), F.array_join(y[p], ",")) if p == "labels" else (x[p].cast("string"), y[p].cast("string"))
        each = [_difference(same_type & ~x[p].eqNullSafe(y[p]), F.lit(p), name, *shown(p)) for p in ("position", "labels", "charset", "signed")]
        return F.array(
            _difference(missing.isNotNull(), missing, name), _difference(missing.isNull() & ~same_type, F.lit("type"), name, *shown("type")), *each
        )

    return F.flatten(F.transform(names, compared))


# -- applying column deltas ----------------------------------------------------------------


class SchemaError(ValueError):
    """A column delta that does not fit the table."""


def evolve(df: DataFrame, deltas: list[dict], key: list[str] | None = None) -> DataFrame:
    """Apply column deltas to a DataFrame in one projection.

    Each delta has ``op`` (add, change, rename, drop) and ``name``; add and change take
    ``type`` and may have ``first: True`` or ``after: <column>``; change and rename take ``to``.
    Added columns are NULL. See ``evolve_key`` for the key's names afterwards.
    """
    cols = [(f.name, F.col(f"`{f.name}`")) for f in df.schema.fields]
    return df.select(*[c.alias(n) for n, c in _evolved(cols, deltas)])


def evolve_key(key: list[str], columns: list[str], deltas: list[dict]) -> list[str]:
    """Names of the key columns after the deltas: they follow renames, changes and drops."""
    marked = [(c, c.lower()) for c in columns]
    now = {origin: name for name, origin in _evolved(marked, deltas) if origin is not None}
    return [now[k.lower()] for k in key if k.lower() in now]


def _evolved(cols: list[tuple], deltas: list[dict]) -> list[tuple]:
    """Columns as (name, content) after the deltas; content is a Column or a plain marker.

    A change that is placed after a column which only a later delta creates waits until all
    deltas have run.
    """

    def find(name: str) -> int:
        at = next((i for i, (n, _) in enumerate(cols) if n.lower() == name.lower()), None)
        if at is None:
            raise SchemaError(f"no column {name}")
        return at

    def has(name: str) -> bool:
        return any(n.lower() == name.lower() for n, _ in cols)

    def place(entry: tuple, d: dict, default: int) -> None:
        if d.get("first"):
            cols.insert(0, entry)
        elif d.get("after"):
            if has(d["after"]):
                cols.insert(find(d["after"]) + 1, entry)
            else:
                waiting.append((entry[0], d["after"]))
                cols.insert(0, entry)
        else:
            cols.insert(default, entry)

    cols, waiting = list(cols), []
    for d in deltas:
        op, name = d["op"], d["name"]
        if op == "add":
            content = F.lit(None).cast(d["type"]) if not cols or isinstance(cols[0][1], Column) else None
            place((name, content), d, len(cols))
        elif op == "drop":
            cols.pop(find(name))
        elif op == "rename":
            i = find(name)
            cols[i] = (d["to"], cols[i][1])
        elif op == "change":
            i = find(name)
            _, content = cols.pop(i)
            if d.get("type") and isinstance(content, Column):
                content = content.try_cast(d["type"])
            place((d.get("to", name), content), d, i)
        else:
            raise SchemaError(f"unknown column change {op}")
    for name, after in waiting:
        entry = cols.pop(find(name))
        if not has(after):
            raise SchemaError(f"no column {after} to place {name} after")
        cols.insert(find(after) + 1, entry)
    return cols


# -- table and database deltas -------------------------------------------------------------


def table_defs(rows: DataFrame) -> DataFrame:
    """Snapshot rows gathered to one row per table with its ``def``."""
    return rows.groupBy("database", "table").agg(
        F.sort_array(F.collect_list(F.struct("position", "name", "type", "charset", "signed", "labels", "length", "pk_position"))).alias("d")
    ).select(
        "database",
        "table",
        F.transform(
            "d",
            lambda c: F.struct(*[c[n].alias(n) for n in ("name", "position", "type", "charset", "signed", "labels", "length", "pk_position")]),
        ).cast(f"array<{COLUMN_DEF}>").alias("def"),
    )


def replay_schema(snapshot: DataFrame, deltas: DataFrame, at: tuple[int, int] | None = None) -> DataFrame:
    """Table definitions after the deltas up to position ``at``: (database, table, def).

    ``snapshot`` is (database, table, def); each definition or drop is an event of its table,
    dropping a database is an event of the database, and the last event of each table decides.
    Creating a table ``like`` another is a create with that table's definition, see
    ``create_like``.
    """
    p = F.col("position")
    if at is not None:
        seq, offset = at
        deltas = deltas.filter((p["file_seq"] < seq) | ((p["file_seq"] == seq) & (p["offset"] <= offset)))
    start = F.struct(F.lit(-1).cast("bigint").alias("seq"), F.lit(-1).cast("bigint").alias("offset"), F.lit(0).alias("step"))
    where = F.struct(p["file_seq"].alias("seq"), p["offset"].alias("offset"))
    no_def = F.lit(None).cast(f"array<{COLUMN_DEF}>")

    def event(db: Column, t: Column, definition: Column, step: int) -> Column:
        when = F.struct(where["seq"].alias("seq"), where["offset"].alias("offset"), F.lit(step).alias("step"))
        return F.struct(db.alias("database"), t.alias("table"), definition.cast(f"array<{COLUMN_DEF}>").alias("def"), when.alias("at"))

    new_db, new_t = F.coalesce("new_database", "database"), F.coalesce("new_table", "table")
    moved = (new_db != F.col("database")) | (new_t != F.col("table"))
    kind = F.col("type")
    events = (
        F.when(kind == "table-create", F.array(event(F.col("database"), F.col("table"), F.col("def"), 1)))
        .when(
            (kind == "table-alter") & moved,
            F.array(event(F.col("database"), F.col("table"), no_def, 0), event(new_db, new_t, F.col("def"), 1)),
        )
        .when(kind == "table-alter", F.array(event(F.col("database"), F.col("table"), F.col("def"), 1)))
        .when(kind == "table-drop", F.array(event(F.col("database"), F.col("table"), no_def, 1)))
    )
    history = deltas.select(F.inline(events)).unionAll(
        snapshot.select("database", "table", F.col("def").cast(f"array<{COLUMN_DEF}>"), start.alias("at"))
    )
    latest = history.groupBy("database", "table").agg(F.max_by(F.struct("def", "at"), "at").alias("l"))
    gone = (
        deltas.filter(kind == "database-drop")
        .groupBy(F.col("database").alias("_db"))
        .agg(F.max(F.struct(p["file_seq"].alias("seq"), p["offset"].alias("offset"), F.lit(2).alias("step"))).alias("_gone"))
    )
    kept = latest.join(gone, F.col("database") == F.col("_db"), "left")
    alive = F.col("l.def").isNotNull() & (F.col("_gone").isNull() | (F.col("l.at") > F.col("_gone")))
    return kept.filter(alive).select("database", "table", F.col("l.def").alias("def"))


def replay_databases(names: DataFrame, deltas: DataFrame) -> DataFrame:
    """Databases after the deltas, (database, charset): created, altered, dropped."""
    p = F.col("position")
    start = F.struct(F.lit(-1).cast("bigint").alias("seq"), F.lit(-1).cast("bigint").alias("offset"))
    at = F.struct(p["file_seq"].alias("seq"), p["offset"].alias("offset"))
    events = names.select("database", "charset", F.lit("database-create").alias("type"), start.alias("at")).unionAll(
        deltas.filter(F.col("type").startswith("database-")).select("database", "charset", "type", at.alias("at"))
    )
    # an alter without a charset changes nothing
    last = events.groupBy("database").agg(
        F.max_by("type", F.when(F.col("type") != "database-alter", F.col("at"))).alias("state"),
        F.max_by("charset", F.when(F.col("charset").isNotNull() & (F.col("type") != "database-drop"), F.col("at"))).alias("charset"),
    )
    return last.filter("state = 'database-create'").select("database", "charset")


def create_like(defs: DataFrame, database: str, table: str, new_database: str, new_table: str) -> DataFrame:
    """The definition of a new table copied from another, as (database, table, def)."""
    return defs.filter((F.col("database") == database) & (F.col("table") == table)).select(
        F.lit(new_database).alias("database"), F.lit(new_table).alias("table"), "def"
    )


def schema_versions(deltas: DataFrame) -> DataFrame:
    """Chain of versions: each delta with its ``schema_id`` and the one it builds on.

    Deltas are metadata, one row per schema statement, so numbering them in one window is small
    work next to any feed.
    """
    from pyspark.sql import Window as W

    order = W.partitionBy(F.coalesce("server_id", F.lit(0).cast("bigint"))).orderBy("position.file_seq", "position.offset")
    n = F.row_number().over(order).cast("bigint")
    return deltas.withColumn("schema_id", n + 1).withColumn("base_schema_id", n)


def schema_as_of(changes: DataFrame, history: DataFrame, slot: int = SLOT) -> DataFrame:
    """Give each change the ``schema_id`` of the newest version at or before its position.

    ``history`` has (position, schema_id) and may have ``server_id``.
    """
    server = F.coalesce("server_id", F.lit(0).cast("bigint")).alias("_server")
    left = changes.drop("schema_id").withColumn("_server", server)
    marks = history.select((server if "server_id" in history.columns else F.lit(0).cast("bigint").alias("_server")), "position", F.col("schema_id").cast("bigint").alias("schema_id"))
    out = last_known(left, marks, ["_server"], "schema_id", slot)
    return out.select(*[F.col(f"`{c}`") for c in changes.columns if c != "schema_id"], "schema_id")


def conform_as_of(changes: DataFrame, history: DataFrame, slot: int = SLOT) -> DataFrame:
    """Keep in the images only columns that the row's table had at the row's position.

    ``history``: (position, database, table, def), and maybe ``server_id``: what each statement made of a table, with a
    NULL ``def`` where it is gone. Each definition's names are carried along the log of its table, so no key of all rows of
    a version is joined on. Rows before their table's first definition, or after its end, keep their images.
    """
    by = ["_server", "database", "table"]
    server = F.coalesce("server_id", F.lit(0).cast("bigint")).alias("_server")
    names = F.struct(F.transform("def", lambda c: c["name"]).alias("names"))
    marks = history.select(server if "server_id" in history.columns else F.lit(0).cast("bigint").alias("_server"), "database", "table", "position", names.alias("_known"))
    found = last_known(changes.withColumn("_server", server), marks, by, "_known", slot)
    return _only_known(found, F.col("_known.names")).select(*changes.columns)


def _only_known(changes: DataFrame, names: Column) -> DataFrame:
    def known(image: str) -> Column:
        return F.when(names.isNull(), F.col(image)).otherwise(F.map_filter(image, lambda k, x: F.array_contains(names, k)))

    return changes.withColumn("data", known("data")).withColumn("old", known("old"))


def conform(changes: DataFrame, versions: DataFrame) -> DataFrame:
    """Keep in the images only columns that the row's schema version knows.

    ``versions``: (schema_id, database, table, def). Rows of tables their version does not know
    keep their images. Versions are metadata; adaptive execution picks the join by their real
    size.
    """
    v = versions.select(
        F.col("schema_id").alias("_sid"), F.col("database").alias("_db"), F.col("table").alias("_tbl"),
        F.transform("def", lambda c: c["name"]).alias("_known"),
    )
    on = (F.col("schema_id") == F.col("_sid")) & (F.col("database") == F.col("_db")) & (F.col("table") == F.col("_tbl"))
    return _only_known(changes.join(v, on, "left"), F.col("_known")).select(*changes.columns)


# -- schema events as a feed ---------------------------------------------------------------


def schema_feed(events: DataFrame, rules: str | list[Rule] | None = None) -> DataFrame:
    """Schema events as JSON: type, names, old and new definition, time, statement, position.

    ``events``: the columns of a schema event and ``ts``, ``sql``, ``old``. A table event passes the rules
    only when they let both its old and its new name through.
    """
    df = events.filter(F.col("type").isin(*SCHEMA_EVENT_TYPES))
    if rules is not None:
        rules = [r for r in (parse_rules(rules) if isinstance(rules, str) else rules) if r.column is None]
        # a database event has no table; its name then counts as empty
        for name in ("table", "new_table"):
            named = df.withColumn("_table", F.col("table")).withColumn("table", F.coalesce(name, "table", F.lit("")))
            df = named.filter(feed_filter(rules)).withColumn("table", F.col("_table")).drop("_table")
    p = F.col("position")
    body = F.struct(
        "type",
        "database",
        "table",
        *[F.col(c) for c in ("old", "def", "charset", "ts", "sql") if c in df.columns],
        F.concat(p["file"], F.lit(":"), p["offset"].cast("string")).alias("position"),
    )
    return df.select("type", "database", "table", "position", F.to_json(body).alias("value"))


def breaking_deltas(deltas: DataFrame, used: dict[str, list[str]] | DataFrame) -> DataFrame:
    """Schema events that views cannot survive: a used table dropped or renamed, a used column
    gone from its new definition. ``used`` is the columns per table that views need, as a dict
    from the view configuration or as a frame (table, columns)."""
    if isinstance(used, DataFrame):
        need = used.select(F.col("table").alias("_table"), F.col("columns").alias("_used"))
    else:
        rows = [(t, cols) for t, cols in used.items()]
        need = deltas.sparkSession.createDataFrame(rows, "_table string, _used array<string>")
    joined = deltas.join(need, F.col("table") == F.col("_table"))
    names = F.transform("def", lambda c: F.lower(c["name"]))
    lost = F.filter("_used", lambda c: ~F.array_contains(names, F.lower(c)))
    dropped = F.col("type") == "table-drop"
    renamed = (F.col("type") == "table-alter") & (F.coalesce("new_table", "table") != F.col("table"))
    reason = (
        F.when(dropped, F.lit("dropped"))
        .when(renamed, F.lit("renamed"))
        .when((F.col("type") == "table-alter") & (F.size(lost) > 0), F.concat(F.lit("lost "), F.array_join(lost, ",")))
    )
    return joined.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("database", "table", "type", "position", "reason")
