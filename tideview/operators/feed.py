"""Change-feed operators: images to changes, transactions, ordering and net effect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideview.operators.moves import fold_moved
from tideview.operators.ordered import SLOT, previous_row, row_index
from tideview.sources.change import (
    POSITION_KEY,
    ROW_TYPES,
    as_changes,
    entry_sql,
    image_map,
    literal,
    quoted,
    typed_sql,
)
from tideview.sources.shared import shared_cut

_EMPTY = "map<string,string>"


# -- row images ----------------------------------------------------------------------------


def diff_snapshots(
    before: DataFrame,
    after: DataFrame,
    key: str,
    *,
    database: str = "",
    table: str = "",
    columns: list[str] | None = None,
) -> DataFrame:
    """Changes that lead from one state of a table to another.

    One full outer join on the key. ``columns`` limits the images (the key stays in them);
    rows that differ nowhere in them give no change.
    """
    kept = before.columns if columns is None else list(dict.fromkeys([key, *columns]))
    schema = T.StructType([before.schema[c] for c in kept])
    b = before.select(F.struct(*kept).alias("_b"), F.col(key).alias("_bk"))
    a = after.select(F.struct(*[F.col(c).cast(before.schema[c].dataType).alias(c) for c in kept]).alias("_a"), F.col(key).alias("_ak"))
    both = b.join(a, F.col("_bk") == F.col("_ak"), "full_outer").filter(~F.col("_b").eqNullSafe(F.col("_a")))
    new, old = image_map(schema, "_a."), image_map(schema, "_b.")
    kind = F.when(F.col("_b").isNull(), "insert").when(F.col("_a").isNull(), "delete").otherwise("update")
    return as_changes(
        both.select(
            F.lit(database).alias("database"),
            F.lit(table).alias("table"),
            kind.alias("type"),
            F.array(F.lit(key)).alias("primary_key_columns"),
            F.when(F.col("_a").isNull(), old).otherwise(new).alias("data"),
            F.when(kind == "update", changed_columns(old, new)).otherwise(F.create_map().cast(_EMPTY)).alias("old"),
        )
    )


def changed_columns(before: Column, after: Column) -> Column:
    """Entries of ``before`` whose column is also in ``after`` with another value (NULL-safe)."""
    return F.map_filter(before, lambda k, v: F.map_contains_key(after, k) & ~v.eqNullSafe(after[k]))


def merge_images(df: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """Row images to ``data`` and ``old``.

    A column found only in the before image identifies the row and belongs to ``data``; of the
    shared columns ``old`` keeps those that changed.
    """
    b = F.coalesce(F.col(before), F.create_map().cast(_EMPTY))
    a = F.coalesce(F.col(after), F.create_map().cast(_EMPTY))
    only_before = F.map_filter(b, lambda k, v: ~F.map_contains_key(a, k))
    return df.withColumn("data", F.map_concat(a, only_before)).withColumn("old", changed_columns(b, a))


# -- transactions --------------------------------------------------------------------------


def assemble_transactions(df: DataFrame, slot: int = SLOT) -> DataFrame:
    """Number the rows of each transaction from 0 and mark its last kept row as commit.

    Apply it after filters. Rows without a transaction id pass unchanged.
    """
    server = F.coalesce("server_id", F.lit(0).cast("bigint"))
    inside = df.filter(F.col("xid").isNotNull()).withColumn("_server", server)
    numbered = row_index(inside, ["_server", "xid"], slot)
    numbered = numbered.withColumn("xoffset", F.col("_index")).withColumn("commit", F.col("_index") == F.col("_total") - 1)
    return numbered.select(*df.columns).unionAll(df.filter(F.col("xid").isNull()))


def mark_pending(df: DataFrame, *, late: str | None = None) -> DataFrame:
    """``df`` with ``_pending``: whether the row's transaction has no commit row yet.

    ``late`` names a column that marks rows the feed had already passed: their commit row lies
    behind them in the log and may have come with an earlier batch, so they close their transaction too.

    One aggregation and one join: open transactions are few, and adaptive execution sees
    their real size and chooses the join.
    """
    server = F.coalesce("server_id", F.lit(0).cast("bigint"))
    done = F.coalesce("commit", F.lit(False))
    done = done if late is None else done | F.col(late)
    open_tx = (
        df.filter(F.col("xid").isNotNull())
        .groupBy(server.alias("_s"), F.col("xid").alias("_x"))
        .agg(F.max(done).alias("_done"))
        .filter(~F.col("_done"))
    )
    same = (server == F.col("_s")) & (F.col("xid") == F.col("_x"))
    return df.join(open_tx, same, "left").withColumn("_pending", F.col("_x").isNotNull()).drop("_s", "_x", "_done")


def committed_only(df: DataFrame, *, late: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Split into (ready, pending): pending rows belong to transactions with no commit row yet.

    Both are filters on ``mark_pending``; where both are needed, store that once and filter it.
    """
    marked = mark_pending(df, late=late)
    return marked.filter(~F.col("_pending")).drop("_pending"), marked.filter("_pending").drop("_pending")


def attach_statement(df: DataFrame, slot: int = SLOT) -> DataFrame:
    """Carry statement text from ``query`` rows to the first row change that follows each.

    A ``query`` row announces the statement of the next row change of its transaction.
    Announcing rows are dropped.
    """
    server = F.coalesce("server_id", F.lit(0).cast("bigint"))
    df2 = df.withColumn("_server", server).withColumn("_is_query", F.col("type") == "query")
    prior = previous_row(df2, ["_server"], {"_prev_query": F.when(F.col("_is_query"), F.col("query")), "_prev_xid": F.col("xid")}, slot)
    text = F.when(F.col("_prev_xid").eqNullSafe(F.col("xid")), F.col("_prev_query"))
    return prior.filter(~F.col("_is_query")).withColumn("query", F.coalesce("query", text)).select(*df.columns)


# -- positions -----------------------------------------------------------------------------


def gtid_intervals(gtid: Column) -> Column:
    """``sid:1-5:8,sid2:1-3`` as an array of (sid, lo, hi)."""
    per_server = F.transform(F.split(F.regexp_replace(gtid, r"\s", ""), ","), lambda s: F.split(s, ":"))
    spread = F.transform(
        per_server,
        lambda p: F.transform(
            F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))),
            lambda r: F.struct(
                F.lower(p[0]).alias("sid"),
                F.split(r, "-")[0].try_cast("bigint").alias("lo"),
                F.element_at(F.split(r, "-"), -1).try_cast("bigint").alias("hi"),
            ),
        ),
    )
    return F.flatten(spread)


def gtid_newer(gtid: Column, other: Column) -> Column:
    """True when ``gtid`` holds a transaction that ``other`` does not."""
    mine, theirs = gtid_intervals(gtid), gtid_intervals(other)
    contained = F.forall(
        mine,
        lambda a: F.exists(theirs, lambda b: (a["sid"] == b["sid"]) & (a["lo"] >= b["lo"]) & (a["hi"] <= b["hi"])),
    )
    return F.when(other.isNull(), F.lit(True)).otherwise(~contained)


def newer_than(df: DataFrame, other: str) -> Column:
    """Is the row's position newer than position column ``other``: file number, then offset."""
    p, o = F.col("position"), F.col(other)
    by_offset = (p["file_seq"] > o["file_seq"]) | ((p["file_seq"] == o["file_seq"]) & (p["offset"] > o["offset"]))
    return F.when(o.isNull(), F.lit(True)).otherwise(by_offset)


# -- net effect ----------------------------------------------------------------------------


def keyed_changes(changes: DataFrame, table: str, key: str, schema: T.StructType) -> DataFrame:
    """Row changes of one table as (_key, _deleted, _at, data, _move, _other).

    An update that moves the key becomes a delete of the old key (``_move`` is ``out``) and an upsert of the new one
    (``in``) at the same position; ``_other`` is the key at the other end.
    """
    name, dtype = literal(key), schema[key].dataType
    now, was = (typed_sql(entry_sql(image, key), dtype) for image in ("data", "old"))
    moved = f"(type = 'update' AND coalesce(map_contains_key(old, {name}), false) AND NOT ({was} <=> {now}))"
    none = f"cast(null AS {dtype.simpleString()})"

    def part(k: str, deleted: str, step: int, move: str = "cast(null AS string)", other: str = none) -> str:
        at = f"struct({POSITION_KEY} AS pos, {step} AS step, coalesce(server_id, 0L) AS server)"
        row = f"CASE WHEN NOT {deleted} THEN data END"
        return f"struct({k} AS _key, {deleted} AS _deleted, {at} AS _at, {row} AS data, {move} AS _move, {other} AS _other)"

    kinds = ", ".join(f"'{t}'" for t in ROW_TYPES)
    rows = changes.filter(f"`table` = {literal(table)} AND type IN ({kinds})")
    both = f"array({part(was, 'true', 0, literal('out'), now)}, {part(now, 'false', 1, literal('in'), was)})"
    gone = "(type = 'delete')"
    one = f"array({part(now, gone, 1)})"
    # a row without a key can be neither stored nor looked up; without_key finds those changes
    return rows.selectExpr(f"inline(CASE WHEN {moved} THEN {both} ELSE {one} END)").filter("_key IS NOT NULL")


def without_key(table: str, key: str, dtype: T.DataType) -> Column:
    """Is it a row change of the table whose key, old or new, is absent, NULL or of another type?
    ``net_changes`` leaves such keys out; a caller that must not lose them sends the changes elsewhere."""
    now, was = (typed_sql(entry_sql(image, key), dtype) for image in ("data", "old"))
    kinds = ", ".join(f"'{t}'" for t in ROW_TYPES)
    moved = f"type = 'update' AND coalesce(map_contains_key(old, {literal(key)}), false)"
    return F.expr(
        f"coalesce(`table` = {literal(table)} AND type IN ({kinds}), false)"
        f" AND ({now} IS NULL OR ({moved} AND {was} IS NULL))"
    )


def lacks_columns(table: str, columns: list[str]) -> Column:
    """Is it an insert or update of the table whose image has no entry at all for one of the columns?"""
    every = ", ".join(literal(c) for c in columns)
    kinds = ", ".join(f"'{t}'" for t in ROW_TYPES if t != "delete")
    return F.expr(
        f"coalesce(`table` = {literal(table)} AND type IN ({kinds}), false)"
        f" AND size(array_except(array({every}), coalesce(map_keys(data), array()))) > 0"
    )


def net_changes(
    changes: DataFrame,
    table: str,
    key: str,
    schema: T.StructType,
    *,
    current: DataFrame | None = None,
    stamp: str | None = None,
    cut: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Fold all changes of a table to the last one per key: (_key, _deleted, <columns of schema>).

    The fold is an aggregation with a map-side step, so a key changed very often costs one row
    per task in the shuffle. ``current`` (the table before the changes) is needed only when
    images may lack columns: the missing ones are taken first from earlier images of the same
    row in this feed, on whatever keys it was, and then from the stored row it began as. ``stamp`` names one more
    column for the place in the log of the last change. ``cut`` stores a frame and returns it as a source; it is used
    where images lack columns, first for the table's changes, so that they are made once; without it, only where keys move
    as well, with the session's shared folder.
    """
    stamps = [] if stamp is None else [f"_last AS {quoted(stamp)}"]
    if current is None:
        parts = keyed_changes(changes, table, key, schema)
        last = parts.groupBy("_key").agg(
            F.max_by(F.struct("_deleted", "data"), "_at").alias("_l"), F.max("_at").alias("_last")
        )
        return last.selectExpr(
            "_key",
            "_l._deleted AS _deleted",
            *stamps,
            *[f"{typed_sql(entry_sql('_l.data', f.name), f.dataType)} AS {quoted(f.name)}" for f in schema.fields],
        )
    return _fold_partial(keyed_changes(changes, table, key, schema), key, schema, current, stamps, cut)


def _fold_partial(
    parts: DataFrame,
    key: str,
    schema: T.StructType,
    current: DataFrame,
    stamps: list[str],
    cut: Callable[[DataFrame], DataFrame] | None,
) -> DataFrame:
    """Per key and column the last value given to the row that is on the key in the end."""
    # the steps below read the changes many times
    if cut is not None:
        parts = cut(parts)
    if parts.filter("_move IS NOT NULL").isEmpty():
        folded = _fold_still(parts, schema.names)
    else:
        if cut is None:
            cut = shared_cut(parts.sparkSession, "moves")
            parts = cut(parts)
        moved = cut(parts.filter("_move IS NOT NULL").select(F.col("_key").alias("_moved")).distinct())
        on = F.col("_key") == F.col("_moved")
        folded = _fold_still(parts.join(moved, on, "left_anti"), schema.names).unionByName(fold_moved(parts.join(moved, on, "left_semi"), cut))
    stored = current.select(F.col(key).alias("_stored_key"), F.struct(*schema.names).alias("_stored"))
    joined = folded.join(stored, F.col("_origin") == F.col("_stored_key"), "left")

    def value(f: T.StructField) -> str:
        given = typed_sql(entry_sql("data", f.name), f.dataType)
        known = f"map_contains_key(data, {literal(f.name)})"
        return f"CASE WHEN {known} THEN {given} ELSE _stored.{quoted(f.name)} END AS {quoted(f.name)}"

    return joined.selectExpr("_key", "_deleted", *stamps, *[value(f) for f in schema.fields])


def _fold_still(parts: DataFrame, columns: list[str]) -> DataFrame:
    """(_key, _deleted, _last, _origin, data) of keys that no row moved from or to: what was given since the last deletion.

    One aggregation with a map-side step: no step holds more of one key than one value per column. ``_origin`` is the key
    itself, or NULL after a deletion: a row that was put back takes nothing from what is stored.
    """
    last = [
        F.max_by(F.struct(F.lit(c).alias("col"), F.col("data")[c].alias("val"), F.col("_at").alias("at")), F.when(F.map_contains_key("data", c), F.col("_at")))
        for c in columns
    ]
    per_key = parts.groupBy("_key").agg(
        F.max_by("_deleted", "_at").alias("_deleted"), F.max("_at").alias("_last"),
        F.max(F.when(F.col("_deleted"), F.col("_at"))).alias("_died"), F.array(*last).alias("cells"),
    )
    alive = F.filter("cells", lambda c: c.isNotNull() & (F.col("_died").isNull() | (c["at"] > F.col("_died"))))
    return per_key.select(
        "_key",
        "_deleted",
        "_last",
        F.when(F.col("_died").isNull(), F.col("_key")).alias("_origin"),
        F.map_from_entries(F.transform(alive, lambda c: F.struct(c["col"], c["val"]))).alias("data"),
    )
