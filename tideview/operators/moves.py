"""Net effect of changes whose images lack columns, for rows that change their key.

A key's history falls into stretches, each holding one row: up to the row's deletion or its move to another key, and
from a move to this key or from a row put back after a deletion. A move links the stretch it ends to the one it begins,
so a row's way over several keys is a chain of stretches, and its columns are the last values given anywhere on
it. What no image gave comes from the stored row of the key on which the chain began, unless that row was deleted before.

Stretches are found by carrying the last deletion or move along each key's log (see ``ordered``), chains by pointer
doubling over the table of moves: a round doubles the way each move looks back, so a row moved n times takes about
log2 n rounds. Values are folded per stretch and column before they meet their chain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideview.operators.ordered import SLOT, carry

_CELLS = "array<struct<col:string,val:string>>"


def _stretch(key: str, begin: Column) -> Column:
    """Name of the stretch of a key that begins with the deletion or move at a place; NULL for the stored row's."""
    return F.md5(F.to_json(F.struct(F.col(key).alias("key"), begin.alias("at"))))


def cells_of(parts: DataFrame, *keep: str) -> DataFrame:
    """One row per given column, and one with a NULL column per change: (..., _deleted, _at, col, val)."""
    text = "string"
    marker = F.array(F.struct(F.lit(None).cast(text).alias("col"), F.lit(None).cast(text).alias("val")))
    given = F.transform(F.map_entries("data"), lambda e: F.struct(e["key"].alias("col"), e["value"].alias("val")))
    every = F.concat(marker, F.coalesce(given, F.array().cast(_CELLS)))
    return parts.select(*keep, "_deleted", "_at", F.inline(every))


def chain_moves(moves: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(stretch, first, origin) per move (stretch, first, origin), which names the stretch it begins and the one it ends:
    ``first`` becomes the chain's first stretch, ``origin`` the key whose stored row that is."""
    chains = cut(moves)
    while True:
        b = chains.select(F.col("stretch").alias("_s"), F.col("first").alias("_f"), F.col("origin").alias("_o"))
        on = F.col("_s").isNotNull()
        longer = chains.join(b, F.col("first") == F.col("_s"), "left").select(
            "stretch", F.coalesce("_f", "first").alias("first"), F.when(on, F.col("_o")).otherwise(F.col("origin")).alias("origin"), on.alias("_more")
        )
        chains = cut(longer)
        if chains.filter("_more").isEmpty():
            return chains.drop("_more")
        chains = chains.drop("_more")


def fold_moved(parts: DataFrame, cut: Callable[[DataFrame], DataFrame], slot: int = SLOT) -> DataFrame:
    """Changes of keys that rows moved from or to, as (_key, _deleted, _last, _origin, data).

    ``parts``: (_key, _deleted, _at, data, _move, _other), where a move is an ``out`` row of the old key and an ``in`` row of
    the new one. ``data`` are the columns given along the chain of the row that is on the key in the end, ``_origin`` the key
    whose stored row they continue.
    """
    breaks = F.col("_deleted") | F.coalesce(F.col("_move") == "in", F.lit(False))
    # the same line fed twice would end a stretch twice
    once = parts.filter(breaks).dropDuplicates(["_key", "_at"]).unionByName(parts.filter(~breaks))
    place = F.struct(F.col("_at.pos.file_seq").alias("file_seq"), F.col("_at.pos.offset").alias("offset"))
    marked = once.withColumn("position", place).withColumn("_mark", F.when(breaks, F.col("_at"))).withColumn("_order", F.col("_at"))
    found = carry(marked, ["_key"], "_mark", "_begin", at=F.col("_order"), slot=slot).withColumnRenamed("_order", "_at")
    is_in = F.coalesce(F.col("_move") == "in", F.lit(False))
    begin = F.when(is_in, F.col("_at")).otherwise(F.col("_begin"))
    # a stretch without a beginning in the feed is the stored row's
    rows = cut(found.select("_key", "_deleted", "_at", "data", "_move", "_other", _stretch("_key", begin).alias("stretch"), begin.isNull().alias("_stored")))

    to = F.col("_at").withField("step", F.lit(1))
    moves = rows.filter("_move = 'out'").select(
        _stretch("_other", to).alias("stretch"), F.col("stretch").alias("first"), F.when(F.col("_stored"), F.col("_key")).alias("origin")
    )
    chains = chain_moves(moves, cut)

    folded = cells_of(rows, "_key", "stretch", "_stored").groupBy("stretch", "col").agg(
        F.max_by("val", "_at").alias("val"), F.max("_at").alias("at"), F.max_by("_deleted", "_at").alias("dead"),
        F.any_value("_key").alias("_key"), F.any_value("_stored").alias("_stored"),
    )
    linked = folded.join(chains, "stretch", "left").select(
        "_key", "col", "val", "at", "dead", F.coalesce("first", "stretch").alias("chain"),
        F.when(F.col("first").isNotNull(), F.col("origin")).otherwise(F.when(F.col("_stored"), F.col("_key"))).alias("origin"),
    )
    linked = cut(linked)
    ends = linked.filter("col IS NULL").groupBy("_key").agg(F.max_by(F.struct("chain", "dead", "origin"), "at").alias("e"), F.max("at").alias("_last"))
    ends = ends.select("_key", F.col("e.dead").alias("_deleted"), "_last", "e.chain", F.when(~F.col("e.dead"), F.col("e.origin")).alias("_origin"))
    values = linked.filter("col IS NOT NULL").groupBy("chain", "col").agg(F.max_by("val", "at").alias("val"))
    values = values.groupBy("chain").agg(F.map_from_entries(F.collect_list(F.struct("col", "val"))).alias("data"))
    none = F.create_map().cast("map<string,string>")
    return ends.join(values, "chain", "left").select("_key", "_deleted", "_last", "_origin", F.coalesce("data", none).alias("data"))
