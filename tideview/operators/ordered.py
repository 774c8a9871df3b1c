"""Ordered operators over long groups, done in steps so that no group is one task's work.

A group (a transaction, a server's feed, a key's history) may hold a large share of all rows, so a window over
the whole group would be one task. Positions are byte offsets in numbered files: rows are cut
into slots of a fixed number of bytes, and windows run inside slots. A summary with one row per slot carries counts
or last values across the slots of a file, and one with a row per file across the files of a group. So a
task sees a slot of rows, a file of slots, or a group of files; a slot cannot hold more rows than it has bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideview.sources.change import position_key

# 64 MiB of log: some million rows at most, and 16 slots to a file of 1 GiB.
SLOT = 1 << 26

_SLOT_COLUMNS = ["_file", "_slot"]


def _slots(df: DataFrame, slot: int) -> DataFrame:
    """Rows without a position share one slot before all others."""
    p = F.col("position")
    return df.withColumn("_file", F.coalesce(p["file_seq"], F.lit(-1).cast("bigint"))).withColumn(
        "_slot", F.coalesce(F.floor(p["offset"] / F.lit(slot)).cast("bigint"), F.lit(-1).cast("bigint"))
    )


def _before(*keys: str, order: str) -> W:
    return W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)


def _named(keys: list[str]) -> list[Column]:
    return [F.col(k).alias(f"s{k}") for k in keys]


def row_index(df: DataFrame, by: list[str], slot: int = SLOT) -> DataFrame:
    """Add ``_index`` (from 0, in position order) and ``_total`` per group of ``by`` columns."""
    rows = _slots(df, slot)
    keys = [*by, *_SLOT_COLUMNS]
    inside = rows.withColumn("_row", F.row_number().over(W.partitionBy(*keys).orderBy(position_key())))
    none = F.lit(0).cast("bigint")
    in_file = W.partitionBy(*by, "_file")
    slots = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    slots = slots.select(
        *_named(keys), F.coalesce(F.sum("_n").over(_before(*by, "_file", order="_slot")), none).alias("_start"),
        F.sum("_n").over(in_file).alias("_file_n"), F.lead("_slot").over(in_file.orderBy("_slot")).isNull().alias("_end"),
    )
    group = [f"s{k}" for k in by]
    files = slots.filter("_end").select(
        *[F.col(f"s{k}").alias(f"f{k}") for k in [*by, "_file"]],
        F.coalesce(F.sum("_file_n").over(_before(*group, order="s_file")), none).alias("_file_start"),
        F.sum("_file_n").over(W.partitionBy(*group)).alias("_total"),
    )
    return (
        inside.join(slots, _same(keys))
        .join(files, _same([*by, "_file"], "f"))
        .withColumn("_index", F.col("_file_start") + F.col("_start") + F.col("_row").cast("bigint") - 1)
        .drop("_row", "_start", "_file_n", "_end", "_file_start", *_SLOT_COLUMNS, *[f"s{k}" for k in keys], *[f"f{k}" for k in [*by, "_file"]])
    )


def carry(rows: DataFrame, by: list[str], mark: str, name: str, *, at: Column | None = None, inclusive: bool = False, slot: int = SLOT) -> DataFrame:
    """Add ``name``: the last value of column ``mark`` that is not NULL on an earlier row of the group.

    Rows have a ``position``; ``at`` is their order, which must follow it. With ``inclusive`` a row's own mark counts.
    """
    rows = _slots(rows, slot).withColumn("_at", position_key() if at is None else at)
    keys = [*by, *_SLOT_COLUMNS]
    near = W.partitionBy(*keys).orderBy("_at").rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    inside = rows.withColumn("_near", F.last(mark, ignorenulls=True).over(near))
    slots = rows.groupBy(*keys).agg(F.max_by(mark, F.when(F.col(mark).isNotNull(), F.col("_at"))).alias("_last"))
    in_file = W.partitionBy(*by, "_file").orderBy("_slot")
    slots = slots.select(
        *_named(keys), F.last("_last", ignorenulls=True).over(_before(*by, "_file", order="_slot")).alias("_far"),
        F.last("_last", ignorenulls=True).over(in_file.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_file_last"),
        F.lead("_slot").over(in_file).isNull().alias("_end"),
    )
    files = slots.filter("_end").select(
        *[F.col(f"s{k}").alias(f"f{k}") for k in [*by, "_file"]],
        F.last("_file_last", ignorenulls=True).over(_before(*[f"s{k}" for k in by], order="s_file")).alias("_farther"),
    )
    found = F.coalesce("_near", "_far", "_farther").alias(name)
    joined = inside.join(slots, _same(keys)).join(files, _same([*by, "_file"], "f"))
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns if c not in ("_at", *_SLOT_COLUMNS)], found)


def previous_row(df: DataFrame, by: list[str], values: dict[str, Column], slot: int = SLOT) -> DataFrame:
    """Add, under each given name, the value on the previous row of the group in position order."""
    rows = df.withColumn("_mine", F.struct(*[v.alias(n) for n, v in values.items()]))
    found = carry(rows, by, "_mine", "_prior", slot=slot)
    return found.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col("_prior")[n].alias(n) for n in values])


def last_known(rows: DataFrame, marks: DataFrame, by: list[str], value: str, slot: int = SLOT) -> DataFrame:
    """As-of join: add to ``rows`` the ``value`` of the latest mark at or before each row.

    Both sides have ``by`` columns and a ``position``; a mark at a row's own position counts.
    The two sides are united and share the slots, so neither is broadcast or joined by range.
    """
    mark = F.struct(F.col(value).alias("v"))
    place = F.struct(F.col("position.file_seq").alias("file_seq"), F.col("position.offset").alias("offset"))
    left = rows.select(
        *by, place.alias("position"), F.lit(1).alias("_side"),
        F.lit(None).cast(marks.select(mark.alias("m")).schema["m"].dataType).alias("_mark"),
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_r"),
    )
    right = marks.select(
        *by, place.alias("position"), F.lit(0).alias("_side"), mark.alias("_mark"),
        F.lit(None).cast(left.schema["_r"].dataType).alias("_r"),
    )
    found = carry(left.unionAll(right), by, "_mark", "_found", at=F.struct("position.offset", "_side"), inclusive=True, slot=slot)
    return found.filter("_side = 1").select("_r.*", F.col("_found.v").alias(value))


def _same(keys: list[str], prefix: str = "s") -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return cond
