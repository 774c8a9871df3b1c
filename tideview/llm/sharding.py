"""Sharding by longest-processing-time scheduling: groups that must stay together, largest first, to the least loaded shard.

One heap over all groups would be one task's work, so the same scheduling runs on several levels. Groups are dealt to blocks
of bounded number. A block sorts its groups by size, cuts them to bands of falling weight (a half of what is left, then a
quarter, ...) and schedules each band through a heap to a few bundles, which from then on stay together. The bundles are the
items of the next level, until one last heap schedules what is left to the shards. As the late bands hold the small groups,
there are always bundles of every size, down to 1/32,000 of a block, and the last ones scheduled level the shards out.

Where everything fits the last heap (``BLOCK`` items), this is plain longest-processing-time scheduling. The largest group bounds
how even shards can be: one that is larger than a shard's share leaves its shard above the others, which stay even among each other.

Rows meet their group's shard by a join in which hot groups (1/1024 of the rows or more, so 1,024 at most) are broadcast. Slots
number the rows of each task and shard where they are written, and add what the tasks before hold. Intermediate tables are kept.

Edge cases: a null group is a group like any other. A size that is null counts as zero. Ties in size go by a hash of the group, so the
result does not depend on how rows are dealt to tasks; slots do. Fewer groups than shards: some shards stay empty. No rows: none.
Columns named like the result's are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideview.llm.numbering import numbered
from tideview.llm.shared import keep, small

#: Items that one heap schedules.
BLOCK = 1 << 14
#: Bands of a block, each of half the weight of what is left, and bundles of a band.
BANDS, BUNDLES = 10, 32
#: Groups that hold this share of the rows or more meet their rows by a broadcast.
HOT = 1024


def schedule(sizes: Iterable[int], shards: int) -> list[int]:
    """The shard of each size, taken in the given order, by the least load and then the smallest number."""
    heap = [(0, s) for s in range(shards)]
    out = []
    for size in sizes:
        load, s = heap[0]
        heapq.heapreplace(heap, (load + size, s))
        out.append(s)
    return out


def bundles(sizes: np.ndarray) -> np.ndarray:
    """The bundle of each of a block's sizes, which fall; each band has bundles of its own."""
    total, before = int(sizes.sum()), np.cumsum(sizes) - sizes
    left = np.maximum(total - before, 1) / max(total, 1)
    band = np.minimum(np.floor(-np.log2(left)).astype(int), BANDS - 1)
    out = np.zeros(len(sizes), np.int64)
    for b in range(BANDS):
        own = np.flatnonzero(band == b)
        out[own] = b * BUNDLES + np.array(schedule(sizes[own].tolist(), BUNDLES), np.int64)
    return out


def _bundled(items: DataFrame, blocks: int) -> DataFrame:
    """(item, bundle): the items (item binary, size) of each block in bundles, named by block and number."""

    def run(key, table):
        size, item = table["size"].to_numpy(), table["item"].to_pylist()
        order = sorted(range(len(item)), key=lambda i: (-size[i], item[i]))
        names = [b"%d:%d" % (key[0].as_py(), n) for n in bundles(size[order])]
        return pa.table({"item": pa.array([item[i] for i in order], pa.binary()), "bundle": pa.array(names, pa.binary())})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(run, "item binary, bundle binary")


def place(groups: DataFrame, shards: int, block: int = BLOCK) -> DataFrame:
    """(item, shard) for ``groups`` (item binary, size long), whose items are distinct."""
    if block < 4 * BANDS * BUNDLES:
        raise ValueError(f"a block must have {4 * BANDS * BUNDLES} items at least, so that each level leaves fewer")
    levels: list[DataFrame] = []
    items = keep(groups.select("item", F.coalesce("size", F.lit(0)).cast("long").alias("size")), "groups")
    while (n := items.count()) > block:
        # half full on average, so that no block is above its bound by much
        levels.append(keep(_bundled(items, -(-2 * n // block)), "bundles"))
        items = keep(items.join(levels[-1], "item").groupBy(F.col("bundle").alias("item")).agg(F.sum("size").alias("size")), "items")
    last = sorted(((r.size, bytes(r.item)) for r in items.toLocalIterator()), key=lambda x: (-x[0], x[1]))  # at most ``block``
    made = zip((item for _, item in last), schedule((size for size, _ in last), shards))
    out = items.sparkSession.createDataFrame(list(made), "item binary, shard int")
    for level in reversed(levels):
        up = out.withColumnRenamed("item", "bundle")
        out = keep(level.join(F.broadcast(up) if small(up, 200_000) else up, "bundle").select("item", "shard"), "placed")
    return out


def assign(rows: DataFrame, group: Column, size: Column, shards: int = 8, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (0, 1, ... in the shard). Rows with equal ``group`` (binary) share a shard; shards have
    near equal sums of ``size``."""
    if shards < 1:
        raise ValueError("there must be one shard at least")
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    held = rows.select(F.struct(*kept).alias("row"), F.coalesce(group, F.lit(b"")).alias("item"), size.alias("size"))
    held = keep(held, "rows")
    groups = keep(held.groupBy("item").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "sizes")
    total = held.count()
    placed = place(groups.select("item", "size"), shards, block)
    # a hot group's rows would otherwise be one task's
    hot = placed.join(F.broadcast(groups.where(F.col("n") * HOT >= total).select("item")), "item")
    hot = F.broadcast(keep(hot, "hot"))
    cold = held.join(hot, "item", "left_anti").join(placed, "item")
    return numbered(held.join(hot, "item").unionByName(cold).select("row.*", "shard"), "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """``docs`` (text, ...) as Parquet in one folder for each shard, equal texts together, files in the order of ``slot``."""
    made = assign(docs, F.unhex(F.md5(F.coalesce("text", F.lit("")))), text_size(F.col("text")), shards)
    made.write.partitionBy("shard").parquet(path)


def text_size(text: Column) -> Column:
    """UTF-8 bytes and one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
