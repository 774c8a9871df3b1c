"""Merkle manifest of a table: persistent trees, and by path copying a version of them for each tampered leaf.

Rows are leaves, in order inside their tree (one for each value of a column); the trees' roots, in the order of that value,
are the leaves of a last tree. Each two neighbours become the hash of both, a last one without a neighbour that of itself.

Trees are cut into aligned blocks of 4,096 leaves, which are built apart from one another; a block's root is a leaf of the next
level of blocks, until one root is left. Each row of a block table holds a block, so a hot value of the column is many rows. In its block
a tampered leaf makes a version: new nodes for its ancestors only, all others shared with the tree it came from. The
version goes on above the block by the steps (shared siblings) that lead from the block's root to the last root, joined by block.

Edge cases: a null tree value is a tree of its own, the first. Null fields are hashed as ``-``. Equal order keys are told apart by
their leaves' hashes; equal rows are equal leaves, in any order. A null id is first, and is never tampered with if that depends on the id.
One row: its leaf is the root. No rows: no rows, and no root. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideview.llm.numbering import numbered
from tideview.llm.shared import keep, small
from tideview.llm.texts import column

#: Levels of a block, and with that its leaves.
LEVELS = 12


def digest(*parts: bytes) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


class Tree:
    """Nodes that are never changed: a version is one more root, whose new nodes point to old ones."""

    def __init__(self, leaves: list[bytes], levels: int):
        self.levels = levels
        self.hash, self.left, self.right = list(leaves), [-1] * len(leaves), [-1] * len(leaves)
        row = list(range(len(leaves)))
        for _ in range(levels):
            row = [self._node(row[i], row[i + 1] if i + 1 < len(row) else -1) for i in range(0, len(row), 2)]
        self.root = row[0]

    def _node(self, left: int, right: int) -> int:
        self.hash.append(digest(self.hash[left], self.hash[right]) if right >= 0 else digest(self.hash[left]))
        self.left.append(left)
        self.right.append(right)
        return len(self.hash) - 1

    def path(self, place: int, root: int | None = None) -> list[tuple[int, int]]:
        """From the leaf at ``place`` upwards: (whether it is the right child, the other child or -1) at each level."""
        at, out = self.root if root is None else root, []
        for level in reversed(range(self.levels)):
            left, right = self.left[at], self.right[at]
            is_right = place >> level & 1
            out.append((is_right, left if is_right else right))
            at = right if is_right else left
        return out[::-1]

    def version(self, place: int, leaf: bytes, root: int | None = None) -> int:
        """The root of the tree with another leaf at ``place``; only the leaf and its ancestors are new nodes."""
        way = self.path(place, root)
        self.hash.append(leaf)
        self.left.append(-1)
        self.right.append(-1)
        at = len(self.hash) - 1
        for is_right, other in way:
            at = self._node(other, at) if is_right else self._node(at, other)
        return at

    def steps(self, place: int) -> list[bytes]:
        """The siblings on the way up: R or L for their side, and their hash; - where there is none."""
        return [b"-" if other < 0 else (b"L" if is_right else b"R") + self.hash[other] for is_right, other in self.path(place)]


def climb(leaf: bytes, steps: list[bytes]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for s in steps:
        leaf = digest(leaf) if s == b"-" else digest(s[1:], leaf) if s[:1] == b"L" else digest(leaf, s[1:])
    return leaf


def height(n: int, total: int) -> int:
    """Levels of a block of ``n`` leaves in a tree of ``total``: all of them, unless it is the only block."""
    return LEVELS if total > 1 << LEVELS else (n - 1).bit_length()


def _blocks(nodes: DataFrame, extra: str = "") -> DataFrame:
    """(tree, block, total, root, hash array, ...) of ``nodes`` (tree, place, total, hash, ...); ``extra`` names other columns."""
    names = [x.split()[0] for x in extra.split(", ") if x]

    def run(key, table):
        table = table.sort_by("place")
        leaves = [h.encode() for h in table["hash"].to_pylist()]
        total = table["total"][0].as_py()
        tree = Tree(leaves, height(len(leaves), total))
        out = {"tree": [key[0].as_py()], "block": [key[1].as_py()], "total": [total], "root": [tree.hash[tree.root].decode()], "hash": [table["hash"].to_pylist()]}
        made = pa.schema([("tree", pa.binary()), ("block", pa.int64()), ("total", pa.int64()), ("root", pa.string()), ("hash", pa.list_(pa.string())), *((x, pa.list_(table.schema.field(x).type)) for x in names)])
        return pa.table(out | {x: [table[x].to_pylist()] for x in names}, schema=made)

    fields = ", ".join(f"{x.split()[0]} array<{x.split()[1]}>" for x in extra.split(", ") if x)
    dealt = nodes.select("tree", "place", "total", "hash", *names, F.shiftright("place", LEVELS).alias("block"))
    return dealt.groupBy("tree", "block").applyInArrow(run, f"tree binary, block long, total long, root string, hash array<string>{fields and ', ' + fields}")


def _side(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if small(table, 20_000) else table


def _above(blocks: DataFrame) -> DataFrame:
    """(tree, block, steps, subroot): the way from each block's root to its tree's root."""
    nodes = blocks.select("tree", F.col("block").alias("place"), F.ceil(F.col("total") / (1 << LEVELS)).cast("long").alias("total"), F.col("root").alias("hash"))
    lone = nodes.where("total = 1").select("tree", F.col("place").alias("block"), F.array().cast("array<string>").alias("steps"), F.col("hash").alias("subroot"))
    if nodes.where("total > 1").isEmpty():
        return lone
    upper = keep(_blocks(nodes.where("total > 1")), "upper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, block, total, hashes in zip(*(column(batch, c).to_pylist() for c in ("tree", "block", "total", "hash"))):
                tree = Tree([h.encode() for h in hashes], height(len(hashes), total))
                n = len(hashes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key] * n, pa.binary()),
                        pa.array([(block << LEVELS) + i for i in range(n)], pa.int64()),
                        pa.array([block] * n, pa.int64()),
                        pa.array([[s.decode() for s in tree.steps(i)] for i in range(n)], pa.list_(pa.string())),
                    ],
                    names=["tree", "place", "up", "own"],
                )

    own = upper.select("tree", "block", "total", "hash").mapInArrow(run, "tree binary, place long, up long, own array<string>")
    rest = keep(_above(upper.select("tree", "block", "total", "root")), "above").withColumnRenamed("block", "up")
    joined = own.join(_side(rest), ["tree", "up"])
    return lone.unionByName(joined.select("tree", F.col("place").alias("block"), F.concat("own", "steps").alias("steps"), "subroot"))


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``place`` in their ``tree``, in the given order, and ``total``; no task holds a whole tree."""
    # the row's own number spreads equal rows over tasks
    rows = keep(rows.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    keys = ["tree", *order, "_row"]
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return numbered(sorted_rows.drop("_row"), "tree", "place", "total")


def leaf_hash(columns: list[str], replaced: dict[str, Column] | None = None) -> Column:
    """The hash of a row's columns, each by its length in bytes and its text."""
    parts = []
    for c in columns:
        text = (replaced or {}).get(c, F.col(f"`{c}`")).cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def manifest(docs: DataFrame, columns: list[str], by: str = "lang", key: str = "doc_id", tampered: Column | None = None, changes: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, tree, place, leaf, steps, subroot, root, changed, folded_root) for every row of ``docs``.

    ``steps`` are the siblings from leaf to root (R, L or -, then the hash), ``changed`` the leaf's hash with ``changes``
    where ``tampered`` holds, else null, and ``folded_root`` the root that it, or else the leaf, leads to. ``tree`` is
    empty for a null ``by``, else the byte 1 and its text.
    """
    value = F.col(f"`{by}`").cast("string")
    other = F.when(F.coalesce(tampered, F.lit(False)), leaf_hash(columns, changes)) if tampered is not None else F.lit(None).cast("string")
    tree = F.when(value.isNull(), F.lit(b"")).otherwise(F.concat(F.lit(b"\x01"), value.cast("binary")))
    leaves = docs.select(tree.alias("tree"), F.col(f"`{key}`").cast("long").alias("doc_id"), leaf_hash(columns).alias("hash"), other.alias("changed"))
    blocks = keep(_blocks(_ranked(leaves, ["doc_id", "hash"]), "doc_id long, changed string"), "blocks")
    above = keep(_above(blocks.select("tree", "block", "total", "root")), "above")

    # the trees' roots are the leaves of one more tree
    subroots = above.where("block = 0").select(F.lit(b"").alias("tree"), F.col("tree").alias("of"), F.col("subroot").alias("hash"))
    top = keep(_ranked(subroots, ["of"]), "subroots")
    top_blocks = keep(_blocks(top), "top")
    to_root = keep(_above(top_blocks.select("tree", "block", "total", "root")), "to-root")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, total, hashes, steps, root in zip(*(column(batch, c).to_pylist() for c in ("block", "total", "hash", "steps", "subroot"))):
                tree, n = Tree([h.encode() for h in hashes], height(len(hashes), total)), len(hashes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(block << LEVELS) + i for i in range(n)], pa.int64()), pa.array([[s.decode() for s in tree.steps(i)] + steps for i in range(n)], pa.list_(pa.string())), pa.array([root] * n)],
                    names=["place", "last_steps", "root"],
                )

    ways = top_blocks.join(_side(to_root), ["tree", "block"]).select("block", "total", "hash", "steps", "subroot")
    ways = ways.mapInArrow(last, "place long, last_steps array<string>, root string")
    tops = keep(ways.join(top, "place").select(F.col("of").alias("tree"), "last_steps", F.col("root").alias("last_root")), "tops")
    joined = blocks.join(_side(above), ["tree", "block"]).join(_side(tops), "tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("tree", "block", "total", "hash", "doc_id", "changed", "steps", "last_steps", "subroot", "last_root")
        for batch in batches:
            for row in zip(*(column(batch, c).to_pylist() for c in names)):
                yield fold(*row)

    def fold(key, block, total, hashes, ids, changed, steps, last_steps, subroot, root) -> pa.RecordBatch:
        n = len(hashes)
        leaves = [h.encode() for h in hashes]
        tree = Tree(leaves, height(n, total))
        upper = [s.encode() for s in (*steps, *last_steps)]
        known: dict[bytes, str] = {}  # where block roots lead to
        own, ends = [], []
        for i in range(n):
            way = tree.steps(i)
            own.append([*(s.decode() for s in way), *steps, *last_steps])
            to = climb(leaves[i], way) if changed[i] is None else tree.hash[tree.version(i, changed[i].encode())]
            if to not in known:
                known[to] = climb(to, upper).decode()
            ends.append(known[to])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([key] * n, pa.binary()),
                pa.array([(block << LEVELS) + i for i in range(n)], pa.int64()),
                pa.array(hashes),
                pa.array(own, pa.list_(pa.string())),
                pa.array([subroot] * n),
                pa.array([root] * n),
                pa.array(changed, pa.string()),
                pa.array(ends),
            ],
            names=["doc_id", "tree", "place", "leaf", "steps", "subroot", "root", "changed", "folded_root"],
        )

    return joined.mapInArrow(run, "doc_id long, tree binary, place long, leaf string, steps array<string>, subroot string, root string, changed string, folded_root string")


def siblings(steps: str = "steps") -> Column:
    """The hashes of a leaf's siblings, from its own level upwards."""
    return F.transform(F.filter(steps, lambda s: s != "-"), lambda s: F.substring(s, 2, 64))
