"""Where intermediate tables go, and how they are cut from their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The session's ``spark.checkpoint.dir`` names it. Where that is unset, only a local session gets a
    temporary folder; on a cluster executors could not see it, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tideview-llm-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Rows of a few numbers that are written to one file, where a kept table's size is known before.
FILE_ROWS = 20_000


def keep(df: DataFrame, name: str, rows: int | None = None, per_file: int = FILE_ROWS) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, and re-read after a loss.

    ``rows``: about as many as there can be, where that is known. So many go to few files, however many shuffle partitions
    there are. Each file costs several calls, and on a local file system Hadoop starts a process for each of them, which
    until it runs its own program counts as another copy of the executor's memory.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // per_file)))
    path = folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_mark(text: str = "text") -> Column:
    """128 bits of a text, null for null; with the id it tells a row from others of its id."""
    return F.unhex(F.md5(text))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its own columns of these names, in any case, renamed out of the way, and how to name them back."""
    wanted = {n.lower() for n in names}
    mine = [c for c in df.columns if c.lower() in wanted]
    new = free(df, *(f"_{c}" for c in mine))
    return df.withColumnsRenamed(dict(zip(mine, new))), dict(zip(new, mine))


#: Rows of two or three numbers that a broadcast may hold: some tens of MB.
SMALL_ROWS = 1_000_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Whether a kept table has at most so many rows, so that it may be broadcast."""
    return df.limit(rows + 1).count() <= rows
