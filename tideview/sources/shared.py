"""Where intermediate results go: a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared place that ``spark.checkpoint.dir`` names.

    Where it is unset a local session gets one temporary folder per process. On a cluster that folder would
    be another one on every machine, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _FALLBACK:
            _FALLBACK.append(tempfile.mkdtemp(prefix="tideview-"))
        root = _FALLBACK[0]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def shared_cut(spark: SparkSession, name: str) -> Callable[[DataFrame], DataFrame]:
    """Store a frame in the shared folder and read it back, so that it is computed once."""
    root = scratch(spark, name)

    def cut(df: DataFrame) -> DataFrame:
        path = f"{root}/{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return cut
