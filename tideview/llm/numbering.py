"""Numbers 0, 1, ... within groups that no single task holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideview.llm.shared import keep, small
from tideview.llm.texts import column


def numbered(rows: DataFrame, by: str, number: str, total: str | None = None) -> DataFrame:
    """``rows`` with ``number``, each row's place in its group of equal ``by`` (not null), and the group's ``total``.

    The order is that of the partitions and of the rows in them. Each task numbers its own rows where they are written;
    one row for each task and group tells how many come before.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            coded = column(batch, by).dictionary_encode()
            codes, values = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            order = np.argsort(codes, kind="stable")
            first = np.searchsorted(codes[order], np.arange(len(values)))
            at = np.empty(len(codes), np.int64)
            at[order] = np.arange(len(codes)) - first[codes[order]] + np.array([seen.get(v, 0) for v in values], np.int64)[codes[order]]
            for v, n in zip(values, np.bincount(codes, minlength=len(values)).tolist()):
                seen[v] = seen.get(v, 0) + n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(codes), part, np.int32)), pa.array(at)], names=[*batch.schema.names, "_part", "_at"])

    made = keep(rows.mapInArrow(run, f"{fields}, _part int, _at long"), "numbered")
    sizes = made.groupBy(by, "_part").agg((F.max("_at") + 1).alias("n"))
    group = Window.partitionBy(by)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = keep(sizes.select(by, "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"), F.sum("n").over(group).alias("_total")), "starts")
    out = made.join(F.broadcast(starts) if small(starts) else starts, [by, "_part"])
    more = [] if total is None else [F.col("_total").alias(total)]
    return out.select(*rows.columns, (F.col("_start") + F.col("_at")).alias(number), *more)
