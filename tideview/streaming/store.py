"""Where views and source mirrors live: keyed tables with atomic, versioned commits.

A table is a base, split into hash buckets of its key, and a short list of deltas. A batch
writes only what it changed, as one more delta; after a number of deltas the buckets they touch
are rewritten. A commit is one small manifest that names the files of every table together with
the progress of the feed, so views, mirrors and progress move in one step. A manifest is never
replaced: of two writers that start from the same version one is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideview.streaming.fs import Conflict, Files



class Store:
    def __init__(self, spark: SparkSession, root: str, *, buckets: int = 64, compact_after: int = 8):
        self.spark = spark
        self.files = Files(spark, root)
        self.buckets = buckets
        self.compact_after = compact_after

    # -- reading -----------------------------------------------------------------------

    def manifest(self) -> dict:
        names = [n for n in self.files.names("manifests") if n.endswith(".json")]
        if not names:
            return {"version": 0, "buckets": self.buckets, "tables": {}, "logs": {}, "state": {}}
        return json.loads(self.files.read(f"manifests/{names[-1]}"))

    def read(self, name: str, keys: DataFrame | None = None) -> DataFrame:
        """A table as of the last commit; ``keys`` (one column) narrows it to those keys."""
        return _View(self, self.manifest()).read(name, keys)

    def read_log(self, name: str) -> DataFrame | None:
        return _View(self, self.manifest()).read_log(name)

    def state(self) -> dict:
        return self.manifest()["state"]

    def begin(self) -> "Commit":
        return Commit(self)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete runs that none of the last ``keep`` manifests names and no open commit can."""
        names = [n for n in self.files.names("manifests") if n.endswith(".json")]
        if not names:
            return []
        live: set[str] = set()
        for n in names[-keep:]:
            m = json.loads(self.files.read(f"manifests/{n}"))
            for name, t in m["tables"].items():
                live |= {f"{name}/base/run={r}" for r in t["base"].values()} | {f"{name}/delta/run={r}" for r in t["deltas"]}
            for name, log in m["logs"].items():
                live |= {f"{name}/log/run={r}" for r in log["runs"]}
        newest = int(names[-1].split(".")[0])
        gone = []
        for top in self.files.names("data"):
            for part in self.files.names(f"data/{top}"):
                for run in self.files.names(f"data/{top}/{part}"):
                    version = int(run.removeprefix("run=r").split("-")[0])
                    if f"{top}/{part}/{run}" not in live and version <= newest:
                        self.files.delete(f"data/{top}/{part}/{run}")
                        gone.append(f"{top}/{part}/{run}")
        return gone


class _View:
    """Tables as one manifest describes them."""

    def __init__(self, store: Store, manifest: dict):
        self.store = store
        self.spark = store.spark
        self.m = manifest

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.m["buckets"]).cast("bigint")).cast("int")

    def schema(self, name: str) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.m["tables"][name]["schema"]))

    def _base(self, name: str, touched: set[int] | None) -> DataFrame:
        t = self.m["tables"][name]
        root = self.store.files.path(f"data/{name}/base")
        paths = [
            f"{root}/run={run}/_bucket={b}" for b, run in t["base"].items() if touched is None or int(b) in touched
        ]
        schema = self.schema(name)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _deltas(self, name: str) -> DataFrame | None:
        """All delta rows with ``_deleted`` and ``_version``, not yet folded."""
        runs = self.m["tables"][name]["deltas"]
        if not runs:
            return None
        schema = T.StructType([*self.schema(name).fields, T.StructField("_deleted", T.BooleanType())])
        root = self.store.files.path(f"data/{name}/delta")
        df = self.spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/run={r}" for r in runs])
        return df.withColumn(
            "_version", F.regexp_extract(F.col("_metadata.file_path"), r"/run=r(\d+)-", 1).cast("bigint")
        ).select(*schema.names, "_version")

    def touched(self, name: str, keys: DataFrame) -> set[int] | None:
        """Buckets of a table that a set of keys (one column) falls in: at most as many numbers as
        there are buckets. None, for all of them, when the keys are of another kind of type."""
        want, have = self.schema(name)[self._by(name)].dataType, keys.schema[0].dataType
        if want != have and not (isinstance(want, T.IntegralType) and isinstance(have, T.IntegralType)):
            return None
        key = F.col(keys.columns[0]).try_cast(want)
        return {r[0] for r in keys.select(self.bucket(key).alias("b")).distinct().collect()}

    def _by(self, name: str) -> str:
        """The column a table's buckets are cut by."""
        t = self.m["tables"][name]
        return t.get("by") or t["key"]

    def read_index(self, name: str, keys: DataFrame) -> DataFrame:
        """Rows of an index that may hold the given keys: only the buckets those fall in."""
        base, deltas = self._base(name, self.touched(name, keys)), self._deltas(name)
        return base if deltas is None else base.unionAll(deltas.select(*base.columns))

    def read(self, name: str, keys: DataFrame | None = None, *, touched: set[int] | None = None) -> DataFrame:
        t = self.m["tables"][name]
        key = t["key"]
        base, deltas = self._base(name, touched), self._deltas(name)
        if keys is not None:
            # repeats are folded before the shuffle, so a key asked for very often costs little
            wanted = keys.select(F.col(keys.columns[0]).alias("_wanted")).distinct()
            base = base.join(wanted, F.col(key) == F.col("_wanted"), "left_semi")
            if deltas is not None:
                deltas = deltas.join(wanted, F.col(key) == F.col("_wanted"), "left_semi")
        if deltas is None:
            return base
        names = self.schema(name).names
        if touched is not None:
            deltas = deltas.filter(self.bucket(F.col(key)).isin(sorted(touched)) if touched else F.lit(False))
        # within one version a written row stands against a deletion of its key
        order = F.struct("_version", (~F.col("_deleted")).alias("_written"))
        latest = deltas.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*names, "_deleted"), order).alias("_l"))
        kept = base.join(latest.select("_k"), F.col(key) == F.col("_k"), "left_anti")
        return kept.unionAll(latest.filter(~F.col("_l._deleted")).select(*[F.col(f"_l.{n}").alias(n) for n in names]))

    def read_log(self, name: str) -> DataFrame | None:
        log = self.m["logs"].get(name)
        if not log or not log["runs"]:
            return None
        schema = T.StructType.fromJson(json.loads(log["schema"]))
        root = self.store.files.path(f"data/{name}/log")
        return self.spark.read.schema(schema).parquet(*[f"{root}/run={r}" for r in log["runs"]])


class Commit(_View):
    """One set of writes that becomes visible at once by ``publish``.

    Reads through a commit see its own writes; ``before`` reads what it started from.
    """

    def __init__(self, store: Store):
        super().__init__(store, store.manifest())
        self.before = _View(store, self.m)
        self.m = json.loads(json.dumps(self.m))
        self.version = self.m["version"] + 1
        self.run = f"r{self.version}-{uuid.uuid4().hex[:12]}"
        self.state = self.m["state"]

    def scratch(self, name: str, df: DataFrame) -> DataFrame:
        """Write an intermediate result to the shared store and read it back. The files of
        earlier commits' scratch are left to ``vacuum``."""
        path = self.store.files.path(f"data/_work/{name}/run={self.run}")
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def replace(self, name: str, df: DataFrame, key: str) -> None:
        """Set a table's whole content."""
        self.m["tables"][name] = {"key": key, "schema": json.dumps(df.schema.jsonValue()), "base": {}, "deltas": []}
        self._write_base(name, df)

    def replace_index(self, name: str, df: DataFrame, by: str) -> None:
        """Set an index: rows found by ``by``, which need not be unique.

        Entries are only ever added, so it may hold some that no longer apply; readers use it to
        find rows that may be concerned.
        """
        schema = json.dumps(df.schema.jsonValue())
        self.m["tables"][name] = {"key": df.columns[0], "by": by, "schema": schema, "base": {}, "deltas": []}
        self._write_base(name, df)

    def _write_base(self, name: str, df: DataFrame) -> None:
        t = self.m["tables"][name]
        rel = f"data/{name}/base/run={self.run}"
        by = self._by(name)
        out = df.withColumn("_bucket", self.bucket(F.col(by)))
        # rebalancing keeps a bucket together unless it is too large for one task
        out = out.hint("rebalance", F.col("_bucket")).sortWithinPartitions("_bucket", by)
        out.write.mode("overwrite").partitionBy("_bucket").parquet(self.store.files.path(rel))
        for n in self.store.files.names(rel):
            if n.startswith("_bucket="):
                t["base"][n.removeprefix("_bucket=")] = self.run

    def change(self, name: str, written: DataFrame, deleted: DataFrame | None = None) -> None:
        """Add a delta: rows written, and keys (one column) deleted. A key in both is written."""
        t, schema = self.m["tables"][name], self.schema(name)
        out = written.select(*schema.names, F.lit(False).alias("_deleted"))
        if deleted is not None:
            key = F.col(deleted.columns[0]).cast(schema[t["key"]].dataType)
            out = out.unionAll(
                deleted.select(
                    *[(key if n == t["key"] else F.lit(None).cast(schema[n].dataType)).alias(n) for n in schema.names],
                    F.lit(True).alias("_deleted"),
                )
            )
        self._write_delta(name, out)

    def own_delta(self, name: str) -> DataFrame:
        """The delta this commit wrote, with ``_deleted``."""
        stored = T.StructType([*self.schema(name).fields, T.StructField("_deleted", T.BooleanType())])
        return self.spark.read.schema(stored).parquet(self.store.files.path(f"data/{name}/delta/run={self.run}"))

    def _write_delta(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self.store.files.path(f"data/{name}/delta/run={self.run}"))
        self.m["tables"][name]["deltas"].append(self.run)

    def compact(self, name: str, *, force: bool = False) -> bool:
        """Fold the deltas into the buckets they touch once there are enough of them."""
        t = self.m["tables"][name]
        if not t["deltas"] or (len(t["deltas"]) < self.store.compact_after and not force):
            return False
        touched = self.touched(name, self._deltas(name).select(self._by(name)))
        if t.get("by"):
            base = self._base(name, touched)
            merged = base.unionAll(self._deltas(name).select(*base.columns)).distinct()
        else:
            merged = self.read(name, touched=touched)
        t["base"] = {b: r for b, r in t["base"].items() if int(b) not in touched}
        deltas, t["deltas"] = t["deltas"], []
        try:
            self._write_base(name, merged)
        except Exception:
            t["deltas"] = deltas
            raise
        return True

    def log(self, name: str, df: DataFrame, *, append: bool = True) -> None:
        """Append rows to an unkeyed table, or with ``append=False`` set its content."""
        df.write.mode("overwrite").parquet(self.store.files.path(f"data/{name}/log/run={self.run}"))
        old = self.m["logs"].get(name, {"runs": []})["runs"] if append else []
        self.m["logs"][name] = {"schema": json.dumps(df.schema.jsonValue()), "runs": [*old, self.run]}

    def publish(self) -> int:
        self.m["version"] = self.version
        self.store.files.put_new(f"manifests/{self.version:012d}.json", json.dumps(self.m))
        return self.version


__all__ = ["Commit", "Conflict", "Store"]
