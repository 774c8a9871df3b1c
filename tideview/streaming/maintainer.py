"""Keeping views up to date from a change feed, in micro-batches."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import count
from threading import Lock

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideview.operators.feed import lacks_columns, mark_pending, net_changes, without_key
from tideview.operators.filters import Rule, feed_filter
from tideview.operators.heartbeats import RecoveryError, committed_position, progress, recover_position
from tideview.operators.hooks import drop_suppressed, with_hook
from tideview.operators.maintain import lookup_guard, relevant_changes, visible
from tideview.operators.schema_history import SCHEMA_EVENT_TYPES, breaking_deltas
from tideview.plans.build import UPDATED_TIME, build_view, count_source
from tideview.plans.spec import VIEW_KEY, LookupSpec, ViewSpec, other_keys, source_columns
from tideview.plans.spec import row_keys as known_by
from tideview.sources.change import CHANGE, ROW_TYPES, after_position, unfit_sql
from tideview.sources.feed import parse_lines, parse_schema_events, split_parsed
from tideview.sources.places import newest_first
from tideview.sources.tables import read_table
from tideview.streaming.store import Commit, Store, _View

_MIRROR = "src_"
_VIEW = "mv_"

#: Of each mirror row the place in the log of the change that set it, and whether that change deleted it.
_STAMP, _GONE = "_stamp", "_gone"
_STAMP_TYPE = (
    "struct<epoch:int,at:struct<pos:struct<file_seq:bigint,offset:bigint,ts_ms:bigint,xid:bigint,xoffset:bigint>,"
    "step:int,server:bigint>>"
)
_NO_KEY = "no usable key"


def _index(spec: ViewSpec, lk: LookupSpec) -> str:
    """Finds view rows by the lookup key of their master row."""
    return f"ix_{spec.name}_{lk.table}"


def _key_index(table: str, column: str) -> str:
    """Finds rows of a mirror by a column that is not its row key."""
    return f"kx_{table}_{column}"


class BuildError(RuntimeError):
    def __init__(self, view: str, cause: Exception):
        super().__init__(f"building {view} failed: {cause}")
        self.view, self.__cause__ = view, cause


class IncrementError(RuntimeError):
    """``rows``: the lines of the batch, readable while the error is told."""

    def __init__(self, view: str | None, batch_id: int, cause: Exception, rows: DataFrame | None = None):
        super().__init__(f"batch {batch_id} failed{f' on {view}' if view else ''}: {cause}")
        self.view, self.batch_id, self.rows = view, batch_id, rows


class UnfitValues(ValueError):
    """Values do not fit their column and were read as NULL. ``rows``: their changes as (value, reason), as in ``rejects``."""

    def __init__(self, count: int, rows: DataFrame):
        super().__init__(f"{count} changes hold values that do not fit their column")
        self.count, self.rows = count, rows


class SchemaChanged(RuntimeError):
    """A table or column that views need is gone."""


class Maintainer:
    """Builds views and follows the feed.

    ``sources``: per table a DataFrame or a ``read_table`` dict. ``feed``: a folder of JSON
    lines, or a function from the session to a streaming frame with a text column ``value``.
    ``store``: the folder that views, mirrors and progress are kept in.

    ``hook`` is a DataFrame function (see ``with_hook``), ``sinks`` are called with each batch
    of row changes (at least once: again after a lost commit, and with lines that are fed again),
    ``on_error(kind, view, error)`` hears of failures with kind ``build``, ``increment`` or ``other``, and, with kind
    ``value``, of changes whose values do not fit; increment and value errors have the ``rows``.

    Files may arrive in any order and more than once: each mirror row keeps the place in the log of
    the change that set it, deleted ones too, and only a newer change of its key replaces it. Places
    of different servers do not compare; between those the later arrival counts. With
    ``full_images=False`` a change older than its row's last one stops the batch with an error,
    since the columns it should still set are not known. With full images an absent column is an
    error too, unless ``absent_is_null`` says that the feed leaves NULLs out. Changes whose key is
    absent or unreadable go to ``rejects``.

    Views may know a table by different keys, as master or as lookup. Its mirror has one row key, ``row_keys`` or else
    the key of a view whose master it is; for each other column there is an index from it to the row key, which the net
    changes keep. Rows whose row key is NULL are in no view.
    """

    def __init__(
        self,
        spark: SparkSession,
        specs: list[ViewSpec],
        sources: dict[str, DataFrame | dict],
        feed: str | Callable[[SparkSession], DataFrame],
        store: str,
        *,
        rules: str | list[Rule] | None = None,
        hook: Callable[[DataFrame], DataFrame] | None = None,
        sinks: tuple[Callable[[DataFrame, int], None], ...] = (),
        on_error: Callable[[str, str | None, Exception], None] | None = None,
        full_images: bool = True,
        absent_is_null: bool = False,
        row_keys: dict[str, str] | None = None,
        secret_key: str | None = None,
        start_position: tuple[int, int] | None = None,
        feed_options: dict | None = None,
        buckets: int = 64,
        compact_after: int = 8,
        workers: int = 8,
        dry_run: bool = False,
    ):
        self.spark, self.specs = spark, list(specs)
        self.sources = {t: s if isinstance(s, DataFrame) else read_table(spark, s) for t, s in sources.items()}
        for s in self.specs:
            s.validate(self.sources)
        self.feed, self.store_path = feed, store.rstrip("/")
        self.store = Store(spark, store, buckets=buckets, compact_after=compact_after)
        stored = {n.removeprefix(_MIRROR): t["key"] for n, t in self.store.manifest()["tables"].items() if n.startswith(_MIRROR)}
        self.keys = known_by(self.specs, {**(row_keys or {}), **stored})
        self.found_by = other_keys(self.specs, {t: self.keys[t] for s in self.specs for t in s.tables})
        self.columns = source_columns(self.specs, self.sources)
        for t, cols in self.columns.items():
            if self.keys[t] not in cols:
                cols.append(self.keys[t])
        self.rules, self.hook, self.sinks, self.on_error = rules, hook, tuple(sinks), on_error
        self.full_images, self.secret_key, self.start_position = full_images, secret_key, start_position
        self.absent_is_null = absent_is_null
        self.feed_options = {k: str(v) for k, v in (feed_options or {}).items()}
        self.workers, self.dry_run = workers, dry_run
        self.query = None
        self._trigger: dict = {"processingTime": "1 second"}

    # -- full builds -------------------------------------------------------------------

    def build_runs(self) -> DataFrame:
        """Registered builds: one row per view of the configuration that was ever started, as far as it is."""
        rows = [
            (b["view_id"], b["view"], b["status"], b["total_rows"], b["inserted_rows"], b["started_at"], b["completed_at"], b.get("error"))
            for b in self.store.state().get("builds", [])
        ]
        return self.spark.createDataFrame(
            rows,
            "view_id int, view string, status string, total_rows bigint, inserted_rows bigint, "
            "started_at double, completed_at double, error string",
        )

    def build_log(self) -> DataFrame:
        """All that was ever noted of builds, in order: started, counted, complete or failed."""
        return self.spark.createDataFrame(
            [(b["view_id"], b["view"], b["status"], b["rows"], b["at"]) for b in self.store.state().get("build_log", [])],
            "view_id int, view string, status string, rows bigint, at double",
        )

    def unfinished(self) -> list[ViewSpec]:
        done = {b["view_id"] for b in self.store.state().get("builds", []) if b["status"] == "complete"}
        return [s for s in self.specs if s.id not in done]

    @staticmethod
    def _note(c: Commit, run: dict) -> None:
        """Set the row of a build and add what changed to the log of builds."""
        c.state["builds"] = [*(b for b in c.state.get("builds", []) if b["view_id"] != run["view_id"]), run]
        rows = run["inserted_rows"] if run["status"] == "complete" else run["total_rows"]
        seen = {"view_id": run["view_id"], "view": run["view"], "status": run["status"], "rows": rows, "at": time.time()}
        c.state["build_log"] = [*c.state.get("build_log", []), seen]

    def build(self) -> None:
        """Build the views that have no complete build.

        The feed's position is taken first, then tables are copied; changes after that position
        are applied again later, which does no harm since applying sets rows by key. The copies are published together with
        a started row for each view; then each view is published alone as soon as it is complete, whatever becomes of the
        others. A view that fails keeps its row, with the error, and is built again by the next call; changes are not followed
        before all views stand.
        """
        todo = self.unfinished()
        if not todo:
            return
        c = self.store.begin()
        if not c.m["tables"]:
            c.state["start"] = list(self.start_position or self.feed_end() or ()) or None
            c.state["started_views"] = [s.id for s in self.specs]
        else:
            # mirrors hold only the columns of the views they were made for, and what made a build fail may be mended
            tried = {b["view_id"] for b in c.state.get("builds", [])}
            again = {t for s in todo if s.id in tried for t in s.tables}
            again |= {t for t, cols in self.columns.items() if _MIRROR + t in c.m["tables"] and set(cols) - set(c.schema(_MIRROR + t).names)}
            self._copy_again(c, again)
            c.state["started_views"] = [s.id for s in self.specs]
        for t, cols in self.columns.items():
            if _MIRROR + t not in c.m["tables"]:
                rows = self.sources[t].select(*cols).filter(F.col(self.keys[t]).isNotNull())
                unset = F.lit(None).cast(_STAMP_TYPE).alias(_STAMP)
                c.replace(_MIRROR + t, rows.select("*", unset, F.lit(False).alias(_GONE)), self.keys[t])
        mirrors = {t: self._rows(c, t) for t in self.columns}
        for t, cols in self.found_by.items():
            for col in cols:
                if _key_index(t, col) not in c.m["tables"]:
                    c.replace_index(_key_index(t, col), mirrors[t].select(self.keys[t], col).filter(F.col(col).isNotNull()), col)
        runs = {}
        for spec in todo:
            runs[spec.id] = {
                "view_id": spec.id, "view": spec.name, "status": "started", "total_rows": None, "inserted_rows": None,
                "started_at": time.time(), "completed_at": None,
            }
            self._note(c, runs[spec.id])
        if not self.dry_run:
            c.publish()
        turn = Lock()

        def publish(run: dict, made: dict | None = None) -> None:
            """One commit for what is new of one view; the views' threads take turns."""
            with turn:
                own = c if self.dry_run else self.store.begin()
                own.m["tables"].update(made or {})
                self._note(own, run)
                if not self.dry_run:
                    own.publish()

        def one(spec: ViewSpec) -> Exception | None:
            run = runs[spec.id]
            try:
                tables = mirrors | {spec.master: self._keyed(spec, mirrors[spec.master])}
                lookup_guard(spec, tables)
                run = run | {"status": "counted", "total_rows": count_source(spec, tables).first()["total_rows"]}
                publish(run)
                own = c if self.dry_run else self.store.begin()
                seen = Observation()
                rows = build_view(spec, tables, match_columns=True).observe(seen, F.count(F.lit(1)).alias("n"))
                own.replace(_VIEW + spec.name, self._stamped(rows), VIEW_KEY)
                for lk in spec.lookups:
                    pairs = own.read(_VIEW + spec.name).select(VIEW_KEY, lk.match_column)
                    own.replace_index(_index(spec, lk), pairs.filter(F.col(lk.match_column).isNotNull()), lk.match_column)
                names = [_VIEW + spec.name, *(_index(spec, lk) for lk in spec.lookups)]
                run = run | {"status": "complete", "inserted_rows": seen.get["n"], "completed_at": time.time()}
                publish(run, {n: own.m["tables"][n] for n in names})
            except Exception as e:
                publish(run | {"status": "failed", "error": str(e).splitlines()[0][:500] if str(e) else type(e).__name__})
                self._tell("build", spec.name, e)
                return BuildError(spec.name, e)

        with ThreadPoolExecutor(self.workers) as pool:
            failed = [e for e in pool.map(inheritable_thread_target(self.spark)(self._pooled(one)), todo) if e is not None]
        if failed:
            raise failed[0]

    def _copy_again(self, c: Commit, tables: set[str]) -> None:
        """Copy mirrors again: a view was added that needs more columns, or a build failed.

        The copy keeps the stamps, so changes that were applied before do not come back, and those
        that the copy holds already are applied again, to the other views as well, when they arrive.
        """
        for t in sorted(tables):
            name, key = _MIRROR + t, self.keys[t]
            # a key that is not unique in the copy before would stay so
            old = c.read(name).groupBy(F.col(key).alias("_old_key")).agg(F.max(_STAMP).alias(_STAMP))
            new = self.sources[t].select(*self.columns[t]).filter(F.col(key).isNotNull())
            named = [F.coalesce(key, "_old_key").alias(key) if n == key else F.col(n) for n in self.columns[t]]
            both = new.join(old, F.col(key) == F.col("_old_key"), "full_outer")
            c.replace(name, both.select(*named, _STAMP, F.col(key).isNull().alias(_GONE)), key)
            for col in self.found_by[t]:
                c.m["tables"].pop(_key_index(t, col), None)  # made anew

    @staticmethod
    def _rows(view: _View, table: str, keys: DataFrame | None = None, *, touched: set[int] | None = None) -> DataFrame:
        """A source table as mirrored, without stamps and deleted rows."""
        return view.read(_MIRROR + table, keys, touched=touched).filter(~F.col(_GONE)).drop(_STAMP, _GONE)

    @staticmethod
    def _schema(view: _View, table: str) -> T.StructType:
        return T.StructType([f for f in view.schema(_MIRROR + table).fields if f.name not in (_STAMP, _GONE)])

    def forget_deleted(self, before: tuple[int, int]) -> None:
        """Drop the marks of rows deleted at or before a position. From then on changes up to that
        position are not applied any more, so all of them must have arrived."""
        c = self.store.begin()
        at = F.col(f"{_STAMP}.at.pos")
        old = (at["file_seq"] < before[0]) | ((at["file_seq"] == before[0]) & (at["offset"] <= before[1]))
        for t in self.columns:
            c.replace(_MIRROR + t, c.read(_MIRROR + t).filter(~(F.col(_GONE) & F.coalesce(old, F.lit(False)))), self.keys[t])
        c.state["start"] = list(max(tuple(before), tuple(c.state.get("start") or before)))
        c.publish()

    def _pooled(self, fn):
        def run(spec):
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", spec.name)
            return fn(spec)

        return run

    @staticmethod
    def _stamped(rows: DataFrame) -> DataFrame:
        return rows.withColumn(UPDATED_TIME, F.current_timestamp())

    def feed_end(self) -> tuple[int, int] | None:
        """Newest committed position now in the feed folder; None for an empty or unseen feed."""
        if not isinstance(self.feed, str):
            return None
        newest = lambda changes: committed_position(changes).filter("file_seq IS NOT NULL").orderBy(F.desc("file_seq"), F.desc("offset")).first()
        row, _ = newest_first(self.spark, self.feed, newest, key=self.secret_key)
        return (row["file_seq"], row["offset"]) if row else None

    def recover(self, heartbeat: int | None = None) -> tuple[int, int]:
        """After a fail-over to another server: resume where its feed, now in the feed folder,
        holds the last heartbeat that was read."""
        c = self.store.begin()
        want = heartbeat if heartbeat is not None else c.state.get("heartbeat")
        found = None
        if want is not None:
            found, _ = newest_first(self.spark, self.feed, lambda changes: recover_position(changes, want).first(), key=self.secret_key)
        if found is None:
            raise RecoveryError(f"the feed does not hold heartbeat {want}")
        c.state["start"], c.state["positions"] = [found["file_seq"], found["offset"]], {}
        c.state["epoch"] = c.state.get("epoch", 0) + 1  # places of the feed before do not compare
        c.publish()
        return found["file_seq"], found["offset"]

    # -- following the feed ------------------------------------------------------------

    def _lines(self) -> DataFrame:
        if isinstance(self.feed, str):
            return self.spark.readStream.options(**self.feed_options).text(self.feed)
        return self.feed(self.spark).select("value")

    def start(self, **trigger) -> "Maintainer":
        """Build what is missing, then follow; by default a batch about every second."""
        self._trigger = trigger or self._trigger
        self.build()
        return self.resume()

    def resume(self) -> "Maintainer":
        if self.query is None or not self.query.isActive:
            where = f"{self.store_path}/checkpoint" + ("-dry" if self.dry_run else "")
            self.query = (
                self._lines()
                .writeStream.foreachBatch(self._batch)
                .option("checkpointLocation", where)
                .trigger(**self._trigger)
                .start()
            )
        return self

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()

    def run_available(self) -> None:
        """Apply everything that is in the feed now and stop."""
        self.start(availableNow=True)
        self.query.awaitTermination()

    def supervise(self, *, wait: float = 10.0, attempts: int | None = None, **trigger) -> None:
        """Follow the feed and start again ``wait`` seconds after a failure."""
        n = 0
        while True:
            try:
                self.start(**trigger)
                self.query.awaitTermination()
                return
            except Exception as e:
                n += 1
                if not isinstance(e, BuildError):
                    self._tell("other", None, e)
                if attempts is not None and n >= attempts:
                    raise
                time.sleep(wait)

    def view(self, name: str) -> DataFrame:
        return visible(self.store.read(_VIEW + name)).drop(UPDATED_TIME)

    def rejects(self) -> DataFrame | None:
        return self.store.read_log("_rejects")

    def _tell(self, kind: str, view: str | None, error: Exception) -> None:
        if self.on_error is not None:
            self.on_error(kind, view, error)

    def _batch(self, lines: DataFrame, batch_id: int) -> None:
        try:
            self.apply_batch(lines, batch_id)
        except Exception as e:
            view = getattr(e, "view", None)
            error = IncrementError(view, batch_id, e, lines)
            self._tell("increment", view, error)
            raise error from e

    def apply_batch(self, lines: DataFrame, batch_id: int, source: str = "feed") -> None:
        """Apply one batch of JSON lines; a batch that was applied before changes nothing."""
        c = self.store.begin()
        if c.state.get("batches", {}).get(source, -1) >= batch_id:
            return
        # The batch is written once to the shared store: later steps read it several times, and
        # they run in the main session, where adaptive execution is on.
        seen = Observation()
        rows = parse_lines(lines.select("value"), key=self.secret_key).observe(
            seen, F.count_if(F.col("reason").isNotNull()).alias("others")
        )
        changes, others = split_parsed(c.scratch("parsed", rows))
        rejects = []
        if seen.get["others"]:
            # schema events have no row image, so they are among the lines that are no row changes
            lost = breaking_deltas(parse_schema_events(others), self.columns).limit(1).collect()
            if lost:
                raise SchemaChanged(f"{lost[0]['table']}: {lost[0]['reason']}")
            about_schema = F.coalesce(F.get_json_object("value", "$.type").isin(*SCHEMA_EVENT_TYPES), F.lit(False))
            rejects.append(others.filter(~about_schema))
        if self.rules is not None:
            changes = changes.filter(feed_filter(self.rules))
        changes = after_position(changes, tuple(c.state["start"]) if c.state.get("start") else None)
        if self.hook is not None:
            changes = with_hook(changes, self.hook)
        else:
            changes = changes.withColumn("suppressed", F.lit(False))
        changes = changes.select(*CHANGE.names, "suppressed")
        held = c.read_log("_pending")
        if held is not None:
            changes = held.unionAll(changes)
        if self.hook is not None:
            changes = c.scratch("changes", changes)
        changes = changes.withColumn("_late", self._late(c))
        marked = mark_pending(changes, late="_late").persist(StorageLevel.MEMORY_AND_DISK)
        ready, pending = marked.filter(~F.col("_pending")).drop("_pending"), marked.filter("_pending").drop("_pending")
        if pending.isEmpty():
            c.m["logs"].pop("_pending", None)
        else:
            c.log("_pending", pending.drop("_late"), append=False)
        try:
            for p in progress(ready).collect():
                if p["file_seq"] is not None:
                    stored = c.state.setdefault("positions", {})
                    newest = [p["file"], p["file_seq"], p["offset"]]
                    stored[str(p["server_id"])] = max(newest, stored.get(str(p["server_id"]), newest), key=lambda x: x[1:])
                if p["heartbeat"] is not None:
                    c.state["heartbeat"] = max(p["heartbeat"], c.state.get("heartbeat", 0))
            kept = drop_suppressed(ready)
            seen_late = self._checked(c, kept, rejects)
            if rejects:
                c.log("_rejects", reduce(DataFrame.unionAll, rejects))
            self._apply(c, relevant_changes(kept, self.specs, self._mirrors(c), self.keys), seen_late)
            c.state.setdefault("batches", {})[source] = batch_id
            if self.dry_run:
                return
            for name in list(c.m["tables"]):
                c.compact(name)
            for sink in self.sinks:
                sink(kept.drop("suppressed", "_late"), batch_id)
            c.publish()
        finally:
            marked.unpersist()

    def _mirrors(self, c: Commit) -> dict[str, DataFrame]:
        return {t: self.spark.createDataFrame([], self._schema(c, t)) for t in self.columns}

    @staticmethod
    def _late(c: Commit) -> Column:
        """Is the row at or below the newest position applied for its server, so replayed or out of
        order? There is one branch per server."""
        late, p = F.lit(False), F.col("position")
        for server, (_, seq, offset) in c.state.get("positions", {}).items():
            below = (p["file_seq"] < seq) | ((p["file_seq"] == seq) & (p["offset"] <= offset))
            late = late | ((F.coalesce("server_id", F.lit(0)) == int(server)) & F.coalesce(below, F.lit(False)))
        return late

    def _checked(self, c: Commit, changes: DataFrame, rejects: list[DataFrame]) -> bool:
        """Look at the batch once: are there late rows, rows without a key, images that lack columns, values that do not fit?"""
        no_key, lacking, unfit = F.lit(False), F.lit(False), F.array().cast("array<struct<column:string,type:string,value:string>>")
        for t, cols in self.columns.items():
            schema = self._schema(c, t)
            no_key = no_key | without_key(t, self.keys[t], schema[self.keys[t]].dataType)
            lacking = lacking | lacks_columns(t, cols)
            unfit = F.when((F.col("table") == t) & F.col("type").isin(*ROW_TYPES), F.expr(unfit_sql("data", schema))).otherwise(unfit)
        unfits = ~no_key & (F.size(unfit) > 0)
        found = changes.agg(
            F.count_if("_late").alias("late"), F.count_if(no_key).alias("no_key"), F.count_if(lacking & ~no_key).alias("lacking"),
            F.count_if(unfits).alias("unfit"),
        ).first()
        text = F.to_json(F.struct(*CHANGE.names)).alias("value")
        if found["no_key"]:
            rejects.append(changes.filter(no_key).select(text, F.lit(_NO_KEY).alias("reason")))
        if found["unfit"]:
            each = F.transform(unfit, lambda u: F.concat(F.col("table"), F.lit("."), u["column"], F.lit(" "), u["type"], F.lit(": "), u["value"]))
            rows = changes.filter(unfits).select(text, F.concat(F.lit("does not fit: "), F.array_join(each, "; ")).alias("reason"))
            rejects.append(rows)
            self._tell("value", None, UnfitValues(found["unfit"], rows))
        if found["lacking"] and self.full_images and not self.absent_is_null:
            raise ValueError(
                f"{found['lacking']} row images lack columns; set full_images=False, or absent_is_null=True "
                "for a feed that leaves NULLs out"
            )
        return found["late"] > 0

    def _apply(self, c: Commit, changes: DataFrame, late: bool) -> None:
        """Net changes into the mirrors, then each view that reads a changed table."""
        found = [r["table"] for r in changes.select("table").distinct().collect()]

        def mirror(t: str) -> DataFrame:
            schema, key, current = self._schema(c, t), self.keys[t], None
            if not self.full_images:
                mine = changes.filter(F.col("table") == t)
                # a row that moved continues the stored row of its old key
                keys = F.filter(F.array(*(F.col(image)[key].try_cast(schema[key].dataType) for image in ("data", "old"))), lambda k: k.isNotNull())
                current = self._rows(c.before, t, mine.select(F.explode(keys).alias("k")))
            number = count()
            net = net_changes(
                changes, t, key, schema, current=current, stamp="_at", cut=lambda df: c.scratch(f"moves_{t}_{next(number)}", df)
            )
            # in a batch without late rows every change is newer than all that was applied
            return self._set_rows(c, t, self._newest(c, t, net) if late else net)

        def one(spec: ViewSpec) -> None:
            try:
                self._apply_view(c, spec, net)
            except Exception as e:
                e.view = spec.name
                raise

        touched = [s for s in self.specs if set(s.tables) & set(found)]
        with ThreadPoolExecutor(self.workers) as pool:
            thread = inheritable_thread_target(self.spark)
            net = dict(zip(found, pool.map(thread(mirror), found)))
            list(pool.map(thread(self._pooled(one)), touched))

    def _newest(self, c: Commit, table: str, net: DataFrame) -> DataFrame:
        """Net changes that are newer than the change that set their row."""
        if not self.full_images:
            net = c.scratch(f"late_{table}", net)
        stored = c.before.read(_MIRROR + table, net.select("_key"))
        stored = stored.select(F.col(self.keys[table]).alias("_stored_key"), F.col(_STAMP).alias("_old"))
        joined = net.join(stored, F.col("_key") == F.col("_stored_key"), "left")
        new, old = F.col("_at"), F.col("_old.at")
        epoch = F.lit(c.state.get("epoch", 0))
        newer = (
            old.isNull()
            | (F.col("_old.epoch") < epoch)
            | (old["server"] != new["server"])
            | new["pos"]["file_seq"].isNull()
            | (F.struct(new["pos"], new["step"]) > F.struct(old["pos"], old["step"]))
        )
        if not self.full_images and joined.filter(~newer).limit(1).count():
            raise ValueError(f"changes of {table} arrive after newer ones of the same row; images that lack columns need log order")
        return joined.filter(newer).select(*net.columns)

    def _set_rows(self, c: Commit, table: str, net: DataFrame) -> DataFrame:
        """Write net changes with their stamps, deletions as rows too, and give them back as stored."""
        name, key = _MIRROR + table, self.keys[table]
        stamp = F.struct(F.lit(c.state.get("epoch", 0)).alias("epoch"), F.col("_at").alias("at")).cast(_STAMP_TYPE)
        cols = [F.col("_key").alias(key) if n == key else F.col(n) for n in self._schema(c, table).names]
        c.change(name, net.select(*cols, stamp.alias(_STAMP), F.col("_deleted").alias(_GONE)))
        own = c.own_delta(name).drop("_deleted", _STAMP)
        own = own.withColumnRenamed(_GONE, "_deleted").withColumn("_key", F.col(key))
        for col in self.found_by[table]:
            c.change(_key_index(table, col), own.filter(~F.col("_deleted") & F.col(col).isNotNull()))
        return own

    def _apply_view(self, c: Commit, spec: ViewSpec, net: dict[str, DataFrame]) -> None:
        name = _VIEW + spec.name
        parts = []
        if spec.master in net:
            own = self._changed_values(c, spec.master, spec.pk, net[spec.master]).withColumnRenamed("_value", VIEW_KEY)
            parts.append(own)
        for lk in spec.lookups:
            if lk.table in net:
                keys = self._changed_values(c, lk.table, lk.key, net[lk.table])
                stored = c.read_index(_index(spec, lk), keys)
                hit = stored.join(keys, F.col(lk.match_column) == F.col("_value"), "left_semi")
                parts.append(hit.select(VIEW_KEY))
        ids = c.scratch(f"ids_{spec.name}", reduce(DataFrame.unionAll, parts))
        master = c.scratch(f"master_{spec.name}", self._found(c, spec.master, spec.pk, ids))
        tables = {spec.master: master}
        for lk in spec.lookups:
            tables[lk.table] = self._found(c, lk.table, lk.key, master.select(lk.master_column))
        c.change(name, self._stamped(build_view(spec, tables, match_columns=True)), ids)
        if spec.master in net:
            # only a change of the master row can give it another lookup key
            written = c.own_delta(name).filter(~F.col("_deleted"))
            moved = written.join(own.select(F.col(VIEW_KEY).alias("_own")), F.col(VIEW_KEY) == F.col("_own"), "left_semi")
            for lk in spec.lookups:
                c.change(_index(spec, lk), moved.filter(F.col(lk.match_column).isNotNull()))

    def _keyed(self, spec: ViewSpec, master: DataFrame) -> DataFrame:
        """Master rows that have the view's key."""
        return master if spec.pk == self.keys[spec.master] else master.filter(F.col(spec.pk).isNotNull())

    def _found(self, c: Commit, table: str, by: str, keys: DataFrame) -> DataFrame:
        """A mirror's rows whose column ``by`` is one of ``keys``; only buckets that may hold one of them are read."""
        if by == self.keys[table]:
            return self._rows(c, table, keys, touched=c.touched(_MIRROR + table, keys))
        wanted = c.scratch(f"wanted_{table}_{uuid.uuid4().hex[:8]}", keys.select(F.col(keys.columns[0]).alias("_wanted")).distinct())
        pairs = c.read_index(_key_index(table, by), wanted).join(wanted, F.col(by) == F.col("_wanted"), "left_semi")
        ids = pairs.select(self.keys[table]).distinct()
        rows = self._rows(c, table, ids, touched=c.touched(_MIRROR + table, ids))
        # the index may hold pairs that no longer apply
        return rows.join(wanted, F.col(by) == F.col("_wanted"), "left_semi")

    def _changed_values(self, c: Commit, table: str, by: str, net: DataFrame) -> DataFrame:
        """Values (_value) of a column that finds rows which the changed rows had before the batch or have after it."""
        if by == self.keys[table]:
            return net.select(F.col("_key").alias("_value"))
        before = self._rows(c.before, table, net.select("_key")).select(F.col(by).alias("_value"))
        after = net.filter(~F.col("_deleted")).select(F.col(by).alias("_value"))
        if self._found(c, table, by, after.filter("_value IS NOT NULL")).groupBy(by).count().filter("count > 1").limit(1).collect():
            raise ValueError(f"keys of {table}.{by} are not unique any more")
        return before.unionAll(after).filter(F.col("_value").isNotNull())
