"""Incremental view maintenance by affected keys.

A batch of changes is folded to its net effect per table. The master keys it can touch are the
changed master keys, old and new, and the keys of view rows whose stored match column equals a
changed lookup key. Those view rows are dropped and built again from the updated tables, so
after each batch the view equals a full build, whatever the kinds and order of the changes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideview.operators.feed import net_changes
from tideview.operators.filters import touches_view, used_by_views
from tideview.plans.build import build_view
from tideview.plans.spec import VIEW_KEY, ViewSpec


def relevant_changes(
    changes: DataFrame, specs: Iterable[ViewSpec], tables: dict[str, DataFrame], row_keys: dict[str, str] | None = None
) -> DataFrame:
    """Drop changes of unused tables and updates that touch no column any view depends on, nor the table's row key."""
    specs = list(specs)
    keep = F.lit(False)
    for t in sorted({t for s in specs for t in s.tables}):
        cols = {c for s in specs if t in s.tables for c in s.relevant_columns(t, tables.get(s.master))}
        cols = sorted(cols | ({row_keys[t]} if row_keys else set()))
        keep = keep | ((F.col("table") == t) & touches_view(cols))
    return changes.filter(used_by_views(specs) & keep)


def net_by_table(
    spec: ViewSpec,
    tables: dict[str, DataFrame],
    changes: DataFrame,
    *,
    full_images: bool = True,
    cut: Callable[[DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Net effect of the changes for each table of the view."""
    return {
        t: net_changes(
            changes, t, spec.row_key(t), tables[t].schema, current=None if full_images else tables[t], cut=cut
        )
        for t in spec.tables
    }


def update_table(table: DataFrame, net: DataFrame, key: str) -> DataFrame:
    """A source table after its net changes: changed keys out, surviving images in."""
    changed = net.select(F.col("_key").alias("_changed"))
    kept = table.join(changed, F.col(key) == F.col("_changed"), "left_anti")
    return kept.unionAll(net.filter(~F.col("_deleted")).select(*table.columns))


def changed_lookup_keys(spec: ViewSpec, table: str, tables: dict[str, DataFrame], net: DataFrame) -> DataFrame:
    """Join keys of a lookup that the changes may have given up or taken on."""
    lk = spec.lookup(table)
    if lk.row_key == lk.key:
        return net.select(F.col("_key").alias("_lk"))
    ids = net.select(F.col("_key").alias("_changed"))
    before = tables[table].join(ids, F.col(lk.row_key) == F.col("_changed"), "left_semi").select(F.col(lk.key).alias("_lk"))
    after = net.filter(~F.col("_deleted")).select(F.col(lk.key).alias("_lk"))
    return before.unionAll(after).filter(F.col("_lk").isNotNull())


def view_rows_on_keys(view: DataFrame, spec: ViewSpec, table: str, keys: DataFrame) -> DataFrame:
    """Ids of view rows whose master points at one of the lookup keys (one column)."""
    lk = spec.lookup(table)
    wanted = keys.select(F.col(keys.columns[0]).alias("_lk"))
    return (
        view.select(VIEW_KEY, lk.match_column)
        .join(wanted, F.col(lk.match_column) == F.col("_lk"), "left_semi")
        .select(VIEW_KEY)
    )


def affected_ids(
    spec: ViewSpec,
    view: DataFrame,
    changes: DataFrame,
    tables: dict[str, DataFrame],
    *,
    net: dict[str, DataFrame] | None = None,
    only: Iterable[str] | None = None,
) -> DataFrame:
    """Ids the changes can touch; repeats are allowed since the result only feeds semi and anti
    joins. ``view`` must carry its match columns. ``only`` limits the lookups looked at."""
    net = net or net_by_table(spec, tables, changes)
    ids = net[spec.master].select(F.col("_key").alias(VIEW_KEY))
    for lk in spec.lookups:
        if only is None or lk.table in only:
            keys = changed_lookup_keys(spec, lk.table, tables, net[lk.table])
            ids = ids.unionAll(view_rows_on_keys(view, spec, lk.table, keys))
    return ids


def master_rows_to_build(spec: ViewSpec, tables: dict[str, DataFrame], net: dict[str, DataFrame], on_lookups: DataFrame | None) -> DataFrame:
    """The master rows, after the changes, whose view rows are affected.

    Changed rows come from their net changes, so the table itself is read only for the unchanged rows that changed lookup keys
    concern, ``on_lookups`` (one column), if there are any.
    """
    table, changed = tables[spec.master], net[spec.master]
    rows = changed.filter(~F.col("_deleted")).select(*table.columns)
    if on_lookups is None:
        return rows
    lo, hi = on_lookups.agg(F.min(VIEW_KEY), F.max(VIEW_KEY)).first()
    # the range reaches the scan, which skips files and row groups without such keys
    near = table.filter(F.col(spec.pk).between(F.lit(lo), F.lit(hi)))
    wanted = on_lookups.select(F.col(on_lookups.columns[0]).alias("_wanted")).distinct()
    others = near.join(wanted, F.col(spec.pk) == F.col("_wanted"), "left_semi")
    others = others.join(changed.select(F.col("_key").alias("_changed")), F.col(spec.pk) == F.col("_changed"), "left_anti")
    return rows.unionAll(others.select(*table.columns))


def narrowed_lookups(spec: ViewSpec, after: dict[str, DataFrame], master: DataFrame) -> tuple[dict[str, DataFrame], int]:
    """The lookups' rows that ``master``, stored rows, points at, and how many rows that are. One aggregation sums up the keys: their range
    reaches the scans, and the keys themselves, folded, a semi join whose size is known when it runs."""
    ends = [f(lk.master_column).alias(f"{n}_{lk.table}") for lk in spec.lookups for n, f in (("lo", F.min), ("hi", F.max))]
    seen = master.agg(F.count(F.lit(1)).alias("n"), *ends).first()
    out = {}
    for lk in spec.lookups:
        keys = master.select(F.col(lk.master_column).alias("_wanted")).distinct()
        near = after[lk.table].filter(F.col(lk.key).between(F.lit(seen[f"lo_{lk.table}"]), F.lit(seen[f"hi_{lk.table}"])))
        out[lk.table] = near.join(keys, F.col(lk.key) == F.col("_wanted"), "left_semi")
    return out, seen["n"]


def apply_changes(
    spec: ViewSpec,
    view: DataFrame,
    tables: dict[str, DataFrame],
    changes: DataFrame,
    *,
    full_images: bool = True,
    cut: Callable[[DataFrame], DataFrame] | None = None,
    rebuild_above: float | None = None,
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Bring a view and its source tables up to date: (view after, tables after).

    ``view`` is a build with ``match_columns=True`` on ``tables``, the tables before the
    changes; the result can be passed in again with the next batch.

    The net changes and the affected ids are each used several times. ``cut`` stores such a
    frame and returns it as a source, for example ``lambda df: df.checkpoint()``; without it
    they are computed again at each use, which suits small batches only. With it the scans are narrowed as well: the
    master is read only for rows that lookups concern, lookups only for keys that are needed.
    Where more than ``rebuild_above`` of the master's rows are affected, the view is built anew on the tables after
    the changes instead, which gives the same rows.
    """
    rows, ids, after = view_delta(spec, view, tables, changes, full_images=full_images, cut=cut, rebuild_above=rebuild_above)
    if ids is None:
        return rows, after
    touched = ids.select(F.col(VIEW_KEY).alias("_touched"))
    kept = view.join(touched, F.col(VIEW_KEY) == F.col("_touched"), "left_anti")
    return kept.select(*rows.columns).unionAll(rows), after


def view_delta(
    spec: ViewSpec,
    view: DataFrame,
    tables: dict[str, DataFrame],
    changes: DataFrame,
    *,
    full_images: bool = True,
    cut: Callable[[DataFrame], DataFrame] | None = None,
    rebuild_above: float | None = None,
) -> tuple[DataFrame, DataFrame | None, dict[str, DataFrame]]:
    """What a batch makes of a view, for a sink by key: (rows to write, ids to delete before, tables after).

    With ``cut`` the view is read only for its match columns, and only if lookups changed, so the cost is that of the
    batch. Ids are None when all rows are to be replaced. The arguments are those of ``apply_changes``.
    """
    changes = relevant_changes(changes, [spec], tables)
    net = net_by_table(spec, tables, changes, full_images=full_images, cut=cut)
    if cut is not None:
        stored = inheritable_thread_target(changes.sparkSession)(cut)
        with ThreadPoolExecutor(len(net)) as pool:
            net = dict(zip(net, pool.map(stored, net.values())))
    after = dict(tables)
    for t in spec.tables:
        after[t] = update_table(tables[t], net[t], spec.row_key(t))
    if cut is None:
        ids = affected_ids(spec, view, changes, tables, net=net)
        return build_view(spec, after, keys=ids, match_columns=True), ids, after
    parts = []
    for lk in spec.lookups:
        if not net[lk.table].isEmpty():
            parts.append(view_rows_on_keys(view, spec, lk.table, changed_lookup_keys(spec, lk.table, tables, net[lk.table])))
    hit = cut(reduce(DataFrame.unionAll, parts)) if parts else None
    hit = None if hit is None or hit.isEmpty() else hit
    master = cut(master_rows_to_build(spec, tables, net, hit))
    lookups, n = narrowed_lookups(spec, after, master)
    if rebuild_above is not None and n > rebuild_above * tables[spec.master].count():
        return build_view(spec, after, match_columns=True), None, after
    ids = net[spec.master].select(F.col("_key").alias(VIEW_KEY))
    ids = ids if hit is None else ids.unionAll(hit)
    return build_view(spec, {spec.master: master, **lookups}, match_columns=True), ids, after


def visible(view: DataFrame) -> DataFrame:
    """A view without its hidden match columns."""
    return view.select(*[c for c in view.columns if not c.startswith("_mk_")])


def route(changes: DataFrame, specs: list[ViewSpec], tables: dict[str, DataFrame]) -> DataFrame:
    """One row per (change, view that must see it), with the part the table plays there.

    The map of tables to views has one row per table and view of the configuration, which is
    what bounds the broadcast side.
    """
    spark = changes.sparkSession
    rows = [
        (t, s.id, s.name, "master" if t == s.master else "lookup", s.relevant_columns(t, tables.get(s.master)))
        for s in specs
        for t in s.tables
    ]
    schema = "_table string, view_id int, view string, role string, _relevant array<string>"
    targets = spark.createDataFrame(rows, schema)
    touched = (F.col("type") != "update") | F.coalesce(F.arrays_overlap(F.map_keys("old"), "_relevant"), F.lit(False))
    return (
        changes.join(F.broadcast(targets), (F.col("table") == F.col("_table")) & touched)
        .drop("_table", "_relevant")
    )


def lookup_guard(spec: ViewSpec, tables: dict[str, DataFrame], *, mode: str = "fail") -> dict[str, DataFrame]:
    """Enforce one lookup row per key.

    ``fail`` raises when a key repeats; ``quarantine`` returns tables whose repeated lookup
    keys are left out entirely, so the master rows stay with NULLs.
    """
    from tideview.plans.build import duplicate_lookup_keys

    dup = duplicate_lookup_keys(spec, tables)
    if mode == "fail":
        bad = dup.limit(5).collect()
        if bad:
            shown = ", ".join(f"{r['lookup']}.{r['key']} x{r['n']}" for r in bad)
            raise ValueError(f"view {spec.name}: lookup keys are not unique: {shown}")
        return tables
    if mode != "quarantine":
        raise ValueError("mode must be fail or quarantine")
    out = dict(tables)
    for lk in spec.lookups:
        t = tables[lk.table]
        keys = dup.filter(F.col("lookup") == lk.table).select(F.col("key").cast(t.schema[lk.key].dataType).alias("_dup"))
        out[lk.table] = t.join(keys, F.col(lk.key) == F.col("_dup"), "left_anti")
    return out
