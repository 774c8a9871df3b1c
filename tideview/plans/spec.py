"""View definitions: plain driver-side configuration, checked against source schemas."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VIEW_KEY = "id"


class SpecError(ValueError):
    """A view definition that cannot be served."""


@dataclass(frozen=True)
class ColumnSpec:
    """One view column ``name`` taken from ``table.column``."""

    name: str
    table: str
    column: str


@dataclass(frozen=True)
class LookupSpec:
    """``master LEFT JOIN table ON master.master_column = table.key``.

    ``pk`` is the lookup's own primary key when that is not the join column. ``salt`` > 1
    spreads each join key over that many reducers (the lookup is replicated as often); leave
    it at 1 unless a few master keys are known to be very hot and the lookup is too large to
    broadcast.
    """

    table: str
    master_column: str
    key: str
    pk: str | None = None
    salt: int = 1

    @property
    def row_key(self) -> str:
        return self.pk or self.key

    @property
    def match_column(self) -> str:
        """Hidden view column with the master's side of the join key."""
        return f"_mk_{self.table}"


@dataclass(frozen=True)
class ViewSpec:
    id: int
    name: str
    master: str
    pk: str
    columns: tuple[ColumnSpec, ...]
    lookups: tuple[LookupSpec, ...] = field(default_factory=tuple)
    where: str = ""

    @classmethod
    def load(cls, conf: dict) -> "ViewSpec":
        """Build a view from a dict; both snake_case and dashed or camelCase keys are read."""
        c = {_snake(k): v for k, v in conf.items()}
        pk = c.get("pk", c.get("master_table_pk"))
        if isinstance(pk, (list, tuple)):
            if len(pk) != 1:
                raise SpecError("the master key must be a single column")
            pk = pk[0]
        columns = []
        for raw in c.get("columns", c.get("view_col_list")) or []:
            col = {_snake(k): v for k, v in raw.items()}
            columns.append(
                ColumnSpec(
                    col.get("name", col.get("col")),
                    col.get("table", col.get("source_table")),
                    col.get("column", col.get("source_col")),
                )
            )
        lookups = []
        for raw in c.get("lookups", c.get("view_left_join_list")) or []:
            lk = {_snake(k): v for k, v in raw.items()}
            lookups.append(
                LookupSpec(
                    lk["table"],
                    lk.get("master_column", lk.get("join_left_col")),
                    lk.get("key", lk.get("join_col")),
                    lk.get("pk"),
                    int(lk.get("salt", 1)),
                )
            )
        spec = cls(
            int(c["id"]),
            c.get("name", c.get("mv_name")),
            c.get("master", c.get("master_table")),
            pk,
            tuple(columns),
            tuple(lookups),
            (c.get("where", c.get("master_where_sql")) or "").strip(),
        )
        spec.check_shape()
        return spec

    # -- derived names ---------------------------------------------------------------

    @property
    def tables(self) -> list[str]:
        return [self.master, *(lk.table for lk in self.lookups)]

    def lookup(self, table: str) -> LookupSpec | None:
        return next((lk for lk in self.lookups if lk.table == table), None)

    def row_key(self, table: str) -> str:
        """The column by which rows of ``table`` are told apart."""
        if table == self.master:
            return self.pk
        lk = self.lookup(table)
        if lk is None:
            raise SpecError(f"{table} is not used by view {self.name}")
        return lk.row_key

    def output_columns(self) -> list[ColumnSpec]:
        """View columns in order, the key first, with missing lookup keys appended."""
        out = [ColumnSpec(VIEW_KEY, self.master, self.pk)]
        out += [c for c in self.columns if (c.table, c.column) != (self.master, self.pk)]
        chosen = {(c.table, c.column) for c in out}
        for lk in self.lookups:
            if (lk.table, lk.key) not in chosen:
                out.append(ColumnSpec(f"{lk.table}_{lk.key}", lk.table, lk.key))
        return out

    def used_columns(self, table: str) -> list[str]:
        """Columns of ``table`` the view reads, without those named only in WHERE."""
        used = [c.column for c in self.output_columns() if c.table == table]
        if table == self.master:
            used += [lk.master_column for lk in self.lookups]
        lk = self.lookup(table)
        if lk is not None:
            used += [lk.row_key, lk.key]
        return list(dict.fromkeys(used))

    # -- checks ----------------------------------------------------------------------

    def check_shape(self) -> None:
        if not (self.name and self.master and self.pk):
            raise SpecError("a view needs a name, a master table and the master's key")
        joined = [lk.table for lk in self.lookups]
        for t in joined:
            if t == self.master or joined.count(t) > 1:
                raise SpecError(f"view {self.name}: table {t} is joined more than once")
        for c in self.columns:
            if c.table not in self.tables:
                raise SpecError(f"view {self.name}: column {c.name} comes from unknown table {c.table}")
        names = [c.name for c in self.output_columns()]
        for n in names:
            if names.count(n) > 1:
                raise SpecError(f"view {self.name}: two columns are named {n}")
            if n.startswith("_mk_"):
                raise SpecError(f"view {self.name}: column names must not start with _mk_")

    def validate(self, tables: dict[str, DataFrame]) -> "ViewSpec":
        """Check tables, columns and the WHERE text against the real schemas."""
        for t in self.tables:
            if t not in tables:
                raise SpecError(f"view {self.name}: no table {t}")
            known = {c.lower() for c in tables[t].columns}
            for c in self.used_columns(t):
                if c.lower() not in known:
                    raise SpecError(f"view {self.name}: no column {t}.{c}")
        if self.where:
            try:
                tables[self.master].alias(self.master).filter(F.expr(self.where)).schema
            except AnalysisException as e:
                raise SpecError(f"view {self.name}: bad where text: {e}") from e
        return self

    def where_columns(self, master: DataFrame) -> list[str]:
        """Master columns whose name occurs in the WHERE text.

        A word inside a string literal may be taken for a column; that only makes more changes
        count as relevant.
        """
        words = {w.lower() for w in re.findall(r"\w+", self.where)}
        return [c for c in master.columns if c.lower() in words]

    def relevant_columns(self, table: str, master: DataFrame | None = None) -> list[str]:
        """Columns whose change can change the view: used ones and, for the master, WHERE ones."""
        cols = self.used_columns(table)
        if table == self.master and self.where:
            if master is None:
                raise SpecError("the master's schema is needed to list WHERE columns")
            cols = list(dict.fromkeys(cols + self.where_columns(master)))
        return cols


def load_views(confs: list[dict]) -> list[ViewSpec]:
    """Load several views and check that ids and names are unique."""
    specs = [ViewSpec.load(c) for c in confs]
    for what in ("id", "name"):
        seen = [getattr(s, what) for s in specs]
        if len(set(seen)) != len(seen):
            raise SpecError(f"view {what}s must be unique")
    return specs


def source_columns(specs: list[ViewSpec], tables: dict[str, DataFrame]) -> dict[str, list[str]]:
    """Per source table, the columns that any of the views depends on."""
    needed: dict[str, list[str]] = {}
    for spec in specs:
        for t in spec.tables:
            have = needed.setdefault(t, [])
            have += [c for c in spec.relevant_columns(t, tables.get(spec.master)) if c not in have]
    return needed


def row_keys(specs: list[ViewSpec], given: dict[str, str] | None = None) -> dict[str, str]:
    """Per source table the one column by which its rows are told apart, however many views know it by another one.

    A given key comes first, then the key of a view whose master it is, then the ``pk`` of a lookup, then a join column.
    """
    keys = dict(given or {})
    for wanted in (
        lambda s, t: s.pk if t == s.master else None,
        lambda s, t: s.lookup(t).pk if t != s.master else None,
        lambda s, t: s.row_key(t),
    ):
        for s in specs:
            for t in s.tables:
                if t not in keys and wanted(s, t):
                    keys[t] = wanted(s, t)
    return keys


def other_keys(specs: list[ViewSpec], keys: dict[str, str]) -> dict[str, list[str]]:
    """Per source table the columns by which views find its rows, apart from the row key."""
    out: dict[str, list[str]] = {t: [] for t in keys}
    for s in specs:
        for t in s.tables:
            by = s.pk if t == s.master else s.lookup(t).key
            if by != keys[t] and by not in out[t]:
                out[t].append(by)
    return out


def _snake(key: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", key).replace("-", "_").lower()
