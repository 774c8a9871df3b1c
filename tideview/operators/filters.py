"""Feed filters: table and column-value rules, column dropping, relevance to views."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideview.plans.spec import ViewSpec
from tideview.sources.change import typed_changes


class FilterError(ValueError):
    """Rule text that cannot be read."""


@dataclass(frozen=True)
class Pattern:
    """``*``, an exact name, or an unanchored regular expression."""

    kind: str  # any | name | regex
    text: str = ""

    def matches(self, value: Column) -> Column:
        if self.kind == "any":
            return F.lit(True)
        return value == F.lit(self.text) if self.kind == "name" else value.rlike(self.text)


@dataclass(frozen=True)
class Rule:
    kind: str  # include | exclude | blacklist
    database: Pattern
    table: Pattern
    column: str | None = None
    value: Pattern | None = None

    def applies(self, database: Column, table: Column) -> Column:
        """A NULL name (a change that has no table) matches every pattern."""
        return (database.isNull() | self.database.matches(database)) & (table.isNull() | self.table.matches(table))

    def value_matches(self, data: Column) -> Column:
        v = data[self.column]
        if self.value.kind == "name" and self.value.text.lower() == "null":
            hit = v.isNull() | v.isin("null", "NULL")
        elif self.value.kind == "any":
            hit = F.lit(True)
        else:
            hit = F.coalesce(self.value.matches(v), F.lit(False))
        return F.coalesce(F.map_contains_key(data, F.lit(self.column)), F.lit(False)) & hit


_NAME = r"(?:/(?:[^/\\]|\\.)*/|\*|`[^`]*`|'[^']*'|\"[^\"]*\"|[\w\-$]+)"
_RULE = re.compile(
    rf"\s*(?P<kind>\w+)\s*:\s*(?P<db>{_NAME})\s*\.\s*(?P<tbl>{_NAME})"
    rf"(?:\s*\.\s*(?P<col>\w+)\s*=\s*(?P<val>{_NAME}))?\s*(?:,|$)"
)


def parse_rules(text: str) -> list[Rule]:
    """Rules such as ``exclude: *.*, include: shop./^ord/, exclude: *.*.status=N``."""
    rules, at = [], 0
    while text[at:].strip():
        m = _RULE.match(text, at)
        if m is None:
            raise FilterError(f"cannot read filter rule at: {text[at:]!r}")
        kind = m["kind"].lower()
        if kind not in ("include", "exclude", "blacklist"):
            raise FilterError(f"unknown filter keyword: {m['kind']}")
        value = _pattern(m["val"]) if m["col"] else None
        rules.append(Rule(kind, _pattern(m["db"]), _pattern(m["tbl"]), m["col"], value))
        at = m.end()
    return rules


def _pattern(token: str) -> Pattern:
    if token == "*":
        return Pattern("any")
    if token[0] == "/":
        return Pattern("regex", token[1:-1])
    return Pattern("name", token[1:-1] if token[0] in "`'\"" else token)


def rules_from_options(
    *,
    filter: str | None = None,
    include_dbs: str | None = None,
    exclude_dbs: str | None = None,
    include_tables: str | None = None,
    exclude_tables: str | None = None,
    blacklist_dbs: str | None = None,
    blacklist_tables: str | None = None,
    include_column_values: str | None = None,
) -> list[Rule]:
    """Rules from separate lists, for use where there is no ``filter`` text.

    The last rule that matches a change decides, so the lists stand here from the weakest to the strongest: a table list
    over a database list, excluding over including, values of columns over both. Blacklists decide by themselves,
    wherever they stand. A list that names what to include excludes all the rest.
    """
    if filter:
        return parse_rules(filter)
    everything = Pattern("any")

    def database(name: Pattern) -> tuple[Pattern, Pattern]:
        return name, everything

    def table(name: Pattern) -> tuple[Pattern, Pattern]:
        return everything, name

    strength = (
        ("blacklist", database, _listed(blacklist_dbs)),
        ("blacklist", table, _listed(blacklist_tables)),
        ("exclude", database, [everything] if include_dbs or include_tables else []),
        ("include", database, _listed(include_dbs)),
        ("exclude", database, _listed(exclude_dbs)),
        ("include", table, _listed(include_tables)),
        ("exclude", table, _listed(exclude_tables)),
    )
    rules = [Rule(kind, *scope(name)) for kind, scope, listed in strength for name in listed]
    for column, value in _listed_values(include_column_values):
        # rows that have the column stay only with that value
        rules.append(Rule("exclude", everything, everything, column, everything))
        rules.append(Rule("include", everything, everything, column, value))
    return rules


_ITEM = re.compile(rf"\s*(?:(?P<col>\w+)\s*=\s*)?(?P<name>{_NAME})\s*(?:,|$)")


def _items(text: str | None) -> list[tuple[str | None, Pattern]]:
    """The entries of a comma list; a comma inside ``/regex/`` or quotes separates nothing."""
    out, at = [], 0
    while text and text[at:].strip():
        m = _ITEM.match(text, at)
        if m is None:
            raise FilterError(f"cannot read list at: {text[at:]!r}")
        out.append((m["col"], _pattern(m["name"])))
        at = m.end()
    return out


def _listed(text: str | None) -> list[Pattern]:
    items = _items(text)
    if any(column for column, _ in items):
        raise FilterError(f"a list of names holds a value: {text!r}")
    return [name for _, name in items]


def _listed_values(text: str | None) -> list[tuple[str, Pattern]]:
    items = _items(text)
    if not all(column for column, _ in items):
        raise FilterError(f"a list of column values holds a bare name: {text!r}")
    return items


def feed_filter(rules: str | list[Rule], data: str = "data") -> Column:
    """True for changes the rules let through.

    Rules start from include and the last one that matches decides. A column-value rule only
    concerns rows that carry its column. The built-in exclusions always hold.
    """
    rules = parse_rules(rules) if isinstance(rules, str) else rules
    db, tbl = F.col("database"), F.col("table")
    verdict = F.lit(True)
    for r in rules:
        hit = r.applies(db, tbl)
        if r.column is not None:
            hit = hit & r.value_matches(F.col(data))
        verdict = F.when(hit, F.lit(r.kind == "include")).otherwise(verdict)
    return table_filter(rules) & verdict


def table_filter(rules: str | list[Rule]) -> Column:
    """The part of the verdict that needs only database and table, for use close to the scan.

    A table that the table rules exclude is kept when an include rule on a column value could
    still let some of its rows through.
    """
    rules = parse_rules(rules) if isinstance(rules, str) else rules
    db, tbl = F.col("database"), F.col("table")
    verdict, rescue = F.lit(True), F.lit(False)
    for r in rules:
        if r.column is None:
            verdict = F.when(r.applies(db, tbl), F.lit(r.kind == "include")).otherwise(verdict)
        elif r.kind == "include":
            rescue = rescue | r.applies(db, tbl)
    return ~system_excluded() & (verdict | rescue)


def system_excluded() -> Column:
    """Fixed names: tables of the server's own health checks."""
    t = F.coalesce("table", F.lit(""))
    return F.coalesce(F.col("database") == "mysql", F.lit(False)) & (
        (t == "ha_health_check") | t.startswith("rds_heartbeat")
    )


def table_blacklisted(rules: str | list[Rule]) -> Column:
    """True for changes of blacklisted tables: only table rules of that kind are looked at."""
    rules = parse_rules(rules) if isinstance(rules, str) else rules
    hit = system_excluded()
    for r in rules:
        if r.kind == "blacklist" and r.column is None:
            hit = hit | r.applies(F.col("database"), F.col("table"))
    return hit


def database_blacklisted(rules: str | list[Rule]) -> Column:
    """True when a whole database is blacklisted (its table pattern is ``*``)."""
    rules = parse_rules(rules) if isinstance(rules, str) else rules
    hit = F.lit(False)
    for r in rules:
        if r.kind == "blacklist" and r.table.kind == "any" and r.column is None:
            hit = hit | F.coalesce(r.database.matches(F.col("database")), F.lit(False))
    return hit


def drop_columns(df: DataFrame, patterns: str) -> DataFrame:
    """Drop columns from both images by a comma list of names or ``/regex/`` (whole name)."""
    exprs = []
    for token in re.findall(r"/(?:[^/\\]|\\.)*/|[^,]+", patterns):
        token = token.strip()
        if token:
            exprs.append(token[1:-1] if token.startswith("/") and token.endswith("/") else re.escape(token))
    if not exprs:
        return df
    whole = "^(?:" + "|".join(f"(?:{e})" for e in exprs) + ")$"
    for image in ("data", "old"):
        df = df.withColumn(image, F.map_filter(image, lambda k, v: ~k.rlike(whole)))
    return df


def in_scope(changes: DataFrame, spec: ViewSpec, schema: T.StructType, image: str = "data") -> DataFrame:
    """Master changes with ``_in_scope``: whether the chosen image satisfies the view's WHERE."""
    rows = typed_changes(changes, spec.master, schema, image)
    scope = F.coalesce(F.expr(spec.where).cast("boolean"), F.lit(False)) if spec.where else F.lit(True)
    return rows.select("_change.*", scope.alias("_in_scope"))


def touches_view(relevant: list[str]) -> Column:
    """False only for updates that change no column the view depends on."""
    changed = F.arrays_overlap(F.map_keys("old"), F.array(*[F.lit(c) for c in relevant]))
    return (F.col("type") != "update") | F.coalesce(changed, F.lit(False))


def used_by_views(specs: list[ViewSpec]) -> Column:
    """True for changes of tables that some view reads."""
    return F.col("table").isin(sorted({t for s in specs for t in s.tables}))
