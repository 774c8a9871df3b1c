"""A small hand-made source: logins with users and roles."""

from __future__ import annotations

from tideview.plans.spec import ViewSpec
from tideview.sources.change import CHANGE

LOGIN = ViewSpec.load(
    {
        "id": 1,
        "mvName": "login_mv",
        "masterTable": "login",
        "masterTablePk": "id",
        "masterWhereSql": "login_time > '2021-12-21 00:00:00'",
        "viewColList": [
            {"col": "user_name", "sourceTable": "user", "sourceCol": "name"},
            {"col": "user_info", "sourceTable": "user", "sourceCol": "info"},
            {"col": "role_name", "sourceTable": "role", "sourceCol": "name"},
            {"col": "login_time", "sourceTable": "login", "sourceCol": "login_time"},
            {"col": "note", "sourceTable": "login", "sourceCol": "login_note"},
        ],
        "viewLeftJoinList": [
            {"table": "user", "joinLeftCol": "user_id", "joinCol": "id"},
            {"table": "role", "joinLeftCol": "role_id", "joinCol": "id"},
        ],
    }
)
SCHEMAS = {
    "login": "id bigint, user_id bigint, role_id bigint, login_time timestamp_ntz, login_note string",
    "user": "id bigint, name string, info string",
    "role": "id bigint, name string",
}
ROWS = {
    "login": {
        1: (1, 10, 1, "2021-12-22 08:00:00", "a"),
        2: (2, 10, None, "2021-12-23 08:00:00", "it's ,) quoted"),
        3: (3, 99, 1, "2021-12-24 08:00:00", None),
        4: (4, 11, 2, "2021-12-20 08:00:00", "out of scope"),
    },
    "user": {10: (10, "Ann", "x"), 11: (11, "Bob", None)},
    "role": {1: (1, "admin"), 2: (2, "user")},
}
NAMES = {t: [c.split()[0] for c in s.split(", ")] for t, s in SCHEMAS.items()}


class Source:
    """Tables in memory that record each change made to them, as a log would."""

    def __init__(self, rows=ROWS):
        self.rows = {t: dict(r) for t, r in rows.items()}
        self.changes: list[tuple] = []
        self.offset = 0
        self.xid = 0

    def frames(self, spark):
        from pyspark.sql import functions as F

        out = {}
        for t, schema in SCHEMAS.items():
            plain = schema.replace("timestamp_ntz", "string")
            df = spark.createDataFrame(list(self.rows[t].values()), plain)
            for c in NAMES[t]:
                if f"{c} timestamp_ntz" in schema:
                    df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
            out[t] = df
        return out

    def _put(self, t, kind, data, old):
        text = lambda m: {k: None if v is None else str(v) for k, v in m.items()}
        self.offset += 10
        self.changes.append(
            ("shop", t, kind, 1700000000 + self.offset, None, self.xid, None, True, ("log.000001", 1, self.offset), None, 1,
             None, None, None, None, ["id"], text(data), text(old), None)
        )
        self.xid += 1

    def insert(self, t, *row):
        self.rows[t][row[0]] = row
        self._put(t, "insert", dict(zip(NAMES[t], row)), {})

    def delete(self, t, key):
        self._put(t, "delete", dict(zip(NAMES[t], self.rows[t].pop(key))), {})

    def update(self, t, key, **sets):
        was = dict(zip(NAMES[t], self.rows[t].pop(key)))
        now = {**was, **sets}
        self.rows[t][now["id"]] = tuple(now.values())
        self._put(t, "update", now, {c: was[c] for c in NAMES[t] if was[c] != now[c]})

    def take(self, spark, last=None):
        """The recorded changes as a frame; ``last`` takes the newest ones only."""
        rows = self.changes if last is None else self.changes[-last:]
        return spark.createDataFrame(rows, CHANGE)


class Shifted:
    """A part of a source for one scenario: its keys are moved by ``base`` so that many
    scenarios fit into one feed."""

    KEYS = {"login": ("id", "user_id", "role_id"), "user": ("id",), "role": ("id",)}

    def __init__(self, source, base):
        self.source, self.base = source, base
        for t, rows in ROWS.items():
            for row in rows.values():
                moved = self._row(t, row)
                source.rows[t][moved[0]] = moved

    def _row(self, t, row):
        at = {NAMES[t].index(k) for k in self.KEYS[t]}
        return tuple(v + self.base if i in at and v is not None else v for i, v in enumerate(row))

    def insert(self, t, *row):
        self.source.insert(t, *self._row(t, row))

    def delete(self, t, key):
        self.source.delete(t, key + self.base)

    def update(self, t, key, **sets):
        moved = {c: v + self.base if c in self.KEYS[t] and v is not None else v for c, v in sets.items()}
        self.source.update(t, key + self.base, **moved)


def rows_by_id(df):
    return {r["id"]: r.asDict() for r in df.collect()}
