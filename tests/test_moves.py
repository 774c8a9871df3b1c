"""Rows that change their key in images that lack columns, and values carried along long groups."""

import random

import pytest
from pyspark.sql import functions as F

from tideview.operators.feed import net_changes
from tideview.operators.moves import chain_moves
from tideview.operators.ordered import carry
from tideview.sources.change import as_changes
from tideview.sources.shared import shared_cut

SCHEMA = "k long, a string, b int, c string"
FEED = "type string, file_seq long, offset long, data map<string,string>, old map<string,string>"


def _feed(spark, lines):
    df = spark.createDataFrame(lines, FEED)
    place = F.struct(F.concat(F.lit("log."), F.lpad(F.col("file_seq").cast("string"), 6, "0")).alias("file"), "file_seq", "offset")
    return as_changes(df.select(F.lit("t").alias("table"), "type", place.alias("position"), F.lit(1).cast("long").alias("server_id"), "data", "old"))


def _text(row, names):
    return {n: None if row[n] is None else str(row[n]) for n in names}


def _simulated(seed, steps=250):
    """A stored table, a feed of slim images, and the table that it leads to, row by row."""
    rnd = random.Random(seed)
    value = lambda: rnd.choice([None, *"xyz"])
    start = {k: {"k": k, "a": value(), "b": rnd.choice([None, k]), "c": value()} for k in range(12)}
    now, lines, at = {k: dict(r) for k, r in start.items()}, [], 0

    def log(kind, data, old=None):
        nonlocal at
        at += rnd.choice([1, 1, 40])
        lines.append((kind, 1 + at // 900, at, data, old or {}))

    def move(k, to, **sets):
        row = now.pop(k)
        old = {"k": k} | {n: row[n] for n in sets}
        row.update(k=to, **sets)
        now[to] = row
        log("update", _text(row, ["k", *sets]), _text(old, old))

    for _ in range(steps):
        free = [k for k in range(20) if k not in now]
        what = rnd.choice(["set", "set", "move", "swap", "delete", "insert", "temp"])
        if what == "insert" and free:
            k = rnd.choice(free)
            now[k] = {"k": k, "a": value(), "b": rnd.choice([None, at]), "c": value()}
            log("insert", _text(now[k], rnd.choice([["k", "a", "b", "c"], ["k", "a"]])))
            if len(lines[-1][3]) == 2:  # what an insert leaves out is NULL
                now[k].update(b=None, c=None)
        elif not now:
            continue
        elif what == "delete":
            k = rnd.choice(sorted(now))
            log("delete", _text(now.pop(k), ["k", "a"]))
        elif what == "set":
            k = rnd.choice(sorted(now))
            n = rnd.choice("abc")
            old, now[k][n] = now[k][n], at if n == "b" else value()
            log("update", _text(now[k], ["k", n]), {n: None if old is None else str(old)})
        elif what == "move" and free:
            move(rnd.choice(sorted(now)), rnd.choice(free), **rnd.choice([{}, {"c": value()}]))
        elif what == "temp":  # a key that many rows pass
            k = rnd.choice(sorted(now))
            move(k, 99)
            move(99, k, **rnd.choice([{}, {"b": at}]))
        elif what == "swap" and len(now) > 1:
            x, y = rnd.sample(sorted(now), 2)
            move(x, 99, a="swapped")
            move(y, x)
            move(99, y)
    return start, lines, now


def _state(stored, net):
    out = dict(stored)
    for r in net:
        out.pop(r["_key"], None)
        if not r["_deleted"]:
            out[r["_key"]] = {n: r[n] for n in "kabc"}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_moves_equal_row_by_row(spark, seed):
    start, lines, want = _simulated(seed)
    stored = spark.createDataFrame([tuple(r.values()) for r in start.values()], SCHEMA)
    fed = lines + random.Random(seed).sample(lines, 60)  # some lines come twice
    net = net_changes(_feed(spark, fed).repartition(5), "t", "k", stored.schema, current=stored).collect()
    assert len({r["_key"] for r in net}) == len(net)
    assert _state(start, net) == want


def test_batches_of_moves_equal_one_batch(spark):
    start, lines, want = _simulated(7, 120)
    state = start
    for a in range(0, len(lines), 45):
        stored = spark.createDataFrame([tuple(r[n] for n in "kabc") for r in state.values()], SCHEMA)
        state = _state(state, net_changes(_feed(spark, lines[a : a + 45]), "t", "k", stored.schema, current=stored).collect())
    assert state == want


def test_what_a_moved_row_leaves_and_meets(spark):
    """A new row on the left key takes nothing from the old one; a row moved onto another takes its place."""
    stored = spark.createDataFrame([(1, "a1", 1, "c1"), (2, "a2", 2, "c2")], SCHEMA)
    lines = [
        ("update", 1, 1, {"k": "3"}, {"k": "1"}),
        ("insert", 1, 2, {"k": "1", "a": "new"}, {}),
        ("update", 1, 3, {"k": "2", "c": "moved"}, {"k": "3", "c": "c1"}),
        ("update", 1, 4, {"k": "7", "a": "unseen"}, {"k": "6", "a": "x"}),
    ]
    net = net_changes(_feed(spark, lines), "t", "k", stored.schema, current=stored).collect()
    assert _state({}, net) == {1: {"k": 1, "a": "new", "b": None, "c": None}, 2: {"k": 2, "a": "a1", "b": 1, "c": "moved"}, 7: {"k": 7, "a": "unseen", "b": None, "c": None}}
    assert sorted(r["_key"] for r in net if r["_deleted"]) == [3, 6]


def test_long_chains_take_few_rounds(spark):
    n, made = 1000, []

    def cut(df):
        made.append(1)
        return shared_cut(spark, "chain")(df)

    moves = spark.range(1, n + 1).selectExpr("cast(id AS string) AS stretch", "cast(id - 1 AS string) AS first", "CASE WHEN id = 1 THEN 42L END AS origin")
    chains = chain_moves(moves, cut).collect()
    assert len(chains) == n and {(r["first"], r["origin"]) for r in chains} == {("0", 42)}
    assert len(made) <= 13


@pytest.mark.parametrize("slot", [1, 16, 1 << 26])
@pytest.mark.parametrize("inclusive", [False, True])
def test_carried_values_do_not_depend_on_slots(spark, slot, inclusive):
    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), f, o, rnd.choice([None, None, None, f"{f}-{o}"])) for f in (1, 2, 5, 9) for o in range(30)]
    want, last = {}, {}
    for g, f, o, m in rows:
        if inclusive:
            last[g] = m or last.get(g)
        want[f, o] = last.get(g)
        last[g] = m or last.get(g)
    df = spark.createDataFrame(rows, "g string, file_seq long, offset long, m string")
    df = df.withColumn("position", F.struct("file_seq", "offset")).repartition(3)
    found = carry(df, ["g"], "m", "found", at=F.struct("file_seq", "offset"), inclusive=inclusive, slot=slot).collect()
    assert {(r["file_seq"], r["offset"]): r["found"] for r in found} == want


def test_carry_keeps_each_window_short(spark):
    """No window sees more than a slot of rows, a file of slots, or a group of files."""
    df = spark.createDataFrame([("a", 1, 1, "x")], "g string, file_seq long, offset long, m string").withColumn("position", F.struct("file_seq", "offset"))
    plan = carry(df, ["g"], "m", "found", at=F.col("offset"))._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if " Window [" in x]
    assert len(windows) >= 3 and sum("_slot" in x for x in windows) == len(windows) - 1
    assert all("_file" in x for x in windows)


def test_partial_images_are_made_once(spark, folder):
    """The net changes rest on stored frames only; the feed behind them is not read again by each step."""
    lines = [("update", 1, i, {"k": str(i), "a": "x"}, {"a": None}) for i in range(1, 5)]
    lines += [("update", 1, 10, {"k": "9"}, {"k": "1"}), ("update", 1, 11, {"k": "2", "b": "7"}, {"b": "2"}), ("delete", 1, 12, {"k": "3"}, {})]
    lines += [("insert", 1, 13, {"k": "3", "c": "new"}, {}), ("insert", 1, 14, {"k": "6", "a": None}, {}), ("delete", 1, 15, {"k": "4"}, {})]
    _feed(spark, lines).write.parquet(f"{folder}/changes")
    changes = spark.read.parquet(f"{folder}/changes")
    table = spark.createDataFrame([(i, "old", i, f"c{i}") for i in range(1, 5)], SCHEMA)
    net = net_changes(changes, "t", "k", table.schema, current=table, cut=shared_cut(spark, "once"))
    got = {r._key: (r._deleted, r.a, r.b, r.c) for r in net.collect()}
    assert {k: v for k, v in got.items() if not v[0]} == {
        9: (False, "x", 1, "c1"), 2: (False, "x", 7, "c2"), 3: (False, None, None, "new"), 6: (False, None, None, None),
    }
    assert got[1][0] and got[4][0]
    assert not [f for f in net.inputFiles() if f"{folder}/changes" in f]
