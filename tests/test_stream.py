import json
import os
import uuid

import pytest
from fixture import LOGIN, Source, rows_by_id

from tideview.plans import build as pb
from tideview.plans.spec import ViewSpec
from tideview.sources.feed import OutputOptions, to_change_json
from tideview.sources.tables import null_sink
from tideview.streaming.maintainer import BuildError, IncrementError, Maintainer, SchemaChanged
from tideview.streaming.store import Conflict, Store

USERS = ViewSpec.load(
    {"id": 2, "name": "user_mv", "master": "user", "pk": "id", "columns": [{"name": "n", "table": "user", "column": "name"}]}
)


def options(frames):
    return OutputOptions(position=True, server_id=True, xoffset=True, tables={t: f.schema for t, f in frames.items()})


def deliver(spark, source, folder, n=None, edit=None):
    """Write the newest changes as one JSON file of the feed."""
    feed = source.take(spark, n)
    if edit:
        feed = edit(feed)
    lines = [r["value"] for r in to_change_json(feed, options(source.frames(spark))).collect()]
    put(folder, lines)


def put(folder, lines):
    os.makedirs(f"{folder}/feed", exist_ok=True)
    with open(f"{folder}/feed/{uuid.uuid4().hex}.json", "w") as f:
        f.write("".join(line + "\n" for line in lines))


def maintainer(spark, source, folder, specs=(LOGIN,), **kw):
    os.makedirs(f"{folder}/feed", exist_ok=True)
    kw = {"buckets": 4, "compact_after": 2, "start_position": (0, 0), **kw}
    return Maintainer(spark, list(specs), source.frames(spark), f"{folder}/feed", f"{folder}/store", **kw)


def check(spark, m, source, specs=(LOGIN,)):
    for s in specs:
        assert rows_by_id(m.view(s.name)) == rows_by_id(pb.build_view(s, source.frames(spark))), s.name


def test_build_follow_restart_compact(spark, folder):
    """Two views over shared tables, several runs; each run starts from the stored progress."""
    source, specs = Source(), (LOGIN, USERS)
    m = maintainer(spark, source, folder, specs)
    m.build()
    check(spark, m, source, specs)
    runs = {r["view"]: r for r in m.build_runs().collect()}
    assert runs["login_mv"]["inserted_rows"] == runs["login_mv"]["total_rows"] == 3
    assert m.unfinished() == []
    seen = []
    steps = [
        lambda: (source.insert("user", 99, "Zed", "late"), source.update("login", 1, id=100)),
        lambda: (source.delete("role", 1), source.update("user", 10, name=None), source.delete("login", 2)),
        lambda: (source.insert("role", 1, "again"), source.insert("login", 2, 99, 1, "2023-01-01 00:00:00", "b")),
    ]
    for step in steps:
        n = len(source.changes)
        step()
        deliver(spark, source, folder, len(source.changes) - n)
        m = maintainer(spark, source, folder, specs, sinks=(null_sink, lambda df, b: seen.append((b, df.count()))))
        m.run_available()
        check(spark, m, source, specs)
    assert seen == [(0, 2), (1, 3), (2, 2)]
    manifest = m.store.manifest()
    assert manifest["tables"]["mv_login_mv"]["deltas"] != [] or manifest["tables"]["mv_login_mv"]["base"]
    assert len(manifest["tables"]["mv_login_mv"]["deltas"]) < 2
    assert manifest["state"]["positions"]["1"][2] == source.offset
    # files of replaced versions can go, and what is left still reads
    assert m.store.vacuum(keep=1)
    check(spark, m, source, specs)


def test_replay_split_and_lost_commit(spark, folder):
    """The same lines again, in other batches, or after a crash before the commit."""
    source = Source()
    m = maintainer(spark, source, folder)
    m.build()
    source.update("login", 1, login_note="one")
    source.delete("user", 10)
    source.insert("user", 10, "Ann2", None)
    deliver(spark, source, folder)
    lines = spark.read.text(f"{folder}/feed")

    real = m.store.files.put_new
    m.store.files.put_new = lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        m.apply_batch(lines, 0)
    m.store.files.put_new = real
    m.apply_batch(lines, 0)
    check(spark, m, source)
    version = m.store.manifest()["version"]
    m.apply_batch(lines, 0)  # a batch seen before is skipped whole
    assert m.store.manifest()["version"] == version
    m.apply_batch(lines, 1)  # lines seen before are not newer than the rows they set
    check(spark, m, source)
    rows = sorted(r["value"] for r in lines.collect())
    source.update("login", 3, user_id=10)
    source.delete("login", 1)
    deliver(spark, source, folder, 2)
    new = sorted(set(r["value"] for r in spark.read.text(f"{folder}/feed").collect()) - set(rows), key=lambda v: json.loads(v)["xid"])
    for i, line in enumerate(new):
        m.apply_batch(spark.createDataFrame([(line,)], "value string"), 2 + i)
    check(spark, m, source)


def test_open_transaction_waits(spark, folder):
    """Rows are held in the store until the transaction's commit row arrives."""
    from pyspark.sql import functions as F

    source = Source()
    m = maintainer(spark, source, folder)
    m.build()
    source.update("login", 1, login_note="held")
    source.update("login", 2, login_note="done")
    whole = source.take(spark).withColumn("xid", F.lit(7).cast("bigint"))
    first = whole.orderBy("position.offset").limit(1).withColumn("commit", F.lit(False))
    rest = whole.orderBy(F.desc("position.offset")).limit(1)
    text = lambda df: to_change_json(df, options(source.frames(spark)))
    m.apply_batch(text(first), 0)
    assert rows_by_id(m.view("login_mv"))[1]["note"] == "a"
    assert m.store.read_log("_pending").count() == 1
    m.apply_batch(text(rest), 1)
    check(spark, m, source)
    assert m.store.read_log("_pending") is None


@pytest.mark.parametrize("seed", range(2))
def test_files_in_any_order(spark, folder, seed):
    """Lines in random order, split over batches inside transactions, some of them twice."""
    import random

    from pyspark.sql import functions as F

    rnd, source = random.Random(seed), Source()
    m = maintainer(spark, source, folder, (LOGIN, USERS))
    m.build()
    source.update("login", 1, login_note="one")
    source.update("login", 1, id=50)
    source.update("login", 50, login_note="two")
    source.delete("user", 10)
    source.insert("user", 10, "Ann2", None)
    source.delete("login", 2)
    source.insert("role", 7, "new")
    source.update("login", 3, user_id=10)
    source.delete("role", 1)
    feed = source.take(spark)
    n = feed.count()
    # transactions of three rows, the last one of each with the commit
    place = F.col("position.offset")
    order = {r[0]: i for i, r in enumerate(feed.select(place).orderBy(place).collect())}
    index = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[place]
    feed = feed.withColumn("xid", (F.floor(index / 3) + 1000).cast("bigint")).withColumn("commit", (index % 3 == 2) | (index == n - 1))
    lines = [r["value"] for r in to_change_json(feed, options(source.frames(spark))).collect()]
    rnd.shuffle(lines)
    lines += rnd.sample(lines, 3)
    cuts = [0, 4, 8, len(lines)]
    for b, (i, j) in enumerate(zip(cuts, cuts[1:])):
        m.apply_batch(spark.createDataFrame([(v,) for v in lines[i:j]], "value string"), b)
    check(spark, m, source, (LOGIN, USERS))
    # old marks go, and what they guarded against is then below the start
    m.forget_deleted((1, source.offset))
    m.apply_batch(spark.createDataFrame([(v,) for v in lines], "value string"), 99)
    check(spark, m, source, (LOGIN, USERS))


def test_no_key_absent_columns_and_late_partial_images(spark, folder):
    from pyspark.sql import functions as F

    source = Source()
    m = maintainer(spark, source, folder)
    m.build()
    row = {"database": "shop", "table": "login", "type": "insert", "ts": 1, "server_id": 1, "data": {"login_note": "x"}}
    for i, data in enumerate(({}, {"id": "q"}, {"id": None})):
        line = json.dumps(row | {"position": f"log.000001:{i + 1}", "data": row["data"] | data})
        m.apply_batch(spark.createDataFrame([(line,)], "value string"), i)
    assert [r["reason"] for r in m.rejects().collect()] == ["no usable key"] * 3
    check(spark, m, source)
    told = []
    m.on_error = lambda kind, view, e: told.append((kind, e.count, [r["reason"] for r in e.rows.collect()]))
    odd = {"id": "8", "user_id": "1.7", "role_id": "1.0", "login_time": "soon", "login_note": "x"}
    m.apply_batch(spark.createDataFrame([(json.dumps(row | {"position": "log.000001:5", "data": odd}),)], "value string"), 3)
    assert told == [("value", 1, ["does not fit: login.login_time timestamp_ntz: soon; login.user_id bigint: 1.7"])]
    assert [r["reason"] for r in m.rejects().collect()].count(told[0][2][0]) == 1
    m.on_error = None
    part = json.dumps(row | {"type": "update", "position": "log.000001:9", "data": {"id": 1, "login_note": "x"}, "old": {"login_note": "a"}})
    part = spark.createDataFrame([(part,)], "value string")
    with pytest.raises(ValueError, match="lack columns"):
        m.apply_batch(part, 4)
    partial = maintainer(spark, source, folder, full_images=False)
    partial.apply_batch(part, 4)
    got = rows_by_id(partial.view("login_mv"))[1]
    assert got["note"] == "x" and got["role_name"] == "admin"
    with pytest.raises(ValueError, match="log order"):
        partial.apply_batch(part.withColumn("value", F.replace("value", F.lit(":9"), F.lit(":8"))), 5)


def test_partial_images_that_move_rows(spark, folder):
    """Updates carry the key and what changed; rows move in one batch, over batches, and onto keys that others left."""
    from pyspark.sql import functions as F

    def slim(feed):
        kept = F.map_filter("data", lambda k, v: (k == "id") | F.map_contains_key("old", k))
        return feed.withColumn("data", F.when(F.col("type") == "update", kept).otherwise(F.col("data")))

    source = Source()
    m = maintainer(spark, source, folder, (LOGIN, USERS), full_images=False)
    m.build()
    steps = [
        lambda: (source.update("login", 1, id=70, login_note="m"), source.update("login", 70, id=71), source.update("login", 2, id=1)),
        lambda: (source.update("login", 71, id=72, role_id=2), source.update("user", 10, id=12), source.update("login", 1, user_id=12)),
        lambda: (source.update("user", 12, id=10, name="Eve"), source.delete("login", 72), source.update("login", 1, id=72)),
    ]
    for step in steps:
        n = len(source.changes)
        step()
        deliver(spark, source, folder, len(source.changes) - n, edit=slim)
        m.run_available()
        check(spark, m, source, (LOGIN, USERS))


def test_view_added_later_and_keys_that_differ(spark, folder):
    """A second view needs one more column of a table that is followed already."""
    small = ViewSpec.load(
        {"id": 5, "name": "small", "master": "user", "pk": "id", "columns": [{"name": "n", "table": "user", "column": "name"}]}
    )
    wide = ViewSpec.load(
        {"id": 6, "name": "wide", "master": "user", "pk": "id", "columns": [{"name": "i", "table": "user", "column": "info"}]}
    )
    source = Source()
    m = maintainer(spark, source, folder, (small,))
    m.build()
    source.update("user", 10, name="B", info="b")
    source.delete("user", 11)
    deliver(spark, source, folder, 2)
    m.run_available()
    source.update("user", 10, info="c")
    m = maintainer(spark, source, folder, (small, wide))
    m.build()
    deliver(spark, source, folder, 1)
    m.run_available()
    check(spark, m, source, (small, wide))
    m.apply_batch(spark.read.text(f"{folder}/feed"), 99)
    check(spark, m, source, (small, wide))


def test_views_that_key_a_table_differently(spark, folder):
    """Users as master by id and by name, and as lookup by name; names are changed, swapped, cleared and taken again."""
    by_name = ViewSpec.load(
        {"id": 7, "name": "by_name", "master": "user", "pk": "name", "columns": [{"name": "i", "table": "user", "column": "info"}]}
    )
    noted = ViewSpec.load(
        {
            "id": 8, "name": "noted", "master": "login", "pk": "id", "columns": [{"name": "i", "table": "user", "column": "info"}],
            "lookups": [{"table": "user", "master_column": "login_note", "key": "name"}],
        }
    )
    source, specs = Source(), (noted, by_name, USERS)
    m = maintainer(spark, source, folder, specs)
    assert m.keys["user"] == "name" and m.found_by["user"] == ["id"]  # the first view that has it as master
    m = maintainer(spark, source, folder, specs, row_keys={"user": "id"})
    assert m.keys["user"] == "id" and m.found_by == {"login": [], "user": ["name"]}
    m.build()

    def held():
        frames = source.frames(spark)
        frames["user"] = frames["user"].filter("name IS NOT NULL")
        for s in specs:
            want = pb.build_view(s, frames if s is not USERS else source.frames(spark))
            assert rows_by_id(m.view(s.name)) == rows_by_id(want), s.name

    held()
    steps = [
        lambda: (source.update("login", 1, login_note="Ann"), source.update("user", 11, name="a"), source.insert("user", 12, "Cy", "z")),
        lambda: (source.update("user", 10, name=None), source.update("user", 11, name="Ann", info="now Ann"), source.update("user", 12, name="a")),
        lambda: (source.update("user", 11, id=13), source.delete("user", 12), source.insert("user", 14, "a", "again"), source.update("user", 10, name="Cy")),
    ]
    for step in steps:
        n = len(source.changes)
        step()
        deliver(spark, source, folder, len(source.changes) - n)
        m.run_available()
        held()
    m = maintainer(spark, source, folder, specs)
    assert m.keys["user"] == "id"  # as stored
    source.update("user", 10, name="a")
    deliver(spark, source, folder, 1)
    with pytest.raises(Exception, match="not unique any more"):
        m.run_available()


def test_rejects_rules_hook_and_partial_images(spark, folder):
    from pyspark.sql import functions as F

    source = Source()
    m = maintainer(
        spark, source, folder, rules="exclude: *.role", full_images=False,
        hook=lambda df: df.withColumn("suppressed", F.col("data")["login_note"] == "secret"),
    )
    m.build()
    source.update("login", 1, login_note="seen")
    source.update("login", 3, login_note="secret")
    source.delete("role", 1)
    slim = lambda df: df.withColumn(
        "data", F.when(F.col("type") == "update", F.map_filter("data", lambda k, v: k.isin("id", "login_note"))).otherwise(F.col("data"))
    )
    deliver(spark, source, folder, edit=slim)
    put(folder, ["not json", '{"type":"insert"}'])
    m.run_available()
    rows = rows_by_id(m.view("login_mv"))
    assert rows[1]["note"] == "seen" and rows[1]["role_name"] == "admin"
    assert rows[3]["note"] is None
    assert sorted(r["reason"] for r in m.rejects().collect()) == ["broken JSON", "database is required"]


def test_lookup_with_its_own_key(spark, folder):
    """The lookup joins by name but is keyed by id; giving up a name clears the rows on it."""
    spec = ViewSpec.load(
        {
            "id": 3, "name": "by_name", "master": "login", "pk": "id",
            "columns": [{"name": "info", "table": "user", "column": "info"}],
            "lookups": [{"table": "user", "master_column": "login_note", "key": "name", "pk": "id"}],
        }
    )
    source = Source()
    source.rows["login"][1] = (1, 10, 1, "2021-12-22 08:00:00", "Ann")
    m = maintainer(spark, source, folder, (spec,))
    m.build()
    assert rows_by_id(m.view("by_name"))[1]["info"] == "x"
    source.update("user", 10, name="Anna")
    deliver(spark, source, folder, 1)
    m.run_available()
    check(spark, m, source, (spec,))
    assert rows_by_id(m.view("by_name"))[1]["info"] is None
    source.insert("user", 12, "Anna", "twice")
    source.update("login", 1, login_note="Anna")
    deliver(spark, source, folder, 2)
    with pytest.raises(Exception, match="not unique any more"):
        m.run_available()


def test_errors_are_told(spark, folder):
    told = []
    source = Source()
    source.rows["role"][9] = (1, "admin twice")
    m = maintainer(spark, source, folder, on_error=lambda kind, view, e: told.append((kind, view)))
    with pytest.raises(BuildError):
        m.build()
    assert told == [("build", "login_mv")]
    (run,) = m.build_runs().collect()
    assert run["status"] == "failed" and "role.1" in run["error"] and run["inserted_rows"] is None
    del source.rows["role"][9]
    m = maintainer(spark, source, folder, on_error=lambda kind, view, e: told.append((kind, view)))
    m.build()
    assert [r["status"] for r in m.build_log().collect()] == ["started", "failed", "started", "counted", "complete"]
    bad = lambda *a: (_ for _ in ()).throw(RuntimeError("sink"))
    m.sinks = (bad,)
    source.update("login", 1, login_note="s")
    deliver(spark, source, folder)
    with pytest.raises(Exception, match="sink"):
        m.supervise(wait=0.0, attempts=2, availableNow=True)
    assert told[1:] == [("increment", None), ("other", None)] * 2
    m.sinks = ()
    m.supervise(wait=0.0, attempts=1, availableNow=True)
    check(spark, m, source)
    with pytest.raises(IncrementError):
        m._batch(spark.createDataFrame([(1,)], "value int"), 99)


def test_a_view_that_fails_leaves_the_others(spark, folder):
    """Views are published one by one; what is left is built later, on the tables as they are then."""
    source, specs = Source(), (LOGIN, USERS)
    source.rows["role"][9] = (1, "admin twice")
    m = maintainer(spark, source, folder, specs)
    with pytest.raises(BuildError, match="login_mv"):
        m.build()
    check(spark, m, source, (USERS,))
    assert [s.name for s in m.unfinished()] == ["login_mv"]
    assert {r["view"]: r["status"] for r in m.build_runs().collect()} == {"login_mv": "failed", "user_mv": "complete"}
    del source.rows["role"][9]
    source.rows["role"][3] = (3, "new")
    source.update("user", 10, name="Eve")
    deliver(spark, source, folder)
    m = maintainer(spark, source, folder, specs)
    m.run_available()
    check(spark, m, source, specs)
    built = [r["view"] for r in m.build_log().collect() if r["status"] == "complete"]
    assert built == ["user_mv", "login_mv"]


def test_schema_event_stops_only_when_a_used_column_goes(spark, folder):
    source = Source()
    m = maintainer(spark, source, folder)
    m.build()

    def event(columns):
        defs = [{"name": c, "position": i, "type": "text"} for i, c in enumerate(columns)]
        table = {"database": "shop", "table": "user", "columns": defs}
        return json.dumps({"type": "table-alter", "database": "shop", "table": "user", "ts": 1, "def": table, "old": table})

    m.apply_batch(spark.createDataFrame([(event(["id", "name", "info", "extra"]),)], "value string"), 0)
    assert m.rejects().count() == 0
    with pytest.raises(SchemaChanged, match="lost info"):
        m.apply_batch(spark.createDataFrame([(event(["id", "name"]),)], "value string"), 1)


def test_dry_run_and_start_position(spark, folder):
    source = Source()
    m = maintainer(spark, source, folder)
    m.build()
    source.update("login", 1, login_note="dry")
    deliver(spark, source, folder)
    version = m.store.manifest()["version"]
    maintainer(spark, source, folder, dry_run=True).run_available()
    assert m.store.manifest()["version"] == version
    m.run_available()
    check(spark, m, source)
    # a new store that starts at the feed's end takes the tables as they are and none of the feed
    later = Maintainer(spark, [LOGIN], source.frames(spark), f"{folder}/feed", f"{folder}/store2", buckets=2)
    later.run_available()
    assert later.store.state()["start"] == [1, source.offset]
    check(spark, later, source)


def test_start_stop_resume(spark, folder):
    source = Source()
    m = maintainer(spark, source, folder).start(processingTime="1 second")
    source.update("login", 1, login_note="live")
    deliver(spark, source, folder)
    m.query.processAllAvailable()
    check(spark, m, source)
    m.stop()
    source.delete("login", 3)
    deliver(spark, source, folder, 1)
    m.resume()
    m.query.processAllAvailable()
    m.stop()
    check(spark, m, source)


def test_resume_in_another_servers_feed(spark, folder):
    """The new feed repeats what was applied; it is taken up behind the last heartbeat read."""
    source = Source()
    m = maintainer(spark, source, folder)
    m.build()
    beat = lambda server, at, h: json.dumps(
        {"database": "d", "table": "h", "type": "heartbeat", "ts": 1, "position": at, "server_id": server, "data": {"heartbeat": h}}
    )
    m.apply_batch(spark.createDataFrame([(beat(1, "log.000009:50", 77),)], "value string"), 0)
    assert m.store.state()["heartbeat"] == 77
    with pytest.raises(RuntimeError):
        m.recover(78)
    source.update("login", 1, login_note="after")
    from pyspark.sql import functions as F

    old = json.dumps({"database": "shop", "table": "login", "type": "delete", "ts": 1, "position": "new.000001:3", "server_id": 2, "data": {"id": "3"}})
    put(folder, [old, beat(2, "new.000001:5", 77)])
    assert m.recover() == (1, 5)
    deliver(spark, source, folder, 1, lambda df: df.withColumn("server_id", F.lit(2).cast("bigint")))
    m.apply_batch(spark.read.text(f"{folder}/feed"), 1)
    check(spark, m, source)


def test_feed_with_a_folder_per_log_file(spark, folder):
    """The start is found in the newest log file alone, a heartbeat in the newest that holds it; the stream follows such a feed."""
    from pyspark.sql import functions as F

    from tideview.operators.heartbeats import recover_position
    from tideview.sources.feed import write_changes
    from tideview.sources.places import feed_files, newest_first

    def filed(feed):
        seq = 1 + F.floor(F.col("position.offset") / 20).cast("bigint")
        name = F.concat(F.lit("log."), F.lpad(seq.cast("string"), 6, "0"))
        return feed.withColumn("position", F.struct(name.alias("file"), seq.alias("file_seq"), F.col("position.offset").alias("offset")))

    def write(n):
        write_changes(filed(source.take(spark, n)), f"{folder}/feed", options(source.frames(spark)), by_file=True)

    source = Source()
    for i in range(12):
        source.update("login", 1, login_note=f"n{i}")
    write(12)
    lines = spark.read.text(f"{folder}/feed")
    assert feed_files(lines) == [7, 6, 5, 4, 3, 2, 1]
    seen = []

    def note(changes):
        plan = changes._jdf.queryExecution().executedPlan().toString()
        seen.append("PartitionFilters: [isnotnull(file_seq" in plan and sorted(r[0] for r in changes.select("position.file_seq").distinct().collect()))
        return changes.filter("position.file_seq = 3").first()

    found, read = newest_first(spark, f"{folder}/feed", note)
    assert found["position"]["file_seq"] == 3 and read == 7 and seen == [[7], [5, 6], [1, 2, 3, 4]]
    assert newest_first(spark, f"{folder}/feed", lambda c: recover_position(c, 5).first()) == (None, 7)

    m = maintainer(spark, source, folder, start_position=None)
    m.build()
    assert m.store.state()["start"] == [7, 120]
    source.update("login", 1, login_note="after")
    source.insert("login", 9, 11, 2, "2022-01-01 00:00:00", "new")
    write(2)
    m.run_available()
    check(spark, m, source)


def test_second_writer_is_refused(spark, folder):
    store = Store(spark, f"{folder}/s", buckets=2)
    a, b = store.begin(), store.begin()
    for c in (a, b):
        c.replace("t", spark.range(10), "id")
    a.publish()
    with pytest.raises(Conflict):
        b.publish()
    c = store.begin()
    c.change("t", spark.range(5, 12), spark.range(0, 3))
    c.publish()
    want = [3, 4, 5, 6, 7, 8, 9, 10, 11]
    assert sorted(r["id"] for r in store.read("t").collect()) == want
    c = store.begin()
    c.change("t", spark.range(0, 1), spark.range(0, 1))
    assert sorted(r["id"] for r in c.read("t", spark.range(0, 4)).collect()) == [0, 3]
    assert c.compact("t") is False and c.compact("t", force=True)
    c.publish()
    assert sorted(r["id"] for r in store.read("t").collect()) == [0, *want]
    assert store.manifest()["tables"]["t"]["deltas"] == []


