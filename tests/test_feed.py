"""JSON rows, encryption, transactions, positions, hooks and heartbeats."""

import json

import pytest
from fixture import Source
from pyspark.sql import functions as F

from tideview.operators import feed as op
from tideview.operators import heartbeats as hb
from tideview.operators import keys as ky
from tideview.operators import schema_history as sh
from tideview.operators.hooks import ddl_hook, drop_suppressed, heartbeat_hook, put, with_hook
from tideview.operators.metrics import commit_lag, health
from tideview.sources import feed as src
from tideview.sources.change import CHANGE, as_changes, position_struct
from tideview.sources.tables import jdbc_options, null_sink, write_batches

KEY = "0123456789abcdef"


def lines(spark, *rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string")


ROW = {"database": "d", "table": "t", "type": "insert", "ts": 5, "data": {"id": 1}}


def test_values_keep_their_text(spark):
    data = {"big": 2**63 - 1, "txt": 'q"\\\n\té', "none": None, "obj": {"a": [1]}, "list": ["x", "y"], "yes": True}
    raw = json.dumps({**ROW, "data": data, "old": {"none": "was"}, "origin": "x"})
    raw = raw.replace('"yes"', '"dec": 12345678901234567890.1234567890, "yes"')
    row = src.parse_changes(lines(spark, raw))[0].first()
    assert row["data"]["big"] == str(2**63 - 1) and row["data"]["txt"] == data["txt"]
    assert "none" in row["data"] and row["data"]["none"] is None and row["old"] == {"none": "was"}
    assert json.loads(row["data"]["obj"]) == {"a": [1]} and row["data"]["yes"] == "true"
    assert row["data"]["dec"] == "12345678901234567890.123456789"
    assert row["extra"] == {"origin": "x"} and row["ts_ms"] == 5000 and row["commit"] is False
    skipped = src.parse_changes(lines(spark, raw), nested="skip")[0].first()
    assert set(row["data"]) - set(skipped["data"]) == {"obj", "list"}


def test_rejects(spark):
    bad = {
        "broken JSON": '{"a":',
        "type is required": {k: v for k, v in ROW.items() if k != "type"},
        "ts is required": {**ROW, "ts": None},
        "data is required": {**ROW, "data": None},
        "data is not an object": {**ROW, "data": [1]},
        "old is not an object": {**ROW, "old": 3},
        "ts is not a number": {**ROW, "ts": "soon"},
    }
    changes, rejects = src.parse_changes(lines(spark, ROW, *bad.values()))
    assert changes.count() == 1
    assert sorted(r["reason"] for r in rejects.collect()) == sorted(bad)


@pytest.mark.parametrize("mode", ["none", "data", "all"])
def test_write_read_round_trip(spark, folder, mode):
    source = Source()
    source.update("login", 2, login_note='new "note", with \\ and \n')
    source.update("user", 10, info=None)
    source.delete("role", 1)
    feed = source.take(spark)
    o = src.OutputOptions(
        position=True, server_id=True, primary_key_columns=True, encrypt=mode, secret_key=None if mode == "none" else KEY,
        tables={t: f.schema for t, f in source.frames(spark).items()},
    )
    src.write_changes(feed, f"{folder}/f", o)
    text = [r["value"] for r in spark.read.text(f"{folder}/f").collect()]
    assert all(("encrypted" in json.loads(t)) == (mode != "none") for t in text)
    back, rejects = src.read_changes(spark, f"{folder}/f", key=KEY)
    assert rejects.count() == 0
    names = ["table", "type", "xid", "commit", "position", "server_id", "primary_key_columns", "data", "old"]
    order = lambda df: sorted((r.asDict(True) for r in df.select(*names).collect()), key=lambda r: r["xid"])
    assert order(back) == order(feed)
    if mode != "none":
        wrong = src.read_changes(spark, f"{folder}/f", key="f" * 16)
        assert wrong[0].count() == 0 and wrong[1].count() == 3


def test_stream_of_files_with_rejects(spark, folder):
    lines(spark, ROW, "junk").write.text(f"{folder}/in")
    changes, rejects = src.read_changes(spark, f"{folder}/in", streaming=True)
    q = changes.writeStream.format("memory").queryName("seen_changes").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen_changes").count() == 1 and rejects.isStreaming


def test_lines_without_extras_are_not_parsed_for_them(spark):
    """Only a line with a field of its own is parsed again; what is read stays the same, odd lines included."""
    raw = ['{"type":"x","data":{"zz":1}}', '{"type":"x","zz":{"q":1}}', "{}", "nope", "[1]", None, '{"type":"x"} tail', '{"type":null,"c":1,"c":2}']
    want = [{}, {"zz": '{"q":1}'}, {}, None, None, None, {}, {"c": "2"}]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, value string")
    made = df.select("i", src._extras(F.col("value"), ["type", "data"]).alias("extra"))
    assert [r.extra for r in made.orderBy("i").collect()] == want
    # for lines whose fields are all known the plan needs no map of the whole line
    known = df.where("i = 0").select(src._extras(F.col("value"), ["type", "data"]).alias("extra"))
    assert "json_object_keys" in known._jdf.queryExecution().analyzed().toString()


def test_extra_attributes_and_protected_names(spark):
    df = as_changes(spark.createDataFrame([({"id": "1"},)], "data map<string,string>"))
    assert src.with_extra(src.with_extra(df, a=1), a=2, b="x", comment="c").first()["extra"] == {"a": "2", "b": "x"}
    with pytest.raises(ValueError, match="xid"):
        src.with_extra(df, xid=1)


def test_keyless_rows_get_a_fresh_key(spark):
    df = as_changes(spark.createDataFrame([("d", "t", {"id": "1"})] * 2, "database string, table string, data map<string,string>"))
    keys = [json.loads(r["row_key"]) for r in ky.row_key(df).collect()]
    assert keys[0]["_uuid"] != keys[1]["_uuid"] and ky.row_identity(df).first()["row_identity"] == "dt"
    with pytest.raises(ValueError):
        ky.partition_key("column", [], "table")
    with pytest.raises(ValueError):
        ky.partition_key("column", ["a"])
    with pytest.raises(ValueError):
        ky.partition_key("nothing")


def positioned(spark, rows):
    """Rows (file number, offset, xid, type)."""
    df = spark.createDataFrame(rows, "seq bigint, off bigint, xid bigint, type string")
    file = F.concat(F.lit("log."), F.col("seq").cast("string"))
    return as_changes(df.withColumn("position", position_struct(file, F.col("off"))).withColumn("ts_ms", F.col("off"))).drop("seq", "off")


def test_file_numbers_are_compared_as_numbers(spark):
    df = positioned(spark, [(999999, 5, 1, "insert"), (1000000, 1, 1, "insert")])
    out = {r["position"]["file_seq"]: (r["xoffset"], r["commit"]) for r in op.assemble_transactions(df, slot=2).collect()}
    assert out == {999999: (0, False), 1000000: (1, True)}


def test_transactions_do_not_depend_on_slots(spark):
    df = positioned(spark, [(1 + i // 30, i * 7, i // 9, "insert") for i in range(90)] + [(1, 1, None, "heartbeat")])
    runs = [
        sorted((r["position"]["offset"], r["xoffset"], r["commit"]) for r in op.assemble_transactions(df, slot=s).collect() if r["xid"] is not None)
        for s in (1, 13, 1 << 20)
    ]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 90


def test_gtid_sets(spark):
    row = lambda a, b: spark.range(1).select(op.gtid_newer(F.lit(a), F.lit(b))).first()[0]
    assert row("a:1-5", "a:1-4") and not row("a:1-4", "a:1-5")
    assert row("a:1-3:7", "a:1-5") and not row("a:1-3:7", "a:1-9") and not row("A:2", "a:1-3,b:1") and row("b:1", "a:1")


def test_hooks(spark):
    df = positioned(spark, [(1, 1, 1, "insert"), (1, 2, 1, "heartbeat"), (1, 3, 1, "table-alter")])
    mark = lambda d: d.withColumn("topic", F.lit("seen"))
    seen = lambda d: sorted(r["type"] for r in d.collect() if r["topic"])
    assert seen(with_hook(df, mark)) == ["insert"]
    assert seen(heartbeat_hook(df, mark)) == ["heartbeat"]
    assert seen(ddl_hook(df, mark)) == ["table-alter"]
    hidden = with_hook(df, lambda d: d.withColumn("suppressed", F.lit(True)).withColumn("extra", put("extra", "k", 1)))
    assert hidden.count() == 3 and drop_suppressed(hidden).count() == 2
    with pytest.raises(ValueError, match="dropped columns"):
        with_hook(df, lambda d: d.drop("data"))


def test_recovery(spark):
    beat = lambda seq, off, h: (seq, off, None, "heartbeat", {"heartbeat": str(h)})
    rows = [beat(1, 10, 5), beat(2, 40, 5), beat(2, 20, 5), beat(3, 1, 6)]
    df = spark.createDataFrame(rows, "seq bigint, off bigint, xid bigint, type string, data map<string,string>")
    df = as_changes(df.withColumn("position", position_struct(F.concat(F.lit("log."), F.col("seq").cast("string")), F.col("off")))).drop("seq", "off")
    assert tuple(hb.recover_position(df, 5).first())[1:3] == (2, 20)
    assert hb.recover_position(df, 9).count() == 0
    stored = spark.createDataFrame([(1, "c", 5), (2, "c", 6), (3, "d", 1), (4, "e", None)], "server_id bigint, client_id string, last_heartbeat_read bigint")
    with pytest.raises(hb.RecoveryError):
        hb.stored_position(stored, "c")
    assert hb.stored_position(stored, "d")["server_id"] == 3 and hb.stored_position(stored, "e") is None
    assert hb.stored_position(hb.forget_other_servers(stored, 2, "c"), "c")["server_id"] == 2


def test_lag_and_health(spark):
    df = positioned(spark, [(1, 1, 1, "insert"), (1, 2, 1, "insert")])
    lags = [r["lag_ms"] for r in commit_lag(op.assemble_transactions(df), F.lit(10)).orderBy("xoffset").collect()]
    assert lags == [None, 8]
    checks = spark.createDataFrame([("a", True, True), ("b", False, False)], "name string, mandatory boolean, ok boolean")
    assert tuple(health(checks).first()) == (2, 1, 0, False)


def test_evolve(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "id bigint, a string, b double")
    deltas = [
        {"op": "change", "name": "a", "to": "a2", "after": "late"},
        {"op": "add", "name": "late", "type": "int", "first": True},
        {"op": "rename", "name": "ID", "to": "key"},
    ]
    assert sh.evolve(df, deltas).columns == ["late", "a2", "key", "b"]
    assert sh.evolve(df, deltas).first().asDict() == {"late": None, "a2": "x", "key": 1, "b": 2.0}
    assert sh.evolve_key(["id"], df.columns, deltas) == ["key"]
    assert sh.evolve_key(["id", "a"], df.columns, [{"op": "drop", "name": "id"}]) == ["a"]
    for bad in ([{"op": "drop", "name": "zz"}], [{"op": "change", "name": "a", "after": "never"}], [{"op": "zap", "name": "a"}]):
        with pytest.raises(sh.SchemaError):
            sh.evolve(df, bad)


def test_schema_rows(spark):
    df = spark.createDataFrame([], "id bigint, n string")
    rows = sh.schema_rows(spark, {"t": df}, "d", {"t": ["id"]})
    assert [(r["name"], r["type"], r["pk_position"]) for r in rows.orderBy("position").collect()] == [("id", "bigint", 0), ("n", "string", None)]
    assert sh.schema_diff(rows, rows).count() == 0
    like = sh.create_like(sh.table_defs(rows), "d", "t", "e", "u").first()
    assert (like["database"], like["table"], len(like["def"])) == ("e", "u", 2)


def test_sinks(spark, folder):
    write_batches(spark.range(0, 2500, 1, 1), f"{folder}/w", rows=1000)
    import glob

    assert len(glob.glob(f"{folder}/w/*.parquet")) == 3
    null_sink(spark.range(10))
    o = jdbc_options({"url": "jdbc:x", "query": "SELECT 1", "partition_column": "id", "lower": 0, "upper": 9, "partitions": 3})
    assert o["dbtable"] == "(SELECT 1) AS q" and o["numPartitions"] == "3"
    assert CHANGE.names[0] == "database"


def test_images_conform_to_what_their_table_was(spark):
    """By position: definitions of the row's own table count, from their statement on, until the table is gone."""
    from pyspark.sql import functions as F

    from tideview.operators.schema_history import conform_as_of
    from tideview.sources.change import as_changes

    place = "struct(concat('log.', file) AS file, cast(file AS bigint) AS file_seq, cast(at AS bigint) AS offset) AS position"
    rows = [("t", 1, 5), ("t", 1, 10), ("u", 1, 11), ("t", 3, 1), ("t", 3, 9), (None, 3, 9)]
    feed = spark.createDataFrame(rows, "`table` string, file int, at int").selectExpr("'d' AS database", "`table`", place, "1L AS server_id", "map('a', '1', 'b', '2') AS data", "map('b', '0') AS old")
    history = spark.createDataFrame([("t", 1, 10, ["a"]), ("u", 1, 2, ["b"]), ("t", 3, 5, None)], "`table` string, file int, at int, names array<string>")
    history = history.selectExpr("'d' AS database", "`table`", place, "1L AS server_id", "transform(names, n -> named_struct('name', n)) AS def")
    out = conform_as_of(as_changes(feed), history, slot=4).select("table", "position.file_seq", "position.offset", F.sort_array(F.map_keys("data")).alias("k"), F.size("old").alias("n"))
    assert sorted(map(tuple, out.filter("table IS NOT NULL").collect())) == [
        ("t", 1, 5, ["a", "b"], 1), ("t", 1, 10, ["a"], 0), ("t", 3, 1, ["a"], 0), ("t", 3, 9, ["a", "b"], 1), ("u", 1, 11, ["b"], 1),
    ]
    assert out.count() == 6
