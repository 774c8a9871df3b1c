import random

import pytest
from fixture import LOGIN, Shifted, Source, rows_by_id

from tideview.operators import maintain as mt
from tideview.plans import build as pb
from tideview.plans.spec import SpecError, ViewSpec, load_views
from workload.registry import shared_cut


def check(spark, source, view):
    """The maintained view equals a full build on the tables as they stand."""
    want = pb.build_view(LOGIN, source.frames(spark))
    assert rows_by_id(mt.visible(view)) == rows_by_id(want)


def run(spark, scenarios, full_images=True, edit=None):
    """All scenarios in one feed, each on its own range of keys: {name: its view rows by id}."""
    source = Source({"login": {}, "user": {}, "role": {}})
    parts = {name: Shifted(source, (i + 1) * 1000) for i, name in enumerate(scenarios)}
    tables = source.frames(spark)
    view = pb.build_view(LOGIN, tables, match_columns=True)
    for name, change in scenarios.items():
        change(parts[name])
    feed = source.take(spark)
    if edit:
        feed = edit(feed)
    after, _ = mt.apply_changes(LOGIN, view, tables, feed, full_images=full_images, cut=shared_cut(spark, "t"))
    got = rows_by_id(after)
    shown = {k: {c: v for c, v in r.items() if not c.startswith("_mk_")} for k, r in got.items()}
    want = rows_by_id(pb.build_view(LOGIN, source.frames(spark)))
    for i, name in enumerate(scenarios):
        mine = lambda rows: {k - (i + 1) * 1000: r for k, r in rows.items() if k // 1000 == i + 1}  # noqa: B023, E731
        assert mine(shown) == mine(want), name
    return {name: {k - (i + 1) * 1000: r for k, r in got.items() if k // 1000 == i + 1} for i, name in enumerate(scenarios)}


def test_full_build(spark):
    rows = rows_by_id(pb.build_view(LOGIN, Source().frames(spark)))
    assert sorted(rows) == [1, 2, 3]
    assert rows[2]["role_name"] is None and rows[2]["user_name"] == "Ann"
    assert rows[3]["user_name"] is None and rows[3]["user_id"] is None
    assert rows[2]["note"] == "it's ,) quoted"
    assert list(rows[1]) == ["id", "user_name", "user_info", "role_name", "login_time", "note", "user_id", "role_id"]


def test_ordered_build_and_ranged_write(spark, folder):
    df = pb.build_view(LOGIN, Source().frames(spark), ordered=True)
    assert [r["id"] for r in df.collect()] == [1, 2, 3]
    pb.write_ordered(spark.range(1000).select("id"), folder + "/o", rows_per_file=100)
    back = spark.read.parquet(folder + "/o")
    assert back.count() == 1000


def test_salted_lookup_gives_the_same_rows(spark):
    tables = Source().frames(spark)
    conf = {
        "id": 1, "name": "s", "master": "login", "pk": "id",
        "columns": [{"name": "u", "table": "user", "column": "name"}],
        "lookups": [{"table": "user", "master_column": "user_id", "key": "id", "salt": 5}],
    }
    salted = rows_by_id(pb.build_view(ViewSpec.load(conf), tables))
    conf["lookups"][0]["salt"] = 1
    assert salted == rows_by_id(pb.build_view(ViewSpec.load(conf), tables))
    assert len(salted) == 4


RULES = {
    "insert in scope": lambda s: s.insert("login", 5, 11, 2, "2022-01-01 00:00:00", "n"),
    "insert out of scope": lambda s: s.insert("login", 5, 11, 2, "2020-01-01 00:00:00", "n"),
    "delete in scope": lambda s: s.delete("login", 1),
    "delete out of scope": lambda s: s.delete("login", 4),
    "update leaves scope": lambda s: s.update("login", 1, login_time="2020-01-01 00:00:00"),
    "update enters scope": lambda s: s.update("login", 4, login_time="2022-01-01 00:00:00"),
    "key change": lambda s: s.update("login", 1, id=100),
    "lookup key to NULL": lambda s: s.update("login", 1, user_id=None),
    "lookup key from NULL": lambda s: s.update("login", 2, role_id=2),
    "late lookup fills": lambda s: s.insert("user", 99, "Zed", "late"),
    "lookup value to NULL": lambda s: s.update("user", 10, info=None),
    "lookup key change": lambda s: s.update("user", 10, id=99),
    "lookup delete": lambda s: s.delete("role", 1),
    "two lookups at once": lambda s: (s.delete("role", 1), s.update("user", 10, name="Eve")),
    "insert then delete": lambda s: (s.insert("login", 5, 11, 2, "2022-01-01 00:00:00", "n"), s.delete("login", 5)),
    "delete then insert": lambda s: (s.delete("login", 1), s.insert("login", 1, 11, 2, "2022-01-01 00:00:00", "back")),
    "key moves twice": lambda s: (s.update("login", 1, id=50), s.update("login", 50, id=60), s.update("login", 60, login_note="z")),
    "key swap": lambda s: (s.update("login", 1, id=50), s.update("login", 2, id=1), s.update("login", 50, id=2)),
    "lookup moves onto late key": lambda s: (s.delete("user", 10), s.update("user", 11, id=10)),
}


def test_rules(spark):
    rows = run(spark, RULES)
    cleared = rows["lookup delete"]
    assert cleared[1]["role_id"] is None and cleared[1]["role_name"] is None and cleared[1]["_mk_role"] is not None
    assert rows["lookup value to NULL"][1]["user_info"] is None
    assert rows["late lookup fills"][3]["user_name"] == "Zed"
    assert sorted(rows["key change"]) == [2, 3, 100]
    assert sorted(rows["update leaves scope"]) == [2, 3] and sorted(rows["update enters scope"]) == [1, 2, 3, 4]


def _slim(feed):
    from pyspark.sql import functions as F

    kept = F.map_filter("data", lambda k, v: (k == "id") | F.map_contains_key("old", k))
    return feed.withColumn("data", F.when(F.col("type") == "update", kept).otherwise(F.col("data")))


PARTIAL = {
    "one column": lambda s: s.update("login", 1, login_note="p"),
    "twice": lambda s: (s.update("login", 1, login_note="p"), s.update("login", 1, role_id=2)),
    "deleted and put back": lambda s: (s.delete("login", 1), s.insert("login", 1, 11, 2, "2022-01-01 00:00:00", None), s.update("login", 1, role_id=1)),
    "inserted and updated": lambda s: (s.insert("login", 7, 11, 2, "2022-01-01 00:00:00", "n"), s.update("login", 7, login_note=None)),
    "lookup column": lambda s: s.update("user", 10, info=None),
    "moved, then updated": lambda s: (s.update("login", 1, id=70), s.update("login", 70, login_note="q")),
    "moved three times": lambda s: (s.update("login", 1, id=70, role_id=2), s.update("login", 70, id=71), s.update("login", 71, id=72, login_note="q")),
    "moved away and back": lambda s: (s.update("login", 1, id=70), s.update("login", 70, id=1, role_id=2)),
    "left key taken again": lambda s: (s.update("login", 1, id=70), s.insert("login", 1, 11, 2, "2022-01-01 00:00:00", None)),
    "moved and deleted": lambda s: (s.update("login", 1, id=70), s.delete("login", 70)),
    "swapped": lambda s: (s.update("login", 1, id=70), s.update("login", 2, id=1), s.update("login", 70, id=2, login_note="q")),
    "lookup moved": lambda s: (s.update("user", 10, id=12), s.update("user", 12, id=11 + 2, info="y"), s.update("login", 1, user_id=13)),
}


def test_partial_images(spark):
    run(spark, PARTIAL, full_images=False, edit=_slim)


@pytest.mark.parametrize("above", [None, 0.0, 1.0])
def test_either_plan_gives_the_same_rows(spark, above):
    """Narrowed scans, or a rebuild where more than a share of the master is affected."""
    for scenario in (
        lambda s: s.update("login", 1, login_note="x"),
        lambda s: (s.update("user", 10, name="Eve"), s.delete("role", 1)),
        lambda s: (s.update("login", 2, user_id=11), s.insert("user", 99, "Late", None), s.delete("login", 4)),
    ):
        source = Source()
        tables = source.frames(spark)
        view = pb.build_view(LOGIN, tables, match_columns=True)
        scenario(source)
        after, _ = mt.apply_changes(LOGIN, view, tables, source.take(spark), cut=shared_cut(spark, "t"), rebuild_above=above)
        check(spark, source, after)


def test_delta_reads_neither_master_nor_view_for_master_changes(spark, folder):
    source = Source()
    tables = {}
    for t, df in source.frames(spark).items():
        df.write.parquet(f"{folder}/{t}")
        tables[t] = spark.read.parquet(f"{folder}/{t}")
    pb.build_view(LOGIN, tables, match_columns=True).write.parquet(f"{folder}/view")
    view = spark.read.parquet(f"{folder}/view")
    source.update("login", 1, login_note="x", role_id=2)
    rows, ids, _ = mt.view_delta(LOGIN, view, tables, source.take(spark), cut=shared_cut(spark, "t"))
    assert [r["id"] for r in ids.collect()] == [1]
    assert rows_by_id(mt.visible(rows)) == {1: rows_by_id(pb.build_view(LOGIN, source.frames(spark)))[1]}
    read = {f.rsplit("/", 2)[-2] for f in rows.inputFiles() if folder in f}
    assert read == {"user", "role"}


def random_changes(rng, source, n):
    for _ in range(n):
        t = rng.choice(["login", "login", "login", "user", "role"])
        keys = list(source.rows[t])
        op = rng.choice(["insert", "update", "update", "delete", "move"])
        new = rng.randrange(1, 30)
        time = rng.choice(["2020-06-01 00:00:00", "2022-06-01 00:00:00"])
        if op == "insert" and new not in source.rows[t]:
            row = {
                "login": (new, rng.choice([None, rng.randrange(1, 30)]), rng.randrange(1, 30), time, rng.choice([None, "x"])),
                "user": (new, rng.choice([None, f"u{new}"]), "i"),
                "role": (new, f"r{rng.randrange(9)}"),
            }[t]
            source.insert(t, *row)
        elif not keys:
            continue
        elif op == "delete":
            source.delete(t, rng.choice(keys))
        elif op == "move" and new not in source.rows[t]:
            source.update(t, rng.choice(keys), id=new)
        elif op == "update":
            sets = {
                "login": {"user_id": rng.choice([None, rng.randrange(1, 30)]), "login_time": time},
                "user": {"name": rng.choice([None, "v"])},
                "role": {"name": f"r{rng.randrange(9)}"},
            }[t]
            source.update(t, rng.choice(keys), **sets)


@pytest.mark.parametrize("seed", range(2))
def test_random_feed_in_batches(spark, seed, folder):
    """After every batch the view equals a rebuild; shuffled delivery inside a batch is harmless."""
    rng, source = random.Random(seed), Source()
    tables = source.frames(spark)
    view = pb.build_view(LOGIN, tables, match_columns=True)
    for batch in range(3):
        n = len(source.changes)
        random_changes(rng, source, 25)
        made = source.changes[n:]
        rng.shuffle(made)
        feed = spark.createDataFrame(made, source.take(spark).schema)
        view, tables = mt.apply_changes(LOGIN, view, tables, feed, cut=shared_cut(spark, "r"))
        # lineage is cut by writing, as a long run would
        for name, df in [("v", view), *tables.items()]:
            df.write.parquet(f"{folder}/{batch}/{name}")
        view = spark.read.parquet(f"{folder}/{batch}/v")
        tables = {t: spark.read.parquet(f"{folder}/{batch}/{t}") for t in tables}
        check(spark, source, view)


def test_duplicate_lookup_keys(spark):
    tables = Source().frames(spark)
    tables["role"] = tables["role"].unionAll(tables["role"].filter("id = 1"))
    assert [tuple(r) for r in pb.duplicate_lookup_keys(LOGIN, tables).collect()] == [("role", "1", 2)]
    with pytest.raises(ValueError, match="role.1"):
        mt.lookup_guard(LOGIN, tables)
    rows = rows_by_id(pb.build_view(LOGIN, mt.lookup_guard(LOGIN, tables, mode="quarantine")))
    assert sorted(rows) == [1, 2, 3] and rows[1]["role_name"] is None


def test_relevant_columns_hold_where_columns(spark):
    spec = ViewSpec.load({"id": 1, "name": "n", "master": "login", "pk": "id", "where": "login.login_time > '2021-01-01'"})
    assert spec.relevant_columns("login", Source().frames(spark)["login"]) == ["id", "login_time"]


def test_validation(spark):
    tables = Source().frames(spark)
    base = {"id": 1, "name": "n", "master": "login", "pk": "id"}
    for bad in (
        {"where": "no_such > 1"},
        {"where": "id >"},
        {"pk": "nope"},
        {"columns": [{"name": "c", "table": "login", "column": "nope"}]},
        {"lookups": [{"table": "user", "master_column": "nope", "key": "id"}]},
        {"lookups": [{"table": "gone", "master_column": "user_id", "key": "id"}]},
    ):
        with pytest.raises(SpecError):
            ViewSpec.load({**base, **bad}).validate(tables)
    for bad in (
        {"lookups": [{"table": "user", "master_column": "user_id", "key": "id"}] * 2},
        {"columns": [{"name": "c", "table": "login", "column": "id"}, {"name": "d", "table": "other", "column": "x"}]},
        {"columns": [{"name": "c", "table": "login", "column": "user_id"}] * 2},
        {"pk": ["id", "user_id"]},
    ):
        with pytest.raises(SpecError):
            ViewSpec.load({**base, **bad})
    with pytest.raises(SpecError):
        load_views([base, base])
    with pytest.raises(SpecError):
        load_views([base, {**base, "id": 2}])


def test_view_schema_and_description(spark):
    from pyspark.sql import functions as F

    tables = Source().frames(spark)
    tables["user"] = tables["user"].withMetadata("name", {"comment": "full name"})
    schema = pb.view_schema(LOGIN, tables)
    assert not schema["id"].nullable and all(f.nullable for f in schema if f.name != "id")
    assert schema["user_name"].metadata["comment"] == "full name"
    assert [f.name for f in schema if f.metadata.get("key")] == ["id", "user_id", "role_id"]
    assert schema.names[-1] == "_updated_time"
    row = pb.describe_views(spark, [LOGIN], tables).first()
    assert "LEFT JOIN role ON login.role_id = role.id" in row["sql"] and row["name"] == "login_mv"
    # the generated text is itself a query with the same rows
    for t, df in tables.items():
        df.createOrReplaceTempView(t)
    assert rows_by_id(spark.sql(row["sql"].replace("user.", "`user`.").replace("JOIN user ", "JOIN `user` "))) == rows_by_id(
        pb.build_view(LOGIN, tables)
    )
