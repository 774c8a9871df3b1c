"""Filter rules: kinds, order, NULL, missing columns, text forms."""

import pytest
from pyspark.sql import functions as F

from tideview.operators import filters as fl

ROWS = [
    ("shop", "orders", {"status": "F"}),
    ("shop", "orders", {"status": None}),
    ("shop", "orders", {"other": "1"}),
    ("shop", "customer", {"status": "null"}),
    ("crm", "orders", {"status": "NULL"}),
    ("mysql", "rds_heartbeat2", {}),
    ("mysql", "ha_health_check", {}),
    ("shop", None, {}),
]
TABLE = [0, 1, 2, 3, 4, 7]

CASES = [
    ("", TABLE),
    ("exclude: *.*", []),
    ("exclude: *.*, include: shop.*", [0, 1, 2, 3, 7]),
    ("include: shop.*, exclude: *.orders", [3]),
    ("exclude: shop.orders", [3, 4]),
    ("exclude: `shop`.'orders'", [3, 4]),
    ('EXCLUDE: "shop" . /^ord/', [3, 4]),
    ("exclude: *./der/", [3]),
    ("exclude: shop.order", [0, 1, 2, 3, 4]),
    ("blacklist: crm.*", [0, 1, 2, 3, 7]),
    ("exclude: *.*.status=*", [2, 7]),
    ("exclude: *.*.status=F", [1, 2, 3, 4, 7]),
    ("exclude: *.*.status=null", [0, 2, 7]),
    ("exclude: *.*.status=NULL", [0, 2, 7]),
    ("exclude: *.*.status=/^[A-Z]$/", [1, 2, 3, 4, 7]),
    ("exclude: *.*.status=/ul/", [0, 1, 2, 4, 7]),
    ("exclude: *.*, include: *.*.status=F", [0]),
    ("exclude: *.*, include: *.*.status=null", [1, 3, 4]),
    ("exclude: *.*, include: *.*.status=F, exclude: shop.*", []),
    ("exclude: *.*.status=*, include: *.*.status=F", [0, 2, 7]),
    ("exclude: mysql.*, include: mysql.*", TABLE),
]


@pytest.fixture(scope="module")
def rows(spark):
    schema = "n int, database string, `table` string, data map<string,string>"
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], schema).cache()


def kept(df, cond):
    return sorted(r["n"] for r in df.filter(cond).collect())


def test_truth_table(rows):
    want, marks = {}, rows
    for i, (text, keep) in enumerate(CASES):
        want[i] = keep
        marks = marks.withColumn(f"v{i}", fl.feed_filter(text))
    got = marks.collect()
    for i, (text, keep) in enumerate(CASES):
        # a table that is missing matches every table pattern, so its verdict follows the rules
        mine = sorted(r["n"] for r in got if r[f"v{i}"])
        assert [n for n in mine if n != 7] == [n for n in keep if n != 7], text


def test_table_step_never_drops_a_row_that_passes(rows):
    for text, _ in CASES:
        lost = rows.filter(fl.feed_filter(text) & ~fl.table_filter(text))
        assert lost.isEmpty(), text


def test_blacklists(rows):
    assert kept(rows, fl.table_blacklisted("exclude: shop.*, blacklist: *.customer")) == [3, 5, 6, 7]
    assert kept(rows, fl.database_blacklisted("blacklist: crm.*, blacklist: shop.orders")) == [4]


def test_options_become_rules():
    rules = fl.rules_from_options(
        include_dbs="a,b", exclude_dbs="c", include_tables="t", exclude_tables="u", blacklist_dbs="d", blacklist_tables="v",
        include_column_values="x=1,y=/z/",
    )
    told = [(r.kind, r.database.text or "*", r.table.text or "*", r.column, r.value and (r.value.text or "*")) for r in rules]
    assert told == [
        ("blacklist", "d", "*", None, None),
        ("blacklist", "*", "v", None, None),
        ("exclude", "*", "*", None, None),
        ("include", "a", "*", None, None),
        ("include", "b", "*", None, None),
        ("exclude", "c", "*", None, None),
        ("include", "*", "t", None, None),
        ("exclude", "*", "u", None, None),
        ("exclude", "*", "*", "x", "*"),
        ("include", "*", "*", "x", "1"),
        ("exclude", "*", "*", "y", "*"),
        ("include", "*", "*", "y", "z"),
    ]
    assert fl.rules_from_options(filter="exclude: q.*", include_dbs="a")[0].database.text == "q"


def test_option_lists_with_regular_expressions():
    rules = fl.rules_from_options(exclude_tables="/^t{1,2}$/, `u`", include_column_values="x=/a,b/, y='c, d'")
    assert [(r.kind, r.table.kind, r.table.text, r.column, r.value and r.value.text) for r in rules] == [
        ("exclude", "regex", "^t{1,2}$", None, None),
        ("exclude", "name", "u", None, None),
        ("exclude", "any", "", "x", ""),
        ("include", "any", "", "x", "a,b"),
        ("exclude", "any", "", "y", ""),
        ("include", "any", "", "y", "c, d"),
    ]
    for bad in ({"include_dbs": "a=b"}, {"include_column_values": "a"}, {"include_dbs": "a b"}, {"exclude_dbs": "/a"}):
        with pytest.raises(fl.FilterError):
            fl.rules_from_options(**bad)


@pytest.mark.parametrize("text", ["allow: a.b", "exclude a.b", "exclude: a", "exclude: a.b.c", "exclude: a.b c"])
def test_bad_rules(text):
    with pytest.raises(fl.FilterError):
        fl.parse_rules(text)


def test_dropped_columns_match_whole_names(spark):
    df = spark.createDataFrame([({"a": "1", "ab": "2", "b.c": "3", "xbc": "4"}, {"a": "0"})], "data map<string,string>, old map<string,string>")
    left = lambda p: sorted(fl.drop_columns(df, p).first()["data"])
    assert left("a") == ["ab", "b.c", "xbc"]
    assert left("/a.*/, b.c") == ["xbc"]
    assert left("/bc/") == ["a", "ab", "b.c", "xbc"]
    assert fl.drop_columns(df, "a").select(F.size("old")).first()[0] == 0
