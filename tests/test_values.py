"""Conversions at their boundaries."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tideview.functions import normalize as nz
from tideview.functions.names import camel_case, to_camel_case
from tideview.functions.normalize import SourceColumn, TableSchema


def one(spark, value, kind, col, **kw):
    """Each value of a list through one column's conversion."""
    df = spark.createDataFrame([(v,) for v in value], f"v {kind}")
    good, bad = nz.normalize_columns(df, TableSchema("d", "t", (col,)), **kw)
    return [r[0] for r in good.collect()], [r["value"] for r in bad.collect()]


def test_integers(spark):
    u = lambda t: SourceColumn("v", t, signed=False)
    assert one(spark, [-1, -128, 127, None], "tinyint", u("tinyint"))[0] == [255, 128, 127, None]
    assert one(spark, [-1, -(2**31)], "int", u("int"))[0] == [2**32 - 1, 2**31]
    assert one(spark, [-1, -(2**23)], "int", u("middleint"))[0] == [2**24 - 1, 2**23]
    assert one(spark, [-1, -(2**63), 5], "bigint", u("bigint"))[0] == [Decimal(2**64 - 1), Decimal(2**63), Decimal(5)]
    assert one(spark, [True, False], "boolean", SourceColumn("v", "bool"))[0] == [1, 0]
    assert one(spark, ["12", "x"], "string", SourceColumn("v", "int")) == ([12, None], ["x"])


def test_bits(spark):
    col = SourceColumn("v", "bit")
    values = [bytes([1]), bytes([0, 1]), bytes([255] * 8), bytes([0] * 7 + [128]), b"", None]
    got, bad = one(spark, values, "binary", col)
    assert got == [Decimal(1), Decimal(256), Decimal(2**64 - 1), Decimal(2**63), Decimal(0), None] and bad == []
    assert one(spark, [bytes([0, 0, 0, 0, 1])], "binary", col)[0] == [Decimal(2**32)]


def test_dates_and_times(spark):
    zero = nz.ZERO_RAW
    day = SourceColumn("v", "date")
    assert one(spark, ["2020-02-29", "0000-00-00", "2021-02-29"], "string", day) == ([date(2020, 2, 29), None, None], ["2021-02-29"])
    assert one(spark, [-1, zero], "bigint", day)[0] == [date(1969, 12, 31), None]
    assert one(spark, [-1, zero], "bigint", day, zero_dates_as_null=False)[0] == ["1969-12-31", "0000-00-00"]
    stamp = lambda n, t="datetime": SourceColumn("v", t, length=n)
    assert one(spark, [-1, 1_999_999], "bigint", stamp(0))[0] == [datetime(1969, 12, 31, 23, 59, 59), datetime(1970, 1, 1, 0, 0, 1)]
    assert one(spark, [-1], "bigint", stamp(3))[0] == [datetime(1969, 12, 31, 23, 59, 59, 999000)]
    assert one(spark, [-1], "bigint", stamp(6))[0] == [datetime(1969, 12, 31, 23, 59, 59, 999999)]
    text = dict(zero_dates_as_null=False)
    assert one(spark, [-1, zero, 0], "bigint", stamp(3), **text)[0] == [
        "1969-12-31 23:59:59.999", "0000-00-00 00:00:00.000", "1970-01-01 00:00:00.000",
    ]
    assert one(spark, [0], "bigint", stamp(0, "timestamp"), **text)[0] == ["0000-00-00 00:00:00"]
    assert one(spark, [0], "bigint", stamp(0, "timestamp")) == ([None], [])
    clock = lambda n: SourceColumn("v", "time", length=n)
    second = 1_000_000
    assert one(spark, [-second, 90_061 * second, -838 * 3600 * second, 0], "bigint", clock(0))[0] == [
        "-00:00:01", "25:01:01", "-838:00:00", "00:00:00",
    ]
    assert one(spark, [1_234_567, -1], "bigint", clock(4))[0] == ["00:00:01.2345", "-00:00:00.0000"]
    assert one(spark, [date(1999, 1, 1)], "date", SourceColumn("v", "year"))[0] == [1999]


def test_labels(spark):
    e = SourceColumn("v", "enum", labels=("a", "b"))
    assert one(spark, [0, 1, 2, 3, None], "int", e) == ([None, "a", "b", None, None], ["3"])
    s = SourceColumn("v", "set", labels=("a", "b", "c"))
    assert one(spark, [0, 5, 7, None], "bigint", s)[0] == [[], ["a", "c"], ["a", "b", "c"], None]
    assert one(spark, ["a,b"], "string", s)[0] == [["a", "b"]]


def test_text_json_geometry(spark):
    assert one(spark, ["é".encode()], "binary", SourceColumn("v", "text", charset="utf8mb4"))[0] == ["é"]
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        assert one(spark, [b"\x80"], "binary", SourceColumn("v", "char", charset="latin1"))[0] == ["€"]
        assert one(spark, ["日本".encode("euc-jp")], "binary", SourceColumn("v", "char", charset="ujis"))[0] == ["日本"]
    finally:
        spark.conf.unset("spark.sql.legacy.javaCharsets")
    assert nz.needs_java_charsets("latin1") and not nz.needs_java_charsets("utf8")
    assert one(spark, ['{"a":1}', "{"], "string", SourceColumn("v", "json")) == (['{"a":1}', None], ["{"])
    assert [bytes(x) for x in one(spark, [b"\0\0\0\0wkb"], "binary", SourceColumn("v", "point"))[0]] == [b"wkb"]
    assert one(spark, ["1.50"], "string", SourceColumn("v", "numeric", precision=10, scale=2))[0] == [Decimal("1.50")]


def test_type_names():
    assert nz.plain_type("INTEGER") == "int" and nz.plain_type("serial") == "bigint"
    assert [nz.plain_type("text", n) for n in (255, 256, 65535, 65536, 2**24, None)] == [
        "tinytext", "text", "text", "mediumtext", "longtext", "text",
    ]
    assert nz.plain_type("varchar", long=True) == "mediumtext" and nz.plain_type("char", byte=True) == "binary"
    assert nz.spark_type("fixed", 10, 2) == "decimal(10,2)"
    for bad in (lambda: nz.spark_type("hyperint"), lambda: nz.plain_type("int", byte=True)):
        with pytest.raises(ValueError):
            bad()


NAMES = {"a_b": "aB", "_a": "a", "__a_b": "aB", "a_": "a", "a__b": "a_b", "a___b": "a_B", "a__": "a_", "__": "__", "a_1": "a1", "a_B": "aB", "ab": "ab"}


def test_camel_case(spark):
    assert {n: to_camel_case(n) for n in NAMES} == NAMES
    rows = spark.createDataFrame([(n,) for n in NAMES], "n string").select("n", camel_case(F.col("n")).alias("c")).collect()
    assert {r["n"]: r["c"] for r in rows} == NAMES
