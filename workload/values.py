"""Value normalisation over columns derived from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideview.functions import crypt
from tideview.functions import normalize as nz
from tideview.functions.normalize import SourceColumn, TableSchema
from workload import feeds as fd
from workload.registry import query


def _normal(df: DataFrame, *columns: SourceColumn, **kw) -> DataFrame:
    good, _ = nz.normalize_columns(df, TableSchema("shop", "t", columns), **kw)
    return good


@query(
    "g1_unsigned_integers",
    """SELECT o_orderkey, CAST(o_orderkey % 256 AS BIGINT) AS u8, CAST(o_orderkey % 65536 AS BIGINT) AS u16,
              CAST(o_orderkey * 1000 % 16777216 AS BIGINT) AS u24, CAST(o_orderkey * 300000 % 4294967296 AS BIGINT) AS u32,
              CAST(o_orderkey % 256 - CASE WHEN o_orderkey % 256 > 127 THEN 256 ELSE 0 END AS BIGINT) AS s8 FROM orders""",
)
def unsigned_ints(spark: SparkSession, sf: str) -> DataFrame:
    """Raw signed values of 8, 16, 24 and 32 bits folded back to what was stored."""
    k = F.col("o_orderkey")

    def raw(value: Column, bits: int) -> Column:
        return F.when(value >= 2 ** (bits - 1), value - 2**bits).otherwise(value)

    o = fd.table(spark, sf, "orders").select(
        "o_orderkey",
        raw(k % 256, 8).cast("tinyint").alias("u8"),
        raw(k % 65536, 16).cast("smallint").alias("u16"),
        raw(k * 1000 % 2**24, 24).cast("int").alias("u24"),
        raw(k * 300000 % 2**32, 32).cast("int").alias("u32"),
        raw(k % 256, 8).cast("tinyint").alias("s8"),
    )
    return _normal(
        o, SourceColumn("u8", "tinyint", signed=False), SourceColumn("u16", "smallint", signed=False),
        SourceColumn("u24", "mediumint", signed=False), SourceColumn("u32", "integer", signed=False), SourceColumn("s8", "int1"),
    )


@query(
    "g2_unsigned_64_bit",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR)
              ELSE CAST(CAST(18446744073709551616 AS HUGEINT) - o_orderkey AS VARCHAR) END AS u64 FROM orders""",
)
def unsigned_64(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = fd.table(spark, sf, "orders").select("o_orderkey", F.when(k % 2 == 0, k).otherwise(-k).alias("u64"))
    return _normal(o, SourceColumn("u64", "bigint", signed=False)).select("o_orderkey", F.col("u64").cast("string").alias("u64"))


@query(
    "g3_bit_columns",
    """SELECT o_orderkey, CAST(o_orderkey % 65536 AS VARCHAR) AS b2,
              CAST(CAST(o_orderkey % 256 AS HUGEINT) + 128 * CAST(72057594037927936 AS HUGEINT) AS VARCHAR) AS b8 FROM orders""",
)
def bits(spark: SparkSession, sf: str) -> DataFrame:
    """Little-endian bytes: two of them, and eight with the top bit set."""
    k = F.col("o_orderkey")
    lo, hi = F.lpad(F.hex(k % 256), 2, "0"), F.lpad(F.hex(F.floor(k / 256) % 256), 2, "0")
    o = fd.table(spark, sf, "orders").select(
        "o_orderkey",
        F.unhex(F.concat(lo, hi)).alias("b2"),
        F.unhex(F.concat(lo, F.lit("00000000000080"))).alias("b8"),
    )
    out = _normal(o, SourceColumn("b2", "bit"), SourceColumn("b8", "bit"))
    return out.select("o_orderkey", F.col("b2").cast("string").alias("b2"), F.col("b8").cast("string").alias("b8"))


@query("g4_utf8_text", "SELECT doc_id, text FROM documents")
def utf8_text(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes decoded by the column's charset."""
    d = fd.table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("text"))
    return _normal(d, SourceColumn("text", "longtext", charset="utf8mb4"))


@query("g5_binary_to_base64", "SELECT doc_id, to_base64(encode(text)) AS b64 FROM documents")
def base64_of(spark: SparkSession, sf: str) -> DataFrame:
    d = fd.table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    out = _normal(d, SourceColumn("raw", "blob"))
    return out.select("doc_id", crypt.base64_text(F.col("raw")).alias("b64"))


def _dates(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates as text and as raw micros; every seventh is the zero date."""
    zero = F.col("o_orderkey") % 7 == 0
    micros = F.unix_micros(F.concat(F.col("o_orderdate").cast("string"), F.lit("Z")).cast("timestamp"))
    return fd.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(zero, nz.ZERO_DATE).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("as_text"),
        F.when(zero, F.lit(nz.ZERO_RAW).cast("bigint")).otherwise(micros).alias("as_raw"),
    )


@query(
    "g6_dates_with_zero_as_null",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS as_text,
              CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS as_raw FROM orders""",
)
def dates(spark: SparkSession, sf: str) -> DataFrame:
    return _normal(_dates(spark, sf), SourceColumn("as_text", "date"), SourceColumn("as_raw", "date"))


@query(
    "g6_dates_with_zero_kept",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '0000-00-00' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS as_text,
              CASE WHEN o_orderkey % 7 = 0 THEN '0000-00-00' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS as_raw FROM orders""",
)
def dates_kept(spark: SparkSession, sf: str) -> DataFrame:
    columns = (SourceColumn("as_text", "date"), SourceColumn("as_raw", "date"))
    return _normal(_dates(spark, sf), *columns, zero_dates_as_null=False)


def _micros(spark: SparkSession, sf: str) -> DataFrame:
    """Event times as raw micros, half of them moved before 1970."""
    m = F.unix_micros(F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp"))
    back = F.when(F.col("event_id") % 2 == 0, m).otherwise(m - 3_000_000_000_000_000)
    return fd.table(spark, sf, "events").select("event_id", back.alias("t0"), back.alias("t3"), back.alias("t6"))


_BACK = "CASE WHEN event_id % 2 = 0 THEN ts ELSE ts - INTERVAL 3000000000 SECONDS END"


@query(
    "g7_datetimes_from_micros",
    f"""SELECT event_id, date_trunc('second', {_BACK}) AS t0, date_trunc('millisecond', {_BACK}) AS t3, {_BACK} AS t6 FROM events""",
)
def datetimes(spark: SparkSession, sf: str) -> DataFrame:
    """Fraction digits are cut, also before 1970."""
    digits = {"t0": 0, "t3": 3, "t6": 6}
    return _normal(_micros(spark, sf), *[SourceColumn(n, "datetime", length=d) for n, d in digits.items()])


@query(
    "g7_datetimes_as_text",
    f"""SELECT event_id, strftime({_BACK}, '%Y-%m-%d %H:%M:%S') AS t0, strftime({_BACK}, '%Y-%m-%d %H:%M:%S.%g') AS t3,
               strftime({_BACK}, '%Y-%m-%d %H:%M:%S.%f') AS t6 FROM events""",
)
def datetimes_text(spark: SparkSession, sf: str) -> DataFrame:
    digits = {"t0": 0, "t3": 3, "t6": 6}
    columns = [SourceColumn(n, "timestamp", length=d) for n, d in digits.items()]
    return _normal(_micros(spark, sf), *columns, zero_dates_as_null=False)


_CLOCK = """lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0')"""


@query(
    "g8_times",
    f"""SELECT event_id, CASE WHEN event_id % 2 = 1 AND event_id > 0 THEN '-' ELSE '' END || {_CLOCK} AS c0,
               CASE WHEN event_id % 2 = 1 AND event_id > 0 THEN '-' ELSE '' END || {_CLOCK} || '.' || lpad(CAST(event_id * 37 % 1000 AS VARCHAR), 3, '0') AS c3
        FROM (SELECT event_id, event_id * 11 % 300000 AS s FROM events)""",
)
def times(spark: SparkSession, sf: str) -> DataFrame:
    """Up to 83 hours, half of them negative."""
    n = F.col("event_id")
    micros = (n * 11 % 300000) * 1_000_000 + (n * 37 % 1000) * 1000
    raw = F.when(n % 2 == 1, -micros).otherwise(micros)
    e = fd.table(spark, sf, "events").select("event_id", raw.alias("c0"), raw.alias("c3"))
    return _normal(e, SourceColumn("c0", "time"), SourceColumn("c3", "time", length=3))


@query("g9_years", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y1, CAST(1900 + o_orderkey % 200 AS INTEGER) AS y2 FROM orders")
def years(spark: SparkSession, sf: str) -> DataFrame:
    o = fd.table(spark, sf, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("y1"), (F.lit(1900) + F.col("o_orderkey") % 200).cast("smallint").alias("y2")
    )
    return _normal(o, SourceColumn("y1", "year"), SourceColumn("y2", "year"))


@query(
    "g10_enum_labels",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' END AS e,
              o_orderstatus AS already FROM orders""",
)
def enums(spark: SparkSession, sf: str) -> DataFrame:
    o = fd.table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 4).cast("int").alias("e"), F.col("o_orderstatus").alias("already")
    )
    return _normal(o, SourceColumn("e", "enum", labels=("a", "b", "c")), SourceColumn("already", "enum", labels=("P", "F", "O")))


@query(
    "g11_set_labels",
    """SELECT o_orderkey, concat_ws('|', CASE WHEN o_orderkey % 2 = 1 THEN 'a' END, CASE WHEN o_orderkey // 2 % 2 = 1 THEN 'b' END,
              CASE WHEN o_orderkey // 4 % 2 = 1 THEN 'c' END) AS s, 'x|' || o_orderstatus AS t FROM orders""",
)
def sets(spark: SparkSession, sf: str) -> DataFrame:
    o = fd.table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 8).alias("s"), F.concat(F.lit("x,"), F.col("o_orderstatus")).alias("t")
    )
    out = _normal(o, SourceColumn("s", "set", labels=("a", "b", "c")), SourceColumn("t", "set"))
    return out.select("o_orderkey", F.array_join("s", "|").alias("s"), F.array_join("t", "|").alias("t"))


@query(
    "g12_json_passed_through",
    "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END AS props FROM events",
)
def json_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Valid JSON keeps its text; every fifth is broken."""
    broken = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    e = fd.table(spark, sf, "events").select("event_id", broken.alias("props"))
    return _normal(e, SourceColumn("props", "json"))


@query("g13_geometry_without_header", "SELECT event_id, '010100000000000000000000000000000000000840' AS wkb FROM events")
def geometry(spark: SparkSession, sf: str) -> DataFrame:
    """The reference number in front is cut off and the standard binary form stays."""
    header = F.lpad(F.hex(F.col("event_id")), 8, "0")
    raw = F.unhex(F.concat(header, F.lit("010100000000000000000000000000000000000840")))
    e = fd.table(spark, sf, "events").select("event_id", raw.alias("wkb"))
    return _normal(e, SourceColumn("wkb", "point")).select("event_id", F.lower(F.hex("wkb")).alias("wkb"))


@query(
    "g14_type_names",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'int' WHEN 1 THEN 'tinyint' WHEN 2 THEN 'decimal' WHEN 3 THEN
              CASE WHEN p_size * 1000 < 256 THEN 'tinytext' WHEN p_size * 1000 < 65536 THEN 'text' ELSE 'mediumtext' END
              WHEN 4 THEN 'mediumtext' ELSE 'varchar' END AS plain_type,
              CASE p_partkey % 6 WHEN 0 THEN 'bigint' WHEN 1 THEN 'bigint' WHEN 2 THEN 'decimal' ELSE 'string' END AS spark_type FROM part""",
)
def type_names(spark: SparkSession, sf: str) -> DataFrame:
    """Declared names folded to plain types; text is sized by its length."""
    r = F.col("p_partkey") % 6
    declared = F.when(r == 0, "INTEGER").when(r == 1, "bool").when(r == 2, "numeric").when(r == 3, "text").when(r == 4, "long").otherwise("nvarchar")
    p = fd.table(spark, sf, "part").select("p_partkey", declared.alias("type"), F.when(r == 3, F.col("p_size") * 1000).alias("n"))
    return nz.plain_types(p, "type", "n").select("p_partkey", "plain_type", "spark_type")


@query(
    "g15_cast_failures",
    """SELECT 'shop' AS db, 'orders' AS tbl, 'priority' AS col, 'int' AS typ, o_orderpriority AS val FROM orders
       UNION ALL SELECT 'shop', 'orders', 'day', 'date', 'day ' || o_orderkey FROM orders WHERE o_orderkey % 3 = 0
       UNION ALL SELECT 'shop', 'orders', 'kind', 'enum', '9' FROM orders WHERE o_orderkey % 10 = 9""",
)
def cast_failures(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = fd.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("priority"),
        F.when(k % 3 == 0, F.concat(F.lit("day "), k.cast("string"))).when(k % 3 == 1, nz.ZERO_DATE).otherwise("2020-02-29").alias("day"),
        (k % 10).cast("int").alias("kind"),
    )
    columns = (SourceColumn("priority", "int"), SourceColumn("day", "date"), SourceColumn("kind", "enum", labels=tuple("abcdefgh")))
    _, rejects = nz.normalize_columns(o, TableSchema("shop", "orders", columns))
    return rejects.select(
        F.col("database").alias("db"), F.col("table").alias("tbl"), F.col("column").alias("col"), F.col("type").alias("typ"), F.col("value").alias("val")
    )


@query(
    "g15_rows_without_failures",
    "SELECT o_orderkey, CAST(o_orderkey % 100 AS BIGINT) AS n FROM orders WHERE o_orderkey % 3 <> 0",
)
def clean_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = fd.table(spark, sf, "orders").select("o_orderkey", F.when(k % 3 == 0, F.lit("none")).otherwise((k % 100).cast("string")).alias("n"))
    return _normal(o, SourceColumn("n", "smallint"), keep_bad=False)
