"""Reading, filtering, ordering, keying and writing change feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideview.functions.names import rename_fields, rename_keys
from tideview.operators import feed as op
from tideview.operators import filters as fl
from tideview.operators import keys as ky
from tideview.operators.hooks import drop_suppressed, put, with_hook
from tideview.plans.build import build_view
from tideview.sources import feed as src
from tideview.sources.change import after_positions, as_changes, image_map, position_struct, typed_changes, unfit_values
from workload import feeds as fd
from workload.registry import query, scratch
from workload.views import every_feed

def _off() -> Column:
    return F.col("position.offset").alias("off")


def _m(spark: SparkSession, sf: str, rules=fd.ALL_M) -> DataFrame:
    return fd.feed_m(fd.table(spark, sf, "orders"), rules)


def _l(spark: SparkSession, sf: str, rules=fd.ALL_L) -> DataFrame:
    return fd.feed_l(fd.table(spark, sf, "customer"), rules)


def _e(spark: SparkSession, sf: str) -> DataFrame:
    return fd.feed_e(fd.table(spark, sf, "events"))


def _id() -> Column:
    return F.col("data")["event_id"].cast("bigint").alias("event_id")


# -- reading -------------------------------------------------------------------------------


@query(
    "a2_read_change_feed",
    f"""SELECT off, typ, k, custkey, total, odate, old_k, xid, 1700000000 + src % 1000 AS ts, 'o_orderkey' AS pk
        FROM ({fd.feed_m_sql()})""",
)
def read_feed(spark: SparkSession, sf: str) -> DataFrame:
    """The feed written as JSON lines and read back, values cast to the table's types."""
    orders = fd.table(spark, sf, "orders")
    options = src.OutputOptions(position=True, server_id=True, primary_key_columns=True, tables={"orders": orders.schema})
    path = scratch(spark, "a2")
    src.write_changes(_m(spark, sf), path, options)
    changes, _ = src.read_changes(spark, path)
    rows = typed_changes(changes, "orders", orders.schema)
    return rows.select(
        F.col("_change.position.offset").alias("off"),
        F.col("_change.type").alias("typ"),
        F.col("o_orderkey").alias("k"),
        F.col("o_custkey").alias("custkey"),
        F.col("o_totalprice").alias("total"),
        F.col("o_orderdate").alias("odate"),
        F.col("_change.old")["o_orderkey"].cast("bigint").alias("old_k"),
        F.col("_change.xid").alias("xid"),
        F.col("_change.ts").alias("ts"),
        F.col("_change.primary_key_columns")[0].alias("pk"),
    )


@query(
    "a2_rejected_lines",
    """SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'broken JSON' WHEN 1 THEN 'type is required'
              WHEN 2 THEN 'database is required' WHEN 3 THEN 'table is required' WHEN 4 THEN 'ts is required'
              WHEN 5 THEN 'data is required' WHEN 6 THEN 'data is not an object' WHEN 7 THEN 'ts is not a number' END AS reason
       FROM events WHERE event_id % 9 <> 8""",
)
def rejected(spark: SparkSession, sf: str) -> DataFrame:
    """Each kind of bad line by ``event_id % 9``; every ninth is good."""
    parts = ['"type":"insert"', '"database":"shop"', '"table":"events"', '"ts":1', '"data":{"a":1}']
    good = "{" + ",".join(parts) + "}"
    line = F.when(F.col("event_id") % 9 == 0, F.lit(good[:-4]))
    for i in range(5):
        line = line.when(F.col("event_id") % 9 == i + 1, F.lit("{" + ",".join(parts[:i] + parts[i + 1 :]) + "}"))
    line = line.when(F.col("event_id") % 9 == 6, F.lit("{" + ",".join(parts[:4]) + ',"data":[1]}'))
    line = line.when(F.col("event_id") % 9 == 7, F.lit(good.replace('"ts":1', '"ts":"x"'))).otherwise(F.lit(good))
    lines = fd.table(spark, sf, "events").select("event_id", line.alias("value"))
    _, rejects = src.parse_changes(lines, carry=("event_id",))
    return rejects.select("event_id", "reason")


@query(
    "a3_value_typing",
    """SELECT event_id, event_id * 1000003 AS big, value AS num, event_type AS txt, event_id % 2 = 0 AS flag,
              true AS has_null, false AS has_object, false AS has_list, CAST(5 AS BIGINT) AS n FROM events""",
)
def value_typing(spark: SparkSession, sf: str) -> DataFrame:
    """Scalars keep their type; with ``nested='skip'`` objects and lists are left out."""
    body = F.to_json(
        F.struct(
            (F.col("event_id") * 1000003).alias("big"), F.col("value").alias("num"), F.col("event_type").alias("txt"),
            (F.col("event_id") % 2 == 0).alias("flag"), F.lit(None).cast("int").alias("none"),
            F.struct(F.col("value").alias("x")).alias("object"), F.array("event_id").alias("list"),
        ),
        {"ignoreNullFields": "false"},
    )
    line = F.concat(F.lit('{"type":"insert","database":"d","table":"t","ts":1,"data":'), body, F.lit("}"))
    lines = fd.table(spark, sf, "events").select("event_id", line.alias("value"))
    changes, _ = src.parse_changes(lines, nested="skip", carry=("event_id",))
    d = F.col("data")
    return changes.select(
        "event_id",
        d["big"].try_cast("bigint").alias("big"),
        d["num"].try_cast("double").alias("num"),
        d["txt"].alias("txt"),
        d["flag"].try_cast("boolean").alias("flag"),
        (F.map_contains_key("data", F.lit("none")) & d["none"].isNull()).alias("has_null"),
        F.map_contains_key("data", F.lit("object")).alias("has_object"),
        F.map_contains_key("data", F.lit("list")).alias("has_list"),
        F.size("data").cast("bigint").alias("n"),
    )


# -- writing -------------------------------------------------------------------------------

_CUSTOMER_AFTER = fd.customer_sql((fd.GONE, fd.CHANGED, fd.NULLED))


def _segment_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of customer over key and segment only."""
    c = fd.table(spark, sf, "customer")
    r = F.pmod("c_custkey", F.lit(10))
    after = c.filter(r != fd.GONE).withColumn(
        "c_mktsegment",
        F.when(r == fd.CHANGED, "CHANGED").when(r == fd.NULLED, F.lit(None)).otherwise(F.col("c_mktsegment")),
    )
    out = op.diff_snapshots(c, after, "c_custkey", database="shop", table="customer", columns=["c_mktsegment"])
    key = F.col("data")["c_custkey"].cast("bigint")
    return out.withColumn("ts", key % 100).withColumn("xid", F.floor(key / 4).cast("bigint")).withColumn(
        "commit", key % 4 == 0
    ).withColumn("xoffset", key % 4).withColumn("position", position_struct(F.lit(fd.FILE), key * 10)).withColumn(
        "server_id", F.lit(7).cast("bigint")
    )


def _json_sql(head: str, images: str, where: str = "true") -> str:
    return f"""SELECT key, '{{"database":"shop","table":"customer"' || {head} || {images} || '}}' AS value FROM (
        SELECT c_custkey AS key, c_custkey % 10 AS r, c_custkey // 4 AS xid, c_mktsegment AS seg,
               CASE WHEN c_custkey % 10 = 2 THEN 'delete' ELSE 'update' END AS typ
        FROM customer WHERE c_custkey % 10 IN (2, 4, 8)) WHERE {where}"""


_IMAGES = """',"data":{"c_custkey":' || key || ',"c_mktsegment":' ||
    CASE r WHEN 2 THEN '"' || seg || '"' WHEN 4 THEN '"CHANGED"' ELSE 'null' END || '}' ||
    CASE WHEN r = 2 THEN '' ELSE ',"old":{"c_mktsegment":"' || seg || '"}' END"""
_HEAD = """',"type":"' || typ || '","ts":' || key % 100 || ',"xid":' || xid ||
    CASE WHEN key % 4 = 0 THEN ',"commit":true' ELSE '' END"""


def _json(spark: SparkSession, sf: str, df: DataFrame, **options) -> DataFrame:
    o = src.OutputOptions(tables={"customer": fd.table(spark, sf, "customer").schema}, **options)
    keyed = df.withColumn("key", F.col("data")["c_custkey"].cast("bigint"))
    return src.to_change_json(keyed, o, carry=("key",))


@query("a4_write_change_json", _json_sql(_HEAD, _IMAGES))
def write_json(spark: SparkSession, sf: str) -> DataFrame:
    return _json(spark, sf, _segment_changes(spark, sf))


@query(
    "f15_null_suppression",
    _json_sql(
        _HEAD,
        """',"data":{"c_custkey":' || key || CASE r WHEN 2 THEN ',"c_mktsegment":"' || seg || '"' WHEN 4 THEN ',"c_mktsegment":"CHANGED"' ELSE '' END || '}' ||
           CASE WHEN r = 2 THEN '' ELSE ',"old":{"c_mktsegment":"' || seg || '"}' END""",
    ),
)
def null_suppression(spark: SparkSession, sf: str) -> DataFrame:
    return _json(spark, sf, _segment_changes(spark, sf), nulls=False)


@query(
    "f16_chosen_metadata",
    _json_sql(
        """',"type":"' || typ || '","ts":' || key % 100 || ',"xid":' || xid ||
           CASE WHEN key % 4 = 0 THEN ',"commit":true' ELSE ',"xoffset":' || key % 4 END ||
           ',"position":"log.000001:' || key * 10 || '","server_id":7,"primary_key":[' || key || '],"primary_key_columns":["c_custkey"]'""",
        _IMAGES,
    ),
)
def chosen_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return _json(
        spark, sf, _segment_changes(spark, sf), xoffset=True, position=True, server_id=True, primary_keys=True, primary_key_columns=True
    )


@query(
    "f19_extra_attributes",
    _json_sql(_HEAD + """ || ',"comment":"nightly","origin":"shop-' || key % 3 || '"'""", _IMAGES),
)
def extra_attributes(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("data")["c_custkey"].cast("bigint")
    df = src.with_extra(_segment_changes(spark, sf), comment="nightly", origin=F.concat(F.lit("shop-"), (key % 3).cast("string")))
    return _json(spark, sf, df)


@query(
    "f14_camel_case_json",
    """SELECT key, '{"database":"shop","table":"customer","type":"' || typ || '","ts":' || key % 100 ||
              ',"primaryKeyColumns":["c_custkey"],"data":{"cCustkey":' || key || ',"cMktsegment":' ||
              CASE r WHEN 2 THEN '"' || seg || '"' WHEN 4 THEN '"CHANGED"' ELSE 'null' END || '}' ||
              CASE WHEN r = 2 THEN '' ELSE ',"old":{"cMktsegment":"' || seg || '"}' END || '}' AS value
       FROM (SELECT c_custkey AS key, c_custkey % 10 AS r, c_mktsegment AS seg,
                    CASE WHEN c_custkey % 10 = 2 THEN 'delete' ELSE 'update' END AS typ
             FROM customer WHERE c_custkey % 10 IN (2, 4, 8))""",
)
def camel_json(spark: SparkSession, sf: str) -> DataFrame:
    return _json(
        spark, sf, _segment_changes(spark, sf), naming="underscore_to_camelcase", commit_info=False, primary_key_columns=True
    )


@query(
    "f14_camel_case_names",
    """SELECT p_partkey AS "pPartkey", p_size AS "pSize", 'pName' AS k1, 'a_b' AS k2, 'a' AS k3, '__' AS k4 FROM part""",
)
def camel_names(spark: SparkSession, sf: str) -> DataFrame:
    """Columns renamed on the driver, map keys by expression."""
    p = rename_fields(fd.table(spark, sf, "part").select("p_partkey", "p_size"))
    names = ["_p_name", "a__b", "a_", "__"]
    m = F.create_map(*[x for i, n in enumerate(names) for x in (F.concat(F.lit(n), F.lit("")), F.lit(i))])
    keys = F.map_keys(rename_keys(m))
    return p.select("*", *[keys[i].alias(f"k{i + 1}") for i in range(4)])


_SEALED = """SELECT c_custkey AS key, CASE c_custkey % 10 WHEN 2 THEN c_mktsegment WHEN 4 THEN 'CHANGED' END AS segment,
    CASE WHEN c_custkey % 10 = 2 THEN NULL ELSE c_mktsegment END AS old_segment, true AS hidden
    FROM customer WHERE c_custkey % 10 IN (2, 4, 8)"""


def _sealed(mode: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        secret = "0123456789abcdef"
        lines = _json(spark, sf, _segment_changes(spark, sf), encrypt=mode, secret_key=secret)
        # the iv is random, so lines are cut from their source before they are read twice
        hidden = lines.withColumn("hidden", ~F.col("value").contains("c_mktsegment"))
        changes, _ = src.parse_changes(hidden, key=secret, carry=("hidden",))
        return changes.select(
            F.col("data")["c_custkey"].cast("bigint").alias("key"),
            F.col("data")["c_mktsegment"].alias("segment"),
            F.col("old")["c_mktsegment"].alias("old_segment"),
            "hidden",
        )

    return run


query("f17_f18_encrypted_data_round_trip", _SEALED)(_sealed("data"))
query("f17_f18_encrypted_row_round_trip", _SEALED)(_sealed("all"))


# -- filters -------------------------------------------------------------------------------


def _mixed(spark: SparkSession, sf: str) -> DataFrame:
    """All feeds spread over four databases by offset."""
    return every_feed(spark, sf).withColumn("database", F.concat(F.lit("db"), (F.col("position.offset") % 4).cast("string")))


_MIXED_SQL = f"""SELECT 'orders' AS tbl, off, 'db' || off % 4 AS db, status, CAST(NULL AS VARCHAR) AS segment, NULL AS event_type FROM ({fd.feed_m_sql()})
    UNION ALL SELECT 'customer', off, 'db' || off % 4, NULL, segment, NULL FROM ({fd.feed_l_sql()})
    UNION ALL SELECT 'events', off, 'db' || off % 4, NULL, NULL, event_type FROM ({fd.FEED_E_SQL})"""


def _verdict(name: str, rules, sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        kept = _mixed(spark, sf).filter(fl.feed_filter(rules))
        return kept.select(F.col("database").alias("db"), F.col("table").alias("tbl"), _off())

    query(name, f"SELECT db, tbl, off FROM ({_MIXED_SQL}) WHERE {sql}")(run)


_verdict(
    "c3_table_rules_last_match_wins",
    "exclude: db1.*, include: db1./^ord/, exclude: *.customer, include: `db3`.'customer', blacklist: db2.events",
    """CASE WHEN db = 'db2' AND tbl = 'events' THEN false WHEN db = 'db3' AND tbl = 'customer' THEN true
            WHEN tbl = 'customer' THEN false WHEN db = 'db1' AND tbl LIKE 'ord%' THEN true WHEN db = 'db1' THEN false ELSE true END""",
)
_verdict(
    "c4_column_value_rules",
    "exclude: *.*.o_orderstatus=*, include: *.*.o_orderstatus=/^[FN]$/, exclude: *.*.c_mktsegment=null, exclude: *.events.event_type=click",
    """(tbl = 'orders' AND status IN ('F', 'N')) OR (tbl = 'customer' AND segment IS NOT NULL) OR (tbl = 'events' AND event_type <> 'click')""",
)
_verdict(
    "c5_excluded_table_rescued_by_column",
    "exclude: *.*, include: db1.orders.o_orderstatus=P, include: *.events.event_type=/i/",
    "(db = 'db1' AND tbl = 'orders' AND status = 'P') OR (tbl = 'events' AND event_type LIKE '%i%')",
)
_verdict(
    "c7_rules_from_option_lists",
    fl.rules_from_options(
        include_dbs="db0,db1", exclude_dbs="db1", include_tables="customer", exclude_tables="events",
        blacklist_tables="nothing", include_column_values="o_orderstatus=F",
    ),
    """CASE WHEN tbl = 'orders' THEN status = 'F' ELSE tbl <> 'events' AND (tbl = 'customer' OR db = 'db0') END""",
)


@query(
    "c5_table_step_before_rows",
    f"SELECT db, tbl, off FROM ({_MIXED_SQL}) WHERE (db = 'db1' AND tbl = 'orders') OR tbl = 'events'",
)
def table_step(spark: SparkSession, sf: str) -> DataFrame:
    rules = "exclude: *.*, include: db1.orders.o_orderstatus=P, include: *.events.event_type=/i/"
    return _mixed(spark, sf).filter(fl.table_filter(rules)).select(F.col("database").alias("db"), F.col("table").alias("tbl"), _off())


@query(
    "c6_built_in_exclusions",
    """SELECT event_id, event_id % 4 = 3 AS listed FROM events
       WHERE NOT (event_id % 2 = 0 AND event_id % 3 IN (0, 1))""",
)
def built_in(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("position.offset")
    e = _e(spark, sf).withColumn("database", F.when(n % 2 == 0, "mysql").when(n % 4 == 3, "scratch").otherwise("shop"))
    e = e.withColumn("table", F.when(n % 3 == 0, "ha_health_check").when(n % 3 == 1, "rds_heartbeat2").otherwise(F.col("table")))
    listed = fl.database_blacklisted("blacklist: scratch.*").alias("listed")
    return e.filter(fl.feed_filter([])).select(_id(), listed)


@query(
    "c8_dropped_columns",
    f"""SELECT off, 'o_custkey,o_orderkey' AS kept,
               CASE WHEN rule = 11 THEN 'o_orderkey' WHEN rule = 15 THEN 'o_custkey' ELSE '' END AS kept_old
        FROM ({fd.feed_m_sql()})""",
)
def dropped_columns(spark: SparkSession, sf: str) -> DataFrame:
    out = fl.drop_columns(_m(spark, sf), "o_totalprice, /o_order[dps].*/")
    names = lambda c: F.array_join(F.sort_array(F.map_keys(c)), ",")
    return out.select(_off(), names("data").alias("kept"), names("old").alias("kept_old"))


# -- images --------------------------------------------------------------------------------


@query(
    "f1_snapshot_diff",
    f"""WITH b AS (SELECT * FROM orders), a AS ({fd.orders_sql()})
        SELECT coalesce(a.o_orderkey, b.o_orderkey) AS k,
               CASE WHEN b.o_orderkey IS NULL THEN 'insert' WHEN a.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS typ,
               coalesce(a.o_custkey, b.o_custkey) AS custkey, coalesce(a.o_totalprice, b.o_totalprice) AS total
        FROM b FULL JOIN a ON a.o_orderkey = b.o_orderkey
        WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_custkey <> b.o_custkey OR a.o_totalprice <> b.o_totalprice
              OR a.o_orderdate <> b.o_orderdate""",
)
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    """The changes between the orders table before and after feed M."""
    from tideview.operators.maintain import update_table

    o = fd.table(spark, sf, "orders")
    after = update_table(o, op.net_changes(fd.feed_m(o), "orders", "o_orderkey", o.schema), "o_orderkey")
    d = F.col("data")
    return op.diff_snapshots(o, after, "o_orderkey", database="shop", table="orders").select(
        d["o_orderkey"].cast("bigint").alias("k"), F.col("type").alias("typ"),
        d["o_custkey"].cast("bigint").alias("custkey"), d["o_totalprice"].cast("double").alias("total"),
    )


@query(
    "f2_old_keeps_changed_columns",
    """SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 2 THEN '' ELSE 'c_mktsegment=' || c_mktsegment END AS old_values
       FROM customer WHERE c_custkey % 10 IN (2, 4, 8)""",
)
def old_columns(spark: SparkSession, sf: str) -> DataFrame:
    """A value that becomes NULL is a change; equal values are left out."""
    pairs = F.transform(F.map_entries("old"), lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit("NULL"))))
    return _segment_changes(spark, sf).select(
        F.col("data")["c_custkey"].cast("bigint").alias("k"), F.array_join(F.sort_array(pairs), ",").alias("old_values")
    )


@query(
    "f3_partial_images_merged",
    """SELECT o_orderkey AS k, o_custkey AS custkey, 'o_custkey,o_orderkey,o_orderstatus' AS data_columns,
              CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'o_orderstatus=' || o_orderstatus END AS old_values FROM orders""",
)
def merged_images(spark: SparkSession, sf: str) -> DataFrame:
    """Before: key, customer, status. After: the new status only."""
    o = fd.table(spark, sf, "orders")
    rows = o.select(
        F.create_map(
            F.lit("o_orderkey"), F.col("o_orderkey").cast("string"), F.lit("o_custkey"), F.col("o_custkey").cast("string"),
            F.lit("o_orderstatus"), F.col("o_orderstatus"),
        ).alias("before"),
        F.create_map(F.lit("o_orderstatus"), F.lit("F")).alias("after"),
    )
    pairs = F.transform(F.map_entries("old"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return op.merge_images(rows).select(
        F.col("data")["o_orderkey"].cast("bigint").alias("k"),
        F.col("data")["o_custkey"].cast("bigint").alias("custkey"),
        F.array_join(F.sort_array(F.map_keys("data")), ",").alias("data_columns"),
        F.array_join(pairs, ",").alias("old_values"),
    )


_ODD = ("1.7", "yes", "abc", "3.0", "TRUE", "2E0", "99999999999")


@query(
    "a3_i15_values_that_do_not_fit",
    """SELECT c_custkey, CASE c_custkey % 8 WHEN 3 THEN 3 WHEN 4 THEN 1 WHEN 5 THEN 2 WHEN 7 THEN c_nationkey END AS nation,
              CASE c_custkey % 8 WHEN 0 THEN 'c_nationkey int: 1.7' WHEN 1 THEN 'c_nationkey int: yes' WHEN 2 THEN 'c_nationkey int: abc'
                   WHEN 6 THEN 'c_nationkey int: 99999999999' END AS unfit FROM customer""",
)
def unfit(spark: SparkSession, sf: str) -> DataFrame:
    """Odd texts in an integer column: whole numbers and truth values are read, the others are NULL and reported."""
    customer = fd.table(spark, sf, "customer")
    key = F.col("data")["c_custkey"].cast("bigint")
    feed = as_changes(customer.select(F.lit("customer").alias("table"), F.lit("insert").alias("type"), image_map(customer.schema).alias("data")))
    odd = F.get(F.array(*[F.lit(x) for x in _ODD]), (key % 8).cast("int"))
    feed = feed.withColumn("data", F.transform_values("data", lambda k, v: F.when((k == "c_nationkey") & odd.isNotNull(), odd).otherwise(v)))
    bad = unfit_values(feed, "customer", customer.schema).select(
        key.alias("_k"), F.array_join(F.transform("unfit", lambda u: F.concat(u["column"], F.lit(" "), u["type"], F.lit(": "), u["value"])), "; ").alias("unfit")
    )
    rows = typed_changes(feed, "customer", customer.schema).select("c_custkey", F.col("c_nationkey").alias("nation"))
    return rows.join(bad, F.col("c_custkey") == F.col("_k"), "left").drop("_k")


# -- transactions and order ----------------------------------------------------------------


@query(
    "f4_f5_transactions_assembled",
    f"""SELECT event_id, xid, row_number() OVER (PARTITION BY xid ORDER BY event_id) - 1 AS xoffset,
               row_number() OVER (PARTITION BY xid ORDER BY event_id DESC) = 1 AS is_commit
        FROM ({fd.FEED_E_SQL}) WHERE event_type <> 'error'""",
)
def transactions(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered after a filter took rows out."""
    kept = _e(spark, sf).filter(fl.feed_filter("exclude: *.events.event_type=error"))
    out = op.assemble_transactions(kept)
    return out.select(_id(), "xid", "xoffset", F.col("commit").alias("is_commit"))


@query(
    "f4_one_transaction_holds_a_third",
    f"""WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE xid END AS xid, seq FROM ({fd.FEED_E_SQL}))
        SELECT event_id, xid, row_number() OVER (PARTITION BY xid ORDER BY seq, event_id) - 1 AS xoffset,
               row_number() OVER (PARTITION BY xid ORDER BY seq DESC, event_id DESC) = 1 AS is_commit FROM e""",
)
def giant_transaction(spark: SparkSession, sf: str) -> DataFrame:
    e = _e(spark, sf)
    e = e.withColumn("xid", F.when(F.col("position.offset") % 3 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("xid")))
    out = op.assemble_transactions(e)
    return out.select(_id(), "xid", "xoffset", F.col("commit").alias("is_commit"))


@query(
    "f6_committed_rows_only",
    """SELECT event_id, CASE WHEN (event_id // 5) % 7 = 3 THEN 'pending' ELSE 'ready' END AS state FROM events""",
)
def committed(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh transaction has no commit row yet."""
    e = op.assemble_transactions(_e(spark, sf)).withColumn("commit", F.col("commit") & (F.col("xid") % 7 != 3))
    return op.mark_pending(e).select(_id(), F.when(F.col("_pending"), "pending").otherwise("ready").alias("state"))


@query(
    "f7_newer_positions",
    f"""SELECT event_id, seq > 10 OR (seq = 10 AND event_id > 3000) AS newer,
               NOT (event_id <= 5000 AND event_id % 2 = 0) AS gtid_newer FROM ({fd.FEED_E_SQL})""",
)
def newer(spark: SparkSession, sf: str) -> DataFrame:
    """By file number and offset; by GTID sets a row is newer unless it is contained."""
    e = _e(spark, sf).withColumn("_other", position_struct(F.lit("log.000010"), F.lit(3000)))
    n = F.col("position.offset").cast("string")
    mine = F.concat(F.when(F.col("position.offset") % 2 == 0, "aa:0-").otherwise("bb:0-"), n)
    return e.select(
        _id(), op.newer_than(e, "_other").alias("newer"), op.gtid_newer(mine, F.lit("AA:0-5000:7000-7001,cc:1-9")).alias("gtid_newer")
    )


@query(
    "f8_net_effect_per_key",
    f"""WITH a AS ({fd.orders_sql()}), t AS (SELECT k FROM ({fd.feed_m_sql()}) UNION SELECT old_k FROM ({fd.feed_m_sql()}) WHERE old_k IS NOT NULL)
        SELECT t.k, a.o_orderkey IS NULL AS deleted, a.o_custkey AS custkey, a.o_totalprice AS total, a.o_orderstatus AS status
        FROM t LEFT JOIN a ON a.o_orderkey = t.k""",
)
def net_effect(spark: SparkSession, sf: str) -> DataFrame:
    o = fd.table(spark, sf, "orders")
    net = op.net_changes(fd.feed_m(o), "orders", "o_orderkey", o.schema)
    return net.select(
        F.col("_key").alias("k"), F.col("_deleted").alias("deleted"), F.col("o_custkey").alias("custkey"),
        F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"),
    )


@query(
    "f8_one_hot_key",
    """SELECT CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS k, max_by(value, event_id) AS v, count(*) > 0 AS present
       FROM events GROUP BY 1""",
)
def hot_key(spark: SparkSession, sf: str) -> DataFrame:
    """A third of all changes hit one key."""
    hot = F.when(F.col("position.offset") % 3 == 0, F.lit("-1")).otherwise(F.col("data")["user_id"])
    e = _e(spark, sf).withColumn("data", put("data", "user_id", hot)).withColumn("type", F.lit("update"))
    schema = fd.table(spark, sf, "events").select("user_id", "value").schema
    net = op.net_changes(e, "events", "user_id", schema)
    return net.select(F.col("_key").alias("k"), F.col("value").alias("v"), (~F.col("_deleted")).alias("present"))


@query(
    "f9_i16_rows_after_stored_position",
    f"""SELECT event_id FROM ({fd.FEED_E_SQL}) WHERE event_id % 3 = 2 OR (event_id % 3 = 0 AND (seq > 5 OR (seq = 5 AND event_id > 100)))
        OR (event_id % 3 = 1 AND seq > 20)""",
)
def after_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Each server has its own stored position; the third has none."""
    e = _e(spark, sf).withColumn("server_id", F.col("position.offset") % 3)
    stored = spark.createDataFrame([(0, 5, 100), (1, 20, 10**12)], "server_id bigint, file_seq bigint, offset bigint")
    return after_positions(e, stored).select(_id())


# -- keys and partitions -------------------------------------------------------------------


@query(
    "f10_row_keys",
    f"""SELECT off, '{{"database":"shop","table":"orders","pk.o_orderkey":' || k || '}}' AS hash_key,
               '["shop","orders",[{{"o_orderkey":' || k || '}}]]' AS array_key FROM ({fd.feed_m_sql()})""",
)
def row_keys(spark: SparkSession, sf: str) -> DataFrame:
    schemas = {"orders": fd.table(spark, sf, "orders").schema}
    h = ky.row_key(_m(spark, sf), "hash", schemas).withColumnRenamed("row_key", "hash_key")
    a = ky.row_key(h, "array", schemas).withColumnRenamed("row_key", "array_key")
    return a.select(_off(), "hash_key", "array_key")


@query(
    "f11_row_identity",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN user_id || event_type
              WHEN 2 THEN 'shopevents' ELSE 'None' END AS ident FROM events""",
)
def row_identities(spark: SparkSession, sf: str) -> DataFrame:
    """One key column, two, none, and one that is NULL."""
    n = F.col("position.offset") % 4
    pk = (
        F.when(n == 0, F.array(F.lit("event_id"))).when(n == 1, F.array(F.lit("user_id"), F.lit("event_type")))
        .when(n == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("absent")))
    )
    e = _e(spark, sf).withColumn("primary_key_columns", pk)
    return ky.row_identity(e).select(_id(), F.col("row_identity").alias("ident"))


@query(
    "f12_partition_keys",
    f"""SELECT off, 'shop' AS by_database, 'orders' AS by_table, CAST(k AS VARCHAR) AS by_key, CAST(xid AS VARCHAR) AS by_xid,
               status || CAST(custkey AS VARCHAR) AS by_column, 'orders' AS by_fallback FROM ({fd.feed_m_sql()})""",
)
def partition_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _m(spark, sf).select(
        _off(),
        ky.partition_key().alias("by_database"),
        ky.partition_key("table").alias("by_table"),
        ky.partition_key("primary_key").alias("by_key"),
        ky.partition_key("transaction_id").alias("by_xid"),
        ky.partition_key("column", ["o_orderstatus", "o_custkey"], "table").alias("by_column"),
        ky.partition_key("column", ["absent"], "table").alias("by_fallback"),
    )


@query("f12_partitions_keep_keys_together", "SELECT count(DISTINCT user_id) AS n_keys, true AS one_partition_each FROM events")
def partitions(spark: SparkSession, sf: str) -> DataFrame:
    out = ky.partition_changes(_e(spark, sf), "column", ["user_id"], "table", n=16)
    per_key = out.groupBy("partition_key").agg(F.min("partition").alias("lo"), F.max("partition").alias("hi"))
    return per_key.agg(F.count(F.lit(1)).alias("n_keys"), F.bool_and((F.col("lo") == F.col("hi")) & F.col("hi").between(0, 15)).alias("one_partition_each"))


@query(
    "f13_dead_letters",
    f"""SELECT '{{"database":"shop","table":"orders","type":"' || typ || '","reason":"too large","data":{{"o_orderkey":' || k || '}}}}' AS value
        FROM ({fd.feed_m_sql()}) WHERE total > 400000""",
)
def dead(spark: SparkSession, sf: str) -> DataFrame:
    big = _m(spark, sf).filter(F.col("data")["o_totalprice"].cast("double") > 400000)
    return ky.dead_letters(big, "too large", {"orders": fd.table(spark, sf, "orders").schema})


@query(
    "f20_statement_attached",
    f"""SELECT event_id, CASE WHEN event_id % 10 = 1 THEN 'statement ' || event_id - 1 END AS statement
        FROM ({fd.FEED_E_SQL}) WHERE event_id % 10 <> 0""",
)
def statements(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth row announces a statement, which goes to the row after it."""
    n = F.col("position.offset")
    e = _e(spark, sf).withColumn("type", F.when(n % 10 == 0, "query").otherwise("insert"))
    e = e.withColumn("query", F.when(n % 10 == 0, F.concat(F.lit("statement "), n.cast("string"))))
    return op.attach_statement(e).select(_id(), F.col("query").alias("statement"))


# -- hooks ---------------------------------------------------------------------------------


@query(
    "k1_k3_hook_edits_and_suppresses",
    f"""SELECT off, typ, CASE WHEN typ = 'delete' THEN status ELSE lower(status) END AS status,
               CASE WHEN typ = 'delete' THEN NULL ELSE 'topic-' || custkey % 4 END AS topic
        FROM ({fd.feed_m_sql()}) WHERE typ = 'delete' OR custkey % 5 <> 0""",
)
def hook(spark: SparkSession, sf: str) -> DataFrame:
    """A native hook on inserts and updates: lower a value, set a topic, suppress some rows."""
    cust = F.col("data")["o_custkey"].cast("bigint")

    def edit(df: DataFrame) -> DataFrame:
        return (
            df.withColumn("suppressed", cust % 5 == 0)
            .withColumn("topic", F.concat(F.lit("topic-"), (cust % 4).cast("string")))
            .withColumn("data", put("data", "o_orderstatus", F.lower(F.col("data")["o_orderstatus"])))
        )

    out = drop_suppressed(with_hook(_m(spark, sf), edit, ("insert", "update")))
    return out.select(_off(), F.col("type").alias("typ"), F.col("data")["o_orderstatus"].alias("status"), "topic")


@query(
    "k1_python_hook",
    f"SELECT event_id, 'P' || user_id % 8 AS part, upper(event_type) AS kind FROM ({fd.FEED_E_SQL})",
)
def python_hook(spark: SparkSession, sf: str) -> DataFrame:
    """The same by a Python function over Arrow batches."""

    def edit(pdf):
        pdf = pdf.copy()
        pdf["data"] = [{**dict(d), "event_type": dict(d)["event_type"].upper()} for d in pdf["data"]]
        pdf["partition_string"] = [f"P{int(d['user_id']) % 8}" for d in pdf["data"]]
        return pdf

    out = with_hook(_e(spark, sf), edit, pandas=True)
    return out.select(_id(), F.col("partition_string").alias("part"), F.col("data")["event_type"].alias("kind"))


@query("b6_hooked_view", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 20 = 13 AND o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'")
def hooked_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys taken from a feed: the orders that were copied."""
    t = fd.tables(spark, sf, fd.ORDERS)
    keys = _m(spark, sf, (fd.COPY,)).select((F.col("data")["o_orderkey"].cast("bigint") - 20_000_000).alias("k"))
    return build_view(fd.ORDERS, t, keys=keys, columns=[])
