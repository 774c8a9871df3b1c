"""Schema history: as-of versions, differences, evolution, replay and the schema feed.

Schemas as large as a catalogue are derived from the tables: a part is read as a table
definition, its brand and type as columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideview.operators import schema_history as sh
from tideview.sources.change import position_struct
from workload import feeds as fd
from workload.registry import query


def _history(spark: SparkSession, sf: str) -> DataFrame:
    """A schema version at the position of every sign-up event."""
    e = fd.feed_e(fd.table(spark, sf, "events"))
    ups = e.filter(F.col("data")["event_type"] == "signup")
    return ups.select("server_id", "position", F.col("data")["event_id"].cast("bigint").alias("schema_id"))


_AS_OF = """SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS)
    OVER (ORDER BY day(ts), event_id ROWS UNBOUNDED PRECEDING) AS schema_id FROM events"""


@query("d5_h5_schema_version_as_of", _AS_OF)
def as_of(spark: SparkSession, sf: str) -> DataFrame:
    """The newest version at or before each change; versions carry across the files of the feed."""
    e = fd.feed_e(fd.table(spark, sf, "events"))
    out = sh.schema_as_of(e, _history(spark, sf))
    return out.select(F.col("data")["event_id"].cast("bigint").alias("event_id"), "schema_id")


@query(
    "h6_rows_conformed_to_version",
    f"""SELECT event_id, CASE WHEN schema_id % 2 = 0 THEN 'event_id,ts,value' ELSE 'event_id,event_type,props,ts,user_id,value' END AS kept
        FROM ({_AS_OF})""",
)
def conformed(spark: SparkSession, sf: str) -> DataFrame:
    """Versions with an even number know three columns; others know the whole table."""
    events = fd.table(spark, sf, "events")
    names = lambda xs: F.array(*[F.struct(F.lit(x).alias("name")) for x in xs])
    history = _history(spark, sf).select(
        "server_id", "position", F.lit("shop").alias("database"), F.lit("events").alias("table"),
        F.when(F.col("schema_id") % 2 == 0, names(["event_id", "ts", "value"])).otherwise(names(events.columns)).alias("def"),
    )
    out = sh.conform_as_of(fd.feed_e(events), history)
    # rows before the first version have none and keep everything
    return out.select(
        F.coalesce(F.col("data")["event_id"]).cast("bigint").alias("event_id"),
        F.array_join(F.sort_array(F.map_keys("data")), ",").alias("kept"),
    )


def _catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Each part as a table of three columns."""
    p = fd.table(spark, sf, "part")
    col = lambda name, pos, typ, charset, signed, labels, pk: F.struct(
        F.lit(name).alias("name"), F.lit(pos).alias("position"), typ.alias("type"), charset.cast("string").alias("charset"),
        F.lit(signed).alias("signed"), labels.cast("array<string>").alias("labels"), F.lit(None).cast("int").alias("length"),
        F.lit(pk).cast("int").alias("pk_position"),
    )
    none = F.lit(None)
    return p.select(
        F.col("p_brand").alias("database"),
        F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("table"),
        F.col("p_partkey").alias("_k"),
        F.inline(
            F.array(
                col("id", 0, F.lit("int"), none, True, none, 0),
                col("kind", 1, F.lit("enum"), none, True, F.array("p_type", F.lit("x")), None),
                col("note", 2, F.lit("varchar"), F.lit("utf8"), True, none, None),
            )
        ),
    )


@query(
    "h2_schema_differences",
    """SELECT t, col, difference, a_value, b_value FROM (
         SELECT 't' || p_partkey AS t, CAST(NULL AS VARCHAR) AS col, 'missing table in b' AS difference, CAST(NULL AS VARCHAR) AS a_value, CAST(NULL AS VARCHAR) AS b_value FROM part WHERE p_partkey % 7 = 0
         UNION ALL SELECT 't' || p_partkey, 'note', 'type', 'varchar', 'text' FROM part WHERE p_partkey % 7 = 1
         UNION ALL SELECT 't' || p_partkey, 'kind', 'labels', p_type || ',x', p_type || ',x,y' FROM part WHERE p_partkey % 7 = 2
         UNION ALL SELECT 't' || p_partkey, 'note', 'charset', 'utf8', 'latin1' FROM part WHERE p_partkey % 7 = 3
         UNION ALL SELECT 't' || p_partkey, 'note', 'missing column in b', NULL, NULL FROM part WHERE p_partkey % 7 = 4
         UNION ALL SELECT 't' || p_partkey, 'extra', 'missing column in a', NULL, NULL FROM part WHERE p_partkey % 7 = 4
         UNION ALL SELECT 't' || p_partkey, 'id', 'signed', 'true', 'false' FROM part WHERE p_partkey % 7 = 5
         UNION ALL SELECT 't' || p_partkey, NULL, 'primary key', 'id', '' FROM part WHERE p_partkey % 7 = 5
         UNION ALL SELECT 'n' || p_partkey, NULL, 'missing table in a', NULL, NULL FROM part WHERE p_partkey % 7 = 0)""",
)
def differences(spark: SparkSession, sf: str) -> DataFrame:
    """A catalogue against one in which each table has changed by its number."""
    a = _catalogue(spark, sf)
    r, n = F.col("_k") % 7, F.col("name")
    is_id, kind, note = n == "id", n == "kind", n == "note"
    b = a.select(
        "database",
        F.when(r == 0, F.concat(F.lit("n"), F.col("_k").cast("string"))).otherwise(F.col("table")).alias("table"),
        F.when((r == 4) & note, "extra").otherwise(n).alias("name"),
        "position",
        F.when((r == 1) & note, "text").otherwise(F.col("type")).alias("type"),
        F.when((r == 3) & note, "latin1").otherwise(F.col("charset")).alias("charset"),
        F.when((r == 5) & is_id, False).otherwise(F.col("signed")).alias("signed"),
        F.when((r == 2) & kind, F.concat("labels", F.array(F.lit("y")))).otherwise(F.col("labels")).alias("labels"),
        "length",
        F.when((r == 5) & is_id, F.lit(None)).otherwise(F.col("pk_position")).alias("pk_position"),
    )
    return sh.schema_diff(a.drop("_k"), b).select(
        F.col("table").alias("t"), F.col("column").alias("col"), "difference", "a_value", "b_value"
    )


@query(
    "h2_databases_and_charsets",
    """WITH gone AS (SELECT min(p_brand) AS g FROM part)
       SELECT p_brand AS db, CAST(NULL AS VARCHAR) AS t, 'missing database in b' AS difference, CAST(NULL AS VARCHAR) AS a_value, CAST(NULL AS VARCHAR) AS b_value
       FROM part, gone WHERE p_brand = g GROUP BY p_brand
       UNION ALL SELECT 'added', NULL, 'missing database in a', NULL, NULL
       UNION ALL SELECT p_brand, NULL, 'database charset', 'utf8', 'latin1' FROM part, gone WHERE p_brand LIKE '%3' AND p_brand <> g GROUP BY p_brand
       UNION ALL SELECT p_brand, 't' || p_partkey, 'table charset', 'utf8', 'latin1' FROM part, gone WHERE p_partkey % 5 = 0 AND p_brand <> g""",
)
def databases_differ(spark: SparkSession, sf: str) -> DataFrame:
    """One database is gone with all its tables, one came, some and some of the tables changed their charset."""
    a = _catalogue(spark, sf)
    tables = a.groupBy("database", "table").agg(F.any_value("_k").alias("_k"))
    names = tables.groupBy("database").agg(F.lit("utf8").alias("charset"))
    gone = names.agg(F.min("database").alias("_gone"))
    left = lambda df: df.join(gone, F.col("database") == F.col("_gone"), "left_anti")
    added = spark.createDataFrame([("added", "utf8")], "database string, charset string")
    now = left(names).withColumn("charset", F.when(F.col("database").endswith("3"), "latin1").otherwise(F.col("charset"))).unionAll(added)
    charset = F.when(F.col("_k") % 5 == 0, "latin1").otherwise("utf8").alias("charset")
    found = sh.schema_diff(
        a.drop("_k"), left(a).drop("_k"), databases=(names, now),
        tables=(tables.select("database", "table", F.lit("utf8").alias("charset")), left(tables).select("database", "table", charset)),
    )
    return found.select(F.col("database").alias("db"), F.col("table").alias("t"), "difference", "a_value", "b_value")


@query(
    "h3_columns_evolved",
    """SELECT o_orderpriority AS priority, o_orderkey AS order_no, CAST(NULL AS BIGINT) AS note_no, o_orderdate,
              o_totalprice, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders""",
)
def evolved(spark: SparkSession, sf: str) -> DataFrame:
    """Rename, drop, retype, move first and add after a column that comes later."""
    o = fd.table(spark, sf, "orders")
    return sh.evolve(
        o,
        [
            {"op": "rename", "name": "o_orderkey", "to": "order_no"},
            {"op": "drop", "name": "o_orderstatus"},
            {"op": "change", "name": "o_custkey", "type": "string", "after": "o_orderdate"},
            {"op": "add", "name": "note_no", "type": "bigint", "after": "order_no"},
            {"op": "change", "name": "o_orderpriority", "to": "priority", "first": True},
        ],
    )


def _deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Schema events on the catalogue of parts, by part number."""
    defs = sh.table_defs(_catalogue(spark, sf).drop("_k")).withColumn("_k", F.substring("table", 2, 20).cast("bigint"))
    r = F.col("_k") % 8
    kind = F.when(r == 1, "table-drop").when(r.isin(2, 3), "table-alter").when(r == 4, "table-create").otherwise("none")
    none = F.lit(None).cast("string")
    late = F.lit(10**9).cast("bigint")
    d = defs.select(
        position_struct(F.lit("log.000003"), F.when(r == 3, late).otherwise(F.lit(0).cast("bigint")) + F.col("_k")).alias("position"),
        kind.alias("type"), "database", F.when(r == 4, F.concat(F.lit("c"), F.col("_k").cast("string"))).otherwise(F.col("table")).alias("table"),
        none.alias("new_database"), F.when(r == 2, F.concat(F.lit("renamed"), F.col("_k").cast("string"))).alias("new_table"),
        none.alias("charset"),
        F.when(r == 1, F.lit(None)).when(r.isin(2, 3), F.filter("def", lambda c: c["name"] != "note")).otherwise(F.col("def")).alias("def"),
    ).filter("type <> 'none'")
    gone = spark.range(1).select(
        position_struct(F.lit("log.000003"), F.lit(500_000_000)).alias("position"), F.lit("database-drop").alias("type"),
        F.lit("Brand#2").alias("database"), none.alias("table"), none.alias("new_database"), none.alias("new_table"), none.alias("charset"),
        F.lit(None).cast(f"array<{sh.COLUMN_DEF}>").alias("def"),
    )
    return d.unionAll(gone)


@query(
    "h4_tables_after_deltas",
    """SELECT p_brand AS db, CASE p_partkey % 8 WHEN 2 THEN 'renamed' || p_partkey ELSE 't' || p_partkey END AS t,
              CASE WHEN p_partkey % 8 = 2 THEN 'id,kind' ELSE 'id,kind,note' END AS cols
       FROM part WHERE p_partkey % 8 <> 1 AND p_brand <> 'Brand#2'
       UNION ALL SELECT p_brand, 'c' || p_partkey, 'id,kind,note' FROM part WHERE p_partkey % 8 = 4 AND p_brand <> 'Brand#2'""",
)
def replayed(spark: SparkSession, sf: str) -> DataFrame:
    """Tables dropped, renamed, created; one database dropped after that; later alters not yet seen."""
    snapshot = sh.table_defs(_catalogue(spark, sf).drop("_k"))
    out = sh.replay_schema(snapshot, _deltas(spark, sf), at=(3, 900_000_000))
    return out.select(
        F.col("database").alias("db"), F.col("table").alias("t"), F.array_join(F.transform("def", lambda c: c["name"]), ",").alias("cols")
    )


@query(
    "h4_databases_after_deltas",
    """SELECT DISTINCT p_brand AS db, CASE WHEN p_brand = 'Brand#3' THEN 'latin1' ELSE 'utf8' END AS charset FROM part WHERE p_brand <> 'Brand#2'
       UNION ALL SELECT DISTINCT 'new_' || p_type, 'utf16' FROM part""",
)
def databases(spark: SparkSession, sf: str) -> DataFrame:
    p = fd.table(spark, sf, "part")
    names = p.select(F.col("p_brand").alias("database")).distinct().withColumn("charset", F.lit("utf8"))
    at = lambda n: position_struct(F.lit("log.000004"), n)
    made = p.select(F.concat(F.lit("new_"), F.col("p_type")).alias("database"), F.lit("utf16").alias("charset"), F.lit("database-create").alias("type"), at(F.lit(1)).alias("position"))
    changed = names.filter("database = 'Brand#3'").select("database", F.lit("latin1"), F.lit("database-alter"), at(F.lit(2)))
    dropped = names.filter("database = 'Brand#2'").select("database", F.lit(None).cast("string"), F.lit("database-drop"), at(F.lit(3)))
    out = sh.replay_databases(names, made.unionAll(changed).unionAll(dropped))
    return out.select(F.col("database").alias("db"), "charset")


@query(
    "h5_version_chain",
    """SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + 1 AS schema_id,
              row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS base_schema_id FROM part""",
)
def chain(spark: SparkSession, sf: str) -> DataFrame:
    """Each server's schema statements in order, every version built on the one before."""
    p = fd.table(spark, sf, "part").select(
        "p_partkey", F.xxhash64("p_brand").alias("server_id"), position_struct(F.lit("log.000001"), F.col("p_partkey")).alias("position")
    )
    return sh.schema_versions(p).select("p_partkey", "schema_id", "base_schema_id")


@query(
    "h7_schema_event_feed",
    """SELECT 'table-drop' AS typ, 't' || p_partkey AS t, p_brand AS db, 'log.000003:' || p_partkey AS at, CAST(NULL AS VARCHAR) AS first_column
       FROM part WHERE p_partkey % 8 = 1 AND p_brand <> 'Brand#1'
       UNION ALL SELECT 'table-alter', 't' || p_partkey, p_brand, 'log.000003:' || (1000000000 + p_partkey), 'id' FROM part
       WHERE p_partkey % 8 = 3 AND p_brand <> 'Brand#1'
       UNION ALL SELECT 'table-create', 'c' || p_partkey, p_brand, 'log.000003:' || p_partkey, 'id' FROM part
       WHERE p_partkey % 8 = 4 AND p_brand <> 'Brand#1'
       UNION ALL SELECT 'database-drop', NULL, 'Brand#2', 'log.000003:500000000', NULL""",
)
def schema_events(spark: SparkSession, sf: str) -> DataFrame:
    """Rules look at the old and the new name: tables renamed to an excluded name stay out."""
    out = sh.schema_feed(_deltas(spark, sf), "exclude: Brand#1.*, exclude: *./^renamed/".replace("Brand#1", "'Brand#1'"))
    j = lambda path: F.get_json_object("value", path)
    return out.select(
        j("$.type").alias("typ"), j("$.table").alias("t"), j("$.database").alias("db"), j("$.position").alias("at"),
        j("$.def[0].name").alias("first_column"),
    )


@query(
    "h7_breaking_schema_events",
    """SELECT 't' || p_partkey AS t, CASE p_partkey % 8 WHEN 1 THEN 'dropped' WHEN 2 THEN 'renamed' ELSE 'lost note' END AS reason
       FROM part WHERE p_partkey % 8 IN (1, 2, 3)""",
)
def breaking(spark: SparkSession, sf: str) -> DataFrame:
    """Events that views over all tables of the catalogue cannot survive."""
    used = _catalogue(spark, sf).filter("name <> 'kind'").groupBy("table").agg(F.collect_list("name").alias("columns"))
    return sh.breaking_deltas(_deltas(spark, sf), used).select(F.col("table").alias("t"), "reason")
