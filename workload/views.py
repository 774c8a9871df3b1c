"""Builds, scans and incremental maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideview.operators import maintain as mt
from tideview.operators.feed import net_changes
from tideview.operators.filters import in_scope, touches_view, used_by_views
from tideview.plans import build as pb
from tideview.plans import builds
from tideview.plans.spec import ViewSpec, load_views
from tideview.sources.tables import read_table
from tideview.streaming.store import Store
from workload import feeds as fd
from workload.registry import query, scratch, shared_cut


@query(
    "a1_snapshot_scan",
    "SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'",
)
def snapshot_scan(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(
        spark,
        {
            "path": f"{sf}/orders.parquet",
            "columns": ["o_orderkey", "o_custkey", "o_orderdate"],
            "where": "o_orderdate >= timestamp_ntz'1997-01-01 00:00:00'",
        },
    )


@query("a1_snapshot_custom_sql", "SELECT o_orderpriority, o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def snapshot_custom_sql(spark: SparkSession, sf: str) -> DataFrame:
    fd.table(spark, sf, "orders").createOrReplaceTempView("tideview_orders")
    return read_table(spark, {"query": "SELECT o_orderpriority, o_orderkey FROM tideview_orders WHERE o_orderstatus = 'F'"})


@query(
    "a5_view_sink_upsert_delete",
    fd.orders_mv_sql(fd.orders_sql((fd.DELETE, fd.PRICE, fd.COPY))),
)
def view_sink(spark: SparkSession, sf: str) -> DataFrame:
    """A stored view, one delta of upserts and deletes by id, then a compaction."""
    t = fd.tables(spark, sf, fd.ORDERS)
    store = Store(spark, scratch(spark, "a5"), buckets=8)
    c = store.begin()
    c.replace("v", pb.build_view(fd.ORDERS, t), "id")
    c.publish()
    changes = fd.feed_m(t["orders"], (fd.DELETE, fd.PRICE, fd.COPY))
    net = mt.net_by_table(fd.ORDERS, t, changes)["orders"]
    after = {**t, "orders": mt.update_table(t["orders"], net, "o_orderkey")}
    c = store.begin()
    c.change("v", pb.build_view(fd.ORDERS, after, keys=net.select("_key")), net.filter("_deleted").select("_key"))
    c.publish()
    c = store.begin()
    c.compact("v", force=True)
    c.publish()
    return store.read("v")


def _build(spec: ViewSpec):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return pb.build_view(spec, fd.tables(spark, sf, spec))

    return run


query("b2_full_build_orders", fd.orders_mv_sql())(_build(fd.ORDERS))
query("b2_full_build_events", fd.events_mv_sql())(_build(fd.EVENTS))
query("b2_full_build_customer_blank_where", fd.customer_mv_sql())(_build(fd.CUSTOMER))
query("d1_star_join_three_lookups", fd.DOCUMENTS_MV_SQL)(_build(fd.DOCUMENTS))

_PK_AGAIN = ViewSpec.load(
    dict(
        id=9, name="pk_again", master="orders", pk="o_orderkey",
        columns=fd._columns(o_orderkey="orders.o_orderkey", priority="orders.o_orderpriority", who="customer.c_custkey"),
        lookups=[dict(table="customer", master_column="o_custkey", key="c_custkey")],
    )
)


_HOT = ViewSpec.load(
    dict(
        id=10, name="hot", master="orders", pk="o_orderkey", columns=fd._columns(customer_name="customer.c_name"),
        lookups=[dict(table="customer", master_column="o_custkey", key="c_custkey", salt=8)],
    )
)


@query(
    "d1_hot_and_null_lookup_keys",
    """SELECT o_orderkey AS id, c_name AS customer_name, c_custkey AS customer_c_custkey FROM
           (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 7 WHEN 1 THEN NULL ELSE o_custkey END AS k FROM orders)
       LEFT JOIN customer ON k = c_custkey""",
)
def hot_lookup_key(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the orders point at one customer and a third at none; the key is salted."""
    t = fd.tables(spark, sf, _HOT)
    r = F.col("o_orderkey") % 3
    key = F.when(r == 0, F.lit(7).cast("bigint")).when(r == 1, F.lit(None).cast("bigint")).otherwise(F.col("o_custkey"))
    return pb.build_view(_HOT, {**t, "orders": t["orders"].withColumn("o_custkey", key)})


_HOT_SQL = "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 7 WHEN 1 THEN NULL ELSE o_custkey END AS k FROM orders"


@query(
    "d1_only_hot_lookup_rows_repeated",
    f"""WITH k AS (SELECT k, count(*) AS n, sum(count(*)) OVER () AS total FROM ({_HOT_SQL}) WHERE k IS NOT NULL GROUP BY k)
        SELECT c_custkey, CASE WHEN n * 100 >= total THEN least(8, (100 * n + total - 1) // total) ELSE 1 END::BIGINT AS copies
        FROM customer LEFT JOIN k ON k = c_custkey""",
)
def hot_rows_repeated(spark: SparkSession, sf: str) -> DataFrame:
    """How often each customer goes into the join: only those that a hundredth of the orders point at more than once."""
    t = fd.tables(spark, sf, _HOT)
    r = F.col("o_orderkey") % 3
    key = F.when(r == 0, F.lit(7).cast("bigint")).when(r == 1, F.lit(None).cast("bigint")).otherwise(F.col("o_custkey"))
    hot = pb.hot_keys(t["orders"].withColumn("o_custkey", key), "o_custkey", _HOT.lookups[0].salt)
    spread = pb.split_lookup(t["customer"], _HOT.lookups[0], [], hot)
    return spread.groupBy(F.col("_key").alias("c_custkey")).agg(F.count(F.lit(1)).alias("copies"))


@query(
    "b3_projection_and_rename",
    "SELECT o_orderkey AS id, o_orderpriority AS priority, c_custkey AS who FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
)
def projection(spark: SparkSession, sf: str) -> DataFrame:
    """The key listed again is skipped; the lookup's key, already a view column, is not added."""
    return pb.build_view(_PK_AGAIN, fd.tables(spark, sf, _PK_AGAIN))


@query(
    "b4_lookup_keys_added",
    "SELECT d.doc_id AS id, l.doc_id AS labels_doc_id, p.page_id AS pages_page_id, b.item_id AS benchmark_item_id "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN pages p ON d.doc_id = p.page_id "
    "LEFT JOIN benchmark b ON d.doc_id = b.item_id WHERE d.n_chars > 200",
)
def lookup_keys(spark: SparkSession, sf: str) -> DataFrame:
    wanted = ["labels_doc_id", "pages_page_id", "benchmark_item_id"]
    return pb.build_view(fd.DOCUMENTS, fd.tables(spark, sf, fd.DOCUMENTS), columns=wanted)


@query("b3_column_subset_prunes_lookups", "SELECT doc_id AS id, lang FROM documents WHERE n_chars > 200")
def column_subset(spark: SparkSession, sf: str) -> DataFrame:
    return pb.build_view(fd.DOCUMENTS, fd.tables(spark, sf, fd.DOCUMENTS), columns=["lang"])


@query("b5_ordered_by_key", fd.customer_mv_sql() + " ORDER BY id")
def ordered(spark: SparkSession, sf: str) -> DataFrame:
    return pb.build_view(fd.CUSTOMER, fd.tables(spark, sf, fd.CUSTOMER), ordered=True)


@query(
    "b6_build_for_keys",
    fd.orders_mv_sql("SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"),
)
def build_for_keys(spark: SparkSession, sf: str) -> DataFrame:
    keys = fd.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey")
    return pb.build_view(fd.ORDERS, fd.tables(spark, sf, fd.ORDERS), keys=keys)


@query(
    "b9_pending_builds",
    """SELECT 3 AS view_id, 'documents_mv' AS view_name, (SELECT count(*) FROM documents WHERE n_chars > 200) AS total_rows
       UNION ALL SELECT 4, 'customer_mv', (SELECT count(*) FROM customer)""",
)
def pending(spark: SparkSession, sf: str) -> DataFrame:
    """Views with no complete build, with the rows each build has to write."""
    specs = [fd.ORDERS, fd.EVENTS, fd.DOCUMENTS, fd.CUSTOMER]
    runs = spark.createDataFrame(
        [(1, "orders_mv", "complete", None), (2, "events_mv", "complete", None), (3, "documents_mv", "started", None)],
        builds.BUILD_RUNS,
    )
    todo = builds.pending_builds(spark, specs, runs)
    counts = [pb.count_source(s, fd.tables(spark, sf, s)) for s in specs]
    totals = counts[0].unionAll(counts[1]).unionAll(counts[2]).unionAll(counts[3]).withColumnRenamed("view", "_v")
    return todo.join(totals, F.col("view") == F.col("_v")).select("view_id", F.col("view").alias("view_name"), "total_rows")


@query(
    "i6_build_progress",
    """SELECT 'orders_mv' AS view_name, count(*) AS total_rows, count(*) FILTER (WHERE o_orderkey % 3 <> 0) AS inserted_rows,
              false AS complete FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'
       UNION ALL SELECT 'customer_mv', count(*), count(*), true FROM customer
       UNION ALL SELECT 'events_mv', count(*), 0, false FROM events WHERE event_type <> 'error'""",
)
def progress(spark: SparkSession, sf: str) -> DataFrame:
    """One build two thirds through, one complete, one not begun."""
    part = pb.build_view(fd.ORDERS, fd.tables(spark, sf, fd.ORDERS), columns=[]).filter("id % 3 <> 0")
    whole = pb.build_view(fd.CUSTOMER, fd.tables(spark, sf, fd.CUSTOMER), columns=[])
    rows = part.select(F.lit("orders_mv").alias("view"), "id").unionAll(whole.select(F.lit("customer_mv"), "id"))
    specs = (fd.ORDERS, fd.CUSTOMER, fd.EVENTS)
    counts = [pb.count_source(s, fd.tables(spark, sf, s)) for s in specs]
    out = builds.build_progress(rows, counts[0].unionAll(counts[1]).unionAll(counts[2]))
    return out.withColumnRenamed("view", "view_name")


@query(
    "i7_unfinished_builds",
    """SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderdate END AS started_at
       FROM orders WHERE o_orderstatus <> 'F'""",
)
def unfinished(spark: SparkSession, sf: str) -> DataFrame:
    """Orders read as build tasks: finished ones are complete, urgent ones not yet started."""
    o = fd.table(spark, sf, "orders")
    tasks = o.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderdate")).alias("started_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("completed_at"),
    )
    return builds.unfinished_builds(tasks).select("id", "started_at")


@query(
    "i6_i7_builds_as_they_stand",
    """SELECT 'customer_mv' AS view_name, status, CASE status WHEN 'started' THEN NULL ELSE (SELECT count(*) FROM customer) END AS n
       FROM (VALUES ('started'), ('counted'), ('complete')) s(status)
       UNION ALL SELECT 'many', status, NULL FROM (VALUES ('started'), ('failed')) s(status)
       UNION ALL SELECT 'rows of customer_mv', 'readable', count(*) FROM customer""",
)
def builds_as_they_stand(spark: SparkSession, sf: str) -> DataFrame:
    """Two builds at once: one view stands, the other one's lookup keys are not unique and its row says that it failed."""
    from tideview.streaming.maintainer import BuildError, Maintainer

    root = scratch(spark, "i6")
    m = Maintainer(spark, [_MANY, fd.CUSTOMER], fd.tables(spark, sf, _MANY, fd.CUSTOMER), f"{root}/feed", f"{root}/store", start_position=(0, 0), buckets=8)
    try:
        m.build()
    except BuildError as e:
        if e.view != _MANY.name or [s.name for s in m.unfinished()] != [_MANY.name]:
            raise
    log = m.build_log().select(F.col("view").alias("view_name"), "status", F.col("rows").alias("n"))
    read = m.view(fd.CUSTOMER.name).agg(F.count(F.lit(1)).alias("n"))
    return log.unionAll(read.select(F.lit("rows of customer_mv"), F.lit("readable"), "n"))


@query(
    "k8_source_row_count",
    "SELECT 'orders_mv' AS view_name, count(*) AS total_rows FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'",
)
def source_count(spark: SparkSession, sf: str) -> DataFrame:
    return pb.count_source(fd.ORDERS, fd.tables(spark, sf, fd.ORDERS)).withColumnRenamed("view", "view_name")


# -- scope and relevance -------------------------------------------------------------------

_NULL_WHERE = ViewSpec.load(
    dict(id=8, name="scoped", master="documents", pk="doc_id", where="nullif(documents.lang, 'en') <> 'de'", columns=[], lookups=[])
)


@query("c1_where_null_drops", "SELECT doc_id AS id FROM documents WHERE nullif(lang, 'en') <> 'de'")
def where_null(spark: SparkSession, sf: str) -> DataFrame:
    return pb.build_view(_NULL_WHERE, fd.tables(spark, sf, _NULL_WHERE))


@query(
    "c2_scope_of_images",
    f"""SELECT f.off, f.odate >= TIMESTAMP '1997-01-01 00:00:00' AS after_in,
               (CASE WHEN f.typ = 'update' THEN o.o_orderdate ELSE f.odate END) >= TIMESTAMP '1997-01-01 00:00:00' AS before_in
        FROM ({fd.feed_m_sql()}) f JOIN orders o ON f.src = o.o_orderkey""",
)
def scope_of_images(spark: SparkSession, sf: str) -> DataFrame:
    o = fd.table(spark, sf, "orders")
    m = fd.feed_m(o)
    after = in_scope(m, fd.ORDERS, o.schema).withColumnRenamed("_in_scope", "after_in")
    both = in_scope(after, fd.ORDERS, o.schema, image="before").withColumnRenamed("_in_scope", "before_in")
    return both.select(F.col("position.offset").alias("off"), "after_in", "before_in")


@query(
    "c9_relevant_updates",
    f"SELECT off, typ FROM ({fd.feed_m_sql()}) WHERE typ <> 'update' OR rule IN (5, 17, 7, 9, 11)",
)
def relevant_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Updates that touch neither a view column, a key nor a WHERE column are skipped. The view
    here has no lookup, so moving an order to another customer does not concern it."""
    spec = ViewSpec.load(
        dict(id=7, name="slim", master="orders", pk="o_orderkey", where=fd.ORDERS.where, columns=fd._columns(total="orders.o_totalprice"))
    )
    o = fd.table(spark, sf, "orders")
    m = fd.feed_m(o)
    kept = m.filter(touches_view(spec.relevant_columns("orders", o)))
    return kept.select(F.col("position.offset").alias("off"), F.col("type").alias("typ"))


def every_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Feeds of orders, customers and events together."""
    return (
        fd.feed_m(fd.table(spark, sf, "orders"))
        .unionAll(fd.feed_l(fd.table(spark, sf, "customer")))
        .unionAll(fd.feed_e(fd.table(spark, sf, "events")))
    )


_EVERY_SQL = f"""SELECT 'orders' AS tbl, off, typ FROM ({fd.feed_m_sql()})
    UNION ALL SELECT 'customer', off, typ FROM ({fd.feed_l_sql()})
    UNION ALL SELECT 'events', off, 'insert' FROM ({fd.FEED_E_SQL})"""


@query("c10_changes_of_view_tables", f"SELECT * FROM ({_EVERY_SQL}) WHERE tbl IN ('orders', 'customer')")
def used_tables(spark: SparkSession, sf: str) -> DataFrame:
    kept = every_feed(spark, sf).filter(used_by_views([fd.ORDERS]))
    return kept.select(F.col("table").alias("tbl"), F.col("position.offset").alias("off"), F.col("type").alias("typ"))


# -- guards and routing --------------------------------------------------------------------

_MANY = ViewSpec.load(
    dict(
        id=6, name="many", master="orders", pk="o_orderkey",
        columns=fd._columns(flag="lineitem.l_returnflag", segment="customer.c_mktsegment"),
        lookups=[
            dict(table="lineitem", master_column="o_orderkey", key="l_orderkey"),
            dict(table="customer", master_column="o_custkey", key="c_custkey"),
        ],
    )
)


@query(
    "d2_duplicate_lookup_keys",
    """SELECT 'lineitem' AS lookup, CAST(l_orderkey AS VARCHAR) AS key, count(*) AS n
       FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1""",
)
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return pb.duplicate_lookup_keys(_MANY, fd.tables(spark, sf, _MANY))


@query(
    "d2_quarantined_lookup_build",
    """SELECT o_orderkey AS id, l.l_returnflag AS flag, c.c_mktsegment AS segment, l.l_orderkey AS lineitem_l_orderkey,
              c.c_custkey AS customer_c_custkey
       FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_orderkey IN
              (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 1)) l ON o_orderkey = l.l_orderkey
            LEFT JOIN customer c ON o_custkey = c.c_custkey""",
)
def quarantined(spark: SparkSession, sf: str) -> DataFrame:
    t = mt.lookup_guard(_MANY, fd.tables(spark, sf, _MANY), mode="quarantine")
    return pb.build_view(_MANY, t)


@query(
    "d3_reverse_lookup",
    f"""SELECT id FROM (SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00')
        WHERE o_custkey IN (SELECT k FROM ({fd.feed_l_sql()}) UNION SELECT old_k FROM ({fd.feed_l_sql()}) WHERE old_k IS NOT NULL)""",
)
def reverse_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """View rows hit by the old and new keys of changed customers."""
    t = fd.tables(spark, sf, fd.ORDERS)
    view = pb.build_view(fd.ORDERS, t, match_columns=True)
    net = mt.net_by_table(fd.ORDERS, t, fd.feed_l(t["customer"]))
    keys = mt.changed_lookup_keys(fd.ORDERS, "customer", t, net["customer"])
    return mt.view_rows_on_keys(view, fd.ORDERS, "customer", keys)


@query(
    "d4_route_to_views",
    f"""WITH f AS ({_EVERY_SQL.replace("off, typ FROM", "off, typ, rule FROM", 2).replace("off, 'insert' FROM", "off, 'insert', 0 FROM")})
        SELECT off, 'orders' AS tbl, 'orders_mv' AS view_name, 'master' AS part FROM f WHERE tbl = 'orders'
        UNION ALL SELECT off, 'events', 'events_mv', 'master' FROM f WHERE tbl = 'events'
        UNION ALL SELECT off, 'customer', 'orders_mv', 'lookup' FROM f WHERE tbl = 'customer'
        UNION ALL SELECT off, 'customer', 'events_mv', 'lookup' FROM f WHERE tbl = 'customer' AND (typ <> 'update' OR rule = 6)
        UNION ALL SELECT off, 'customer', 'customer_mv', 'master' FROM f WHERE tbl = 'customer' AND (typ <> 'update' OR rule = 6)""",
)
def routed(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of a segment concern only the view that shows segments."""
    specs = [fd.ORDERS, fd.EVENTS, fd.DOCUMENTS, fd.CUSTOMER]
    out = mt.route(every_feed(spark, sf), specs, fd.tables(spark, sf, *specs))
    return out.select(
        F.col("position.offset").alias("off"), F.col("table").alias("tbl"), F.col("view").alias("view_name"), F.col("role").alias("part")
    )


# -- rule by rule --------------------------------------------------------------------------


def _apply(spark: SparkSession, sf: str, changes_of) -> DataFrame:
    """Build on the original tables, apply changes incrementally, show the view."""
    t = fd.tables(spark, sf, fd.ORDERS)
    view = pb.build_view(fd.ORDERS, t, match_columns=True)
    after, _ = mt.apply_changes(fd.ORDERS, view, t, changes_of(t), cut=shared_cut(spark, "e"))
    return mt.visible(after)


def _rule(name: str, m: tuple[int, ...] = (), lk: tuple[int, ...] = ()) -> None:
    def changes_of(t):
        parts = ([fd.feed_m(t["orders"], m)] if m else []) + ([fd.feed_l(t["customer"], lk)] if lk else [])
        return parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])

    sql = fd.orders_mv_sql(fd.orders_sql(m), fd.customer_sql(lk))
    query(name, sql)(lambda spark, sf: _apply(spark, sf, changes_of))


_rule("e1_master_insert", (fd.COPY,))
_rule("e2_master_delete", (fd.DELETE,))
_rule("e3_master_update_in_scope", (fd.PRICE, fd.LATE))
_rule("e3_master_update_leaves_scope", (fd.LEAVE,))
_rule("e3_master_update_enters_scope", (fd.ENTER,))
_rule("e4_master_key_change", (fd.MOVE,))
_rule("e5_lookup_insert_fills_late", (fd.LATE,), (fd.ARRIVE,))
_rule("e6_lookup_update", (), (fd.CHANGED, fd.NULLED))
_rule("e7_lookup_key_change", (), (fd.REKEY,))
_rule("e8_lookup_delete", (), (fd.GONE,))
_rule("e10_mixed_feed", fd.ALL_M, fd.ALL_L)
_rule("e10_net_effect_in_batch", (fd.TWICE,))


@query(
    "e9_one_feed_many_views",
    f"""SELECT 'orders_mv' AS view_name, id, customer_name AS name FROM ({fd.orders_mv_sql(customer=fd.customer_sql())})
        UNION ALL SELECT 'events_mv', id, customer_name FROM ({fd.events_mv_sql(fd.customer_sql())})
        UNION ALL SELECT 'customer_mv', id, name FROM ({fd.customer_mv_sql(fd.customer_sql())})""",
)
def many_views(spark: SparkSession, sf: str) -> DataFrame:
    """Customer changes reach a view as master and two views as lookup."""
    out = None
    for spec, name in ((fd.ORDERS, "customer_name"), (fd.EVENTS, "customer_name"), (fd.CUSTOMER, "name")):
        t = fd.tables(spark, sf, spec)
        view = pb.build_view(spec, t, match_columns=True)
        after, _ = mt.apply_changes(spec, view, t, fd.feed_l(t["customer"]), cut=shared_cut(spark, "e9"))
        rows = after.select(F.lit(spec.name).alias("view_name"), "id", F.col(name).alias("name"))
        out = rows if out is None else out.unionAll(rows)
    return out


_ALL_NAMED = (*fd.ALL_L, fd.RENAME, fd.HANDED)

#: The customer table as master by its id, as master by its name, and as lookup by its name.
BY_ID, BY_NAME, SOLD = load_views(
    [
        dict(id=11, name="customers_by_id", master="customer", pk="c_custkey", columns=fd._columns(name="customer.c_name", balance="customer.c_acctbal")),
        dict(
            id=12, name="customers_by_name", master="customer", pk="c_name", where="c_acctbal > 0",
            columns=fd._columns(custkey="customer.c_custkey", segment="customer.c_mktsegment", nation="nation.n_name"),
            lookups=[dict(table="nation", master_column="c_nationkey", key="n_nationkey")],
        ),
        dict(
            id=13, name="sales_by_name", master="sales", pk="o_orderkey",
            columns=fd._columns(total="sales.o_totalprice", segment="customer.c_mktsegment", balance="customer.c_acctbal"),
            lookups=[dict(table="customer", master_column="sold_to", key="c_name")],
        ),
    ]
)


@query(
    "e9_views_with_different_keys",
    f"""WITH c AS ({fd.customer_sql(_ALL_NAMED)}),
             o AS (SELECT *, 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS sold_to FROM orders)
        SELECT 'customers_by_id' AS view_name, c_custkey::VARCHAR AS id, c_name AS name, CAST(NULL AS VARCHAR) AS segment, c_acctbal AS amount FROM c
        UNION ALL SELECT 'customers_by_name', c_name, n_name, c_mktsegment, c_custkey::DOUBLE FROM c LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0
        UNION ALL SELECT 'sales_by_name', o_orderkey::VARCHAR, c_name, c_mktsegment, o_totalprice + coalesce(c_acctbal, 0) FROM o LEFT JOIN c ON sold_to = c_name""",
)
def views_by_other_keys(spark: SparkSession, sf: str) -> DataFrame:
    """One stream of customer changes keeps three views that know customers by id or by name."""
    from tideview.sources.feed import OutputOptions, to_change_json
    from tideview.streaming.maintainer import Maintainer

    root = scratch(spark, "e9")
    t = fd.tables(spark, sf, fd.CUSTOMER)
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    t["sales"] = fd.table(spark, sf, "orders").withColumn("sold_to", name)
    m = Maintainer(spark, [BY_NAME, SOLD, BY_ID], t, f"{root}/feed", f"{root}/store", row_keys={"customer": "c_custkey"}, start_position=(0, 0), buckets=8)
    options = OutputOptions(position=True, server_id=True, tables={n: df.schema for n, df in t.items()})
    to_change_json(fd.feed_l(t["customer"], _ALL_NAMED), options).write.text(f"{root}/feed")
    m.run_available()
    text = "cast(null AS string)"
    by_id = m.view("customers_by_id").selectExpr("'customers_by_id' AS view_name", "cast(id AS string) AS id", "name", f"{text} AS segment", "balance AS amount")
    by_name = m.view("customers_by_name").selectExpr("'customers_by_name' AS view_name", "id", "nation AS name", "segment", "cast(custkey AS double) AS amount")
    sold = m.view("sales_by_name").selectExpr(
        "'sales_by_name' AS view_name", "cast(id AS string) AS id", "customer_c_name AS name", "segment", "total + coalesce(balance, 0) AS amount"
    )
    return by_id.unionAll(by_name).unionAll(sold)


@query("e10_two_batches", fd.orders_mv_sql(fd.orders_sql(), fd.customer_sql()))
def two_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Orders first, then customers: the second batch starts from the first one's result."""
    t = fd.tables(spark, sf, fd.ORDERS)
    view = pb.build_view(fd.ORDERS, t, match_columns=True)
    cut = shared_cut(spark, "e10")
    view, after = mt.apply_changes(fd.ORDERS, view, t, fd.feed_m(t["orders"]), cut=cut)
    view, after = cut(view), {n: cut(df) for n, df in after.items()}
    view, _ = mt.apply_changes(fd.ORDERS, view, after, fd.feed_l(t["customer"]), cut=cut)
    return mt.visible(view)


def _slim(m: DataFrame) -> DataFrame:
    """Updates whose images hold only the key and what changed."""
    kept = F.map_filter("data", lambda k, v: (k == "o_orderkey") | F.map_contains_key("old", k))
    return m.withColumn("data", F.when(F.col("type") == "update", kept).otherwise(F.col("data")))


@query("e10_partial_images", fd.orders_mv_sql(fd.orders_sql((*fd.ALL_M, fd.CHAIN))))
def partial_images(spark: SparkSession, sf: str) -> DataFrame:
    """Images that lack columns, with rows that change their key, some three times in the batch."""
    t = fd.tables(spark, sf, fd.ORDERS)
    m = _slim(fd.feed_m(t["orders"], (*fd.ALL_M, fd.CHAIN)))
    view = pb.build_view(fd.ORDERS, t, match_columns=True)
    after, _ = mt.apply_changes(fd.ORDERS, view, t, m, full_images=False, cut=shared_cut(spark, "e10"))
    return mt.visible(after)


@query("e4_f8_rows_moved_on_partial_images", fd.orders_sql((*fd.ALL_M, fd.CHAIN)))
def moved_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The master table itself after moves whose images lack columns."""
    orders = fd.table(spark, sf, "orders")
    m = _slim(fd.feed_m(orders, (*fd.ALL_M, fd.CHAIN)))
    net = net_changes(m, "orders", "o_orderkey", orders.schema, current=orders, cut=shared_cut(spark, "e4"))
    return mt.update_table(orders, shared_cut(spark, "e4")(net), "o_orderkey")


@query("e11_streamed_views", fd.orders_mv_sql(fd.orders_sql(), fd.customer_sql()))
def streamed(spark: SparkSession, sf: str) -> DataFrame:
    """The whole way: build, then follow the feed as a stream of JSON files into the store."""
    from tideview.sources.feed import OutputOptions, to_change_json
    from tideview.streaming.maintainer import Maintainer

    root = scratch(spark, "e11")
    t = fd.tables(spark, sf, fd.ORDERS)
    m = Maintainer(
        spark, [fd.ORDERS], t, f"{root}/feed", f"{root}/store", start_position=(0, 0), buckets=8, feed_options={"maxFilesPerTrigger": 100}
    )
    options = OutputOptions(position=True, server_id=True, tables={n: df.schema for n, df in t.items()})
    for part in (fd.feed_m(t["orders"]), fd.feed_l(t["customer"])):
        to_change_json(part, options).write.mode("append").text(f"{root}/feed")
    m.run_available()
    return m.view("orders_mv")


@query("e11_files_out_of_order", fd.orders_mv_sql(fd.orders_sql(), fd.customer_sql()))
def out_of_order(spark: SparkSession, sf: str) -> DataFrame:
    """Newer changes of a row arrive in an earlier batch than older ones, and transactions are torn apart."""
    from tideview.sources.feed import OutputOptions, to_change_json
    from tideview.streaming.maintainer import Maintainer

    root = scratch(spark, "e11")
    t = fd.tables(spark, sf, fd.ORDERS)
    m = Maintainer(spark, [fd.ORDERS], t, f"{root}/feed", f"{root}/store", start_position=(0, 0), buckets=8)
    options = OutputOptions(position=True, server_id=True, tables={n: df.schema for n, df in t.items()})
    orders = fd.feed_m(t["orders"])
    # the last digit of an offset is the step of a change within its row
    first = F.col("position.offset") % 10 == 0
    for part in (orders.filter(~first).unionByName(fd.feed_l(t["customer"])), orders.filter(first)):
        to_change_json(part, options).write.mode("append").text(f"{root}/feed")
        m.run_available()
    return m.view("orders_mv")
