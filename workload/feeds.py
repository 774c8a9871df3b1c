"""Views over the test tables and change feeds derived from them by rules on the key.

Because each rule is a function of the key, the state after a feed is plain SQL as well; the
SQL side of each query is a full build on that state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideview.plans.spec import ViewSpec, load_views
from tideview.sources.change import as_changes, image_map, position_struct, text_of

FILE = "log.000001"
LOOKUP_BASE = 10**12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *specs: ViewSpec) -> dict[str, DataFrame]:
    return {t: table(spark, sf_dir, t) for t in dict.fromkeys(t for s in specs for t in s.tables)}


def _columns(**cols: str) -> list[dict]:
    return [dict(name=n, table=c.split(".")[0], column=c.split(".")[1]) for n, c in cols.items()]


ORDERS, EVENTS, DOCUMENTS, CUSTOMER = load_views(
    [
        dict(
            id=1, name="orders_mv", master="orders", pk="o_orderkey", where="o_orderdate >= '1997-01-01 00:00:00'",
            columns=_columns(
                order_date="orders.o_orderdate", total="orders.o_totalprice", status="orders.o_orderstatus",
                customer_name="customer.c_name", segment="customer.c_mktsegment",
            ),
            lookups=[dict(table="customer", master_column="o_custkey", key="c_custkey")],
        ),
        dict(
            id=2, name="events_mv", master="events", pk="event_id", where="event_type <> 'error'",
            columns=_columns(
                ts="events.ts", event_type="events.event_type", value="events.value", customer_name="customer.c_name",
            ),
            lookups=[dict(table="customer", master_column="user_id", key="c_custkey")],
        ),
        dict(
            id=3, name="documents_mv", master="documents", pk="doc_id", where="documents.n_chars > 200",
            columns=_columns(
                lang="documents.lang", n_chars="documents.n_chars", quality="labels.quality", toxic="labels.toxic",
                url="pages.url", sample="benchmark.text",
            ),
            lookups=[
                dict(table="labels", master_column="doc_id", key="doc_id"),
                dict(table="pages", master_column="doc_id", key="page_id"),
                dict(table="benchmark", master_column="doc_id", key="item_id"),
            ],
        ),
        dict(
            id=4, name="customer_mv", master="customer", pk="c_custkey",
            columns=_columns(name="customer.c_name", balance="customer.c_acctbal", nation="nation.n_name"),
            lookups=[dict(table="nation", master_column="c_nationkey", key="n_nationkey")],
        ),
    ]
)

# -- rules of feed M on orders: residue of o_orderkey % 20 -> what happens --------------------

DELETE, PRICE, LEAVE, ENTER, MOVE, COPY, LATE, TWICE = 3, 5, 7, 9, 11, 13, 15, 17
ALL_M = (DELETE, PRICE, LEAVE, ENTER, MOVE, COPY, LATE, TWICE)
#: For images that hold only the key and what changed: a row that moves three times and is changed on the way.
CHAIN = 1


def feed_m(orders: DataFrame, rules: tuple[int, ...] = ALL_M, database: str = "shop") -> DataFrame:
    """Changes of orders by ``o_orderkey % 20``, made in one pass over the table."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    copied = {"o_orderkey": key + _big(30_000_000)}
    made = {
        DELETE: [("delete", 0, {})],
        PRICE: [("update", 0, {"o_totalprice": price + 100})],
        LEAVE: [("update", 0, {"o_orderdate": _ts("1995-06-01")})],
        ENTER: [("update", 0, {"o_orderdate": _ts("2000-01-01")})],
        MOVE: [("update", 0, {"o_orderkey": key + _big(10_000_000)})],
        COPY: [("insert", 0, {"o_orderkey": key + _big(20_000_000), "o_orderstatus": F.lit("N")})],
        LATE: [("update", 0, {"o_custkey": _big(-1)})],
        TWICE: [
            ("update", 0, {"o_totalprice": price + 1}),
            ("update", 1, {"o_totalprice": price + 2}, {"o_totalprice": price + 1}),
            ("insert", 2, copied),
            ("delete", 3, copied),
        ],
        CHAIN: [
            ("update", 0, {"o_orderkey": key + _big(40_000_000), "o_totalprice": price + 1}),
            ("update", 1, {"o_orderkey": key + _big(50_000_000)}, {"o_orderkey": key + _big(40_000_000)}),
            ("update", 2, {"o_orderkey": key + _big(60_000_000), "o_orderstatus": F.lit("M")}, {"o_orderkey": key + _big(50_000_000)}),
            ("update", 3, {"o_orderkey": key + _big(60_000_000), "o_totalprice": price + 5}, {"o_orderkey": key + _big(60_000_000)}),
        ],
    }
    return _changes(orders, F.pmod(key, F.lit(20)), {r: made[r] for r in rules}, "orders", "o_orderkey", database)


# -- rules of feed L on customer: residue of c_custkey % 10 ------------------------------------

GONE, CHANGED, REKEY, NULLED, ARRIVE = 2, 4, 6, 8, -1
ALL_L = (GONE, CHANGED, REKEY, NULLED, ARRIVE)
#: For views that find customers by name: another name, and an old name that another customer takes on.
RENAME, HANDED = 1, 5


def feed_l(customer: DataFrame, rules: tuple[int, ...] = ALL_L, database: str = "shop") -> DataFrame:
    """Changes of customer by ``c_custkey % 10``, and one customer that arrives late."""
    key = F.col("c_custkey")
    made = {
        GONE: [("delete", 0, {})],
        CHANGED: [("update", 0, {"c_mktsegment": F.lit("CHANGED")})],
        REKEY: [("update", 0, {"c_custkey": key + _big(10_000_000)})],
        NULLED: [("update", 0, {"c_mktsegment": F.lit(None).cast("string")})],
        ARRIVE: [("insert", 9, {})],
        RENAME: [("update", 0, {"c_name": F.concat(F.lit("New "), F.col("c_name"))})],
        HANDED: [("delete", 0, {}), ("insert", 1, {"c_custkey": key + _big(70_000_000), "c_acctbal": F.lit(0.5)})],
    }
    late = customer.sparkSession.range(1).select(
        _big(-1).alias("c_custkey"), F.lit("Customer#LATE").alias("c_name"), F.lit(0).cast("int").alias("c_nationkey"),
        F.lit(0.0).alias("c_acctbal"), F.lit("LATE").alias("c_mktsegment"),
    )
    rows = customer.unionAll(late) if ARRIVE in rules else customer
    residue = F.when(key == -1, F.lit(ARRIVE).cast("bigint")).otherwise(F.pmod(key, F.lit(10)))
    return _changes(rows, residue, {r: made[r] for r in rules}, "customer", "c_custkey", database, LOOKUP_BASE)


def _big(n: int) -> Column:
    return F.lit(n).cast("bigint")


def _ts(day: str) -> Column:
    return F.lit(f"{day} 00:00:00").cast("timestamp_ntz")


def _changes(
    rows: DataFrame, residue: Column, made: dict[int, list[tuple]], name: str, pk: str, database: str, base: int = 0
) -> DataFrame:
    """Changes of each row by its residue: a list of (type, step, columns set, their old values).

    Positions, transactions and times follow from the row's key and the step.
    """
    steps = None
    for r, parts in made.items():
        out = F.array(*[F.struct(F.lit(p[0]).alias("type"), F.lit(p[1]).alias("step")) for p in parts])
        steps = F.when(residue == r, out) if steps is None else steps.when(residue == r, out)
    rows = rows.withColumn("_r", residue).filter(F.col("_r").isin(list(made))).select("*", F.inline(steps).alias("_type", "_step"))
    events = [(r, *p) for r, parts in made.items() for p in parts]

    def at(r: int, step: int) -> Column:
        return (F.col("_r") == r) & (F.col("_step") == step)

    image, old = [], F.create_map().cast("map<string,string>")
    for f in rows.schema.fields:
        if f.name.startswith("_"):
            continue
        value = F.col(f.name)
        for r, _, step, sets, *_ in events:
            if f.name in sets:
                value = F.when(at(r, step), sets[f.name].cast(f.dataType)).otherwise(value)
        image += [F.lit(f.name), text_of(value, f.dataType)]
    for r, kind, step, sets, *was in events:
        if kind == "update":
            before = [x for n in sets for x in (F.lit(n), text_of((was[0] if was else {}).get(n, F.col(n)), rows.schema[n].dataType))]
            old = F.when(at(r, step), F.create_map(*before)).otherwise(old)
    key, offset = F.col(pk), _big(base) + F.col(pk) * 10 + F.col("_step")
    seconds = _big(1_700_000_000) + key % 1000
    return as_changes(
        rows.select(
            F.lit(database).alias("database"), F.lit(name).alias("table"), F.col("_type").alias("type"), seconds.alias("ts"),
            (seconds * 1000).alias("ts_ms"), F.floor(key / 4).cast("bigint").alias("xid"), F.lit(True).alias("commit"),
            position_struct(F.lit(FILE), offset).alias("position"), _big(1).alias("server_id"),
            F.array(F.lit(pk)).alias("primary_key_columns"), F.create_map(*image).alias("data"), old.alias("old"),
        )
    )


def feed_e(events: DataFrame, database: str = "shop") -> DataFrame:
    """The events table as a feed of inserts: a file per day, five rows to a transaction."""
    ms = F.unix_millis(F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp"))
    day = F.concat(F.lit("log."), F.lpad(F.dayofmonth("ts").cast("string"), 6, "0"))
    xid = F.floor(F.col("event_id") / 5).cast("bigint")
    return as_changes(
        events.select(
            F.lit(database).alias("database"), F.lit("events").alias("table"), F.lit("insert").alias("type"),
            F.floor(ms / 1000).cast("bigint").alias("ts"), ms.alias("ts_ms"), xid.alias("xid"),
            position_struct(day, F.col("event_id")).alias("position"), F.lit(1).cast("bigint").alias("server_id"),
            (F.col("event_id") % 7).cast("bigint").alias("thread_id"), F.array(F.lit("event_id")).alias("primary_key_columns"),
            image_map(events.schema).alias("data"), F.create_map().cast("map<string,string>").alias("old"),
        )
    )


# -- the same states as SQL ----------------------------------------------------------------


def orders_sql(rules: tuple[int, ...] = ALL_M) -> str:
    on = lambda r, then, other: (f"CASE WHEN o_orderkey % 20 = {r} THEN {then} ELSE {other} END" if r in rules else other)
    price = on(PRICE, "o_totalprice + 100", on(TWICE, "o_totalprice + 2", on(CHAIN, "o_totalprice + 5", "o_totalprice")))
    date = on(LEAVE, "TIMESTAMP '1995-06-01 00:00:00'", on(ENTER, "TIMESTAMP '2000-01-01 00:00:00'", "o_orderdate"))
    text = (
        f"SELECT {on(MOVE, 'o_orderkey + 10000000', on(CHAIN, 'o_orderkey + 60000000', 'o_orderkey'))} AS o_orderkey, "
        f"{on(LATE, 'CAST(-1 AS BIGINT)', 'o_custkey')} AS o_custkey, {on(CHAIN, chr(39) + 'M' + chr(39), 'o_orderstatus')} AS o_orderstatus, {price} AS o_totalprice, "
        f"{date} AS o_orderdate, o_orderpriority FROM orders"
    )
    if DELETE in rules:
        text += f" WHERE o_orderkey % 20 <> {DELETE}"
    if COPY in rules:
        text += (
            " UNION ALL SELECT o_orderkey + 20000000, o_custkey, 'N', o_totalprice, o_orderdate, o_orderpriority "
            f"FROM orders WHERE o_orderkey % 20 = {COPY}"
        )
    return text


def customer_sql(rules: tuple[int, ...] = ALL_L) -> str:
    on = lambda r, then, other: (f"CASE WHEN c_custkey % 10 = {r} THEN {then} ELSE {other} END" if r in rules else other)
    segment = on(CHANGED, "'CHANGED'", on(NULLED, "NULL", "c_mktsegment"))
    text = (
        f"SELECT {on(REKEY, 'c_custkey + 10000000', on(HANDED, 'c_custkey + 70000000', 'c_custkey'))} AS c_custkey, "
        f"{on(RENAME, chr(39) + 'New ' + chr(39) + ' || c_name', 'c_name')} AS c_name, c_nationkey, {on(HANDED, '0.5::DOUBLE', 'c_acctbal')} AS c_acctbal, "
        f"{segment} AS c_mktsegment FROM customer"
    )
    if GONE in rules:
        text += f" WHERE c_custkey % 10 <> {GONE}"
    if ARRIVE in rules:
        text += (
            " UNION ALL SELECT CAST(-1 AS BIGINT), 'Customer#LATE', CAST(0 AS INTEGER), CAST(0 AS DOUBLE), 'LATE'"
        )
    return text


def orders_mv_sql(orders: str = "SELECT * FROM orders", customer: str = "SELECT * FROM customer") -> str:
    return f"""
        SELECT o.o_orderkey AS id, o.o_orderdate AS order_date, o.o_totalprice AS total, o.o_orderstatus AS status,
               c.c_name AS customer_name, c.c_mktsegment AS segment, c.c_custkey AS customer_c_custkey
        FROM ({orders}) o LEFT JOIN ({customer}) c ON o.o_custkey = c.c_custkey
        WHERE o.o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'"""


def customer_mv_sql(customer: str = "SELECT * FROM customer", nation: str = "SELECT * FROM nation") -> str:
    return f"""
        SELECT c.c_custkey AS id, c.c_name AS name, c.c_acctbal AS balance, n.n_name AS nation,
               n.n_nationkey AS nation_n_nationkey
        FROM ({customer}) c LEFT JOIN ({nation}) n ON c.c_nationkey = n.n_nationkey"""


def events_mv_sql(customer: str = "SELECT * FROM customer") -> str:
    return f"""
        SELECT e.event_id AS id, e.ts, e.event_type, e.value, c.c_name AS customer_name, c.c_custkey AS customer_c_custkey
        FROM events e LEFT JOIN ({customer}) c ON e.user_id = c.c_custkey WHERE e.event_type <> 'error'"""


DOCUMENTS_MV_SQL = """
    SELECT d.doc_id AS id, d.lang, d.n_chars, l.quality, l.toxic, p.url, b.text AS sample,
           l.doc_id AS labels_doc_id, p.page_id AS pages_page_id, b.item_id AS benchmark_item_id
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN pages p ON d.doc_id = p.page_id
         LEFT JOIN benchmark b ON d.doc_id = b.item_id
    WHERE d.n_chars > 200"""


def feed_m_sql() -> str:
    """Rows of feed M: off, typ, k (key after), old_k, custkey, total, status, odate, xid, src (key the rule saw)."""
    base = "o_orderkey AS src, o_orderkey // 4 AS xid"

    def row(r, typ, step, k="o_orderkey", old="NULL", total="o_totalprice", status="o_orderstatus", date="o_orderdate", cust="o_custkey"):
        return (
            f"SELECT {base}, o_orderkey * 10 + {step} AS off, '{typ}' AS typ, {k} AS k, CAST({old} AS BIGINT) AS old_k, "
            f"{cust} AS custkey, {total} AS total, {status} AS status, {date} AS odate, {r} AS rule "
            f"FROM orders WHERE o_orderkey % 20 = {r}"
        )

    parts = [
        row(DELETE, "delete", 0),
        row(PRICE, "update", 0, total="o_totalprice + 100"),
        row(LEAVE, "update", 0, date="TIMESTAMP '1995-06-01 00:00:00'"),
        row(ENTER, "update", 0, date="TIMESTAMP '2000-01-01 00:00:00'"),
        row(MOVE, "update", 0, k="o_orderkey + 10000000", old="o_orderkey"),
        row(COPY, "insert", 0, k="o_orderkey + 20000000", status="'N'"),
        row(LATE, "update", 0, cust="CAST(-1 AS BIGINT)"),
        row(TWICE, "update", 0, total="o_totalprice + 1"),
        row(TWICE, "update", 1, total="o_totalprice + 2"),
        row(TWICE, "insert", 2, k="o_orderkey + 30000000"),
        row(TWICE, "delete", 3, k="o_orderkey + 30000000"),
    ]
    return " UNION ALL ".join(parts)


def feed_l_sql() -> str:
    """Rows of feed L: off, typ, k, old_k, segment, xid, rule."""

    def row(r, typ, k="c_custkey", old="NULL", segment="c_mktsegment"):
        return (
            f"SELECT 1000000000000 + c_custkey * 10 AS off, '{typ}' AS typ, {k} AS k, CAST({old} AS BIGINT) AS old_k, "
            f"CAST({segment} AS VARCHAR) AS segment, c_custkey // 4 AS xid, {r} AS rule FROM customer WHERE c_custkey % 10 = {r}"
        )

    parts = [
        row(GONE, "delete"),
        row(CHANGED, "update", segment="'CHANGED'"),
        row(REKEY, "update", k="c_custkey + 10000000", old="c_custkey"),
        row(NULLED, "update", segment="NULL"),
        "SELECT 1000000000000 - 10 + 9, 'insert', CAST(-1 AS BIGINT), NULL, 'LATE', CAST(-1 AS BIGINT), -1",
    ]
    return " UNION ALL ".join(parts)


FEED_E_SQL = """SELECT event_id, event_id AS off, day(ts) AS seq, event_id // 5 AS xid, epoch_us(ts) // 1000 AS ts_ms, event_type,
    user_id, value FROM events"""
