"""Feed metrics, heartbeats, recovery and health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideview.operators import heartbeats as hb
from tideview.operators import metrics as mx
from tideview.operators.feed import assemble_transactions
from workload import feeds as fd
from workload.registry import query, scratch
from workload.views import _EVERY_SQL, every_feed


def _e(spark: SparkSession, sf: str) -> DataFrame:
    return fd.feed_e(fd.table(spark, sf, "events"))


def _beats(spark: SparkSession, sf: str) -> DataFrame:
    """The events feed with every hundredth row a heartbeat; the beat is the row's time."""
    e = _e(spark, sf)
    is_beat = F.col("position.offset") % 100 == 50
    return e.withColumn("type", F.when(is_beat, "heartbeat").otherwise(F.col("type"))).withColumn(
        "data", F.when(is_beat, F.create_map(F.lit("heartbeat"), F.col("ts_ms").cast("string"))).otherwise(F.col("data"))
    )


@query(
    "k4_rows_per_table_and_type",
    f"SELECT tbl, typ, count(*) AS row_count FROM ({_EVERY_SQL}) GROUP BY tbl, typ",
)
def row_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = mx.feed_metrics(every_feed(spark, sf))
    return out.select(F.col("table").alias("tbl"), F.col("type").alias("typ"), "row_count")


@query(
    "k4_row_rate",
    f"""SELECT count(*) AS row_count, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms,
               round(count(*) * 1000.0 / (max(ts_ms) - min(ts_ms)), 9) AS rate FROM ({fd.FEED_E_SQL})""",
)
def row_rate(spark: SparkSession, sf: str) -> DataFrame:
    return mx.feed_metrics(_e(spark, sf)).select("row_count", "first_ms", "last_ms", F.round("rows_per_second", 9).alias("rate"))


@query(
    "k5_transaction_metrics",
    f"""SELECT xid, count(*) AS row_count, max(ts_ms) - min(ts_ms) AS duration_ms FROM ({fd.FEED_E_SQL}) GROUP BY xid""",
)
def transaction_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return mx.transaction_metrics(_e(spark, sf)).select("xid", "row_count", "duration_ms")


@query(
    "k5_transaction_percentiles",
    f"""SELECT count(*) AS n, min(d) AS lo, max(d) AS hi, round(avg(d), 4) AS mean, round(quantile_cont(d, 0.5), 4) AS p50,
               round(quantile_cont(d, 0.95), 4) AS p95
        FROM (SELECT max(ts_ms) - min(ts_ms) AS d FROM ({fd.FEED_E_SQL}) GROUP BY xid)""",
)
def transaction_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    out = mx.percentiles(mx.transaction_metrics(_e(spark, sf)), "duration_ms")
    r = lambda c: F.round(F.col(c).cast("double"), 4)
    return out.select("n", F.col("min").alias("lo"), F.col("max").alias("hi"), r("mean").alias("mean"), r("p50").alias("p50"), r("p95").alias("p95"))


@query(
    "k5_rows_per_transaction_histogram",
    f"SELECT c AS value, count(*) AS n FROM (SELECT count(*) AS c FROM ({fd.FEED_E_SQL}) GROUP BY xid) GROUP BY c",
)
def rows_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return mx.histogram(mx.transaction_metrics(_e(spark, sf)), "row_count")


@query(
    "k6_lag_at_commit",
    f"""SELECT event_id, 1800000000000 - ts_ms AS lag_ms FROM ({fd.FEED_E_SQL})
        QUALIFY row_number() OVER (PARTITION BY xid ORDER BY seq DESC, event_id DESC) = 1""",
)
def lag(spark: SparkSession, sf: str) -> DataFrame:
    e = assemble_transactions(_e(spark, sf))
    out = mx.commit_lag(e, F.lit(1_800_000_000_000)).filter(F.col("lag_ms").isNotNull())
    return out.select(F.col("data")["event_id"].cast("bigint").alias("event_id"), "lag_ms")


@query(
    "k7_message_age_over_slo",
    """SELECT 'events' AS tbl, count(*) AS messages, count(*) FILTER (WHERE event_type <> 'error') AS succeeded,
              count(*) FILTER (WHERE event_type = 'error') AS failed, max(1706745600000 - (epoch_us(ts) // 1000)) AS max_age_ms,
              count(*) FILTER (WHERE 1706745600000 - (epoch_us(ts) // 1000) > 1000000000) AS over_slo FROM events""",
)
def slo(spark: SparkSession, sf: str) -> DataFrame:
    failed = F.col("data")["event_type"] == "error"
    out = mx.age_slo(_e(spark, sf), 1_000_000, F.lit(1_706_745_600_000), failed)
    return out.select(F.col("table").alias("tbl"), "messages", "succeeded", "failed", "max_age_ms", "over_slo")


@query(
    "k9_health",
    """WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error' AND epoch_us(ts) // 1000 > 1706745600000 - 86400000 * 3) AS recent FROM events GROUP BY user_id)
       SELECT count(*) AS checks, count(*) FILTER (WHERE recent > 0) AS failed, count(*) FILTER (WHERE recent > 0) AS mandatory_failed,
              count(*) FILTER (WHERE recent > 0) = 0 AS healthy FROM c""",
)
def health(spark: SparkSession, sf: str) -> DataFrame:
    """Each user is a check that fails when an error happened in the last three days."""
    e = _e(spark, sf)
    failures = e.select(
        F.col("data")["user_id"].alias("name"), F.when(F.col("data")["event_type"] == "error", F.col("ts_ms")).alias("failed_ms")
    )
    return mx.health(mx.failure_checks(failures, F.lit(1_706_745_600_000), 86_400_000 * 3))


@query(
    "i8_heartbeat_lag",
    f"""SELECT CAST(1 AS BIGINT) AS server_id, count(*) AS heartbeats, max(ts_ms) AS last_heartbeat, max(off % 977) AS max_lag_ms,
               max_by(off % 977, ts_ms) AS last_lag_ms FROM ({fd.FEED_E_SQL}) WHERE off % 100 = 50""",
)
def heartbeat_lag(spark: SparkSession, sf: str) -> DataFrame:
    """Read times are the beat plus a delay that follows from the offset."""
    return hb.heartbeat_lag(_beats(spark, sf), F.col("ts_ms") + F.col("position.offset") % 977)


@query(
    "i9_heartbeats_due",
    f"""SELECT event_id, CASE WHEN ps IS NULL THEN 'first' WHEN seq <> ps THEN 'file' WHEN place - pp > 1000 THEN 'bytes'
               WHEN ts_ms - pt >= 10000 THEN 'time' END AS due
        FROM (SELECT *, lag(seq) OVER w AS ps, lag(place) OVER w AS pp, lag(ts_ms) OVER w AS pt
              FROM (SELECT event_id, seq, ts_ms, event_id * 300 + event_id // 11 * 1500 AS place FROM ({fd.FEED_E_SQL})) WINDOW w AS (ORDER BY seq, event_id))
        WHERE ps IS NULL OR seq <> ps OR place - pp > 1000 OR ts_ms - pt >= 10000""",
)
def due(spark: SparkSession, sf: str) -> DataFrame:
    """Offsets 300 bytes apart, and 1800 after every eleventh."""
    e, p = _e(spark, sf), F.col("position")
    at = p["offset"] * 300 + F.floor(p["offset"] / 11) * 1500
    e = e.withColumn("position", F.struct(p["file"].alias("file"), p["file_seq"].alias("file_seq"), at.alias("offset")))
    out = hb.heartbeats_due(e)
    return out.select(F.col("data")["event_id"].cast("bigint").alias("event_id"), "due")


@query(
    "i11_position_recovered_by_heartbeat",
    f"""WITH b AS (SELECT off, seq, ts_ms FROM ({fd.FEED_E_SQL}) WHERE off % 100 = 50), h AS (SELECT max_by(ts_ms, off) AS h FROM b WHERE seq = 7)
        SELECT 'log.' || lpad(CAST(seq AS VARCHAR), 6, '0') AS file, CAST(seq AS BIGINT) AS file_seq, off AS "offset", CAST(1 AS BIGINT) AS beats
        FROM b, h WHERE b.ts_ms = h.h""",
)
def recovered(spark: SparkSession, sf: str) -> DataFrame:
    """The last heartbeat known from the seventh file, looked for in the whole feed."""
    feed = _beats(spark, sf)
    known = feed.filter((F.col("type") == "heartbeat") & (F.col("position.file_seq") == 7)).agg(
        F.max_by("ts_ms", F.col("position.offset")).alias("h")
    )
    # one row at most; the join keeps the rows of the whole feed that hold this heartbeat
    held = feed.withColumn("h", F.col("data")["heartbeat"].try_cast("bigint")).join(known.where("h IS NOT NULL"), "h")
    return hb.recover_position(held, F.col("h"))


@query(
    "i1_i11_places_found_from_the_newest_file",
    f"""WITH e AS ({fd.FEED_E_SQL}), b AS (SELECT seq, off, ts_ms FROM e WHERE off % 100 = 50),
             w AS (SELECT ts_ms FROM b WHERE seq <= 20 ORDER BY seq DESC, off DESC LIMIT 1),
             h AS (SELECT seq, min(off) AS off FROM b WHERE ts_ms = (SELECT ts_ms FROM w) GROUP BY seq ORDER BY seq DESC LIMIT 1),
             n AS (SELECT count(DISTINCT e.seq) AS files, count(DISTINCT e.seq) FILTER (WHERE e.seq >= h.seq) AS newer FROM e, h),
             c AS (SELECT max(seq) AS seq FROM e WHERE off % 5 = 4)
        SELECT 'heartbeat' AS what, CAST(seq AS BIGINT) AS file_seq, off AS "offset",
               least(files, CAST(pow(2, ceil(log2(newer + 1))) - 1 AS BIGINT)) AS files_read FROM h, n
        UNION ALL SELECT 'end', seq, (SELECT max(off) FROM e WHERE e.seq = c.seq AND off % 5 = 4), 1 FROM c""",
)
def places_found(spark: SparkSession, sf: str) -> DataFrame:
    """A feed with a folder per log file: the last heartbeat up to the twentieth, and the newest committed row."""
    from tideview.sources.feed import OutputOptions, write_changes
    from tideview.sources.places import newest_first

    path = scratch(spark, "i11")
    feed = _beats(spark, sf).withColumn("commit", F.col("position.offset") % 5 == 4)
    write_changes(feed, path, OutputOptions(position=True, server_id=True), by_file=True)
    beats = feed.filter((F.col("type") == "heartbeat") & (F.col("position.file_seq") <= 20))
    want = beats.agg(F.max_by("ts_ms", F.struct("position.file_seq", "position.offset")).alias("h")).first()["h"]
    beat, read = newest_first(spark, path, lambda changes: hb.recover_position(changes, want).first())
    last, end_read = newest_first(spark, path, lambda changes: hb.committed_position(changes).orderBy(F.desc("file_seq"), F.desc("offset")).first())
    rows = [("heartbeat", beat["file_seq"], beat["offset"], read), ("end", last["file_seq"], last["offset"], end_read)]
    return spark.createDataFrame(rows, "what string, file_seq long, offset long, files_read long")


@query(
    "i16_positions_of_other_servers_forgotten",
    """SELECT o_orderkey AS server_id, 'c' || o_custkey % 3 AS client_id FROM orders WHERE NOT (o_orderkey <> 7 AND o_custkey % 3 = 1)""",
)
def forgotten(spark: SparkSession, sf: str) -> DataFrame:
    """Orders read as stored positions of three clients on many servers."""
    positions = fd.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("server_id"), F.concat(F.lit("c"), (F.col("o_custkey") % 3).cast("string")).alias("client_id")
    )
    return hb.forget_other_servers(positions, 7, "c1")


@query(
    "f6_position_to_resume_at",
    f"""SELECT CAST(1 AS BIGINT) AS server_id, CAST(max(seq * 1000000000 + off) // 1000000000 AS BIGINT) AS file_seq,
               max(seq * 1000000000 + off) % 1000000000 AS "offset" FROM ({fd.FEED_E_SQL}) WHERE off % 5 = 4""",
)
def resume_position(spark: SparkSession, sf: str) -> DataFrame:
    e = _e(spark, sf).withColumn("commit", F.col("position.offset") % 5 == 4)
    return hb.committed_position(e).select("server_id", "file_seq", "offset")
