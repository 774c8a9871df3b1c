"""Heartbeats: lag, which positions call for one, and recovery of a position by heartbeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideview.operators.ordered import SLOT, previous_row
from tideview.sources.change import position_key

# A heartbeat is due after this many bytes or seconds.
DUE_BYTES = 1000
DUE_SECONDS = 10


def heartbeat_lag(df: DataFrame, read_ms: Column) -> DataFrame:
    """Per server: the last heartbeat seen in the feed and the lag when it was read."""
    beat = F.coalesce(F.col("data")["heartbeat"].try_cast("bigint"), F.col("ts_ms"))
    beats = df.filter(F.col("type") == "heartbeat").select(
        F.coalesce("server_id", F.lit(0).cast("bigint")).alias("server_id"), beat.alias("beat"), read_ms.alias("read")
    )
    return beats.groupBy("server_id").agg(
        F.count(F.lit(1)).alias("heartbeats"),
        F.max("beat").alias("last_heartbeat"),
        F.max(F.col("read") - F.col("beat")).alias("max_lag_ms"),
        F.max_by(F.col("read") - F.col("beat"), F.col("beat")).alias("last_lag_ms"),
    )


def heartbeats_due(df: DataFrame, slot: int = SLOT) -> DataFrame:
    """Rows at which a heartbeat is due, judged against the row before in the same server's feed:
    the first row, a new file, more than 1000 bytes further, or at least 10 seconds later."""
    rows = df.withColumn("_server", F.coalesce("server_id", F.lit(0).cast("bigint")))
    rows = previous_row(rows, ["_server"], {"_p": F.col("position"), "_t": F.col("ts_ms")}, slot)
    p, q = F.col("position"), F.col("_p")
    reason = (
        F.when(q.isNull(), F.lit("first"))
        .when(p["file_seq"] != q["file_seq"], F.lit("file"))
        .when(p["offset"] - q["offset"] > DUE_BYTES, F.lit("bytes"))
        .when(F.col("ts_ms") - F.col("_t") >= DUE_SECONDS * 1000, F.lit("time"))
    )
    return rows.withColumn("due", reason).filter(F.col("due").isNotNull()).drop("_server", "_p", "_t")


def recover_position(feed: DataFrame, heartbeat: int | Column) -> DataFrame:
    """Where to resume in a new server's feed: the newest file that holds the heartbeat, and in
    it the position of its first row with that heartbeat. Empty when it is nowhere."""
    want = heartbeat if isinstance(heartbeat, Column) else F.lit(heartbeat)
    hits = feed.filter((F.col("type") == "heartbeat") & (F.col("data")["heartbeat"].try_cast("bigint") == want))
    p = F.col("position")
    per_file = hits.groupBy(p["file"].alias("file"), p["file_seq"].alias("file_seq")).agg(
        F.min(p["offset"]).alias("offset"), F.count(F.lit(1)).alias("n")
    )
    return (
        per_file.agg(F.max_by(F.struct("file", "file_seq", "offset", "n"), F.col("file_seq")).alias("r"))
        .filter(F.col("r").isNotNull())
        .select("r.file", "r.file_seq", "r.offset", F.col("r.n").alias("beats"))
    )


class RecoveryError(RuntimeError):
    """The stored position to recover from is not certain."""


def stored_position(positions: DataFrame, client_id: str):
    """The one stored position with a heartbeat of a client; more than one is an error."""
    rows = (
        positions.filter((F.col("client_id") == client_id) & F.col("last_heartbeat_read").isNotNull())
        .orderBy(F.desc("last_heartbeat_read"))
        .limit(2)
        .collect()
    )
    if len(rows) > 1:
        raise RecoveryError(f"client {client_id} has positions of several servers; keep only the right one and retry")
    return rows[0] if rows else None


def forget_other_servers(positions: DataFrame, server_id: int, client_id: str) -> DataFrame:
    """Positions without those the client stored for other servers."""
    other = (F.col("server_id") != server_id) & (F.col("client_id") == client_id)
    return positions.filter(~F.coalesce(other, F.lit(False)))


def progress(df: DataFrame) -> DataFrame:
    """Per server the newest position at which a transaction ended, where a restart resumes, and
    the newest heartbeat: (server_id, file, file_seq, offset, heartbeat)."""
    done = F.coalesce("commit", F.lit(False)) | F.col("xid").isNull()
    beat = F.when(F.col("type") == "heartbeat", F.coalesce(F.col("data")["heartbeat"].try_cast("bigint"), F.col("ts_ms")))
    at = F.max_by(F.when(done, F.col("position")), F.when(done, position_key()))
    return df.groupBy(F.coalesce("server_id", F.lit(0).cast("bigint")).alias("server_id")).agg(
        at.alias("position"), F.max(beat).alias("heartbeat")
    ).select("server_id", "position.file", "position.file_seq", "position.offset", "heartbeat")


def committed_position(df: DataFrame) -> DataFrame:
    """Per server the newest position at which a transaction ended."""
    return progress(df).drop("heartbeat").filter(F.col("file").isNotNull())
