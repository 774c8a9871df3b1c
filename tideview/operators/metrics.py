"""Feed and run metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def feed_metrics(df: DataFrame) -> DataFrame:
    """Rows per table and type, with the time they span and the rate over it."""
    seconds = (F.max("ts_ms") - F.min("ts_ms")) / F.lit(1000.0)
    return df.groupBy("database", "table", "type").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("ts_ms").alias("first_ms"),
        F.max("ts_ms").alias("last_ms"),
        F.when(seconds > 0, F.count(F.lit(1)) / seconds).alias("rows_per_second"),
    )


def transaction_metrics(df: DataFrame) -> DataFrame:
    """Per transaction: rows and the time from its first row to its last."""
    return (
        df.filter(F.col("xid").isNotNull())
        .groupBy(F.coalesce("server_id", F.lit(0).cast("bigint")).alias("server_id"), "xid")
        .agg(F.count(F.lit(1)).alias("row_count"), (F.max("ts_ms") - F.min("ts_ms")).alias("duration_ms"))
    )


def histogram(df: DataFrame, value: str) -> DataFrame:
    """(value, n): how often each value occurs."""
    return df.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def percentiles(df: DataFrame, value: str, points: tuple[float, ...] = (0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """Count, extremes, mean and exact (interpolated) percentiles of a whole-number column, as one row.

    Values are first counted. Their order is then found in two steps: over coarse classes (the
    value cut to its 13 leading bits, so at most some 440,000 classes of any 64-bit column), and
    inside each class. No task sees all distinct values.
    """
    v = F.col("value")
    size = F.floor(F.log2(F.abs(v).cast("double"))).cast("int")
    step = F.when(F.abs(v) < 8192, F.lit(1)).otherwise(F.pow(F.lit(2.0), size - 12)).cast("bigint")
    h = histogram(df.filter(F.col(value).isNotNull()), value).withColumn("value", v.cast("bigint")).withColumn("_class", v - v % step)
    before = W.orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    coarse = h.groupBy(F.col("_class").alias("_c")).agg(F.sum("n").alias("_n")).select(
        "_c",
        F.coalesce(F.sum("_n").over(before), F.lit(0).cast("bigint")).alias("_start"),
        F.sum("_n").over(W.partitionBy(F.lit(1))).alias("_total"),
    )
    inside = W.partitionBy("_class").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    ranked = h.join(coarse, F.col("_class") == F.col("_c")).withColumn("_upto", F.col("_start") + F.sum("n").over(inside))

    def at(rank: Column) -> Column:
        """The value on a rank that counts from 0."""
        return F.max(F.when((rank >= F.col("_upto") - F.col("n")) & (rank < F.col("_upto")), v))

    out = [F.sum("n").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), (F.sum(v * F.col("n")) / F.sum("n")).alias("mean")]
    total = F.col("_total")
    for p in points:
        rank = (total - 1) * F.lit(p)
        share = F.max(rank - F.floor(rank))
        low, high = at(F.floor(rank)), at(F.ceil(rank))
        out.append((low + (high - low) * share).alias(f"p{round(p * 100)}"))
    return ranked.agg(*out)


def commit_lag(df: DataFrame, seen_ms: Column) -> DataFrame:
    """Add ``lag_ms`` to commit rows: when it was seen less when it happened."""
    return df.withColumn("lag_ms", F.when(F.col("commit"), seen_ms - F.col("ts_ms")))


def age_slo(df: DataFrame, seconds: float, seen_ms: Column | None = None, failed: Column | None = None) -> DataFrame:
    """Message age and delivery counters per table.

    ``seen_ms`` defaults to now; ``failed`` marks rows that were not delivered.
    """
    seen = seen_ms if seen_ms is not None else F.unix_millis(F.current_timestamp())
    bad = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
    age = seen - F.col("ts_ms")
    return df.groupBy("database", "table").agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum(F.when(~bad, 1).otherwise(0)).cast("bigint").alias("succeeded"),
        F.sum(F.when(bad, 1).otherwise(0)).cast("bigint").alias("failed"),
        F.max(age).alias("max_age_ms"),
        F.sum(F.when(age > seconds * 1000, 1).otherwise(0)).cast("bigint").alias("over_slo"),
    )


def health(checks: DataFrame) -> DataFrame:
    """Overall state from (name, mandatory, ok): one row (healthy, mandatory_failed, failed).

    ``healthy`` is false as soon as one check fails; a failed mandatory check is counted apart
    so that a caller can tell a warning from an outage.
    """
    bad = ~F.coalesce("ok", F.lit(False))
    return checks.agg(
        F.count(F.lit(1)).alias("checks"),
        F.coalesce(F.sum(F.when(bad, 1).otherwise(0)), F.lit(0)).cast("bigint").alias("failed"),
        F.coalesce(F.sum(F.when(bad & F.col("mandatory"), 1).otherwise(0)), F.lit(0)).cast("bigint").alias("mandatory_failed"),
    ).withColumn("healthy", F.col("failed") == 0)


def failure_checks(failures: DataFrame, now_ms: Column, window_ms: int = 15 * 60 * 1000) -> DataFrame:
    """One mandatory check per name in (name, failed_ms): ok when none failed in the window.

    The window is the last 15 minutes unless said otherwise.
    """
    recent = F.sum(F.when(F.col("failed_ms") > now_ms - window_ms, 1).otherwise(0)).cast("bigint")
    return failures.groupBy("name").agg(recent.alias("recent")).select(
        "name", F.lit(True).alias("mandatory"), (F.col("recent") == 0).alias("ok"), "recent"
    )
