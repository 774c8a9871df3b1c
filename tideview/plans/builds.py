"""The register of builds: which views still have to be built, and in which order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideview.plans.spec import ViewSpec

BUILD_RUNS = "view_id int, view string, status string, started_at timestamp_ntz"


def drop_half_done(runs: DataFrame) -> DataFrame:
    """Registrations without those that never completed."""
    return runs.filter("status = 'complete'")


def pending_builds(spark: SparkSession, specs: list[ViewSpec], runs: DataFrame) -> DataFrame:
    """Views of the configuration (view_id, view, master) with no complete build."""
    wanted = spark.createDataFrame([(s.id, s.name, s.master) for s in specs], "view_id int, view string, master string")
    done = drop_half_done(runs).select(F.col("view_id").alias("_done"))
    return wanted.join(done, F.col("view_id") == F.col("_done"), "left_anti")


def unfinished_builds(tasks: DataFrame) -> DataFrame:
    """Open tasks of (id, started_at, completed_at, ...): not started first, then the oldest."""
    return tasks.filter(F.col("completed_at").isNull()).orderBy(
        F.col("started_at").isNotNull(), F.col("started_at").asc_nulls_first(), F.col("id")
    )


def build_progress(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Progress of builds: (view, total_rows, inserted_rows, complete) from rows written so far,
    (view, id), and the expected totals, (view, total_rows)."""
    done = rows.groupBy(F.col("view").alias("_view")).agg(F.count(F.lit(1)).alias("inserted_rows"))
    return totals.join(done, F.col("view") == F.col("_view"), "left").select(
        "view",
        "total_rows",
        F.coalesce("inserted_rows", F.lit(0).cast("bigint")).alias("inserted_rows"),
        (F.coalesce("inserted_rows", F.lit(0).cast("bigint")) >= F.col("total_rows")).alias("complete"),
    )
