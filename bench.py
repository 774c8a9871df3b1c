"""Headline timings: prints one JSON line.

``BENCH_SF_DIR`` names the tables and ``BENCH_CPUS`` the local cores. Each query is planned and
run once after a warm-up, all rows going to a sink that drops them.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: How many times the orders of the larger of the two sizes at which feeds are applied.
GROWN = 20

HEADLINE = (
    "a1_snapshot_scan",
    "b2_full_build_orders",
    "b2_full_build_events",
    "b2_full_build_customer_blank_where",
    "d1_star_join_three_lookups",
    "b6_build_for_keys",
    "a2_read_change_feed",
    "a4_write_change_json",
    "c3_table_rules_last_match_wins",
    "d2_duplicate_lookup_keys",
    "d3_reverse_lookup",
    "d4_route_to_views",
    "e1_master_insert",
    "e2_master_delete",
    "e4_master_key_change",
    "e6_lookup_update",
    "e7_lookup_key_change",
    "e8_lookup_delete",
    "e10_mixed_feed",
    "f1_snapshot_diff",
    "f4_one_transaction_holds_a_third",
    "f8_net_effect_per_key",
    "f8_one_hot_key",
    "d5_h5_schema_version_as_of",
    "g7_datetimes_from_micros",
    "h2_schema_differences",
    "i9_heartbeats_due",
    "k5_transaction_metrics",
)


def session() -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("tideview-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # call sites are not recorded for every column, which halves planning time
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    start = time.perf_counter()
    fn()
    return round(time.perf_counter() - start, 3)


def maintenance(spark: SparkSession) -> dict:
    """Applying feeds of 1, 10 and 50 % of the master against a rebuild, and one micro-batch."""
    from tideview.operators import maintain as mt
    from tideview.operators.feed import diff_snapshots
    from tideview.plans.build import build_view
    from tideview.sources.change import position_struct
    from tideview.sources.feed import OutputOptions, to_change_json
    from tideview.streaming.maintainer import Maintainer
    from workload import feeds as fd
    from workload.registry import scratch, shared_cut

    root = scratch(spark, "bench")
    t = fd.tables(spark, SF, fd.ORDERS)
    out: dict = {"cores": CPUS}
    for times in (1, GROWN):
        big = dict(t)
        if times > 1:
            # the same orders under many keys
            copies = t["orders"].withColumn("o_orderkey", F.explode(F.transform(F.sequence(F.lit(0), F.lit(times - 1)), lambda i: F.col("o_orderkey") + i.cast("bigint") * 100_000_000)))
            copies.write.parquet(f"{root}/orders{times}")
            big["orders"] = spark.read.parquet(f"{root}/orders{times}")
        name = "" if times == 1 else f"x{times}_"
        build_view(fd.ORDERS, big, match_columns=True).write.parquet(f"{root}/{name}view")
        view = spark.read.parquet(f"{root}/{name}view")
        rows = big["orders"].count()
        rebuild = timed(lambda: drain(build_view(fd.ORDERS, big)))  # noqa: B023
        out |= {f"{name}master_rows": rows, f"{name}build_rows_per_second": round(rows / rebuild), f"{name}rebuild_seconds": rebuild}
        for percent in (1, 10, 50):
            orders = big["orders"]
            after = orders.withColumn(
                "o_totalprice", F.when(F.pmod(F.xxhash64("o_orderkey"), F.lit(100)) < percent, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
            )
            made = diff_snapshots(orders, after, "o_orderkey", database="shop", table="orders")
            key = F.col("data")["o_orderkey"].cast("bigint")
            made = made.withColumn("position", position_struct(F.lit(fd.FILE), key * 10)).withColumn("ts", F.lit(1).cast("bigint"))
            made.write.parquet(f"{root}/{name}feed{percent}")
            feed = spark.read.parquet(f"{root}/{name}feed{percent}")
            n = feed.count()
            seconds = timed(lambda: drain(mt.apply_changes(fd.ORDERS, view, big, feed, cut=shared_cut(spark, "b"))[0]))  # noqa: B023
            out[f"{name}apply_{percent}_percent_seconds"] = seconds
            out[f"{name}apply_{percent}_percent_changes_per_second"] = round(n / seconds)
            out[f"{name}apply_{percent}_percent_over_rebuild"] = round(seconds / rebuild, 2)
            # what a sink by key has to write, without reading the rest of the view
            delta = timed(lambda: drain(mt.view_delta(fd.ORDERS, view, big, feed, cut=shared_cut(spark, "b"))[0]))  # noqa: B023
            out[f"{name}delta_{percent}_percent_seconds"] = delta
            out[f"{name}delta_{percent}_percent_over_rebuild"] = round(delta / rebuild, 2)
    lines = to_change_json(spark.read.parquet(f"{root}/feed1"), OutputOptions(position=True, server_id=True, tables={"orders": t["orders"].schema}))
    lines.write.text(f"{root}/lines")
    spark.createDataFrame([], "value string").write.text(f"{root}/none")
    m = Maintainer(spark, [fd.ORDERS], t, f"{root}/none", f"{root}/store", start_position=(0, 0), buckets=16)
    out["store_build_seconds"] = timed(m.build)
    out["micro_batch_first_seconds"] = timed(lambda: m.apply_batch(spark.read.text(f"{root}/lines"), 0))
    one = spark.read.text(f"{root}/lines").limit(100)
    m2 = Maintainer(spark, [fd.ORDERS], t, f"{root}/none", f"{root}/store2", start_position=(0, 0), buckets=16)
    m2.build()
    out["micro_batch_100_rows_seconds"] = timed(lambda: m2.apply_batch(one, 0))
    return out


def main() -> None:
    spark = session()
    from workload import all_queries

    queries = all_queries()
    drain(queries["b2_full_build_orders"](spark, SF))
    drain(queries["e10_mixed_feed"](spark, SF))
    times = {name: timed(lambda: drain(queries[name](spark, SF))) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF.rstrip("/")),
                "maintenance": maintenance(spark),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
