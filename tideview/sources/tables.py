"""Source tables and plain sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, source: dict) -> DataFrame:
    """Read one source table.

    ``source`` holds one of ``path`` (with an optional ``format``), ``table`` (a catalog
    table), ``query`` (Spark SQL) or ``jdbc``; ``where`` and ``columns`` narrow the scan. A
    JDBC source is read in parallel when ``partition_column``, ``lower``, ``upper`` and
    ``partitions`` are given.
    """
    if "path" in source:
        df = spark.read.format(source.get("format", "parquet")).options(**source.get("options", {})).load(source["path"])
    elif "table" in source:
        df = spark.read.table(source["table"])
    elif "query" in source:
        df = spark.sql(source["query"])
    elif "jdbc" in source:
        df = spark.read.format("jdbc").options(**jdbc_options(source["jdbc"])).load()
    else:
        raise ValueError("a source needs path, table, query or jdbc")
    if source.get("where"):
        df = df.filter(source["where"])
    if source.get("columns"):
        df = df.select(*source["columns"])
    return df


def jdbc_options(conf: dict) -> dict[str, str]:
    """Spark reader options of a JDBC source: partitioned and streamed, not buffered."""
    opts = {"url": conf["url"], "fetchsize": str(conf.get("fetch_size", 10_000))}
    if "query" in conf and "partition_column" in conf:
        opts["dbtable"] = f"({conf['query']}) AS q"
    elif "query" in conf:
        opts["query"] = conf["query"]
    else:
        opts["dbtable"] = conf["table"]
    if "partition_column" in conf:
        opts |= {
            "partitionColumn": conf["partition_column"],
            "lowerBound": str(conf["lower"]),
            "upperBound": str(conf["upper"]),
            "numPartitions": str(conf["partitions"]),
        }
    for k in ("user", "password", "driver"):
        if conf.get(k):
            opts[k] = conf[k]
    return opts


def write_batches(df: DataFrame, path: str, rows: int = 1000, mode: str = "append") -> None:
    """Write files of at most ``rows`` rows; each task's remainder makes its last file."""
    df.write.mode(mode).option("maxRecordsPerFile", rows).parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, *, rows: int = 1000, mode: str = "append", **options) -> None:
    """Insert in batches of ``rows`` rows per statement round trip."""
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(rows), **options).mode(mode).save()


def null_sink(df: DataFrame, batch_id: int = 0) -> None:
    """Consume every row and keep none."""
    df.write.format("noop").mode("overwrite").save()


Sink = Callable[[DataFrame, int], None]
