"""Full build of a view, its derived schema and its description."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideview.plans.spec import VIEW_KEY, LookupSpec, ViewSpec

UPDATED_TIME = "_updated_time"

#: A lookup key is hot when it holds one in so many master rows, so there are at most that many hot keys.
HOT_SHARE = 100
#: Keys that the sketch of the frequent ones tracks; a key's count is off by a small part of rows / TRACKED.
TRACKED = 10_000


def build_view(
    spec: ViewSpec,
    tables: dict[str, DataFrame],
    keys: DataFrame | None = None,
    *,
    columns: list[str] | None = None,
    match_columns: bool = False,
    ordered: bool = False,
) -> DataFrame:
    """Build ``spec`` from source tables.

    ``keys`` (one column) restricts the build to those master keys; the restriction is applied
    to the master before any lookup is joined. ``columns`` keeps only some view columns, and
    lookups that then contribute nothing are not joined. ``match_columns`` adds the hidden
    ``_mk_<lookup>`` columns that incremental maintenance needs.
    """
    out = [c for c in spec.output_columns() if columns is None or c.name == VIEW_KEY or c.name in columns]
    master = tables[spec.master].alias(spec.master)
    if spec.where:
        master = master.filter(F.expr(spec.where))
    if keys is not None:
        # repeats are folded before the shuffle, so a key asked for very often costs little
        wanted = keys.select(F.col(keys.columns[0]).alias("_wanted")).distinct()
        master = master.join(wanted, F.col(f"{spec.master}.{spec.pk}") == F.col("_wanted"), "left_semi")

    lookups = [lk for lk in spec.lookups if any(c.table == lk.table for c in out)]
    hidden = list(spec.lookups) if match_columns else lookups
    rows = master.select(
        *[F.col(f"{spec.master}.{c.column}").alias(c.name) for c in out if c.table == spec.master],
        *[F.col(f"{spec.master}.{lk.master_column}").alias(lk.match_column) for lk in hidden],
    )
    base = rows
    for lk in lookups:
        wanted = [(c.column, c.name) for c in out if c.table == lk.table]
        hot = hot_keys(base, lk.match_column, lk.salt) if lk.salt > 1 else None
        rows = _join_lookup(rows, split_lookup(tables[lk.table], lk, wanted, hot), lk, wanted, hot)
    names = [c.name for c in out]
    if match_columns:
        names += [lk.match_column for lk in spec.lookups]
    rows = rows.select(*names)
    return rows.orderBy(VIEW_KEY) if ordered else rows


def hot_keys(rows: DataFrame, column: str, most: int) -> DataFrame:
    """(_hot, _pieces): the keys that hold at least one in ``HOT_SHARE`` of the rows that have a key, and over how many
    pieces each is spread, ``most`` at most.

    One pass over the key column with a sketch of frequent items, merged map-side first. Its result, at most ``HOT_SHARE``
    rows, is taken to the driver, since both sides of the join must agree on it.
    """
    known = rows.filter(F.col(column).isNotNull())
    found = known.agg(F.expr(f"approx_top_k(`{column}`, {HOT_SHARE}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    hot = [(t["item"], min(most, -(-HOT_SHARE * t["count"] // found["n"]))) for t in found["top"] or [] if t["count"] * HOT_SHARE >= found["n"]]
    schema = T.StructType([T.StructField("_hot", rows.schema[column].dataType), T.StructField("_pieces", T.LongType())])
    return rows.sparkSession.createDataFrame([h for h in hot if h[1] > 1], schema)


def split_lookup(lookup: DataFrame, lk: LookupSpec, wanted: list[tuple[str, str]], hot: DataFrame | None = None) -> DataFrame:
    """A lookup's rows as (_key, _v_<name>..., _key_salt): those of hot keys once for each piece, all others once."""
    right = lookup.select(F.col(lk.key).alias("_key"), *[F.col(c).alias(f"_v_{n}") for c, n in wanted])
    if hot is None:
        # computed from the key, so that it stays an equi-join key and is not folded away as a constant
        return right.withColumn("_key_salt", F.pmod(F.xxhash64("_key"), F.lit(1).cast("bigint")))
    pieces = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_pieces", F.lit(1).cast("bigint")) - 1)
    spread = right.join(F.broadcast(hot), F.col("_key") == F.col("_hot"), "left")
    return spread.withColumn("_key_salt", F.explode(pieces)).drop("_hot", "_pieces")


def _join_lookup(rows: DataFrame, right: DataFrame, lk: LookupSpec, wanted: list[tuple[str, str]], hot: DataFrame | None) -> DataFrame:
    """Left join one lookup, keeping any single join key from landing on one reducer.

    A second join key spreads the master's rows: those with a NULL key, which match nothing, over all
    reducers, those with a hot key over the key's pieces. Skew left after that is split by adaptive
    execution, which may split the left side of a left join.
    """
    key = F.col(lk.match_column)
    row_hash = F.xxhash64(VIEW_KEY)
    none = F.lit(0).cast("bigint")
    if hot is None:
        salt = F.when(key.isNull(), row_hash).otherwise(none)
    else:
        rows_hot = rows.join(F.broadcast(hot), key == F.col("_hot"), "left")
        salt = F.when(key.isNull(), row_hash).when(F.col("_pieces").isNotNull(), F.pmod(row_hash, F.col("_pieces"))).otherwise(none)
    joined = (rows if hot is None else rows_hot).withColumn("_salt", salt).join(
        right, (F.col(lk.match_column) == F.col("_key")) & (F.col("_salt") == F.col("_key_salt")), "left"
    )
    return joined.select(
        *[F.col(c) for c in rows.columns],
        *[F.col(f"_v_{n}").alias(n) for _, n in wanted],
    )


def duplicate_lookup_keys(spec: ViewSpec, tables: dict[str, DataFrame]) -> DataFrame:
    """Lookup keys that occur more than once: (lookup, key, n). Empty when the view is sound."""
    parts = [
        tables[lk.table]
        .filter(F.col(lk.key).isNotNull())
        .groupBy(F.col(lk.key).cast("string").alias("key"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(F.lit(lk.table).alias("lookup"), "key", "n")
        for lk in spec.lookups
    ]
    if not parts:
        return next(iter(tables.values())).sparkSession.createDataFrame([], "lookup string, key string, n bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def count_source(spec: ViewSpec, tables: dict[str, DataFrame]) -> DataFrame:
    """How many master rows a build will write, as one row (view, total_rows)."""
    master = tables[spec.master].alias(spec.master)
    if spec.where:
        master = master.filter(F.expr(spec.where))
    return master.agg(F.count(F.lit(1)).alias("total_rows")).select(F.lit(spec.name).alias("view"), "total_rows")


def view_schema(spec: ViewSpec, tables: dict[str, DataFrame]) -> T.StructType:
    """Schema of the stored view: source types, all but the key nullable, source comments kept."""
    fields = []
    for c in spec.output_columns():
        src = next(f for f in tables[c.table].schema.fields if f.name.lower() == c.column.lower())
        meta = {"comment": src.metadata["comment"]} if "comment" in src.metadata else {}
        if c.name == VIEW_KEY or any(c.table == lk.table and c.column == lk.key for lk in spec.lookups):
            meta["key"] = True
        fields.append(T.StructField(c.name, src.dataType, c.name != VIEW_KEY, meta))
    fields.append(T.StructField(UPDATED_TIME, T.TimestampType(), True))
    return T.StructType(fields)


def view_sql(spec: ViewSpec) -> str:
    """The view as one SQL query."""
    cols = ",\n       ".join(f"{c.table}.{c.column} AS {c.name}" for c in spec.output_columns())
    joins = "".join(
        f"\nLEFT JOIN {lk.table} ON {spec.master}.{lk.master_column} = {lk.table}.{lk.key}" for lk in spec.lookups
    )
    where = f"\nWHERE {spec.where}" if spec.where else ""
    return f"SELECT {cols}\nFROM {spec.master}{joins}{where}\nORDER BY {spec.master}.{spec.pk}"


def describe_views(spark: SparkSession, specs: list[ViewSpec], tables: dict[str, DataFrame]) -> DataFrame:
    """One row per view: definition, generated SQL and schema."""
    rows = [
        (s.id, s.name, s.master, s.pk, s.where, [lk.table for lk in s.lookups], view_sql(s), view_schema(s, tables).simpleString())
        for s in specs
    ]
    return spark.createDataFrame(
        rows, "id int, name string, master string, pk string, where string, lookups array<string>, sql string, schema string"
    )


def write_ordered(df: DataFrame, path: str, key: str = VIEW_KEY, rows_per_file: int = 0) -> None:
    """Write globally ordered by ``key`` without a single-task sort: range partitions, sorted inside."""
    out = df.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    writer = out.write.mode("overwrite")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)
