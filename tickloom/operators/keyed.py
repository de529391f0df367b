"""Keyed building blocks that stay safe when one key holds much of the data.

Every helper either combines on the map side, or spreads a hot key over many
tasks by a salt or a range bucket. Salts are hashes of row content, never
random numbers, so a recomputed task sends each row where it went before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.session import settle

#: Rows of one key that a task may join; a key with more is split.
ROWS_PER_TASK = 1_000_000


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in ``order``.

    ``row_number() = 1`` is turned into a per-task limit before the shuffle, so
    a key with many copies ships one row per task, whatever its size.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def top_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)


def heavy_keys(counts: DataFrame, keys: list[str], rows: str = "_rows", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keys with more rows than a task may hold, and how many ``_salts`` each is split by.

    There are at most total rows / ``rows_per_task`` of them: a million at 10**12 rows.
    """
    return counts.where(F.col(rows) > rows_per_task).select(*keys, F.ceil(F.col(rows) / rows_per_task).cast("int").alias("_salts"))


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", spread_by: list[str] | None = None,
                heavy: DataFrame | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Join many rows per key to one row per key, splitting only heavy keys, each by its own count.

    ``heavy`` comes from ``heavy_keys``; without it the rows per key of ``big`` are counted first, map-side.
    ``spread_by`` names columns that differ between rows of a key (all other columns by default); naming
    few keeps the scan narrow. Only the ``small`` rows of heavy keys are copied. The heavy keys are
    broadcast (see their bound); how the two sides meet is left to Spark.
    """
    spread_by = spread_by or [c for c in big.columns if c not in keys]
    if heavy is None:
        heavy = heavy_keys(big.groupBy(*keys).agg(F.count("*").alias("_rows")), keys, rows_per_task=rows_per_task)
    salts, heavy = F.coalesce("_salts", F.lit(1)), F.broadcast(heavy)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), salts).cast("int")
    left = big.join(heavy, keys, "left").withColumn("_salt", salt).drop("_salts")
    right = small.join(heavy, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def attach_totals(df: DataFrame, keys: list[str], spread_by: list[str] | None = None, rows_per_task: int = ROWS_PER_TASK,
                  **aggregates: Column) -> DataFrame:
    """Group totals next to every row: partial aggregation plus a salted join.

    Equal to ``agg over (partition by keys)``, which would instead move each
    whole group into one task. The totals also tell which keys are heavy.
    """
    totals = df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in aggregates.items()], F.count("*").alias("_rows"))
    return salted_join(df, totals.drop("_rows"), keys, "left", spread_by, heavy_keys(totals, keys, rows_per_task=rows_per_task))


def share_within(df: DataFrame, keys: list[str], value: str, into: str = "weight",
                 spread_by: list[str] | None = None) -> DataFrame:
    """``value`` divided by its total within ``keys``."""
    return attach_totals(df, keys, spread_by, _total=F.sum(value)).withColumn(
        into, F.try_divide(F.col(value), F.col("_total"))
    ).drop("_total")


def latest_per_key(df: DataFrame, keys: list[str], by: str, columns: list[str]) -> DataFrame:
    """Newest values per key from a plain hash aggregation."""
    newest = [F.max_by(c, by).alias(c) for c in columns]
    return df.groupBy(*keys).agg(F.max(by).alias(by), *newest)


def ordered_position(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Adds ``position`` (1 = first in ``order``) and ``group_rows`` per key, exactly.

    The rows are range-partitioned by key and order, so a task holds one slice
    of the sort order and no group has to fit a task. Ranks inside a slice are
    local; the offset of a slice is the row count of the slices before it,
    taken from one row per (slice, key). ``order`` must be total.
    """
    spark = df.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(slices, *[F.col(k) for k in keys], *order)
    placed = settle(ranged.withColumn("_slice", F.spark_partition_id()))
    counts = placed.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    whole = W.partitionBy(*keys)
    before = whole.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_slice",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("group_rows"),
    )
    local = W.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        placed.withColumn("_local", F.row_number().over(local))
        .join(offsets, [*keys, "_slice"])
        .withColumn("position", F.col("_local") + F.col("_before"))
        .drop("_local", "_before", "_slice")
    )


def previous_in_ranges(df: DataFrame, keys: list[str], bucket: Column, order: list,
                       value: str, into: str) -> DataFrame:
    """``lag(value)`` per key with each key cut into ``bucket`` ranges.

    ``bucket`` must not decrease along ``order``. A task sorts one bucket; the
    value before a bucket comes from the last row of the bucket before it, one
    row per (key, bucket).
    """
    cut = df.withColumn("_bucket", bucket)
    part = W.partitionBy(*keys, "_bucket").orderBy(*order)
    tail = F.max_by(F.col(value), F.struct(*order)).alias("_tail")
    ends = cut.groupBy(*keys, "_bucket").agg(tail)
    across = W.partitionBy(*keys).orderBy("_bucket")
    carried = ends.select(*keys, "_bucket", F.lag("_tail").over(across).alias("_carried"))
    return (
        cut.withColumn("_n", F.row_number().over(part))
        .withColumn("_lag", F.lag(value).over(part))
        .join(carried, [*keys, "_bucket"], "left")
        .withColumn(into, F.when(F.col("_n") == 1, F.col("_carried")).otherwise(F.col("_lag")))
        .drop("_bucket", "_n", "_lag", "_carried")
    )


def exact_median(df: DataFrame, keys: list[str], value: str, tie: list) -> DataFrame:
    """Exact per-key median of the non-null values, by distributed position."""
    placed = ordered_position(df.where(F.col(value).isNotNull()), keys, [F.col(value), *tie])
    low = F.floor((F.col("group_rows") + 1) / 2)
    high = F.floor((F.col("group_rows") + 2) / 2)
    middle = placed.where((F.col("position") == low) | (F.col("position") == high))
    return middle.groupBy(*keys).agg(((F.min(value) + F.max(value)) / 2).alias(f"{value}_median"))
