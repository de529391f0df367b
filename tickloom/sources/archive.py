"""Day-partitioned feed and panel tables: scans, range guards, sorted archive writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions import times
from tickloom.operators.calendar import last_days, one_per_day, trading_days
from tickloom.operators.keyed import keep_first

HEAVY = ("tick", "order", "deal")


def table_path(root: str, kind: str) -> str:
    return f"{root.rstrip('/')}/{kind}"


def scan(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The whole table; a filter on ``trade_date`` prunes folders."""
    return spark.read.parquet(table_path(root, kind))


def only_codes(df: DataFrame, codes: Sequence[str] | DataFrame | None, column: str = "code") -> DataFrame:
    """Rows of some codes.

    A short list becomes a pushed-down ``IN``, which skips row groups of files
    sorted by code; a table of codes becomes a semi-join.
    """
    if codes is None:
        return df
    if isinstance(codes, DataFrame):
        return df.join(codes.select(column).distinct(), column, "left_semi")
    return df.where(F.col(column).isin(*codes))


def load_day(df: DataFrame, day: str, codes: Sequence[str] | DataFrame | None = None) -> DataFrame:
    return only_codes(df.where(F.col("trade_date") == F.lit(day).cast("date")), codes)


def load_range(df: DataFrame, start: str, end: str, codes: Sequence[str] | DataFrame | None = None,
               kind: str | None = None, max_days: int | None = None) -> DataFrame:
    """Inclusive day range; heavy kinds may be limited to a number of days."""
    inside = df.where(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if kind in HEAVY and max_days is not None:
        guard_days(inside, kind, max_days)
    return only_codes(inside, codes)


def guard_days(df: DataFrame, kind: str, max_days: int) -> None:
    """Refuse a heavy load over too many trading days. Reads the partition column only."""
    days = trading_days(df).count()
    if days > max_days:
        raise ValueError(f"{days} days of '{kind}' exceed the limit of {max_days}; load day by day or raise the limit")


def load_last_days(df: DataFrame, anchor: str, count: int, codes: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """The last ``count`` trading days up to the anchor, tagged ``_date`` (``YYYYMMDD``).

    The day list is a small subquery result, so the scan is pruned at run time.
    """
    wanted = last_days(trading_days(df), F.lit(anchor).cast("date"), count)
    rows = df.join(one_per_day(wanted), "trade_date", "left_semi")
    return only_codes(rows, codes).withColumn("_date", F.date_format("trade_date", "yyyyMMdd"))


def load_time_range(df: DataFrame, start: str, end: str, codes: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Inclusive time range; reversed ends are swapped. Whole days are pruned first."""
    lo, hi = sorted((start, end))
    days = F.col("trade_date").between(F.to_date(F.lit(lo)), F.to_date(F.lit(hi)))
    span = F.col("time").between(F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz"))
    return only_codes(df.where(days & span), codes)


def write_partitioned(df: DataFrame, root: str, kind: str) -> None:
    """Replace the days present in ``df``, leaving other days alone.

    Ranges go down to time and sequence where present, so a busy stock or day
    is written by several tasks.
    """
    order = ["trade_date", "code", *[c for c in ("time", "seq_num") if c in df.columns]]
    (df.repartitionByRange(*order).sortWithinPartitions(*order)
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("trade_date").parquet(table_path(root, kind)))


def write_archive(df: DataFrame, root: str, kind: str, keys: Sequence[str] = ("code", "seq_num"),
                  order: Sequence[str] = ("time", "update_time")) -> None:
    """Deduplicated archive days in zstd files that are sorted and disjoint by (code, seq_num).

    Range partitioning on day, code and sequence splits a stock that fills a
    day over several files, and sorted files let readers skip row groups.
    """
    rows = keep_first(df, ["trade_date", *keys], [F.col(c) for c in order])
    (rows.repartitionByRange("trade_date", *keys).sortWithinPartitions("trade_date", *keys)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd").partitionBy("trade_date").parquet(table_path(root, kind)))


def write_ordered(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Canonical row order at the sink only: ranges over files, sorted inside each file."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def out_of_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row: row count, and rows that sort before the row above them in their file."""
    at = W.partitionBy("_file").orderBy("_row")
    key = F.struct(*order)
    rows = df.select(*order, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return rows.select((key < F.lag(key).over(at)).alias("_bad")).agg(
        F.count("*").alias("rows"), F.count_if("_bad").alias("out_of_order"))
