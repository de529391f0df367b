"""Factor-result files: readers, writers, shard merges, audit rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import values
from tickloom.operators.keyed import keep_first

# Result folders below a day.
CATEGORIES = {
    "daily": "daily-feature", "minutes": "minutes-feature", "positions": "positions",
    "minutes_daily": "minutes-daily-feature",
}
# Fixed value: date, optional slice, shard and part of a result file name.
_NAME = r"(\d{8})(?:_(\d{6}))?(?:_s(\d+))?(?:_p(\d+))?\.[a-z]+$"


def file_parts(path: Column) -> dict[str, Column]:
    """Date, slice, shard and part read off a result path; absent parts are null."""
    part = lambda i: F.nullif(F.regexp_extract(path, _NAME, i), F.lit(""))
    return {"file_date": part(1), "file_end_time": part(2), "shard": part(3).cast("int"), "part": part(4).cast("int")}


def read_results(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Result rows with the file they came from; the format follows the extension."""
    fmt = fmt or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    reader = spark.read.option("recursiveFileLookup", "true")
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true")
    df = reader.format(fmt).load(path)
    source = F.col("_metadata.file_path")
    return df.select("*", source.alias("_file")).withColumns(file_parts(F.col("_file")))


def list_results(df: DataFrame) -> DataFrame:
    """One row per result file: name parts and row count."""
    return df.groupBy("_file", "file_date", "file_end_time", "shard", "part").agg(F.count("*").alias("rows"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """The result files below ``path`` with name parts, bytes and time of change, whatever their format; none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("_file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("changed")).withColumns(
        file_parts(F.col("_file")))


def read_json_variants(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON result files whose fields differ, as ``VARIANT``: a file is one record, a list of them, or an
    object with a list ``records``. A file that is no JSON gives no rows; take fields with ``variant_get``."""
    text = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path)
    whole = text.select(F.col("_metadata.file_path").alias("_file"), F.try_parse_json("value").alias("_v"))
    listed = F.coalesce(F.try_variant_get("_v", "$.records", "array<variant>"), F.try_variant_get("_v", "$", "array<variant>"), F.array("_v"))
    return whole.where(F.col("_v").isNotNull()).select("_file", F.explode(listed).alias("record")).withColumns(file_parts(F.col("_file")))


def read_json_results(spark: SparkSession, path: str, record: T.StructType, multi_line: bool = True) -> DataFrame:
    """JSON results: a file (or a line) is an array of records or an object with ``records``."""
    schema = T.StructType(record.fields + [T.StructField("records", T.ArrayType(record))])
    raw = spark.read.schema(schema).option("multiLine", str(multi_line).lower()).option("recursiveFileLookup", "true").json(path)
    names = [f.name for f in record.fields]
    own = F.array(F.struct(*names))
    rows = raw.select(F.col("_metadata.file_path").alias("_file"),
                      F.inline(F.coalesce("records", own)))
    return rows.withColumns(file_parts(F.col("_file")))


def prefer_files(df: DataFrame, mode: str = "auto") -> DataFrame:
    """Choose between shard files and merged files of a day.

    ``shards`` and ``full`` keep one sort, ``all`` keeps both, ``auto`` keeps a
    day's shards when it has any and its merged file otherwise.
    """
    is_shard = F.col("shard").isNotNull()
    if mode == "all":
        return df
    if mode == "shards":
        return df.where(is_shard)
    if mode == "full":
        return df.where(~is_shard)
    if mode != "auto":
        raise ValueError(f"mode must be auto, shards, full or all, got {mode!r}")
    has = df.groupBy("file_date").agg(F.max(F.when(is_shard, 1).otherwise(0)).alias("_sharded"))
    return df.join(has, "file_date").where(is_shard == (F.col("_sharded") == 1)).drop("_sharded")


def prefer_source(preferred: DataFrame, fallback: DataFrame, day: str = "trade_date") -> DataFrame:
    """All days of the preferred source, and the days only the fallback has."""
    known = preferred.select(day).distinct()
    return preferred.withColumn("source", F.lit("history")).unionByName(
        fallback.join(known, day, "left_anti").withColumn("source", F.lit("live")), allowMissingColumns=True)


def write_results(df: DataFrame, root: str, category: str, fmt: str = "parquet", compact: bool = True) -> None:
    """Result sink partitioned by day and slice; days and slices present are replaced."""
    out = values.compact_floats(df) if compact else df
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.partitionBy("trade_date", "end_time").format(fmt).save(f"{root.rstrip('/')}/{CATEGORIES.get(category, category)}")


def shard_summary(df: DataFrame, day: str = "trade_date") -> DataFrame:
    """One row: days, records, distinct stocks."""
    per = df.groupBy(day, "code").agg(F.count("*").alias("n"))
    stocks = per.groupBy("code").agg(F.sum("n").alias("n"))
    days = per.groupBy(day).agg(F.sum("n").alias("n"))
    d = days.agg(F.count("*").alias("day_count"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.lit(1).alias("_one"))
    s = stocks.agg(F.sum("n").alias("total_records"), F.count("*").alias("stock_count"), F.lit(1).alias("_one"))
    return d.join(s, "_one").drop("_one")


def merge_shards(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key over all shards: the one of the last shard, part and row."""
    return keep_first(df, list(keys), [F.desc_nulls_last(c) for c in order])


def merge_gate(df: DataFrame, day: str = "trade_date", min_rows: int = 4000, min_columns: int = 100,
               prefix: str = "F_") -> DataFrame:
    """Per day: rows, factor columns, and whether the merged file may be published."""
    columns = sum(c.startswith(prefix) for c in df.columns)
    return df.groupBy(day).agg(F.count("*").alias("rows")).withColumns({
        "factor_columns": F.lit(columns),
        "passed": (F.col("rows") >= min_rows) & F.lit(columns >= min_columns)})


def write_audit(df: DataFrame, path: str) -> None:
    """Audit rows, one JSON line per day and record."""
    df.write.mode("append").json(path)
