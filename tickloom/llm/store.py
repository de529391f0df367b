"""Tables of the query folder and written intermediates."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import scratch_path

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: several later steps use one computation,
    lineage ends here, and a lost executor costs one read."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside hands Python workers Arrow batches of ``rows`` rows at most, whole texts and
    sets being long rows. A smaller setting of the session stays."""
    was = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(rows if int(was) <= 0 else min(rows, int(was))))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, was)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that clashes with none of ``df``, whatever extra columns it carries."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = "_" + name
    return name


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.transform(F.array(value), body)[0]


def bounded_sample(rows: DataFrame, key: str, bound: int) -> list:
    """About ``bound`` rows at most, chosen by a hash of ``key``; never more than twice ``bound``."""
    total = rows.count()
    if total > bound:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1_000_000)) < int(1_000_000 * bound / total))
    return rows.limit(2 * bound).collect()


def same_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null; the left side's key columns stay."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(right, on, how).drop(*[f"_right_{k}" for k in keys])
