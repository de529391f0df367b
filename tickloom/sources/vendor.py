"""Vendor tables and raw message files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import codes, values


def read_table(spark: SparkSession, name: str, url: str | None = None, partition: dict | None = None,
               properties: dict | None = None) -> DataFrame:
    """A catalog table, or a database table over JDBC read in key ranges.

    ``partition`` (column, lower, upper, number) splits the read; filters and
    columns chosen later are pushed to the database.
    """
    if url is None:
        return spark.table(name)
    options = {"url": url, "dbtable": name, **(properties or {})}
    if partition:
        options |= {"partitionColumn": partition["column"], "lowerBound": str(partition["lower"]),
                    "upperBound": str(partition["upper"]), "numPartitions": str(partition["number"])}
    return spark.read.format("jdbc").options(**options).load()


def limit_table(df: DataFrame) -> DataFrame:
    """Published limits -> (code, trade_date, high_limit, low_limit, pre_close) as doubles."""
    code = F.concat_ws(".", codes.zfill(F.col("ticker_symbol")), F.col("exchange_cd"))
    double = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return df.select(
        code.alias("code"), "trade_date", double("limit_up_price").alias("high_limit"),
        double("limit_down_price").alias("low_limit"), double("pre_close_price").alias("pre_close"))


def market_on(df: DataFrame, day: Column, exchanges: Sequence[str] = ("XSHG", "XSHE")) -> DataFrame:
    return df.where((F.col("trade_date") == day) & F.col("exchange_cd").isin(*exchanges))


def listed_equities(df: DataFrame) -> DataFrame:
    """Listed shares of the security master."""
    return df.where((F.col("asset_class") == "E") & (F.col("list_status_cd") == "L"))


def _message_reader(header: Sequence[str], titled: bool, *more: T.StructField):
    schema = T.StructType([*[T.StructField(h, T.StringType()) for h in header], *more])
    # Without pruning every line is parsed whole, so a line counts as malformed whichever columns are asked.
    return lambda reader: reader.schema(schema).option("header", str(titled).lower()).option("columnPruning", "false")


def read_message_csv(spark: SparkSession, path: str, header: Sequence[str], columns: Sequence[str],
                     titled: bool = True) -> DataFrame:
    """Raw message backup: all text, malformed lines dropped, only wanted columns kept.

    ``message_line_counts`` tells how many lines that were.
    """
    reader = _message_reader(header, titled)(spark.read)
    df = reader.option("mode", "DROPMALFORMED").option("enforceSchema", "true").csv(path)
    return df.select(*[c for c in columns if c in header])


def message_line_counts(spark: SparkSession, path: str, header: Sequence[str], titled: bool = True) -> DataFrame:
    """One row: lines, and lines whose number of fields is not the header's."""
    bad = T.StructField("_bad", T.StringType())
    reader = _message_reader(header, titled, bad)(spark.read)
    df = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)
    # The first field is read as well: Spark does not answer from the malformed-line column alone.
    first = F.col(header[0])
    return df.agg((F.count_if(first.isNull()) + F.count_if(first.isNotNull())).alias("lines"), F.count("_bad").alias("bad_lines"))
