"""Daily panel: assembly, gap filling, column repair, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions import codes, values
from tickloom.operators.calendar import DAY, calendar, one_per_day
from tickloom.operators.keyed import keep_first

MIN_ROWS = 5200  # Fixed value: rows of a complete panel day.


def build_panel(market: DataFrame, adjusted: DataFrame, security: DataFrame,
                exposures: DataFrame | None = None, index_rows: DataFrame | None = None) -> DataFrame:
    """Market rows with adjusted prices (inner), master data and exposures (left), and
    the day's index row on every stock row.

    The index row joins on the day: in bulk each day has its own single row, so
    no Cartesian product is needed, and a day without one keeps its stocks.
    """
    out = market.join(adjusted, ["security_id", DAY]).join(security, "security_id", "left")
    if exposures is not None:
        out = out.join(exposures, ["security_id", DAY], "left")
    if index_rows is not None:
        out = out.join(index_rows, DAY, "left")
    return out


def fill_nulls_from(df: DataFrame, other: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Null (or blank) cells take the other source's value; set cells stay."""
    have = dict(df.dtypes)
    fresh = other.select(*keys, *[F.col(c).alias(f"_fill_{c}") for c in columns])
    current = lambda c: F.nullif(F.col(c), F.lit("")).try_cast("double") if have[c] == "string" else F.col(c)
    return df.join(fresh, keys, "left").select(*[
        F.coalesce(current(c), F.col(f"_fill_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns
    ])


def _short_days(panel: DataFrame, min_rows: int, today: Column | None) -> DataFrame:
    """Days below the row threshold, with the day before each. One row per such day."""
    counts = panel.groupBy(DAY).agg(F.count("*").alias("rows"))
    w = W.orderBy(DAY)  # one row per trading day
    days = counts.withColumn("stale_from", F.lag(DAY).over(w))
    short = days.where((F.col("rows") < min_rows) & F.col("stale_from").isNotNull())
    return short if today is None else short.where(F.col(DAY) != today)


def stale_rows(panel: DataFrame, code: str, min_rows: int = MIN_ROWS, today: Column | None = None) -> DataFrame:
    """Rows to add to short days: the raw previous day's stocks that the day lacks.

    The date is rewritten to the short day; ``stale_from`` keeps the origin.
    """
    short = _short_days(panel, min_rows, today).select(F.col(DAY).alias("_day"), "stale_from")
    shifted = panel.join(one_per_day(short), F.col(DAY) == F.col("stale_from")).drop(DAY).withColumnRenamed("_day", DAY)
    return shifted.join(panel.select(DAY, code), [DAY, code], "left_anti")


def backfill_rows(panel: DataFrame, code: str, min_rows: int = MIN_ROWS,
                  today: Column | None = None, mark: bool = False) -> DataFrame:
    added = stale_rows(panel, code, min_rows, today)
    if mark:
        return panel.withColumn("stale_from", F.lit(None).cast(dict(panel.dtypes)[DAY])).unionByName(added)
    return panel.unionByName(added.drop("stale_from"))


def backfill_audit(panel: DataFrame, code: str, min_rows: int = MIN_ROWS,
                   today: Column | None = None) -> DataFrame:
    """One row per repaired day: origin, rows added, rows after, still short or not."""
    added = stale_rows(panel, code, min_rows, today).groupBy(DAY, "stale_from").agg(F.count("*").alias("count"))
    counts = panel.groupBy(DAY).agg(F.count("*").alias("rows"))
    return added.join(counts, DAY).withColumn("rows_after", F.col("rows") + F.col("count")).withColumn(
        "still_short", F.col("rows_after") < min_rows
    ).drop("rows")


def _all_null(columns: list[str]) -> Column:
    return F.sum(F.when(values.any_of([F.col(c).isNotNull() for c in columns]), 1).otherwise(0)) == 0


def backfill_column_group(panel: DataFrame, code: str, stable: list[str], moving: list[str]) -> DataFrame:
    """Days whose stable columns are all null take the previous day's stored values.

    Consecutive empty days chain through the filled ones, so a stock keeps its
    value only while it is present on every day of the gap. Moving columns are
    never filled: a day where they are all null is flagged ``moving_missing``.
    """
    flags = panel.groupBy(DAY).agg(
        _all_null(stable).alias("stable_missing"), _all_null(moving).alias("moving_missing")
    )
    days = calendar(panel).select(DAY, "ordinal").join(flags, DAY)
    # One row per stock and day from here on: a window per stock is as long as
    # the history has days.
    by_day = W.partitionBy(code).orderBy("ordinal")
    run = F.col("ordinal") - F.row_number().over(by_day)
    rows = panel.join(one_per_day(days), DAY).withColumn("_run", run)
    in_run = W.partitionBy(code, "_run").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)
    stored = F.last(F.when(~F.col("stable_missing"), F.struct(*stable)), ignorenulls=True).over(in_run)
    filled = rows.withColumn("_stored", stored)
    return filled.select(*[
        F.when(F.col("stable_missing"), F.col(f"_stored.{c}")).otherwise(F.col(c)).alias(c) if c in stable
        else F.col(c) for c in panel.columns
    ], "stable_missing", "moving_missing")


def merge_current(history: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows replace history rows with the same keys."""
    both = history.withColumn("_source", F.lit(0)).unionByName(
        current.withColumn("_source", F.lit(1)), allowMissingColumns=True
    )
    return keep_first(both, keys, [F.desc("_source")]).drop("_source")


def panel_gate(panel: DataFrame, expected_columns: int, min_rows: int = MIN_ROWS) -> DataFrame:
    """Per day: row count, column count, and whether both pass."""
    return panel.groupBy(DAY).agg(F.count("*").alias("rows")).withColumns({
        "columns": F.lit(len(panel.columns)),
        "passed": (F.col("rows") >= min_rows) & F.lit(len(panel.columns) == expected_columns),
    })


def attach_new_columns(factors: DataFrame, panel: DataFrame, keys: list[str], suffix: str | None = None) -> DataFrame:
    """Left join bringing only columns the left side lacks, or all with a suffix on clashes."""
    have = set(factors.columns)
    take = []
    for c in panel.columns:
        if c in keys:
            take.append(F.col(c))
        elif c not in have:
            take.append(F.col(c))
        elif suffix:
            take.append(F.col(c).alias(f"{c}{suffix}"))
    return factors.join(panel.select(*take), keys, "left")


def universe_frame(codes_df: DataFrame, panel: DataFrame, columns: list[str]) -> DataFrame:
    """Codes with one panel row of attributes each."""
    attributes = panel.withColumn("id_qi", codes.pad6(F.col("id_qi"))).select("id_qi", *columns)
    first = keep_first(attributes, ["id_qi"], [F.col(c) for c in columns])
    return codes_df.select("code").withColumn("id_qi", codes.pad6(F.col("code"))).join(first, "id_qi", "left")


def select_stock(panel: DataFrame, wanted: DataFrame, key: str | None = None) -> DataFrame:
    """Panel rows of the wanted codes, whichever key column the panel carries."""
    names = ("id_qi", "code", "ticker_symbol", "ts_code", "symbol")
    key = key or next(n for n in names if n in panel.columns)
    asked = wanted.select(codes.pad6(F.col("code")).alias("_key")).distinct()
    return panel.withColumn("_key", codes.pad6(F.col(key))).join(asked, "_key", "left_semi").drop("_key")
