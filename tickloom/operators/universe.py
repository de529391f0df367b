"""Tradable universe and session filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions import codes, times, values
from tickloom.operators.calendar import DAY, latest_snapshot

# Marks of special-treatment and delisting names.
_EXCLUDED_MARKS = ("ST", "退")


def cut_at(df: DataFrame, end_time: Column, time: str = "time") -> DataFrame:
    """Rows up to and including a slice end (``HHMMSS``)."""
    end = F.lpad(end_time.cast("string"), 6, "0")
    second = (F.substring(end, 1, 2).cast("int") * 3600 + F.substring(end, 3, 2).cast("int") * 60
              + F.substring(end, 5, 2).cast("int"))
    return df.where(times.micros_of_day(F.col(time)) <= second.cast("long") * 1_000_000)


def traded(panel: DataFrame, needs_depth: bool = True, volume: str = "volume") -> DataFrame:
    """Stocks with volume, when a factor needs order-level data."""
    if not needs_depth:
        return panel
    return panel.where(F.coalesce(values.number(F.col(volume)), F.lit(0.0)) > 0)


def _marked(name: str) -> Column:
    upper = F.upper(F.coalesce(F.col(name), F.lit("")))
    return values.any_of([upper.contains(m) for m in _EXCLUDED_MARKS])


def excluded_names(panel: DataFrame, name: str, code: str) -> DataFrame:
    """Codes whose name on the newest day carries an excluded mark."""
    return latest_snapshot(panel).where(_marked(name)).select(codes.pad6(F.col(code)).alias("code6")).distinct()


def trading_universe(panel: DataFrame, name: str = "sec_short_name", code: str = "id_qi",
                     blacklist: list[str] = ()) -> DataFrame:
    """Newest-day codes without marked names and without blacklisted codes, as symbols.

    One pass over the panel leaves each code's newest day and whether any name of that day is
    marked; the newest day of all is then a window over one row per listed code.
    """
    newest = panel.groupBy(codes.pad6(F.col(code)).alias("code6")).agg(
        F.max(F.struct(F.col(DAY).alias("day"), _marked(name).alias("marked"))).alias("last"))
    current = newest.withColumn("_newest", F.max("last.day").over(W.partitionBy()))
    kept = current.where((F.col("last.day") == F.col("_newest")) & ~F.col("last.marked"))
    if blacklist:
        kept = kept.where(~F.col("code6").isin(*[b.split(".")[0].zfill(6) for b in blacklist]))
    return kept.select("code6", codes.universe_symbol(F.col("code6")).alias("symbol"))


def restrict_to(df: DataFrame, universe: DataFrame, key: str = "code6") -> DataFrame:
    return df.join(universe.select(key), key, "left_semi")


def plausible_latency(df: DataFrame, latency_ms: str = "latency_ms", limit_ms: int = 600_000) -> DataFrame:
    return df.where(F.col(latency_ms).between(0, limit_ms))


def at_limit_up(price: Column, high_limit: Column, slack: float = 1e-6) -> Column:
    """Confirmed at the limit: both known and the price reaches it."""
    known = (F.coalesce(high_limit, F.lit(0.0)) > 0) & (F.coalesce(price, F.lit(0.0)) > 0)
    return known & (price >= high_limit - F.lit(slack))


def held_codes(positions: DataFrame, keys: list[str], volume: str = "current_volume") -> DataFrame:
    return positions.where(F.coalesce(F.col(volume), F.lit(0)) > 0).select(*keys).distinct()


def drop_limit_up_buys(orders: DataFrame, held: DataFrame, quotes: DataFrame, keys: list[str]) -> DataFrame:
    """Buys of unheld stocks confirmed at the limit leave; everything else stays.

    ``quotes`` has (code, price, high_limit); unknown limits never block.
    """
    marked = orders.join(held.select(*keys).distinct().withColumn("_held", F.lit(1)), keys, "left").join(
        quotes.select("code", F.col("price").alias("_price"), F.col("high_limit").alias("_limit")), "code", "left"
    )
    blocked = (F.col("side") == "buy") & F.col("_held").isNull() & at_limit_up(F.col("_price"), F.col("_limit"))
    return marked.where(~blocked).select(*orders.columns)


def drop_limit_up_candidates(candidates: DataFrame, held: DataFrame, quotes: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates minus unheld stocks confirmed at the limit, before a model runs."""
    confirmed = quotes.where(at_limit_up(F.col("price"), F.col("high_limit"))).select("code")
    blocked = candidates.join(confirmed, "code", "left_semi").join(held.select(*keys).distinct(), keys, "left_anti")
    return candidates.join(blocked.select(*keys).distinct(), keys, "left_anti")
