"""Feature matrix, model scores, tail weights and model orders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import codes, values
from tickloom.operators.keyed import ordered_position, top_n
from tickloom.session import ship_package


def feature_matrix(df: DataFrame, features: list[str], medians: dict[str, float] | None = None,
                   keep: list[str] = ()) -> DataFrame:
    """Numeric features; gaps take the given median, then zero; absent columns too."""
    have, medians = set(df.columns), medians or {}

    def column(name: str) -> Column:
        value = values.number(F.col(name)) if name in have else F.lit(None).cast("double")
        fallback = [F.lit(float(medians[name]))] if medians.get(name) is not None else []
        return F.coalesce(value, *fallback, F.lit(0.0)).alias(name)

    return df.select(*keep, *[column(f) for f in features])


def linear_score(df: DataFrame, weights: dict[str, float], intercept: float = 0.0, into: str = "pred") -> DataFrame:
    """Linear model as one column expression."""
    total = F.lit(float(intercept))
    for name, weight in weights.items():
        total = total + F.col(name) * F.lit(float(weight))
    return df.withColumn(into, total)


def model_score(df: DataFrame, features: list[str], predict: Callable[[pd.DataFrame], object],
                keep: list[str], into: str = "pred") -> DataFrame:
    """Any model: ``predict`` gets Arrow batches of the feature columns.

    The model travels with the function; rows are scored where they lie.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[list(keep)].copy()
            out[into] = predict(batch[list(features)])
            yield out

    ship_package(df.sparkSession)
    return df.select(*keep, *features).mapInPandas(run, f"{schema}, `{into}` double")


def tail_weights(df: DataFrame, keys: list[str], tail: float, tie: str = "code",
                 pred: str = "pred", short: bool = True) -> DataFrame:
    """+1/k for the k best and -1/k for the k worst of each group, zero between.

    k = ceil(n * tail), at least one and at most half the group; groups of one
    get zero. Positions are exact for groups of any size.
    """
    if not 0 < tail <= 0.5:
        raise ValueError("tail must be in (0, 0.5]")
    scored = df.withColumn(pred, values.number(F.col(pred)))
    empty = scored.where(F.col(pred).isNull()).withColumn("position", F.lit(0.0))
    placed = ordered_position(scored.where(F.col(pred).isNotNull()), keys, [F.col(pred), F.col(tie)])
    n, at = F.col("group_rows"), F.col("position")
    k = F.least(F.greatest(F.lit(1), F.ceil(n * tail)), F.floor(n / 2))
    low = -1.0 / k if short else F.lit(0.0)
    weight = F.when(n < 2, 0.0).when(at > n - k, 1.0 / k).when(at <= k, low).otherwise(0.0)
    return placed.withColumn("position", weight).drop("group_rows").unionByName(empty)


def order_price(realtime: Column, *fallbacks: Column, default: float = 10.0) -> Column:
    usable = lambda c: F.when(values.is_finite(c) & (c > 0), c)
    return F.coalesce(*[usable(c) for c in (realtime, *fallbacks)], F.lit(float(default)))


def lot_floor(volume: Column, lot: int = 100) -> Column:
    """Whole lots at or below a non-negative volume."""
    return F.greatest(F.floor(volume / lot) * lot, F.lit(0)).cast("long")


def model_orders(scored: DataFrame, positions: DataFrame, account: DataFrame, quotes: DataFrame,
                 keys: list[str], max_orders: int = 10, default_price: float = 10.0,
                 lot: int = 100, strategy: str = "model") -> DataFrame:
    """Orders towards model weights for every (``keys``) book at once.

    The strongest ``max_orders`` non-zero weights per book are traded; shorts
    only reduce holdings to zero. ``quotes`` has (code6, last_price[, close]).
    """
    active = top_n(
        scored.where(F.col("position") != 0), keys,
        [F.desc(F.abs("position")), F.desc("pred"), F.col("code6")], max_orders,
    ).drop("_rank")
    held = positions.where(F.col("current_volume") > 0).groupBy(*keys, "code6").agg(
        F.sum("current_volume").alias("current_volume"))
    closes = F.col("close") if "close" in quotes.columns else F.lit(None).cast("double")
    priced = quotes.select("code6", order_price(F.col("last_price"), closes, default=default_price).alias("price"))
    sized = (
        active.join(account.select(*keys, F.col("total_asset").alias("_capital")), keys)
        .join(priced, "code6", "left").join(held, [*keys, "code6"], "left")
        .withColumn("price", F.coalesce("price", F.lit(default_price)))
        .withColumn("current_volume", F.coalesce("current_volume", F.lit(0)).cast("long"))
        .withColumn("target_volume", lot_floor(
            F.greatest("position", F.lit(0.0)) * F.col("_capital") / F.col("price"), lot))
        .withColumn("_delta", F.col("target_volume") - F.col("current_volume"))
        .where(F.col("_delta") != 0)
        .withColumn("side", F.when(F.col("_delta") > 0, "buy").otherwise("sell"))
    )
    volume = lot_floor(F.abs("_delta"), lot)
    capped = F.when(F.col("side") == "sell", F.least(volume, lot_floor(F.col("current_volume"), lot))).otherwise(volume)
    return sized.withColumn("volume", capped).where(F.col("volume") > 0).select(
        *keys, codes.prefixed_symbol(F.col("code6")).alias("code"), "side", "volume",
        F.lit("latest").alias("price_type"), F.lit(strategy).alias("strategy"),
        "pred", "position", "target_volume", "current_volume",
    )
