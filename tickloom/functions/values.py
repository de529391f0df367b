"""Numeric columns: fixed point, rounding, depth measures, coercion, turnover budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT32_MIN, INT32_MAX = -2_147_483_648, 2_147_483_647
INT64_MIN = -9_223_372_036_854_775_808


def fixed_point(raw: Column, decimals: int, sentinel: int = INT32_MIN) -> Column:
    """Scaled integer -> double; the empty marker becomes 0."""
    return F.when(raw == F.lit(sentinel), F.lit(0.0)).otherwise(raw.cast("double") / (10.0 ** decimals))


def to_cents(price: Column) -> Column:
    """Half-up integer cents, clipped at the 32-bit maximum."""
    return F.least(F.floor(price * 100 + 0.5), F.lit(INT32_MAX)).cast("int")


def half_up_cents(price: Column) -> Column:
    """Half-up rounding to cents for positive prices, others unchanged."""
    return F.when(price > 0, F.floor(price * 100 + 0.5) / F.lit(100.0)).otherwise(price)


def round_to(value: Column, digits: int) -> Column:
    """Half-up rounding that gives the same double in every engine."""
    scale = 10.0 ** digits
    return F.floor(value * scale + 0.5) / F.lit(scale)


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, null unless the denominator is positive."""
    return F.when(bottom > 0, top / bottom)


def spread(ask: Column, bid: Column) -> Column:
    return F.when((ask > 0) & (bid > 0), ask - bid)


def change_pct(price: Column, base: Column) -> Column:
    return F.when((base > 0) & (price > 0), (price - base) / base * 100)


def range_position(price: Column, high: Column, low: Column) -> Column:
    """Place of the price in the day range; the middle when the range is empty."""
    return F.when(high > low, (price - low) / (high - low)).otherwise(F.lit(0.5))


def buy_pressure(bid_volume: Column, ask_volume: Column) -> Column:
    total = bid_volume + ask_volume
    return F.when(total > 0, bid_volume / total).otherwise(F.lit(0.5))


def number(value: Column) -> Column:
    """Text or number -> double, null when it does not parse or is not a number."""
    v = value.try_cast("double")
    return F.when(~F.isnan(v), v)


def is_finite(value: Column) -> Column:
    v = value.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def compact_floats(df: DataFrame, digits: int = 6) -> DataFrame:
    """Output copy: floating columns rounded half-even and stored as 32-bit."""
    scale = 10.0 ** digits
    floating = (T.DoubleType, T.FloatType)
    return df.select(*[
        (F.rint(F.col(f.name) * scale) / scale).cast("float").alias(f.name)
        if isinstance(f.dataType, floating) else F.col(f.name)
        for f in df.schema.fields
    ])


def decimals_to_double(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
        for f in df.schema.fields
    ])


def parse_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: per text column the non-null count and how many of those are numbers."""
    aggs = []
    for c in columns:
        aggs += [F.count(c).alias(f"{c}__rows"), F.count(number(F.col(c))).alias(f"{c}__numbers")]
    return df.agg(*aggs)


def coerce_numeric_text(df: DataFrame, keep_text=(), share: float = 0.99) -> DataFrame:
    """Cast text columns to double when at least ``share`` of their values parse.

    The choice needs one aggregate row of counters per call, which is the only
    thing read by the driver: the output schema depends on it.
    """
    texts = [f.name for f in df.schema.fields
             if isinstance(f.dataType, T.StringType) and f.name not in keep_text]
    if not texts:
        return df
    stats = parse_shares(df, texts).first()
    numeric = {
        c for c in texts
        if stats[f"{c}__rows"] == 0 or stats[f"{c}__numbers"] / stats[f"{c}__rows"] >= share
    }
    return df.select(*[number(F.col(c)).alias(c) if c in numeric else F.col(c) for c in df.columns])


def turnover_budget(gross: Column, cash_flow: Column, total: Column,
                    base: Column, buffer: Column) -> Column:
    """Turnover cap that grows with today's inflow; the plain base when inputs are unusable."""
    floor_ = F.when(is_finite(base), F.least(F.greatest(base, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.35))
    extra = F.when(is_finite(buffer), F.greatest(buffer, F.lit(0.0))).otherwise(F.lit(0.02))
    usable = (
        is_finite(gross) & (gross >= 0) & is_finite(total) & (total > 0)
        & is_finite(cash_flow) & (cash_flow > 0)
    )
    required = (1.0 - F.least(gross, F.lit(1.0))) + extra
    cap = floor_ + F.least(cash_flow / total, F.lit(1.0))
    grown = F.least(F.lit(1.0), F.greatest(floor_, F.least(required, cap)))
    missing = gross.isNull() | cash_flow.isNull() | total.isNull() | base.isNull() | buffer.isNull()
    return F.when(missing, F.lit(0.35)).when(usable, grown).otherwise(floor_)
