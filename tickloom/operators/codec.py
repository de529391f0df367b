"""Archive encoding of feed rows (integer cents, epoch microseconds) and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import schemas as S
from tickloom.functions import times, values
from tickloom.operators.keyed import salted_join

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _is_price(name: str) -> bool:
    return "price" in name.lower() or "iopv" in name.lower()


def _is_volume(name: str) -> bool:
    return "volume" in name.lower()


def _stored(name: str, fill_levels: bool) -> Column:
    """Archived form of one feed column."""
    c = F.col(name)
    if name == "time":
        out = times.epoch_micros(c) - F.lit(times.ARCHIVE_SHIFT_US)
    elif name == "update_time":
        out = times.epoch_micros(c)
    elif _is_price(name):
        out = values.to_cents(c)
    elif _is_volume(name):
        out = F.floor(F.coalesce(c, F.lit(0)) if fill_levels and name[-1].isdigit() else c).cast("long")
    elif name in ("side", "order_type"):
        out = c.cast("byte")
    elif "_num" in name and name != "seq_num":
        out = F.coalesce(c, F.lit(0)).cast("int")
    elif name in ("sale_order_id", "buy_order_id"):
        out = c.cast("long")
    elif name in ("order_id", "seq_num"):
        out = c.cast("int")
    else:
        out = c
    return out.alias(name)


# Columns an archive keeps, per feed, in file order.
ARCHIVED = {
    "order": ["time", "update_time", "order_id", "side", "price", "volume", "order_type", "seq_num"],
    "deal": ["time", "update_time", "sale_order_id", "buy_order_id", "side", "price", "volume", "seq_num"],
    "tick": (["time", "update_time", "current_price", "total_volume", "pre_close_price", "open_price",
              "highest_price", "lowest_price", "high_limit_price", "low_limit_price", "iopv", "trade_num",
              "total_bid_volume", "total_ask_volume", "avg_bid_price", "avg_ask_price"]
             + S.level_columns() + ["seq_num"]),
}


def encode(df: DataFrame, kind: str, code: str = "security_id", keep: tuple = ()) -> DataFrame:
    """Feed rows carrying a security number -> archive columns that are present."""
    have = set(df.columns)
    return df.select(
        *keep, F.col(code).cast("int").alias("code"),
        *[_stored(n, kind == "tick") for n in ARCHIVED[kind] if n in have],
    )


def decode(df: DataFrame, volume_scale: float = 1.0, update_time_mode: str = "absolute",
           keep: tuple = ("code",)) -> DataFrame:
    """Archive columns -> feed types, decided from the schema alone.

    Only integer columns are rescaled, so rows that were never encoded pass
    through. ``volume_scale=100`` and ``update_time_mode='offset'`` read the
    older writer's files. An empty input yields the same types.
    """
    out = []
    for f in df.schema.fields:
        c, whole = F.col(f.name), isinstance(f.dataType, _INTEGRAL)
        if f.name == "code":
            c = c.cast("string")
        elif f.name == "time" and whole:
            c = times.from_epoch_micros(c + F.lit(times.ARCHIVE_SHIFT_US))
        elif f.name == "update_time" and whole:
            if update_time_mode == "offset":
                base = F.col("time") + F.lit(times.ARCHIVE_SHIFT_US)
                c = times.from_epoch_micros(base + c)
            else:
                c = times.from_epoch_micros(c)
        elif whole and _is_price(f.name):
            c = c / F.lit(100.0)
        elif whole and _is_volume(f.name):
            c = c * F.lit(float(volume_scale))
        out.append(c.alias(f.name))
    return df.select(*out)


def resolve_clock(df: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """Epoch microseconds -> wall clock when writers disagreed about the zone.

    Per key the reading that lands more rows in 08:30-15:30 wins, the shifted
    one on a tie. Counting is a partial aggregation; the verdict returns to the
    rows through a salted join.
    """
    start, end = 8 * 60 + 30, 15 * 60 + 30
    minute = F.floor(F.pmod(F.col(time), F.lit(times.DAY_SECONDS * 1_000_000)) / F.lit(60_000_000))
    shifted = F.pmod(minute + 480, F.lit(1440))
    hits = lambda m: F.sum(F.when(m.between(start, end), 1).otherwise(0))
    verdict = df.groupBy(*keys).agg(hits(shifted).alias("_via"), hits(minute).alias("_as_is")).select(
        *keys, (F.col("_as_is") > F.col("_via")).alias("clock_as_is")
    )
    joined = salted_join(df, verdict, keys, "left", [time])
    micros = F.col(time) + F.when(F.col("clock_as_is"), F.lit(0)).otherwise(F.lit(times.ARCHIVE_SHIFT_US))
    return joined.withColumn(time, times.from_epoch_micros(micros))


def repair_legacy_tick(df: DataFrame) -> DataFrame:
    """Archives whose snapshot columns are named by expression text get their names back."""
    names = ["code", *ARCHIVED["tick"]]
    broken = [c for c in df.columns if "CurrentPrice" in c and c != "CurrentPrice"]
    if "CurrentPrice" in df.columns or len(df.columns) != len(names) or not broken:
        return df
    if not {"Code", "Time", "UpdateTime", "TotalVolume", "TradeNum", "SeqNum"} <= set(df.columns):
        return df
    return df.toDF(*[S.header_name(n) for n in names])
