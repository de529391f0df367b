"""Bars from snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resample(tick: DataFrame, minutes: int, keys: list[str] = ["code"],
             volume_mode: str = "cumulative_last") -> DataFrame:
    """Left-closed, left-labelled, day-aligned bars; bins without rows do not appear.

    ``volume_mode``: ``cumulative_last`` keeps the last running total in the
    bin, ``delta`` the growth of the running total inside the bin.
    """
    last_volume = F.max_by("total_volume", "seq_num")
    volume = last_volume if volume_mode == "cumulative_last" else last_volume - F.min_by("total_volume", "seq_num")
    return (
        tick.groupBy(*keys, F.window("time", f"{minutes} minutes").alias("_bin"))
        .agg(
            F.min_by("current_price", "seq_num").alias("open"), F.max("current_price").alias("high"),
            F.min("current_price").alias("low"), F.max_by("current_price", "seq_num").alias("close"),
            volume.alias("volume"),
        )
        .select(*keys, F.col("_bin.start").alias("time"), "open", "high", "low", "close", "volume")
        .dropna(subset=["open", "high", "low", "close", "volume"])
    )
