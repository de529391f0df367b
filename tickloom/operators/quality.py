"""Row-level checks on feeds and archives, and field statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import times, values
from tickloom.operators.keyed import keep_first, previous_in_ranges


def duplicate_stats(df: DataFrame, keys: list[str], by: list[str] = ()) -> DataFrame:
    """Raw rows, distinct keys and surplus rows, optionally per ``by``."""
    counted = df.groupBy(*by, *[k for k in keys if k not in by]).agg(F.count("*").alias("n"))
    return counted.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("raw_rows"), F.count("*").alias("distinct_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def date_mismatches(df: DataFrame, by: list[str], day: str = "trade_date", time: str = "time") -> DataFrame:
    """Rows whose timestamp lies on another day than the partition says, or in 1970."""
    stamp = F.to_date(time)
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count_if(stamp != F.col(day)).alias("other_day"), F.count_if(F.year(stamp) == 1970).alias("epoch_day"))


def sequence_gaps(df: DataFrame, keys: list[str], seq: str = "seq_num", width: int = 1_000_000) -> DataFrame:
    """Per key: messages, missing sequence numbers, number and largest of the gaps.

    The stream of one key is cut into ranges of ``width`` numbers, so a busy
    channel is sorted by many tasks.
    """
    bucket = F.floor(F.col(seq) / F.lit(width))
    prev = previous_in_ranges(df.select(*keys, seq), keys, bucket, [F.col(seq)], seq, "_prev")
    gap = F.greatest(F.col(seq) - F.col("_prev") - 1, F.lit(0))
    return prev.withColumn("_gap", F.coalesce(gap, F.lit(0))).groupBy(*keys).agg(
        F.count("*").alias("messages"), F.sum("_gap").alias("missing"),
        F.count_if(F.col("_gap") > 0).alias("gaps"), F.max("_gap").alias("largest_gap"))


def sequence_stats(df: DataFrame, keys: list[str], order: list, bucket: Column, seq: str = "seq_num") -> DataFrame:
    """Per key: rows, distinct numbers, duplicates, range, and whether numbers ever fall in ``order``."""
    walked = previous_in_ranges(df, keys, bucket, order, seq, "_prev")
    falls = F.when(F.col(seq) < F.col("_prev"), 1).otherwise(0)
    # Counting per number first keeps the distinct count to plain hash aggregation.
    per_number = walked.groupBy(*keys, seq).agg(F.count("*").alias("_n"), F.sum(falls).alias("_falls"))
    return per_number.groupBy(*keys).agg(
        F.sum("_n").alias("rows"), F.count("*").alias("distinct_seq"),
        F.sum(F.col("_n") - 1).alias("duplicate_seq"), F.min(seq).alias("min_seq"), F.max(seq).alias("max_seq"),
        F.sum("_falls").alias("falls"),
    ).withColumn("monotonic", F.col("falls") == 0)


def archive_check(source: DataFrame, archive: DataFrame, keys: list[str] = ["code", "seq_num"]) -> DataFrame:
    """One row: source and archive row counts, matched rows, wrong times, verdict.

    The source is deduplicated the way the archive is. Both sides are stacked
    and grouped by key, so counts and comparison take one shuffle.
    """
    src = keep_first(source.select(*keys, "time", "update_time"), keys, [F.col("time"), F.col("update_time")])
    lay = lambda df, s: df.select(*keys, "time", "update_time", F.lit(s).alias("_s"))
    at = lambda s, c: F.max(F.when(F.col("_s") == s, F.col(c)))
    n = lambda s: F.count_if(F.col("_s") == s)
    per_key = lay(src, 0).unionByName(lay(archive, 1)).groupBy(*keys).agg(
        n(0).alias("_src"), n(1).alias("_dst"), at(0, "time").alias("_t0"), at(1, "time").alias("_t1"),
        at(0, "update_time").alias("_u0"), at(1, "update_time").alias("_u1"))
    total = lambda e: F.coalesce(F.sum(e), F.lit(0))
    both = (F.col("_src") > 0) & (F.col("_dst") > 0)
    out = per_key.agg(
        total("_src").alias("src_rows"), total("_dst").alias("dst_rows"),
        total(F.when(both, F.col("_dst")).otherwise(0)).alias("rows_checked"),
        total(F.when(both & (F.col("_t0") != F.col("_t1")), 1).otherwise(0)).alias("time_bad"),
        total(F.when(both & (F.col("_u0") != F.col("_u1")), 1).otherwise(0)).alias("update_bad"))
    c = F.col
    return out.withColumn(
        "valid", (c("rows_checked") > 0) & (c("rows_checked") == c("dst_rows")) & (c("rows_checked") == c("src_rows"))
        & (c("time_bad") == 0) & (c("update_bad") == 0))


def unit_sanity(tick: DataFrame, keys: list[str] = ["code"]) -> DataFrame:
    """Last snapshot per key and flags that betray a wrong unit."""
    c = F.col
    names = ["current_price", "pre_close_price", "ask_price1", "bid_price1", "ask_volume1", "bid_volume1",
             "total_volume", "total_money"]
    last = tick.groupBy(*keys).agg(*[F.max_by(n, "seq_num").alias(n) for n in names])
    ok = lambda n: F.coalesce(c(n), F.lit(0.0)) > 0
    implied = F.when(ok("current_price") & ok("total_volume") & ok("total_money"),
                     c("total_money") / c("total_volume") / c("current_price"))
    drift = F.when(ok("current_price") & ok("pre_close_price"), c("current_price") / c("pre_close_price") - 1)
    ask = F.when(ok("current_price") & ok("ask_price1"), c("ask_price1") / c("current_price"))
    bid = F.when(ok("current_price") & ok("bid_price1"), c("bid_price1") / c("current_price"))
    level = F.when(ok("ask_volume1") & ok("bid_volume1"), c("ask_volume1") / c("bid_volume1"))
    out = lambda r, low, high: F.coalesce((r < low) | (r > high), F.lit(False))
    return last.select(
        *keys, implied.alias("implied_ratio"), drift.alias("day_return"), ask.alias("ask_ratio"),
        bid.alias("bid_ratio"), level.alias("level_ratio"),
        out(implied, 0.95, 1.05).alias("amount_unit_bad"), F.coalesce(F.abs(drift) > 0.15, F.lit(False)).alias("price_drift"),
        (~(ok("current_price") & ok("pre_close_price"))).alias("pre_close_missing"),
        out(ask, 0.99, 1.10).alias("ask_bad"), out(bid, 0.90, 1.01).alias("bid_bad"),
        out(level, 0.001, 1000.0).alias("level_volume_bad"))


def push_latency(df: DataFrame, kind: str = "event_type", time: str = "time", latency: str = "latency_ms",
                 limit_ms: int = 600_000) -> DataFrame:
    """Per receive minute and kind: count, minimum, mean and maximum of plausible latencies."""
    minute = F.date_trunc("minute", F.col(time))
    return df.where(F.col(latency).between(0, limit_ms)).groupBy(minute.alias("minute"), F.col(kind).alias("kind")).agg(
        F.count("*").alias("n"), F.min(latency).alias("min_ms"), F.avg(latency).alias("avg_ms"),
        F.max(latency).alias("max_ms"))


def valid_rate(factors: DataFrame, rounds: list[str], prefix: str = "F_") -> DataFrame:
    """Share of usable factor cells per round, and the alert on a fall from above 0.8 to below 0.5."""
    from pyspark.sql import Window as W

    cols = [c for c in factors.columns if c.startswith(prefix)]
    usable = lambda c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 0).otherwise(1)
    good = sum((usable(c) for c in cols[1:]), usable(cols[0]))
    per = factors.groupBy(*rounds).agg((F.count("*") * len(cols)).alias("cells"), F.sum(good).alias("usable"))
    rate = per.withColumn("valid_rate", F.col("usable") / F.col("cells"))
    before = F.lag("valid_rate").over(W.orderBy(*rounds))  # one row per round
    return rate.withColumn("alert", F.coalesce((F.col("valid_rate") < 0.5) & (before > 0.8), F.lit(False)))


def field_diff(left: DataFrame, right: DataFrame, keys: list[str], prices: list[str], exact: list[str],
               tolerance: float = 1.0, right_scale: float = 1.0) -> DataFrame:
    """Per field over common keys: compared, matching, mismatching cells, largest difference, usual ratio.

    Prices match within ``tolerance`` cents, other fields exactly. ``right``
    prices are multiplied by ``right_scale`` to reach the left unit. The usual
    ratio is the most frequent left/right quotient (one decimal) of mismatches.
    """
    fields = [*prices, *exact]
    l = left.select(*keys, *[F.col(f).cast("double").alias(f"l_{f}") for f in fields])
    r = right.select(*keys, *[F.col(f).cast("double").alias(f"r_{f}") for f in fields])
    cells = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"l_{f}").alias("lv"),
                 (F.col(f"r_{f}") * (right_scale if f in prices else 1.0)).alias("rv"),
                 F.lit(f in prices).alias("is_price")) for f in fields])
    long = l.join(r, keys).select(F.inline(cells)).where("lv IS NOT NULL AND rv IS NOT NULL")
    gap = F.when(F.col("is_price"), F.abs(F.rint((F.col("lv") - F.col("rv")) * 1e8) / 1e8) * 100).otherwise(
        F.abs(F.col("lv") - F.col("rv")))
    judged = long.withColumn("_gap", gap).withColumn(
        "_ok", F.when(F.col("is_price"), F.col("_gap") <= tolerance).otherwise(F.col("_gap") == 0))
    ratio = F.when(~F.col("_ok") & (F.col("rv") != 0), values.round_to(F.col("lv") / F.col("rv"), 1))
    # Counting per ratio first keeps the mode a hash aggregation.
    per_ratio = judged.groupBy("field", ratio.alias("_ratio")).agg(
        F.count("*").alias("n"), F.count_if("_ok").alias("ok"), F.max("_gap").alias("gap"))
    votes = F.when(F.col("_ratio").isNotNull(), F.struct(F.col("n"), (-F.col("_ratio")).alias("tie")))
    return per_ratio.groupBy("field").agg(
        F.sum("n").alias("total"), F.sum("ok").alias("matched"), F.max("gap").alias("max_diff"),
        F.max_by("_ratio", votes).alias("usual_ratio"),
    ).withColumn("mismatched", F.col("total") - F.col("matched"))
