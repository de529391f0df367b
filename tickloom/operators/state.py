"""Per-stock state from ticks, deals and orders: whole day, or as of every slice.

All aggregates are order-insensitive (``min_by`` / ``max_by`` on the sequence
number), so replays, file order and micro-batch cuts cannot change a result,
and everything combines before the shuffle: a stock with a million rows ships
one partial row per task and feed.

``seq_num`` must be unique per stock, day and feed; run ``keep_first`` before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom import schemas as S
from tickloom.functions import times, values

KEYS = ["trade_date", "code"]


def _positive_at(value: str) -> Column:
    """Sequence number where ``value`` is positive, else null (ignored by min_by / max_by)."""
    return F.when(F.col(value) > 0, F.col("seq_num"))


def tick_aggregates() -> list[Column]:
    price = F.when(F.col("current_price") > 0, F.col("current_price"))
    return [
        F.min_by("current_price", _positive_at("current_price")).alias("open"),
        F.max_by("current_price", _positive_at("current_price")).alias("latest_price"),
        F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by("pre_close_price", _positive_at("pre_close_price")).alias("pre_close"),
        F.max_by("ask_price1", _positive_at("ask_price1")).alias("ask1"),
        F.max_by("bid_price1", _positive_at("bid_price1")).alias("bid1"),
        F.max_by("ask_volume1", F.when(F.col("ask_volume1").isNotNull(), F.col("seq_num"))).alias("ask_volume1"),
        F.max_by("bid_volume1", F.when(F.col("bid_volume1").isNotNull(), F.col("seq_num"))).alias("bid_volume1"),
        F.count("*").alias("tick_count"),
        F.max_by("time", "seq_num").alias("last_tick_time"),
    ]


def tick_state(tick: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return tick.groupBy(*keys).agg(*tick_aggregates())


def deal_state(deal: DataFrame, keys: list[str] = KEYS, amount: Column | None = None) -> DataFrame:
    """Turnover, volume, count and volume-weighted price.

    ``amount`` may name an exact amount column; price times volume otherwise.
    """
    amount = F.col("price") * F.col("volume") if amount is None else amount
    return deal.groupBy(*keys).agg(
        F.sum(amount).alias("cum_amount"), F.sum("volume").alias("cum_volume"),
        F.count("*").alias("deal_count"), F.max_by("time", "seq_num").alias("last_deal_time"),
    ).withColumn("vwap", values.ratio(F.col("cum_amount"), F.col("cum_volume")))


def order_state(order: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Order counts and volumes by side, cancels, and the ratios built on them."""
    buy, sell = F.col("side") == S.SIDE_BUY, F.col("side") == S.SIDE_SELL
    volume = lambda side: F.coalesce(F.sum(F.when(side, F.col("volume"))), F.lit(0))
    out = order.groupBy(*keys).agg(
        F.count("*").alias("order_count"),
        F.count_if(buy).alias("buy_order_count"), F.count_if(sell).alias("sell_order_count"),
        volume(buy).alias("buy_order_volume"), volume(sell).alias("sell_order_volume"),
        F.count_if(F.col("order_type") == S.ORDER_CANCEL).alias("cancel_count"),
        F.max_by("time", "seq_num").alias("last_order_time"),
    )
    return with_order_ratios(out)


def with_order_ratios(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns({
        "order_imbalance": values.ratio(c("buy_order_count"), c("buy_order_count") + c("sell_order_count")),
        "order_buy_vol_ratio": values.ratio(c("buy_order_volume"), c("buy_order_volume") + c("sell_order_volume")),
        "cancel_ratio": values.ratio(c("cancel_count"), c("order_count")),
    })


# Columns of the three feeds that the state reads, with one tag per feed.
_FIELDS = {
    "current_price": "double", "pre_close_price": "double", "ask_price1": "double",
    "bid_price1": "double", "ask_volume1": "double", "bid_volume1": "double",
    "price": "double", "volume": "double", "amount": "double", "side": "int", "order_type": "int",
}


def tag_feeds(tick: DataFrame, deal: DataFrame, order: DataFrame, keys: list[str] = KEYS,
              extra: tuple = ()) -> DataFrame:
    """The three feeds under each other with a ``kind`` column; absent fields are null."""
    def lay(df: DataFrame, kind: str) -> DataFrame:
        have = set(df.columns)
        amount = (F.col("amount") if "amount" in have else F.col("price") * F.col("volume")) \
            if kind == "deal" else F.lit(None)
        fields = [
            (amount if n == "amount" else F.col(n) if n in have else F.lit(None)).cast(t).alias(n)
            for n, t in _FIELDS.items()
        ]
        return df.select(*keys, *extra, "time", "seq_num", F.lit(kind).alias("kind"), *fields)

    return lay(tick, "tick").unionByName(lay(deal, "deal")).unionByName(lay(order, "order"))


# Fields each feed contributes, and what they are reduced to.
_FEED_FIELDS = {
    "tick": ("current_price", "pre_close_price", "ask_price1", "bid_price1", "ask_volume1", "bid_volume1"),
    "deal": ("amount", "volume"),
    "order": ("side", "order_type", "volume"),
}
SEQUENCED = ("latest_price", "pre_close", "ask1", "bid1", "ask_volume1", "bid_volume1")
COUNTERS = (
    "tick_count", "deal_count", "order_count", "cum_amount", "cum_volume", "buy_order_count",
    "sell_order_count", "buy_order_volume", "sell_order_volume", "cancel_count",
)
_LAST = ("last_tick_time", "last_deal_time", "last_order_time", "last_market_time")


def _sequence_of(name: str) -> str:
    return f"{name}_seq"


def _feed_aggregates(kind: str) -> list[Column]:
    """Aggregates of one feed. All buffers are plain numbers, so they stay in hash aggregation."""
    c, last = F.col, F.max_by("time", "seq_num").alias(f"last_{kind}_time")
    common = [F.count("*").alias(f"{kind}_count"), last, F.max("time").alias("last_market_time")]
    if kind == "tick":
        seen = {n: F.when(c(n).isNotNull(), c("seq_num")) for n in ("ask_volume1", "bid_volume1")}
        sources = {"latest_price": "current_price", "pre_close": "pre_close_price", "ask1": "ask_price1", "bid1": "bid_price1"}
        return [
            F.min_by("current_price", _positive_at("current_price")).alias("open"),
            F.min(_positive_at("current_price")).alias("open_seq"),
            *[F.max_by(src, _positive_at(src)).alias(n) for n, src in sources.items()],
            *[F.max(_positive_at(src)).alias(_sequence_of(n)) for n, src in sources.items()],
            *[F.max_by(n, at).alias(n) for n, at in seen.items()],
            *[F.max(at).alias(_sequence_of(n)) for n, at in seen.items()],
            F.max(F.when(c("current_price") > 0, c("current_price"))).alias("high"),
            F.min(F.when(c("current_price") > 0, c("current_price"))).alias("low"), *common,
        ]
    if kind == "deal":
        return [F.sum("amount").alias("cum_amount"), F.sum("volume").alias("cum_volume"), *common]
    buy, sell = c("side") == S.SIDE_BUY, c("side") == S.SIDE_SELL
    total = lambda rule: F.sum(F.when(rule, c("volume")).otherwise(F.lit(0.0)))
    return [
        F.count_if(buy).alias("buy_order_count"), F.count_if(sell).alias("sell_order_count"),
        total(buy).alias("buy_order_volume"), total(sell).alias("sell_order_volume"),
        F.count_if(c("order_type") == S.ORDER_CANCEL).alias("cancel_count"), *common,
    ]


def tagged_aggregates() -> list[Column]:
    """The whole state in one aggregation over tagged rows (``tag_feeds``), for one keyed state over all
    three feeds. Each value reads the rows of its own feed; same values as ``full_state``."""
    c, is_kind = F.col, {k: F.col("kind") == k for k in _FEED_FIELDS}
    sources = {"latest_price": "current_price", "pre_close": "pre_close_price", "ask1": "ask_price1", "bid1": "bid_price1",
               "ask_volume1": "ask_volume1", "bid_volume1": "bid_volume1"}
    seen = lambda name: F.when(is_kind["tick"] & (c(name).isNotNull() if "volume" in name else c(name) > 0), c("seq_num"))
    price = F.when(is_kind["tick"] & (c("current_price") > 0), c("current_price"))
    total = lambda rule, name: F.sum(F.when(rule, c(name)).otherwise(F.lit(0.0)))
    buy, sell = (is_kind["order"] & (c("side") == side) for side in (S.SIDE_BUY, S.SIDE_SELL))
    return [
        F.min_by("current_price", seen("current_price")).alias("open"),
        *[F.max_by(src, seen(src)).alias(n) for n, src in sources.items()],
        F.max(price).alias("high"), F.min(price).alias("low"),
        *[F.count_if(rule).alias(f"{k}_count") for k, rule in is_kind.items()],
        total(is_kind["deal"], "amount").alias("cum_amount"), total(is_kind["deal"], "volume").alias("cum_volume"),
        F.count_if(buy).alias("buy_order_count"), F.count_if(sell).alias("sell_order_count"),
        total(buy, "volume").alias("buy_order_volume"), total(sell, "volume").alias("sell_order_volume"),
        F.count_if(is_kind["order"] & (c("order_type") == S.ORDER_CANCEL)).alias("cancel_count"),
        *[F.max_by("time", F.when(rule, c("seq_num"))).alias(f"last_{k}_time") for k, rule in is_kind.items()],
        F.max("time").alias("last_market_time"),
    ]


def _merged_state(feeds: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """State per key out of feeds that are each reduced on their own.

    A feed's rows carry only that feed's columns into its shuffle. After that a
    key has one row per feed and every value comes from one of them, so the
    last step only lines three small rows up; no join, no pairing.
    """
    parts = [df.groupBy(*keys).agg(*_feed_aggregates(kind)) for kind, df in feeds.items()]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    merged = stacked.groupBy(*keys).agg(*[F.max(n).alias(n) for n in stacked.columns if n not in keys])
    zero = lambda n: F.coalesce(F.col(n), F.lit(0.0 if n.startswith("cum") or n.endswith("volume") else 0)).alias(n)
    return merged.select(*[zero(n) if n in COUNTERS else F.col(n) for n in merged.columns])


def _narrow(tick: DataFrame, deal: DataFrame, order: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Only the columns the state reads, at the types it keeps."""
    if "amount" not in deal.columns:
        deal = deal.withColumn("amount", F.col("price") * F.col("volume"))
    return {
        kind: df.select(*keys, "time", "seq_num", *[F.col(n).cast(_FIELDS[n]).alias(n) for n in _FEED_FIELDS[kind]])
        for kind, df in (("tick", tick), ("deal", deal), ("order", order))
    }


def full_state(tick: DataFrame, deal: DataFrame, order: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """State over all three feeds."""
    out = _merged_state(_narrow(tick, deal, order, keys), keys)
    return out.drop("open_seq", *[_sequence_of(n) for n in SEQUENCED])


def sliced_state(tick: DataFrame, deal: DataFrame, order: DataFrame, slices: DataFrame,
                 keys: list[str] = KEYS) -> DataFrame:
    """State as of every slice end (rows with time <= end), for all slices at once.

    ``slices`` has (slice, end_second). Rows are reduced to one partial state
    per (key, slice) first; a running window then walks at most one row per
    slice, and each state is copied to the empty slices up to the next one. No
    row is ever paired with more than one slice. Slices before a key's first
    row are absent.
    """
    first = F.coalesce(F.lag("end_second").over(W.orderBy("end_second")) + 1, F.lit(0))
    # At most 86,401 rows: one per second of a day, so a broadcast is bounded.
    seconds = slices.withColumn("_from", first).select(
        "slice", F.explode(F.sequence("_from", "end_second")).alias("_second"))
    last = slices.agg(F.max("slice")).scalar()
    second = F.ceil(times.micros_of_day(F.col("time")) / F.lit(1_000_000.0)).cast("int")
    placed = {
        kind: df.withColumn("_second", second).join(F.broadcast(seconds), "_second").drop("_second")
        for kind, df in _narrow(tick, deal, order, keys).items()
    }
    partial = _merged_state(placed, [*keys, "slice"])

    order_ = W.partitionBy(*keys).orderBy("slice")
    so_far = order_.rowsBetween(W.unboundedPreceding, 0)
    seen = lambda name: F.when(F.col(_sequence_of(name)).isNotNull(),
                               F.struct(F.col(_sequence_of(name)), F.col(name)))
    first_open = F.min(F.when(F.col("open_seq").isNotNull(), F.struct("open_seq", "open"))).over(so_far)
    running = {
        "open": first_open["open"],
        "high": F.max("high").over(so_far), "low": F.min("low").over(so_far),
        **{n: F.max(seen(n)).over(so_far)[n] for n in SEQUENCED},
        **{n: F.sum(n).over(so_far) for n in COUNTERS},
        **{n: F.max(n).over(so_far) for n in _LAST},
    }
    walked = partial.select(*keys, "slice", F.lead("slice").over(order_).alias("_next"),
                            *[e.alias(n) for n, e in running.items()])
    stops = walked.withColumn("_stop", F.coalesce(F.col("_next") - 1, last))
    spread = stops.withColumn("slice", F.explode(F.sequence(F.col("slice"), F.col("_stop")))).drop("_next", "_stop")
    return spread.join(F.broadcast(slices), "slice")


def factor_pack(state: DataFrame, digits: int | None = 4, ids: tuple = ()) -> DataFrame:
    """The built-in intraday factors of a full state, one row per state row."""
    c = F.col
    r = (lambda e, d=digits: values.round_to(e, d)) if digits is not None else (lambda e, d=None: e)
    zero = lambda n: F.coalesce(c(n), F.lit(0.0))
    known = c("high").isNotNull()
    return state.select(
        *KEYS, *ids,
        zero("latest_price").alias("latest_price"), zero("high").alias("high"), zero("low").alias("low"),
        r(values.change_pct(c("latest_price"), c("pre_close"))).alias("change_pct"),
        r(values.spread(c("ask1"), c("bid1"))).alias("spread"),
        F.when(known, r(values.range_position(c("latest_price"), c("high"), c("low"))))
        .otherwise(F.lit(0.5)).alias("price_pos"),
        r(values.buy_pressure(zero("bid_volume1"), zero("ask_volume1"))).alias("buy_pressure"),
        r(values.ratio(c("cum_amount"), c("cum_volume"))).alias("vwap"),
        c("cum_volume").alias("total_vol"), c("deal_count"),
        F.when(c("deal_count") > 0, r(c("cum_volume") / c("deal_count"), None if digits is None else 2))
        .otherwise(F.lit(0.0)).alias("vol_ratio"),
        r(values.ratio(c("buy_order_count"), c("buy_order_count") + c("sell_order_count"))).alias("order_imbalance"),
        r(values.ratio(c("buy_order_volume"), c("buy_order_volume") + c("sell_order_volume")))
        .alias("order_buy_vol_ratio"),
        r(values.ratio(c("cancel_count"), c("order_count"))).alias("cancel_ratio"),
        c("order_count"),
    )
