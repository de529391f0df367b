"""Raw exchange messages -> canonical order, deal and tick rows.

Inputs carry the vendor's column names; every rule is a column expression, so
a whole feed is one scan and one projection. The market is decided per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom import schemas as S
from tickloom.functions import codes, times, values

SH, SZ = codes.SH, codes.SZ


def is_status_row(flag: Column) -> Column:
    """Closing status rows of suspended names, not trades."""
    return F.trim(flag).isin("CLOSE", "ENDTR")


def letter_side(flag: Column) -> Column:
    """B / S letter -> side code; anything else is unknown."""
    letter = F.substring(F.upper(F.trim(flag)), 1, 1)
    return F.when(letter == "B", S.SIDE_BUY).when(letter == "S", S.SIDE_SELL).otherwise(S.SIDE_UNKNOWN)


def ascii_side(code: Column) -> Column:
    return F.when(code == 49, S.SIDE_BUY).when(code == 50, S.SIDE_SELL).otherwise(S.SIDE_UNKNOWN)


def ascii_order_type(code: Column) -> Column:
    return F.when(code == 49, 1).when(code == 50, 2).when(code == 85, 3).otherwise(0)


def _or_zero(name: str, kind: str = "double") -> Column:
    return F.coalesce(F.col(name).try_cast(kind), F.lit(0).cast(kind))


def _when_clock(df: DataFrame, name: str, day: Column) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("timestamp_ntz")
    if dict(df.dtypes)[name] == "string":
        return times.parse_clock_text(F.col(name), day)
    return times.parse_clock_number(F.col(name), day)


def _equities(df: DataFrame, market: str) -> DataFrame:
    raw = codes.zfill(F.col("SecurityID"))
    return df.where(codes.is_equity_feed_code(raw, F.lit(market))).withColumn(
        "code", F.concat(raw, F.lit("." + market))
    )


def merged_sh(df: DataFrame, trade_date: Column) -> DataFrame:
    """Merged Shanghai stream in one projection: ``kind`` is order (types A, D) or deal (T).

    Both kinds come from one scan; a writer partitioned by ``kind`` separates them.
    """
    base = _equities(df, SH).where(~is_status_row(F.coalesce("TickBSFlag", F.lit("")))).select(
        trade_date.alias("trade_date"), "code",
        _when_clock(df, "TickTime", trade_date).alias("time"),
        _when_clock(df, "LocalTime", trade_date).alias("update_time"),
        letter_side(F.coalesce("TickBSFlag", F.lit("N"))).alias("side"),
        _or_zero("Price").alias("price"), _or_zero("Qty").alias("volume"),
        _or_zero("Channel", "long").alias("channel"), _or_zero("BizIndex", "long").alias("seq_num"),
        _or_zero("BuyOrderNO", "long").alias("buy_order_id"),
        _or_zero("SellOrderNO", "long").alias("sale_order_id"),
        F.trim("Type").alias("_type"),
        (_or_zero("TradeMoney") if "TradeMoney" in df.columns else F.lit(0.0)).alias("_money"),
    )
    deal = F.col("_type") == "T"
    # A stated amount wins; otherwise the amount is price times volume.
    money = F.when(F.col("_money") != 0, F.col("_money")).otherwise(F.col("price") * F.col("volume"))
    return base.where(F.col("_type").isin("A", "D", "T")).withColumns({
        "kind": F.when(deal, "deal").otherwise("order"),
        "order_id": F.when(~deal, F.col("buy_order_id") + F.col("sale_order_id")),
        "order_type": F.when(F.col("_type") == "A", S.ORDER_ADD).when(F.col("_type") == "D", S.ORDER_CANCEL),
        "money": F.when(deal, money),
    }).drop("_type", "_money")


def split_merged_sh(df: DataFrame, trade_date: Column) -> tuple[DataFrame, DataFrame]:
    """Merged Shanghai stream -> (orders, deals) as two frames, each with its own scan."""
    both = merged_sh(df, trade_date)
    return S.conform(both.where("kind = 'order'"), "order"), S.conform(both.where("kind = 'deal'"), "deal")


def _normalised(df: DataFrame, kind: str, market: str, columns: dict[str, Column]) -> DataFrame:
    return S.conform(_equities(df, market).select("code", *[c.alias(n) for n, c in columns.items()]), kind)


def _orders_sh(df: DataFrame, trade_date: Column) -> dict[str, Column]:
    return {
        "trade_date": trade_date, "time": _when_clock(df, "OrderTime", trade_date),
        "update_time": _when_clock(df, "LocalTime", trade_date), "order_id": F.col("OrderNO"),
        "side": F.when(F.col("OrderBSFlag") == "B", S.SIDE_BUY).when(F.col("OrderBSFlag") == "S", S.SIDE_SELL),
        "price": F.col("OrderPrice"), "volume": F.col("Balance"),
        "order_type": F.when(F.col("OrderType") == "A", S.ORDER_ADD).when(F.col("OrderType") == "D", S.ORDER_CANCEL),
        "channel": F.col("OrderChannel"), "seq_num": F.col("BizIndex"),
    }


def _orders_sz(df: DataFrame, trade_date: Column) -> dict[str, Column]:
    return {
        "trade_date": trade_date, "time": _when_clock(df, "TransactTime", trade_date),
        "update_time": _when_clock(df, "LocalTime", trade_date), "order_id": _or_zero("ApplSeqNum", "long"),
        "side": ascii_side(F.col("Side")), "price": _or_zero("Price"), "volume": _or_zero("OrderQty"),
        "order_type": ascii_order_type(F.col("OrdType")), "channel": _or_zero("ChannelNo", "long"),
        "seq_num": _or_zero("ApplSeqNum", "long"),
    }


def _deals_sh(df: DataFrame, trade_date: Column) -> dict[str, Column]:
    return {
        "trade_date": trade_date, "time": _when_clock(df, "TradTime", trade_date),
        "update_time": _when_clock(df, "LocalTime", trade_date), "sale_order_id": F.col("TradeSellNo"),
        "buy_order_id": F.col("TradeBuyNo"), "side": letter_side(F.col("TradeBSFlag")), "price": F.col("TradPrice"),
        "volume": F.col("TradVolume"), "money": F.col("TradeMoney"), "channel": F.col("TradeChan"),
        "seq_num": F.col("BizIndex"),
    }


def _deals_sz(df: DataFrame, trade_date: Column) -> dict[str, Column]:
    inferred = (
        F.when(F.col("ExecType") == 52, S.SIDE_SPECIAL)
        .when(F.col("BidApplSeqNum") > F.col("OfferApplSeqNum"), S.SIDE_BUY)
        .otherwise(S.SIDE_SELL)
    )
    return {
        "trade_date": trade_date, "time": _when_clock(df, "TransactTime", trade_date),
        "update_time": _when_clock(df, "LocalTime", trade_date), "sale_order_id": F.col("OfferApplSeqNum"),
        "buy_order_id": F.col("BidApplSeqNum"), "side": inferred, "price": F.col("LastPx"), "volume": F.col("LastQty"),
        "money": F.col("LastPx") * F.col("LastQty"), "channel": F.col("ChannelNo"), "seq_num": F.col("ApplSeqNum"),
    }


def orders_sh(df: DataFrame, trade_date: Column) -> DataFrame:
    return _normalised(df, "order", SH, _orders_sh(df, trade_date))


def orders_sz(df: DataFrame, trade_date: Column) -> DataFrame:
    """Shenzhen orders: ASCII side and type codes; the sequence is the order number."""
    return _normalised(df, "order", SZ, _orders_sz(df, trade_date))


def deals_sh(df: DataFrame, trade_date: Column) -> DataFrame:
    return _normalised(df, "deal", SH, _deals_sh(df, trade_date))


def deals_sz(df: DataFrame, trade_date: Column) -> DataFrame:
    """Shenzhen deals: the later order took liquidity, so its side names the deal."""
    return _normalised(df, "deal", SZ, _deals_sz(df, trade_date))


# Snapshot field -> vendor column, where the two differ.
_SH_TICK = {
    "current_price": "LastPrice", "total_volume": "TradVolume", "total_money": "Turnover",
    "pre_close_price": "PreCloPrice", "open_price": "OpenPrice", "highest_price": "HighPrice",
    "lowest_price": "LowPrice", "iopv": "IOPV", "trade_num": "TradNumber",
    "total_bid_volume": "TotalBidVol", "total_ask_volume": "TotalAskVol",
    "avg_bid_price": "WAvgBidPri", "avg_ask_price": "WAvgAskPri", "seq_num": "SeqNo",
}
_SZ_TICK = {
    "current_price": "LastPrice", "total_volume": "Volume", "total_money": "Turnover",
    "pre_close_price": "PreCloPrice", "open_price": "OpenPrice", "highest_price": "HighPrice",
    "lowest_price": "LowPrice", "high_limit_price": "HighLimitPrice", "low_limit_price": "LowLimitPrice",
    "iopv": "IOPV", "trade_num": "TurnNum", "total_bid_volume": "TotalBidQty",
    "total_ask_volume": "TotalOfferQty", "avg_bid_price": "WeightedAvgBidPx",
    "avg_ask_price": "WeightedAvgOfferPx", "seq_num": "SeqNo",
}


def level_source(column: str, order_prefix: str = "NumOrders") -> str:
    """``ask_num3`` -> ``NumOrdersS3``; other depth fields keep the header name."""
    side = {"a": "S", "b": "B"}[column[0]]
    if "_num" in column:
        return f"{order_prefix}{side}{column.rsplit('num', 1)[1]}"
    return S.header_name(column)


def _take(df: DataFrame, source: str, kind: str = "double") -> Column:
    return _or_zero(source, kind) if source in df.columns else F.lit(0).cast(kind)


def _tick_levels(df: DataFrame) -> dict[str, Column]:
    """Depth fields, named alike in both markets."""
    return {n: _take(df, level_source(n)) for n in S.level_columns()}


def _tick_scalars(df: DataFrame, trade_date: Column, market: str) -> dict[str, Column]:
    fields = _SH_TICK if market == SH else _SZ_TICK
    stamp = _when_clock(df, "UpdateTime", trade_date)
    return {
        "trade_date": trade_date, "time": stamp,
        "update_time": _when_clock(df, "LocalTime", trade_date) if "LocalTime" in df.columns else stamp,
        **{n: _take(df, fields.get(n, "")) for n in S.TICK_SCALARS},
        "channel": F.lit(0), "seq_num": _take(df, fields["seq_num"], "long"),
    }


def ticks(df: DataFrame, trade_date: Column, market: str) -> DataFrame:
    """Snapshot rows; absent or empty scalar and depth fields are zero."""
    return _normalised(df, "tick", market, _tick_scalars(df, trade_date, market) | _tick_levels(df))


def route_by_market(df: DataFrame, trade_date: Column, kind: str) -> DataFrame:
    """Rows of both markets through their own rules, market by code prefix: one scan, one projection."""
    raw = codes.zfill(F.col("SecurityID"))
    in_sh = codes.is_shanghai(raw)
    market = F.when(in_sh, F.lit(SH)).otherwise(F.lit(SZ))
    if kind == "tick":
        sh, sz = (_tick_scalars(df, trade_date, m) for m in (SH, SZ))
        shared = _tick_levels(df)
    else:
        sh, sz = (rule(df, trade_date) for rule in {"order": (_orders_sh, _orders_sz), "deal": (_deals_sh, _deals_sz)}[kind])
        shared = {}
    # Each side takes its feed type before the two meet, so neither market's spelling widens the other.
    types = {f.name: f.dataType for f in S.FEEDS[kind].fields if f.name in sh}
    routed = {n: F.when(in_sh, sh[n].cast(t)).otherwise(sz[n].cast(t)) for n, t in types.items()}
    rows = df.where(codes.is_equity_feed_code(raw, market))
    return S.conform(rows.select(
        F.concat(raw, F.lit("."), market).alias("code"), *[c.alias(n) for n, c in (routed | shared).items()]), kind)


def validate_feed(df: DataFrame, kind: str, keys=("channel", "seq_num")) -> DataFrame:
    """One row: rows, missing columns, duplicate keys, malformed codes, verdict."""
    missing = [c for c in S.FEEDS[kind].fieldNames() if c not in df.columns]
    good_code = F.col("code").rlike(r"^(6\d{5}\.XSHG|[03]\d{5}\.XSHE)$")
    per_key = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.when(good_code, 0).otherwise(1)).alias("bad")
    )
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.lit(len(missing)).alias("missing_columns"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_codes"),
    ).withColumn(
        "valid",
        (F.col("rows") > 0) & (F.col("missing_columns") == 0)
        & (F.col("duplicate_rows") == 0) & (F.col("bad_codes") == 0),
    )


def levels_to_array(df: DataFrame, levels: int = S.LEVELS) -> DataFrame:
    """Adds ``asks`` / ``bids``: arrays of (price, volume, num), best level first."""
    have = set(df.columns)

    def side(name: str) -> Column:
        return F.array(*[
            F.struct(*[F.col(f"{name}_{f}{i}").alias(f) for f in S.LEVEL_FIELDS if f"{name}_{f}{i}" in have])
            for i in range(1, levels + 1) if f"{name}_price{i}" in have
        ])

    return df.withColumn("asks", side("ask")).withColumn("bids", side("bid"))


def explode_levels(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per (kept columns, side, level)."""
    both = F.array(F.struct(F.lit("ask").alias("side"), F.col("asks").alias("book")),
                   F.struct(F.lit("bid").alias("side"), F.col("bids").alias("book")))
    sided = df.select(*keep, F.inline(both))
    return sided.select(*keep, "side", F.posexplode("book").alias("_at", "_level")).select(
        *keep, "side", (F.col("_at") + 1).alias("level"), "_level.*"
    )
