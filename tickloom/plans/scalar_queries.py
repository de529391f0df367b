"""Projections, scalar functions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import codes, times, values
from tickloom.operators import codec, feeds
from tickloom.operators import universe as uni
from tickloom.operators.keyed import exact_median
from tickloom.operators.scoring import feature_matrix
from tickloom.plans.registry import query
from tickloom.plans.views import day, view


def feed_day():
    return F.lit("2024-01-05").cast("date")


def us(name, alias=None):
    return times.epoch_micros(F.col(name)).alias(alias or f"{name}_us")


@query("p1_code_forms", "v_raw_feed", """
SELECT biz_index, ticker, ticker || CASE WHEN ticker LIKE '6%' OR ticker LIKE '9%' THEN '.XSHG' ELSE '.XSHE' END AS full_code,
       CASE WHEN ticker LIKE '6%' OR ticker LIKE '9%' THEN 'XSHG' ELSE 'XSHE' END AS market,
       ticker || CASE WHEN ticker LIKE '6%' THEN '.SH' WHEN ticker LIKE '4%' OR ticker LIKE '8%' THEN '.BJ' ELSE '.SZ' END AS symbol,
       CASE WHEN ticker LIKE '6%' THEN 'SH' ELSE 'SZ' END || ticker AS order_code, lpad(security_code, 6, '0') AS digits
FROM v_raw_feed""")
def p1(spark, sf):
    df = view(spark, sf, "v_raw_feed").withColumn("full_code", codes.full_code(F.col("ticker")))
    parsed = codes.split_code(F.col("full_code"))
    return df.select(
        "biz_index", "ticker", "full_code", parsed["market"].alias("market"),
        codes.universe_symbol(codes.key6(F.col("full_code"))).alias("symbol"),
        codes.prefixed_symbol(F.col("ticker")).alias("order_code"),
        codes.digits6(F.concat(F.col("security_code"), F.lit(".SZ"))).alias("digits"))


@query("p2_instrument_class", "v_raw_feed", """
SELECT biz_index, ticker, regexp_matches(ticker, '^(6|9|000|880)') AS sh_ok, regexp_matches(ticker, '^[03]') AS sz_ok
FROM v_raw_feed""")
def p2(spark, sf):
    raw = F.col("ticker")
    return view(spark, sf, "v_raw_feed").select(
        "biz_index", "ticker", codes.is_equity_or_index(raw, F.lit(codes.SH)).alias("sh_ok"),
        codes.is_equity_or_index(raw, F.lit(codes.SZ)).alias("sz_ok"))


def _merged_feed(spark, sf):
    return view(spark, sf, "v_raw_feed").select(
        F.col("ticker").alias("SecurityID"), F.col("raw_time").alias("TickTime"), F.col("raw_time").alias("LocalTime"),
        F.col("msg_type").alias("Type"), F.col("bs_flag").alias("TickBSFlag"),
        values.fixed_point(F.col("raw_price3"), 3).alias("Price"), F.col("qty").alias("Qty"),
        F.col("buy_order_no").alias("BuyOrderNO"), F.col("sell_order_no").alias("SellOrderNO"),
        F.lit(1).alias("Channel"), F.col("biz_index").alias("BizIndex"))


_CLOCK_US = """CAST(raw_time // 10000000 * 3600000 + raw_time // 100000 % 100 * 60000 + raw_time // 1000 % 100 * 1000
 + raw_time % 1000 AS BIGINT) * 1000 + 1704412800000000"""


@query("p3_merged_split", "v_raw_feed", f"""
, b AS (SELECT *, ticker || '.XSHG' AS code, {_CLOCK_US} AS time_us, CAST(raw_price3 AS DOUBLE) / 1000 AS price,
   CAST(CASE bs_flag WHEN 'B' THEN 0 WHEN 'S' THEN 1 ELSE 10 END AS SMALLINT) AS side
   FROM v_raw_feed WHERE ticker LIKE '6%' AND bs_flag NOT IN ('CLOSE', 'ENDTR'))
SELECT 'order' AS kind, code, time_us, biz_index AS seq_num, buy_order_no + sell_order_no AS order_id, side, price,
       CAST(CASE msg_type WHEN 'A' THEN 2 ELSE 5 END AS SMALLINT) AS order_type, 0.0::DOUBLE AS money FROM b WHERE msg_type IN ('A', 'D')
UNION ALL SELECT 'deal', code, time_us, biz_index, buy_order_no, side, price, CAST(0 AS SMALLINT), price * qty FROM b WHERE msg_type = 'T'""")
def p3(spark, sf):
    both = feeds.merged_sh(_merged_feed(spark, sf), feed_day())
    return both.select(
        "kind", "code", us("time"), "seq_num", F.coalesce("order_id", "buy_order_id").alias("order_id"),
        F.col("side").cast("short").alias("side"), "price",
        F.coalesce("order_type", F.lit(0)).cast("short").alias("order_type"), F.coalesce("money", F.lit(0.0)).alias("money"))


def _order_feed(spark, sf):
    """Order messages of both markets: letter codes in Shanghai, ASCII numbers in Shenzhen."""
    c = F.col
    return view(spark, sf, "v_raw_feed").select(
        c("ticker").alias("SecurityID"), c("raw_time").alias("OrderTime"), c("raw_time").alias("TransactTime"),
        c("raw_time").alias("LocalTime"), c("sell_order_no").alias("OrderNO"), c("biz_index").alias("ApplSeqNum"),
        F.when(c("bs_flag").isin("B", "S"), c("bs_flag")).alias("OrderBSFlag"),
        F.when(c("bs_flag") == "B", 49).when(c("bs_flag") == "S", 50).otherwise(0).alias("Side"),
        c("raw_price3").cast("double").alias("OrderPrice"), c("raw_price3").cast("double").alias("Price"),
        c("qty").alias("Balance"), c("qty").alias("OrderQty"),
        F.when(c("msg_type").isin("A", "D"), c("msg_type")).alias("OrderType"),
        F.when(c("msg_type") == "A", 49).when(c("msg_type") == "D", 85).otherwise(7).alias("OrdType"),
        F.lit(3).alias("OrderChannel"), F.lit(4).alias("ChannelNo"), c("biz_index").alias("BizIndex"))


@query("p4_order_normalise", "v_raw_feed", """
SELECT ticker || CASE WHEN ticker LIKE '6%' THEN '.XSHG' ELSE '.XSHE' END AS code, biz_index AS seq_num,
  CASE WHEN ticker LIKE '6%' THEN sell_order_no ELSE biz_index END AS order_id,
  CAST(CASE WHEN bs_flag = 'B' THEN 0 WHEN bs_flag = 'S' THEN 1 WHEN ticker LIKE '6%' THEN NULL ELSE 10 END AS DOUBLE) AS side,
  CAST(CASE WHEN ticker LIKE '6%' THEN CASE msg_type WHEN 'A' THEN 2 WHEN 'D' THEN 5 END
       ELSE CASE msg_type WHEN 'A' THEN 1 WHEN 'D' THEN 3 ELSE 0 END END AS DOUBLE) AS order_type,
  CASE WHEN ticker LIKE '6%' THEN 3 ELSE 4 END::BIGINT AS channel, CAST(qty AS DOUBLE) AS volume FROM v_raw_feed""")
def p4(spark, sf):
    out = feeds.route_by_market(_order_feed(spark, sf), feed_day(), "order")
    return out.select("code", "seq_num", "order_id", F.col("side").cast("double").alias("side"),
                      F.col("order_type").cast("double").alias("order_type"), "channel", "volume")


def _deal_feed(spark, sf):
    c = F.col
    return view(spark, sf, "v_raw_feed").select(
        c("ticker").alias("SecurityID"), c("raw_time").alias("TradTime"), c("raw_time").alias("TransactTime"),
        c("raw_time").alias("LocalTime"), c("sell_order_no").alias("TradeSellNo"), c("buy_order_no").alias("TradeBuyNo"),
        (c("sell_order_no") % 7).alias("OfferApplSeqNum"), (c("buy_order_no") % 5).alias("BidApplSeqNum"),
        c("bs_flag").alias("TradeBSFlag"), c("raw_price3").cast("double").alias("TradPrice"),
        c("raw_price3").cast("double").alias("LastPx"), c("qty").alias("TradVolume"), c("qty").alias("LastQty"),
        (c("raw_price3") * c("qty")).cast("double").alias("TradeMoney"), F.lit(3).alias("TradeChan"),
        F.lit(4).alias("ChannelNo"), c("biz_index").alias("BizIndex"), c("biz_index").alias("ApplSeqNum"),
        F.when(c("msg_type") == "D", 52).otherwise(70).alias("ExecType"))


@query("p5_deal_normalise", "v_raw_feed", """
SELECT ticker || CASE WHEN ticker LIKE '6%' THEN '.XSHG' ELSE '.XSHE' END AS code, biz_index AS seq_num,
  CASE WHEN ticker LIKE '6%' THEN sell_order_no ELSE sell_order_no % 7 END AS sale_order_id,
  CAST(CASE WHEN ticker LIKE '6%' THEN CASE bs_flag WHEN 'B' THEN 0 WHEN 'S' THEN 1 WHEN 'CLOSE' THEN 10 ELSE 10 END
       WHEN msg_type = 'D' THEN 4 WHEN buy_order_no % 5 > sell_order_no % 7 THEN 0 ELSE 1 END AS SMALLINT) AS side,
  CAST(raw_price3 * qty AS DOUBLE) AS money FROM v_raw_feed""")
def p5(spark, sf):
    out = feeds.route_by_market(_deal_feed(spark, sf), feed_day(), "deal")
    return out.select("code", "seq_num", "sale_order_id", "side", "money")


def _tick_feed(spark, sf):
    c = F.col
    return view(spark, sf, "v_raw_feed").select(
        c("ticker").alias("SecurityID"), c("raw_time").alias("UpdateTime"), c("raw_time").alias("LocalTime"),
        c("raw_price3").cast("double").alias("LastPrice"), c("qty").cast("double").alias("TradVolume"),
        (c("qty") * 2).cast("double").alias("Volume"), F.lit(None).cast("double").alias("OpenPrice"),
        c("raw_price3").cast("double").alias("AskPrice1"), c("qty").cast("double").alias("NumOrdersS1"),
        c("qty").cast("double").alias("BidVolume2"), c("biz_index").alias("SeqNo"))


@query("p6_tick_normalise", "v_raw_feed", """
SELECT ticker || CASE WHEN ticker LIKE '6%' THEN '.XSHG' ELSE '.XSHE' END AS code, biz_index AS seq_num,
  CAST(raw_price3 AS DOUBLE) AS current_price, CAST(CASE WHEN ticker LIKE '6%' THEN qty ELSE qty * 2 END AS DOUBLE) AS total_volume,
  0.0::DOUBLE AS open_price, CAST(raw_price3 AS DOUBLE) AS ask_price1, CAST(qty AS DOUBLE) AS ask_num1,
  CAST(qty AS DOUBLE) AS bid_volume2, 0.0::DOUBLE AS bid_price10, 0.0::DOUBLE AS iopv FROM v_raw_feed""")
def p6(spark, sf):
    out = feeds.route_by_market(_tick_feed(spark, sf), feed_day(), "tick")
    return out.select("code", "seq_num", "current_price", "total_volume", "open_price", "ask_price1", "ask_num1",
                      "bid_volume2", "bid_price10", "iopv")


@query("p7_market_route", "v_raw_feed", """
SELECT CASE WHEN ticker LIKE '6%' OR ticker LIKE '9%' THEN 'XSHG' ELSE 'XSHE' END AS market, count(*) AS n FROM v_raw_feed GROUP BY 1""")
def p7(spark, sf):
    return view(spark, sf, "v_raw_feed").groupBy(codes.exchange_of(F.col("ticker")).alias("market")).agg(F.count("*").alias("n"))


@query("p8_status_rows", "v_raw_feed", "SELECT biz_index, bs_flag FROM v_raw_feed WHERE bs_flag NOT IN ('CLOSE', 'ENDTR')")
def p8(spark, sf):
    return view(spark, sf, "v_raw_feed").where(~feeds.is_status_row(F.col("bs_flag"))).select("biz_index", "bs_flag")


@query("p9_fixed_point", "v_raw_feed", """
SELECT biz_index, CASE WHEN raw_price3 = 5000 THEN 0.0 ELSE CAST(raw_price3 AS DOUBLE) / 1000 END AS price,
  CAST(raw_time // 10000000 % 100 * 3600 + raw_time // 100000 % 100 * 60 + raw_time // 1000 % 100 AS DOUBLE)
  + CAST(raw_time % 1000 AS DOUBLE) / 1000 AS seconds FROM v_raw_feed""")
def p9(spark, sf):
    return view(spark, sf, "v_raw_feed").select(
        "biz_index", values.fixed_point(F.col("raw_price3"), 3, sentinel=5000).alias("price"),
        times.clock_int_seconds(F.col("raw_time")).alias("seconds"))


@query("p10_time_parsing", "v_raw_feed", f"""
, t AS (SELECT *, {_CLOCK_US} AS us FROM v_raw_feed)
SELECT biz_index, us AS from_number, CASE WHEN event_type = 'error' THEN NULL ELSE us END::DOUBLE AS from_text,
       us AS from_epoch FROM t""")
def p10(spark, sf):
    raw, two = F.col("raw_time"), lambda c: F.lpad(c.cast("string"), 2, "0")
    part = lambda d, w: F.floor(raw / F.lit(d)) % w
    text = F.concat_ws(":", two(part(10000000, 100)), two(part(100000, 100)), F.concat(
        two(part(1000, 100)), F.lit("."), F.lpad((raw % 1000).cast("string"), 3, "0")))
    text = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(text)
    number = times.parse_clock_number(raw, feed_day())
    epoch_ms = F.floor(times.epoch_micros(number) / F.lit(1000))
    return view(spark, sf, "v_raw_feed").select(
        "biz_index", times.epoch_micros(number).alias("from_number"),
        times.epoch_micros(times.parse_clock_text(text, feed_day())).cast("double").alias("from_text"),
        times.epoch_micros(times.parse_clock_number(epoch_ms, feed_day())).alias("from_epoch"))


@query("p11_time_of_day", "v_tick", """
SELECT seq_num, CAST(epoch_us(time) - epoch_us(CAST(trade_date AS TIMESTAMP)) AS DOUBLE) / 1000000 AS seconds,
       strftime(time, '%H%M%S') AS label, strftime(time, '%H%M') || '00' AS minute FROM v_tick""")
def p11(spark, sf):
    t = F.col("time")
    return view(spark, sf, "v_tick").select("seq_num", times.seconds_of_day(t).alias("seconds"),
                                            times.label_hhmmss(t).alias("label"), times.minute_label(t).alias("minute"))


@query("p12_seconds_to_time", "v_raw_feed", """
, s AS (SELECT biz_index, user_id, CAST(raw_time // 10000000 * 3600 + raw_time // 100000 % 100 * 60 + raw_time // 1000 % 100 AS DOUBLE)
   + CAST(raw_time % 1000 AS DOUBLE) / 1000 - CASE WHEN event_type = 'error' THEN 40000 ELSE 0 END AS sec FROM v_raw_feed)
SELECT biz_index, CASE WHEN sec >= 0 THEN 1704412800000000 + CAST(round_even(sec * 1000000, 0) AS BIGINT) END::DOUBLE AS time_us FROM s""")
def p12(spark, sf):
    seconds = times.clock_int_seconds(F.col("raw_time")) - F.when(F.col("event_type") == "error", 40000).otherwise(0)
    return view(spark, sf, "v_raw_feed").select(
        "biz_index", times.epoch_micros(times.seconds_to_time(feed_day(), seconds)).cast("double").alias("time_us"))


@query("p13_date_forms", "v_tick", """
SELECT seq_num, strftime(time, '%Y%m%d') AS compact, strftime(time, '%Y-%m-%d') AS dashed,
       CAST(strftime(time, '%H%M%S') AS INTEGER) AS clock FROM v_tick""")
def p13(spark, sf):
    stamp = F.col("time").cast("string")
    return view(spark, sf, "v_tick").select(
        "seq_num", times.compact_date(stamp).alias("compact"), times.dashed_date(stamp).alias("dashed"),
        times.clock_digits(F.date_format("time", "HH:mm:ss")).alias("clock"))


@query("p14_numeric_coercion", "v_tick", """
SELECT seq_num, current_price AS price_text, event_type AS mostly_text FROM v_tick""")
def p14(spark, sf):
    df = view(spark, sf, "v_tick").select(
        "seq_num", F.col("current_price").cast("string").alias("price_text"), F.col("event_type").alias("mostly_text"))
    return values.coerce_numeric_text(df)


@query("p15_archive_encode", "v_deal", """
SELECT CAST(code AS INTEGER) AS code, epoch_us(time) - 28800000000 AS time, epoch_us(time) AS update_time, sale_order_id,
  buy_order_id, CAST(side AS TINYINT) AS side, CAST(least(floor(price * 100 + 0.5), 2147483647) AS INTEGER) AS price,
  CAST(volume AS BIGINT) AS volume, CAST(seq_num AS INTEGER) AS seq_num FROM v_deal""")
def p15(spark, sf):
    df = view(spark, sf, "v_deal").withColumn("security_id", F.col("code").cast("int")).withColumn("update_time", F.col("time"))
    return codec.encode(df, "deal")


@query("p16_archive_decode", "v_deal", """
SELECT CAST(CAST(code AS INTEGER) AS VARCHAR) AS code, seq_num::INTEGER AS seq_num, epoch_us(time) AS time_us, epoch_us(time) AS update_time_us,
  floor(price * 100 + 0.5) / 100 AS price, CAST(volume AS DOUBLE) * 100 AS volume FROM v_deal""")
def p16(spark, sf):
    df = view(spark, sf, "v_deal").withColumn("security_id", F.col("code").cast("int")).withColumn("update_time", F.col("time"))
    out = codec.decode(codec.encode(df, "deal"), volume_scale=100.0)
    return out.select("code", "seq_num", us("time"), us("update_time"), "price", "volume")


@query("p17_clock_repair", "v_tick", """
, e AS (SELECT code, seq_num, epoch_us(time) - CASE WHEN security_id % 2 = 0 THEN 28800000000 ELSE 0 END AS t FROM v_tick),
m AS (SELECT *, (t // 60000000) % 1440 AS m FROM e),
h AS (SELECT code, sum(CASE WHEN (m + 480) % 1440 BETWEEN 510 AND 930 THEN 1 ELSE 0 END) AS via,
             sum(CASE WHEN m BETWEEN 510 AND 930 THEN 1 ELSE 0 END) AS direct FROM m GROUP BY 1)
SELECT code, seq_num, t + CASE WHEN direct > via THEN 0 ELSE 28800000000 END AS time_us FROM m JOIN h USING (code)""")
def p17(spark, sf):
    shift = F.when(F.col("security_id") % 2 == 0, times.ARCHIVE_SHIFT_US).otherwise(0)
    df = view(spark, sf, "v_tick").select("code", "seq_num", (times.epoch_micros(F.col("time")) - shift).alias("time"))
    return codec.resolve_clock(df, ["code"]).select("code", "seq_num", us("time"))


@query("p18_legacy_columns", "v_tick", """
SELECT code AS "Code", seq_num AS "SeqNum", CAST(floor(current_price * 100 + 0.5) AS INTEGER) AS "CurrentPrice" FROM v_tick""")
def p18(spark, sf):
    from tickloom import schemas as S
    df = view(spark, sf, "v_tick")
    named = {"code": F.col("code"), "time": F.col("time"), "update_time": F.col("time"), "seq_num": F.col("seq_num"),
             "current_price": values.to_cents(F.col("current_price"))}
    plain = ("code", "time", "update_time", "total_volume", "trade_num", "seq_num")
    broken = df.select(*[
        named.get(n, F.lit(0)).alias(S.header_name(n) if n in plain else f"LEAST(x.{S.header_name(n)}, 2147483647)")
        for n in ["code", *codec.ARCHIVED["tick"]]])
    return codec.repair_legacy_tick(broken).select("Code", "SeqNum", "CurrentPrice")


@query("p19_half_up_cents", "v_tick", """
SELECT seq_num, CASE WHEN ask_price1 > 0 THEN floor(ask_price1 * 100 + 0.5) / 100 ELSE ask_price1 END AS ask_price1 FROM v_tick""")
def p19(spark, sf):
    return view(spark, sf, "v_tick").select("seq_num", values.half_up_cents(F.col("ask_price1").cast("double")).alias("ask_price1"))


@query("p20_level_measures", "v_tick v_daily", """
SELECT t.seq_num, CASE WHEN ask_price1 > 0 AND bid_price1 > 0 THEN ask_price1 - bid_price1 END AS spread,
  CASE WHEN pre_close_price > 0 AND current_price > 0 THEN (current_price - pre_close_price) / pre_close_price * 100 END AS change_pct,
  CASE WHEN d.high > d.low THEN (current_price - d.low) / (d.high - d.low) ELSE 0.5 END AS price_pos,
  CASE WHEN bid_volume1 + ask_volume1 > 0 THEN CAST(bid_volume1 AS DOUBLE) / (bid_volume1 + ask_volume1) ELSE 0.5 END AS buy_pressure
FROM v_tick t JOIN v_daily d ON t.trade_date = d.trade_date AND t.code = d.id_qi""")
def p20(spark, sf):
    daily = view(spark, sf, "v_daily").select("trade_date", F.col("id_qi").alias("code"), "high", "low")
    c = F.col
    return view(spark, sf, "v_tick").join(daily, ["trade_date", "code"]).select(
        "seq_num", values.spread(c("ask_price1"), c("bid_price1")).alias("spread"),
        values.change_pct(c("current_price"), c("pre_close_price")).alias("change_pct"),
        values.range_position(c("current_price"), c("high"), c("low")).alias("price_pos"),
        values.buy_pressure(c("bid_volume1"), c("ask_volume1")).alias("buy_pressure"))


@query("p21_feature_matrix", "v_daily", """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, id_qi, CASE WHEN close > 60 THEN 12.5 ELSE close END AS f_close,
       high - low AS f_range, 0.0::DOUBLE AS f_absent FROM v_daily""")
def p21(spark, sf):
    df = view(spark, sf, "v_daily").select(
        "trade_date", "id_qi", F.when(F.col("close") > 60, F.lit("n/a")).otherwise(F.col("close").cast("string")).alias("f_close"),
        (F.col("high") - F.col("low")).alias("f_range"))
    return feature_matrix(df, ["f_close", "f_range", "f_absent"], {"f_close": 12.5}, [day(), F.col("id_qi")])


@query("p21_exact_median", "v_daily", """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, median(close) AS close_median FROM v_daily GROUP BY 1""")
def p21_median(spark, sf):
    out = exact_median(view(spark, sf, "v_daily"), ["trade_date"], "close", [F.col("id_qi")])
    return out.select(day(), "close_median")


@query("p22_level_rows", "v_tick", """
SELECT seq_num, 'ask' AS side, 1 AS level, ask_price1::DOUBLE AS price, ask_volume1 AS volume FROM v_tick
UNION ALL SELECT seq_num, 'bid', 1, bid_price1, bid_volume1 FROM v_tick
UNION ALL SELECT seq_num, 'ask', 2, ask_price1 + 1, ask_volume1 + 1 FROM v_tick
UNION ALL SELECT seq_num, 'bid', 2, bid_price1 - 1, bid_volume1 + 1 FROM v_tick""")
def p22(spark, sf):
    c = F.col
    df = view(spark, sf, "v_tick").withColumns({
        "ask_price1": c("ask_price1").cast("double"),
        "ask_price2": c("ask_price1") + 1, "ask_volume2": c("ask_volume1") + 1,
        "bid_price2": c("bid_price1") - 1, "bid_volume2": c("bid_volume1") + 1})
    return feeds.explode_levels(feeds.levels_to_array(df, 2), ["seq_num"])


@query("p23_pad_key", "v_raw_feed", "SELECT biz_index, lpad(security_code, 6, '0') AS _ID_QI_PAD FROM v_raw_feed")
def p23(spark, sf):
    return view(spark, sf, "v_raw_feed").select(
        "biz_index", codes.pad6(F.concat(F.col("security_code"), F.lit(".XSHE"))).alias("_ID_QI_PAD"))


@query("f1_slice_cut", "v_tick", """
SELECT code, seq_num FROM v_tick WHERE epoch_us(time) - epoch_us(CAST(trade_date AS TIMESTAMP)) <= (10 * 3600 + 30 * 60) * 1000000::BIGINT""")
def f1(spark, sf):
    return uni.cut_at(view(spark, sf, "v_tick"), F.lit("103000")).select("code", "seq_num")


@query("f2_traded_stocks", "v_daily", """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, id_qi FROM v_daily WHERE volume >= 300""")
def f2(spark, sf):
    text = F.when(F.col("volume") < 300, F.lit("none")).otherwise(F.col("volume").cast("string"))
    return uni.traded(view(spark, sf, "v_daily").withColumn("volume", text)).select(day(), "id_qi")


_NAMED = """
, p AS (SELECT d.trade_date, d.id_qi, s.sec_short_name FROM v_daily d JOIN v_security s USING (security_id)),
cur AS (SELECT DISTINCT id_qi, sec_short_name FROM p WHERE trade_date = (SELECT max(trade_date) FROM p)),
kept AS (SELECT id_qi FROM cur WHERE sec_short_name NOT LIKE '%ST%' AND sec_short_name NOT LIKE '%退%')"""


def _named_panel(spark, sf):
    return view(spark, sf, "v_daily").join(
        view(spark, sf, "v_security").select("security_id", "sec_short_name", "exchange_cd", "industry"), "security_id")


@query("f3_special_treatment", "v_daily v_security", _NAMED + """
SELECT id_qi AS code6, id_qi || '.SZ' AS symbol FROM kept""")
def f3(spark, sf):
    return uni.trading_universe(_named_panel(spark, sf))


@query("f4_blacklist", "v_daily v_security", _NAMED + """
SELECT id_qi AS code6, id_qi || '.SZ' AS symbol FROM kept WHERE id_qi NOT IN ('000003', '000005', '000110')""")
def f4(spark, sf):
    return uni.trading_universe(_named_panel(spark, sf), blacklist=["000003", "5", "000110.SZ"])


@query("f5_universe_restriction", "v_daily v_security", _NAMED + """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, id_qi AS code6, close FROM v_daily WHERE id_qi IN (SELECT id_qi FROM kept)""")
def f5(spark, sf):
    panel = view(spark, sf, "v_daily").withColumnRenamed("id_qi", "code6")
    return uni.restrict_to(panel, uni.trading_universe(_named_panel(spark, sf))).select(day(), "code6", "close")


_ORDERS = """
, o AS (SELECT account_id, code, CASE WHEN position > 0.01 THEN 'buy' ELSE 'sell' END AS side FROM v_target),
h AS (SELECT DISTINCT account_id, code FROM v_position WHERE current_volume > 0)"""


@query("f6_limit_up_buys", "v_target v_position v_quote", _ORDERS + """
SELECT o.account_id, o.code, o.side FROM o LEFT JOIN h ON o.account_id = h.account_id AND o.code = h.code LEFT JOIN v_quote q ON q.code = o.code
WHERE NOT (o.side = 'buy' AND h.code IS NULL AND coalesce(q.high_limit, 0) > 0 AND q.price >= q.high_limit - 1e-6)""")
def f6(spark, sf):
    side = F.when(F.col("position") > 0.01, "buy").otherwise("sell")
    orders = view(spark, sf, "v_target").select("account_id", "code", side.alias("side"))
    held = uni.held_codes(view(spark, sf, "v_position"), ["account_id", "code"])
    return uni.drop_limit_up_buys(orders, held, view(spark, sf, "v_quote"), ["account_id", "code"])


@query("f7_limit_up_candidates", "v_target v_position v_quote", _ORDERS + """
SELECT t.account_id, t.code, t.position FROM v_target t LEFT JOIN h ON t.account_id = h.account_id AND t.code = h.code LEFT JOIN v_quote q ON q.code = t.code
WHERE NOT (h.code IS NULL AND coalesce(q.high_limit, 0) > 0 AND coalesce(q.price, 0) > 0 AND q.price >= q.high_limit - 1e-6)""")
def f7(spark, sf):
    held = uni.held_codes(view(spark, sf, "v_position"), ["account_id", "code"])
    return uni.drop_limit_up_candidates(
        view(spark, sf, "v_target"), held, view(spark, sf, "v_quote"), ["account_id", "code"]).select("account_id", "code", "position")


@query("f8_session_filter", "v_tick", """
, m AS (SELECT code, seq_num, CAST(hour(time) * 60 + minute(time) AS INTEGER) AS m FROM v_tick)
SELECT code, seq_num, m >= 555 AND m < 900 AS in_window,
  (m BETWEEN 570 AND 690 OR m BETWEEN 780 AND 900) AND m NOT IN (571, 899) AS in_session FROM m""")
def f8(spark, sf):
    t = F.col("time")
    return view(spark, sf, "v_tick").select(
        "code", "seq_num", times.in_window(t).alias("in_window"),
        times.in_sessions(t, excluded=("09:31", "14:59")).alias("in_session"))


@query("f9_plausible_latency", "v_tick", "SELECT code, seq_num, latency_ms FROM v_tick WHERE latency_ms BETWEEN 0 AND 600")
def f9(spark, sf):
    return uni.plausible_latency(view(spark, sf, "v_tick"), limit_ms=600).select("code", "seq_num", "latency_ms")
