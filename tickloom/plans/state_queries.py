"""State, slices, bars, dedupe, windows and data quality (A1-A5, A10-A12, A16, A21, W1-W9, T1, Q1-Q3, UD6, UD9, UD10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import times, values
from tickloom.operators import bars, calendar as cal
from tickloom.operators import factors as fac
from tickloom.operators import feeds
from tickloom.operators import panel as pan
from tickloom.operators import quality as qual
from tickloom.operators import state as st
from tickloom.operators.keyed import keep_first
from tickloom.plans.registry import query
from tickloom.plans.views import day, view
from tickloom.session import scratch_path
from tickloom.sources import archive

US = lambda name: times.epoch_micros(F.col(name)).alias(name)
DEAL_ORDER = ["time", "buy_order_id", "sale_order_id", "money", "volume", "side"]


@query("a1_tick_state", "v_tick", """
, g AS (SELECT trade_date, code, arg_min(current_price, seq_num) FILTER (WHERE current_price > 0) AS open,
  arg_max(current_price, seq_num) FILTER (WHERE current_price > 0) AS latest_price,
  max(current_price) FILTER (WHERE current_price > 0) AS high, min(current_price) FILTER (WHERE current_price > 0) AS low,
  arg_max(pre_close_price, seq_num) FILTER (WHERE pre_close_price > 0) AS pre_close,
  arg_max(ask_price1, seq_num) FILTER (WHERE ask_price1 > 0) AS ask1, arg_max(bid_price1, seq_num) FILTER (WHERE bid_price1 > 0) AS bid1,
  arg_max(ask_volume1, seq_num) AS ask_volume1, arg_max(bid_volume1, seq_num) AS bid_volume1, count(*) AS tick_count,
  epoch_us(arg_max(time, seq_num)) AS last_tick_time FROM v_tick GROUP BY 1, 2)
SELECT * REPLACE (CAST(trade_date AS VARCHAR) AS trade_date) FROM g""")
def a1(spark, sf):
    return st.tick_state(view(spark, sf, "v_tick")).withColumn("trade_date", day()).withColumn("last_tick_time", US("last_tick_time"))


def _cents(spark, sf):
    """Deals with their amount in whole cents, which sums exactly."""
    return view(spark, sf, "v_deal").withColumn("cents", F.floor(F.col("money") * 100 + 0.5).cast("long"))


_CENTS = "CAST(floor(money * 100 + 0.5) AS BIGINT)"


@query("a2_deal_state", "v_deal", f"""
SELECT CAST(trade_date AS VARCHAR) AS trade_date, code, CAST(sum({_CENTS}) AS BIGINT) AS cum_cents, CAST(sum(volume) AS DOUBLE) AS cum_volume,
  count(*) AS deal_count, CAST(sum({_CENTS}) AS BIGINT) / sum(volume) AS vwap FROM v_deal GROUP BY 1, 2""")
def a2(spark, sf):
    out = st.deal_state(_cents(spark, sf), amount=F.col("cents"))
    return out.select(day(), "code", F.col("cum_amount").alias("cum_cents"), F.col("cum_volume").cast("double").alias("cum_volume"),
                      "deal_count", "vwap")


@query("a3_order_state", "v_order", """
, g AS (SELECT trade_date, code, count(*) AS order_count, count(*) FILTER (WHERE side = 0) AS buy_order_count, count(*) FILTER (WHERE side = 1) AS sell_order_count,
  coalesce(sum(volume) FILTER (WHERE side = 0), 0)::BIGINT AS buy_order_volume, coalesce(sum(volume) FILTER (WHERE side = 1), 0)::BIGINT AS sell_order_volume,
  count(*) FILTER (WHERE order_type = 5) AS cancel_count FROM v_order GROUP BY 1, 2)
SELECT * REPLACE (CAST(trade_date AS VARCHAR) AS trade_date),
  CASE WHEN buy_order_count + sell_order_count > 0 THEN buy_order_count / (buy_order_count + sell_order_count) END AS order_imbalance,
  CASE WHEN buy_order_volume + sell_order_volume > 0 THEN buy_order_volume / (buy_order_volume + sell_order_volume) END AS order_buy_vol_ratio,
  CAST(cancel_count AS DOUBLE) / order_count AS cancel_ratio FROM g""")
def a3(spark, sf):
    return st.order_state(view(spark, sf, "v_order")).drop("last_order_time").withColumn("trade_date", day())


def event_feeds(spark, sf):
    deal = view(spark, sf, "v_deal_ev").withColumn("amount", F.col("money_cents"))
    return view(spark, sf, "v_tick"), deal, view(spark, sf, "v_order")


_STATE = """
, k AS (SELECT DISTINCT trade_date, code FROM v_order),
t AS (SELECT trade_date, code, arg_min(current_price, seq_num) FILTER (WHERE current_price > 0) AS open, arg_max(current_price, seq_num) FILTER (WHERE current_price > 0) AS latest_price,
  max(current_price) FILTER (WHERE current_price > 0) AS high, min(current_price) FILTER (WHERE current_price > 0) AS low,
  arg_max(pre_close_price, seq_num) FILTER (WHERE pre_close_price > 0) AS pre_close, arg_max(ask_price1, seq_num) FILTER (WHERE ask_price1 > 0) AS ask1,
  arg_max(bid_price1, seq_num) FILTER (WHERE bid_price1 > 0) AS bid1, arg_max(ask_volume1, seq_num)::DOUBLE AS ask_volume1, arg_max(bid_volume1, seq_num)::DOUBLE AS bid_volume1,
  count(*) AS tick_count FROM v_tick GROUP BY 1, 2),
d AS (SELECT trade_date, code, count(*) AS deal_count, sum(money_cents)::DOUBLE AS cum_amount, sum(volume)::DOUBLE AS cum_volume FROM v_deal_ev GROUP BY 1, 2),
o AS (SELECT trade_date, code, count(*) AS order_count, count(*) FILTER (WHERE side = 0) AS buy_order_count, count(*) FILTER (WHERE side = 1) AS sell_order_count,
  coalesce(sum(volume) FILTER (WHERE side = 0), 0)::DOUBLE AS buy_order_volume, coalesce(sum(volume) FILTER (WHERE side = 1), 0)::DOUBLE AS sell_order_volume,
  count(*) FILTER (WHERE order_type = 5) AS cancel_count FROM v_order GROUP BY 1, 2),
s AS (SELECT k.trade_date, k.code, open, latest_price, high, low, pre_close, ask1, bid1, ask_volume1, bid_volume1, coalesce(tick_count, 0) AS tick_count,
  coalesce(deal_count, 0) AS deal_count, order_count, coalesce(cum_amount, 0.0)::DOUBLE AS cum_amount, coalesce(cum_volume, 0.0)::DOUBLE AS cum_volume, buy_order_count, sell_order_count,
  buy_order_volume, sell_order_volume, cancel_count
  FROM k LEFT JOIN t USING (trade_date, code) LEFT JOIN d USING (trade_date, code) LEFT JOIN o USING (trade_date, code))"""


@query("a4_full_state", "v_tick v_order v_deal_ev", _STATE + " SELECT * REPLACE (CAST(trade_date AS VARCHAR) AS trade_date) FROM s")
def a4(spark, sf):
    out = st.full_state(*event_feeds(spark, sf))
    return out.drop("last_tick_time", "last_deal_time", "last_order_time", "last_market_time").withColumn("trade_date", day())


_PACK = """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, code, coalesce(latest_price, 0.0)::DOUBLE AS latest_price, coalesce(high, 0.0)::DOUBLE AS high, coalesce(low, 0.0)::DOUBLE AS low,
  CASE WHEN pre_close > 0 AND latest_price > 0 THEN floor((latest_price - pre_close) / pre_close * 100 * 10000 + 0.5) / 10000 END AS change_pct,
  CASE WHEN ask1 > 0 AND bid1 > 0 THEN floor((ask1 - bid1) * 10000 + 0.5) / 10000 END AS spread,
  CASE WHEN high > low THEN floor((latest_price - low) / (high - low) * 10000 + 0.5) / 10000 ELSE 0.5 END AS price_pos,
  CASE WHEN coalesce(bid_volume1, 0) + coalesce(ask_volume1, 0) > 0 THEN floor(coalesce(bid_volume1, 0) / (coalesce(bid_volume1, 0) + coalesce(ask_volume1, 0)) * 10000 + 0.5) / 10000 ELSE 0.5 END AS buy_pressure,
  CASE WHEN cum_volume > 0 THEN floor(cum_amount / cum_volume * 10000 + 0.5) / 10000 END AS vwap, cum_volume AS total_vol, deal_count,
  CASE WHEN deal_count > 0 THEN floor(cum_volume / deal_count * 100 + 0.5) / 100 ELSE 0.0 END AS vol_ratio,
  CASE WHEN buy_order_count + sell_order_count > 0 THEN floor(buy_order_count / (buy_order_count + sell_order_count) * 10000 + 0.5) / 10000 END AS order_imbalance,
  CASE WHEN buy_order_volume + sell_order_volume > 0 THEN floor(buy_order_volume / (buy_order_volume + sell_order_volume) * 10000 + 0.5) / 10000 END AS order_buy_vol_ratio,
  CASE WHEN order_count > 0 THEN floor(CAST(cancel_count AS DOUBLE) / order_count * 10000 + 0.5) / 10000 END AS cancel_ratio, order_count FROM s"""


@query("ud9_factor_pack", "v_tick v_order v_deal_ev", _STATE + _PACK)
def ud9(spark, sf):
    return st.factor_pack(st.full_state(*event_feeds(spark, sf))).withColumn("trade_date", day())


@query("a5_bars_cumulative", "v_tick", """
SELECT code, epoch_us(time_bucket(INTERVAL 30 MINUTE, time)) AS time, arg_min(current_price, seq_num) AS open, max(current_price) AS high, min(current_price) AS low,
  arg_max(current_price, seq_num) AS close, arg_max(total_volume, seq_num) AS volume FROM v_tick GROUP BY code, time_bucket(INTERVAL 30 MINUTE, time)""")
def a5(spark, sf):
    return bars.resample(view(spark, sf, "v_tick"), 30).withColumn("time", US("time"))


@query("a5_bars_delta", "v_tick", """
SELECT code, epoch_us(time_bucket(INTERVAL 60 MINUTE, time)) AS time, arg_max(current_price, seq_num) AS close,
  arg_max(total_volume, seq_num) - arg_min(total_volume, seq_num) AS volume FROM v_tick GROUP BY code, time_bucket(INTERVAL 60 MINUTE, time)""")
def a5_delta(spark, sf):
    out = bars.resample(view(spark, sf, "v_tick"), 60, volume_mode="delta")
    return out.select("code", US("time"), "close", "volume")


@query("a10_duplicate_stats", "v_deal", """
, g AS (SELECT channel, code, seq_num, count(*) AS n FROM v_deal GROUP BY 1, 2, 3)
SELECT channel, sum(n)::BIGINT AS raw_rows, count(*) AS distinct_keys, sum(n - 1)::BIGINT AS duplicate_rows FROM g GROUP BY 1""")
def a10(spark, sf):
    return qual.duplicate_stats(view(spark, sf, "v_deal"), ["code", "seq_num"], ["channel"])


@query("a11_valid_rate", "v_daily", """
, f AS (SELECT trade_date, id_qi, CASE WHEN day(trade_date) % 6 = 0 AND volume > 100 THEN NULL ELSE close END AS a, CASE WHEN day(trade_date) % 6 = 0 THEN NULL ELSE open END AS b FROM v_daily),
g AS (SELECT trade_date, count(*) * 2 AS cells, (count(a) + count(b)) AS usable FROM f GROUP BY 1),
r AS (SELECT *, usable / cells AS valid_rate FROM g)
SELECT CAST(trade_date AS VARCHAR) AS trade_date, cells, usable, valid_rate,
  coalesce(valid_rate < 0.5 AND lag(valid_rate) OVER (ORDER BY trade_date) > 0.8, false) AS alert FROM r""")
def a11(spark, sf):
    hole = F.dayofmonth("trade_date") % 6 == 0
    df = view(spark, sf, "v_daily").select(
        "trade_date", F.when(~(hole & (F.col("volume") > 100)), F.col("close")).alias("F_a"),
        F.when(~hole, F.col("open")).alias("F_b"))
    out = qual.valid_rate(df, ["trade_date"])
    return out.select(day(), "cells", F.col("usable").cast("long").alias("usable"), "valid_rate", "alert")


_SLICES = """
, sl AS (SELECT CAST(i AS INTEGER) AS slice, CAST((i + 1) * 1800 - 1 AS INTEGER) AS end_second FROM range(48) r(i)),
tk AS (SELECT *, (epoch_us(time) - epoch_us(CAST(trade_date AS TIMESTAMP)))::DOUBLE / 1000000 AS sec FROM v_tick),
dl AS (SELECT *, (epoch_us(time) - epoch_us(CAST(trade_date AS TIMESTAMP)))::DOUBLE / 1000000 AS sec FROM v_deal_ev),
od AS (SELECT *, (epoch_us(time) - epoch_us(CAST(trade_date AS TIMESTAMP)))::DOUBLE / 1000000 AS sec FROM v_order),
t AS (SELECT trade_date, code, slice, arg_min(current_price, seq_num) FILTER (WHERE current_price > 0) AS open, arg_max(current_price, seq_num) FILTER (WHERE current_price > 0) AS latest_price,
  max(current_price) FILTER (WHERE current_price > 0) AS high, min(current_price) FILTER (WHERE current_price > 0) AS low,
  arg_max(pre_close_price, seq_num) FILTER (WHERE pre_close_price > 0) AS pre_close, arg_max(ask_price1, seq_num) FILTER (WHERE ask_price1 > 0) AS ask1,
  arg_max(ask_volume1, seq_num)::DOUBLE AS ask_volume1, count(*) AS tick_count FROM tk JOIN sl ON sec <= end_second GROUP BY 1, 2, 3),
d AS (SELECT trade_date, code, slice, count(*) AS deal_count, sum(money_cents)::DOUBLE AS cum_amount FROM dl JOIN sl ON sec <= end_second GROUP BY 1, 2, 3),
o AS (SELECT trade_date, code, slice, count(*) AS order_count, count(*) FILTER (WHERE side = 0) AS buy_order_count,
  count(*) FILTER (WHERE order_type = 5) AS cancel_count FROM od JOIN sl ON sec <= end_second GROUP BY 1, 2, 3)
SELECT CAST(o.trade_date AS VARCHAR) AS trade_date, o.code, o.slice, open, latest_price, high, low, pre_close, ask1, ask_volume1, tick_count,
  coalesce(deal_count, 0) AS deal_count, coalesce(cum_amount, 0.0)::DOUBLE AS cum_amount, order_count, buy_order_count, cancel_count
FROM o JOIN t USING (trade_date, code, slice) LEFT JOIN d USING (trade_date, code, slice)"""


def half_hours(spark):
    return spark.range(48).select(F.col("id").cast("int").alias("slice"), ((F.col("id") + 1) * 1800 - 1).cast("int").alias("end_second"))


@query("a12_multi_slice_state", "v_tick v_order v_deal_ev", _SLICES)
def a12(spark, sf):
    out = st.sliced_state(*event_feeds(spark, sf), half_hours(spark))
    return out.select(day(), "code", "slice", "open", "latest_price", "high", "low", "pre_close", "ask1", "ask_volume1",
                      "tick_count", "deal_count", "cum_amount", "order_count", "buy_order_count", "cancel_count")


@query("a16_unit_sanity", "v_tick", """
, l AS (SELECT code, arg_max(current_price, seq_num)::DOUBLE AS p, arg_max(pre_close_price, seq_num)::DOUBLE AS pc, arg_max(ask_price1, seq_num)::DOUBLE AS a, arg_max(bid_price1, seq_num) AS b,
  arg_max(ask_volume1, seq_num)::DOUBLE AS av, arg_max(bid_volume1, seq_num)::DOUBLE AS bv, arg_max(total_volume, seq_num) AS tv, arg_max(total_volume, seq_num) * arg_max(bid_price1, seq_num) AS tm FROM v_tick GROUP BY 1),
r AS (SELECT code, CASE WHEN p > 0 AND tv > 0 AND tm > 0 THEN tm / tv / p END AS implied_ratio, CASE WHEN p > 0 AND pc > 0 THEN p / pc - 1 END AS day_return,
  CASE WHEN p > 0 AND a > 0 THEN a / p END AS ask_ratio, CASE WHEN p > 0 AND b > 0 THEN b / p END AS bid_ratio, CASE WHEN av > 0 AND bv > 0 THEN av / bv END AS level_ratio, p, pc FROM l)
SELECT code, implied_ratio, day_return, ask_ratio, bid_ratio, level_ratio, coalesce(implied_ratio < 0.95 OR implied_ratio > 1.05, false) AS amount_unit_bad,
  coalesce(abs(day_return) > 0.15, false) AS price_drift, NOT (p > 0 AND pc > 0) AS pre_close_missing, coalesce(ask_ratio < 0.99 OR ask_ratio > 1.10, false) AS ask_bad,
  coalesce(bid_ratio < 0.90 OR bid_ratio > 1.01, false) AS bid_bad, coalesce(level_ratio < 0.001 OR level_ratio > 1000, false) AS level_volume_bad FROM r""")
def a16(spark, sf):
    df = view(spark, sf, "v_tick").withColumns({n: F.col(n).cast("double") for n in
                                                ("current_price", "pre_close_price", "ask_price1", "ask_volume1", "bid_volume1")})
    return qual.unit_sanity(df.withColumn("total_money", F.col("total_volume") * F.col("bid_price1")))


@query("a21_sequence_stats", "v_deal", """
, f AS (SELECT code, seq_num, lag(seq_num) OVER (PARTITION BY code ORDER BY time, money, seq_num) AS p FROM v_deal)
SELECT code, count(*) AS rows, count(DISTINCT seq_num) AS distinct_seq, count(*) - count(DISTINCT seq_num) AS duplicate_seq, min(seq_num) AS min_seq, max(seq_num) AS max_seq,
  sum(CASE WHEN seq_num < p THEN 1 ELSE 0 END)::BIGINT AS falls, sum(CASE WHEN seq_num < p THEN 1 ELSE 0 END) = 0 AS monotonic FROM f GROUP BY 1""")
def a21(spark, sf):
    deals = view(spark, sf, "v_deal").select("code", "seq_num", "time", "money")
    order = [F.col("time"), F.col("money"), F.col("seq_num")]
    return qual.sequence_stats(deals, ["code"], order, F.date_trunc("month", "time"))


@query("w1_dedupe_keep_first", "v_deal", """
, r AS (SELECT *, row_number() OVER (PARTITION BY code, seq_num ORDER BY time, buy_order_id, sale_order_id, money, volume, side) AS rn FROM v_deal)
SELECT code, seq_num, epoch_us(time) AS time, buy_order_id, sale_order_id, money, volume, side FROM r WHERE rn = 1""")
def w1(spark, sf):
    out = keep_first(view(spark, sf, "v_deal"), ["code", "seq_num"], [F.col(c) for c in DEAL_ORDER])
    return out.select("code", "seq_num", US("time"), "buy_order_id", "sale_order_id", "money", "volume", "side")


@query("w1_deduped_vwap", "v_deal", f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY code, seq_num ORDER BY time, buy_order_id, sale_order_id, money, volume, side) AS rn FROM v_deal)
SELECT CAST(trade_date AS VARCHAR) AS trade_date, code, count(*) AS n, sum(volume)::DOUBLE AS vol, CAST(sum({_CENTS}) AS BIGINT) / sum(volume) / 100 AS vwap FROM r WHERE rn = 1 GROUP BY 1, 2""")
def w1_vwap(spark, sf):
    first = keep_first(_cents(spark, sf), ["code", "seq_num"], [F.col(c) for c in DEAL_ORDER])
    out = st.deal_state(first, amount=F.col("cents"))
    return out.select(day(), "code", F.col("deal_count").alias("n"), F.col("cum_volume").cast("double").alias("vol"), (F.col("vwap") / 100).alias("vwap"))


@query("w2_momentum", "v_daily", """
, p AS (SELECT trade_date, id_qi AS code, CASE WHEN volume >= 600 THEN NULL ELSE close END AS close FROM v_daily),
n AS (SELECT *, count(close) OVER (PARTITION BY code ORDER BY trade_date) AS k FROM p),
v AS (SELECT code, k, close FROM n WHERE close IS NOT NULL)
SELECT CAST(n.trade_date AS VARCHAR) AS trade_date, n.code, a.close / nullif(b.close, 0) - 1 AS momentum FROM n LEFT JOIN v a ON a.code = n.code AND a.k = n.k LEFT JOIN v b ON b.code = n.code AND b.k = n.k - 5""")
def w2(spark, sf):
    panel = view(spark, sf, "v_daily").select("trade_date", F.col("id_qi").alias("code"), F.when(F.col("volume") < 600, F.col("close")).alias("close"))
    return fac.momentum(panel, 5).select(day(), "code", "momentum")


@query("w3_liquidity_mask", "v_daily", """
, m AS (SELECT trade_date, id_qi AS code, avg(amount_cents) OVER w AS mean_amount, count(amount_cents) OVER w AS n, close FROM v_daily WINDOW w AS (PARTITION BY id_qi ORDER BY trade_date ROWS 19 PRECEDING))
SELECT CAST(trade_date AS VARCHAR) AS trade_date, code, mean_amount, n AS amount_days, n >= 10 AND mean_amount >= 6000 AND close BETWEEN 2 AND 80 AS tradable FROM m""")
def w3(spark, sf):
    panel = view(spark, sf, "v_daily").select("trade_date", F.col("id_qi").alias("code"), F.col("amount_cents").alias("amount"), "close")
    out = fac.liquidity_mask(panel, window=20, min_days=10, min_amount=6000, price_band=(2, 80))
    return out.select(day(), "code", "mean_amount", "amount_days", "tradable")


@query("w5_latest_snapshot", "v_daily", """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, id_qi, close FROM v_daily WHERE trade_date = (SELECT max(trade_date) FROM v_daily)""")
def w5(spark, sf):
    return cal.latest_snapshot(view(spark, sf, "v_daily")).select(day(), "id_qi", "close")


@query("w6_sequence_gaps", "v_raw_feed", """
, g AS (SELECT msg_type, bs_flag, biz_index - lag(biz_index) OVER (PARTITION BY msg_type, bs_flag ORDER BY biz_index) - 1 AS gap FROM v_raw_feed)
SELECT msg_type, bs_flag, count(*) AS messages, coalesce(sum(greatest(gap, 0)), 0)::BIGINT AS missing, count(*) FILTER (WHERE gap > 0) AS gaps, coalesce(max(greatest(gap, 0)), 0) AS largest_gap FROM g GROUP BY 1, 2""")
def w6(spark, sf):
    return qual.sequence_gaps(view(spark, sf, "v_raw_feed"), ["msg_type", "bs_flag"], "biz_index", width=1000)


@query("w7_previous_day", "v_daily", """
, c AS (SELECT trade_date, lag(trade_date) OVER (ORDER BY trade_date) AS prev FROM (SELECT DISTINCT trade_date FROM v_daily))
SELECT CAST(d.trade_date AS VARCHAR) AS trade_date, d.id_qi, d.close, p.close AS prev_close FROM v_daily d JOIN c USING (trade_date) LEFT JOIN v_daily p ON p.trade_date = c.prev AND p.id_qi = d.id_qi""")
def w7(spark, sf):
    daily = view(spark, sf, "v_daily").select("trade_date", "id_qi", "close")
    return cal.previous_day_values(daily, cal.calendar(daily), ["id_qi"], ["close"]).select(day(), "id_qi", "close", "prev_close")


@query("w9_keep_current", "v_daily", """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, id_qi, CASE WHEN trade_date = DATE '2024-01-30' THEN close + 1 ELSE close END AS close FROM v_daily
UNION ALL SELECT '2024-01-31', id_qi, close + 1 FROM v_daily WHERE trade_date = DATE '2024-01-29'""")
def w9(spark, sf):
    history = view(spark, sf, "v_daily").select("trade_date", "id_qi", "close")
    today = history.where("trade_date = DATE '2024-01-30'").withColumn("close", F.col("close") + 1)
    tomorrow = history.where("trade_date = DATE '2024-01-29'").select(F.date_add("trade_date", 2).alias("trade_date"), "id_qi", (F.col("close") + 1).alias("close"))
    return pan.merge_current(history, today.unionByName(tomorrow), ["trade_date", "id_qi"]).select(day(), "id_qi", "close")


@query("t1_sequence_order", "v_tick", """
, s AS (SELECT trade_date, code, seq_num, current_price, lag(seq_num) OVER (PARTITION BY trade_date, code ORDER BY seq_num) AS prev FROM v_tick)
SELECT CAST(trade_date AS VARCHAR) AS trade_date, code, seq_num, CAST(prev AS DOUBLE) AS prev_seq FROM s""")
def t1(spark, sf):
    from tickloom.operators.keyed import previous_in_ranges
    ticks = view(spark, sf, "v_tick").select("trade_date", "code", "seq_num")
    out = previous_in_ranges(ticks, ["trade_date", "code"], F.floor(F.col("seq_num") / 1000), [F.col("seq_num")], "seq_num", "prev")
    return out.select(day(), "code", "seq_num", F.col("prev").cast("double").alias("prev_seq"))


@query("t4_ordered_sink", "v_daily", "SELECT count(*) AS rows, 0::BIGINT AS out_of_order FROM v_daily")
def t4(spark, sf):
    path = scratch_path(spark, "ordered")
    archive.write_ordered(view(spark, sf, "v_daily").orderBy(F.xxhash64("id_qi", "trade_date")), path, ["trade_date", "id_qi"])
    return archive.out_of_order(spark.read.parquet(path), ["trade_date", "id_qi"])


@query("q1_feed_validation", "v_order", """
, o AS (SELECT channel, seq_num, CASE WHEN code < '000100' THEN code || '.XSHE' ELSE code END AS code FROM v_order),
k AS (SELECT channel, seq_num, count(*) AS n, sum(CASE WHEN regexp_matches(code, '^(6[0-9]{5}\\.XSHG|[03][0-9]{5}\\.XSHE)$') THEN 0 ELSE 1 END) AS bad FROM o GROUP BY 1, 2)
SELECT sum(n)::BIGINT AS rows, 1 AS missing_columns, sum(n - 1)::BIGINT AS duplicate_rows, sum(bad)::BIGINT AS bad_codes, false AS valid FROM k""")
def q1(spark, sf):
    code = F.when(F.col("code") < "000100", F.concat("code", F.lit(".XSHE"))).otherwise(F.col("code"))
    return feeds.validate_feed(view(spark, sf, "v_order").withColumn("code", code), "order")


@query("q2_date_consistency", "v_deal", """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, count(*) AS rows, count(*) FILTER (WHERE CAST(time AS DATE) <> trade_date) AS other_day,
  count(*) FILTER (WHERE year(time) = 1970) AS epoch_day FROM v_deal GROUP BY 1""")
def q2(spark, sf):
    return qual.date_mismatches(view(spark, sf, "v_deal"), ["trade_date"]).withColumn("trade_date", day())


@query("q3_archive_check", "v_deal", """
, s AS (SELECT code, seq_num, time, money AS u, row_number() OVER (PARTITION BY code, seq_num ORDER BY time, money) AS rn FROM v_deal),
d AS (SELECT code, seq_num, max(time) AS time, min(money) AS u FROM v_deal GROUP BY 1, 2)
SELECT (SELECT count(*) FROM s WHERE rn = 1) AS src_rows, (SELECT count(*) FROM d) AS dst_rows, count(*) AS rows_checked,
  sum(CASE WHEN d.time <> s.time THEN 1 ELSE 0 END)::BIGINT AS time_bad, sum(CASE WHEN d.u <> s.u THEN 1 ELSE 0 END)::BIGINT AS update_bad,
  sum(CASE WHEN d.time <> s.time OR d.u <> s.u THEN 1 ELSE 0 END) = 0 AS valid
FROM d JOIN s ON s.code = d.code AND s.seq_num = d.seq_num AND s.rn = 1""")
def q3(spark, sf):
    deals = view(spark, sf, "v_deal").withColumn("update_time", F.col("money"))
    # An archive that kept the wrong copy of duplicated rows, to see the check count.
    archived = deals.groupBy("code", "seq_num").agg(F.max("time").alias("time"), F.min("update_time").alias("update_time"))
    return qual.archive_check(deals, archived)


@query("ud6_slice_labels", "v_tick", """
, g AS (SELECT unnest(generate_series(33900, 41399, 60)) AS s UNION ALL SELECT unnest(generate_series(46800, 53999, 60))),
l AS (SELECT row_number() OVER (ORDER BY s) - 1 AS slice, s, lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS end_time FROM g),
t AS (SELECT (epoch_us(time) - epoch_us(CAST(trade_date AS TIMESTAMP)))::DOUBLE / 1000000 AS sec FROM v_tick)
SELECT l.slice::INTEGER AS slice, l.end_time, count(t.sec) AS rows FROM l LEFT JOIN t ON t.sec <= l.s AND t.sec > l.s - 60 GROUP BY 1, 2""")
def ud6(spark, sf):
    slices = times.slice_dimension(spark, 60)
    second = F.ceil(times.seconds_of_day(F.col("time"))).cast("int")
    minute = (F.ceil(second / 60) * 60).cast("int").alias("end_second")
    per = view(spark, sf, "v_tick").groupBy(minute).agg(F.count("*").alias("rows"))
    return slices.join(per, "end_second", "left").select("slice", "end_time", F.coalesce("rows", F.lit(0)).alias("rows"))


@query("ud10_slice_count", "v_daily", "SELECT CAST(trade_date AS VARCHAR) AS trade_date, id_qi AS code, 245::BIGINT AS end_time_count FROM v_daily")
def ud10(spark, sf):
    slices = times.slice_dimension(spark, 60).agg(F.count("*")).scalar()
    return view(spark, sf, "v_daily").select(day(), F.col("id_qi").alias("code"), slices.alias("end_time_count"))
