"""Orders and portfolio tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import values
from tickloom.operators import portfolio as pf
from tickloom.operators import scoring as sc
from tickloom.operators.keyed import top_n
from tickloom.plans.registry import query
from tickloom.plans.views import view

KEYS = ["account_id"]
BOOK = "v_book_target v_book_position v_account v_price"

_ORDERS = """
, held AS (SELECT account_id, code, sum(current_volume) AS hv, sum(available_volume) AS av, max(last_price) AS bp, sum(current_volume * last_price) AS bval FROM v_book_position GROUP BY 1, 2),
j AS (SELECT coalesce(t.account_id, h.account_id) AS account_id, coalesce(t.code, h.code) AS code, coalesce(t.position, 0.0) AS w, t.code IS NOT NULL AS is_t, h.hv, coalesce(h.av, 0) AS av, h.bp, h.bval
  FROM v_book_target t FULL JOIN held h ON t.account_id = h.account_id AND t.code = h.code),
k AS (SELECT j.*, a.total_asset AS cap, CASE WHEN q.price > 0 THEN q.price END AS live, q.high_limit, j.account_id IN (SELECT account_id FROM held) AS booked
  FROM j JOIN v_account a ON a.account_id = j.account_id LEFT JOIN v_price q ON q.code = j.code),
m AS (SELECT *, coalesce(live, bp) AS price, CASE WHEN booked THEN coalesce(hv * live, bval, 0) / cap ELSE 0.0 END AS cur FROM k),
n AS (SELECT *, w - cur AS delta, cap * abs(w - cur) / price AS raw, code LIKE '688%' OR code LIKE '689%' AS star FROM m
  WHERE price IS NOT NULL AND (is_t OR (booked AND av > 0))),
s AS (SELECT *, CASE WHEN star AND delta >= 0 THEN CASE WHEN floor(raw) < 200 THEN 0 ELSE floor(raw) END WHEN star THEN floor(raw) ELSE floor(raw / 100) * 100 END AS sized,
  CASE WHEN star THEN av ELSE av // 100 * 100 END AS sellable FROM n),
v AS (SELECT *, CAST(CASE WHEN NOT booked OR delta >= 0 THEN sized WHEN w <= 0 THEN sellable ELSE least(sized, sellable) END AS BIGINT) AS volume FROM s),
ord AS (SELECT account_id, code, CASE WHEN delta > 0 THEN 'buy' ELSE 'sell' END AS side, volume, price FROM v WHERE volume > 0 AND delta <> 0
  AND NOT (delta > 0 AND coalesce(hv, 0) <= 0 AND high_limit > 0 AND price >= high_limit - 1e-6))"""


def book_orders(spark, sf):
    return pf.positions_to_orders(
        view(spark, sf, "v_book_target"), view(spark, sf, "v_book_position"), view(spark, sf, "v_account"),
        view(spark, sf, "v_price"), KEYS)


@query("o1_positions_to_orders", BOOK, _ORDERS + " SELECT account_id, code, side, volume, price FROM ord")
def o1(spark, sf):
    return book_orders(spark, sf).select("account_id", "code", "side", "volume", "price")


@query("o1_unpriced_targets", BOOK, """
SELECT DISTINCT t.account_id, t.code AS code6 FROM v_book_target t LEFT JOIN v_price q ON q.code = t.code AND q.price > 0
LEFT JOIN v_book_position p ON p.account_id = t.account_id AND p.code = t.code AND p.last_price > 0 WHERE q.code IS NULL AND p.code IS NULL""")
def o1_unpriced(spark, sf):
    return pf.unpriced_targets(view(spark, sf, "v_book_target"), view(spark, sf, "v_book_position"), view(spark, sf, "v_price"), KEYS)


@query("o1_limit_up_report", BOOK, _ORDERS + """
 SELECT account_id, code, volume, price FROM v WHERE volume > 0 AND delta > 0 AND coalesce(hv, 0) <= 0 AND high_limit > 0 AND price >= high_limit - 1e-6""")
def o1_blocked(spark, sf):
    out = pf.limit_up_buys(view(spark, sf, "v_book_target"), view(spark, sf, "v_book_position"), view(spark, sf, "v_account"),
                           view(spark, sf, "v_price"), KEYS)
    return out.select("account_id", "code", "volume", "price")


_TOP = """
, r AS (SELECT account_id, code AS code6, position, pred, row_number() OVER (PARTITION BY account_id ORDER BY abs(position) DESC, pred DESC, code) AS rn FROM v_book_target WHERE position <> 0)"""


@query("t2_top_orders", "v_book_target", _TOP + " SELECT account_id, code6, position, pred, rn FROM r WHERE rn <= 10")
def t2(spark, sf):
    rows = view(spark, sf, "v_book_target").where("position <> 0").withColumnRenamed("code", "code6")
    out = top_n(rows, KEYS, [F.desc(F.abs("position")), F.desc("pred"), F.col("code6")], 10)
    return out.select("account_id", "code6", "position", "pred", F.col("_rank").cast("long").alias("rn"))


@query("o2_model_orders", BOOK, _TOP + """
, h AS (SELECT account_id, code AS code6, sum(current_volume)::BIGINT AS cv FROM v_book_position WHERE current_volume > 0 GROUP BY 1, 2),
z AS (SELECT r.*, coalesce(CASE WHEN q.price > 0 THEN q.price END, 10.0) AS price, coalesce(h.cv, 0) AS cv, a.total_asset AS cap FROM r JOIN v_account a USING (account_id)
  LEFT JOIN v_price q ON q.code = r.code6 LEFT JOIN h ON h.account_id = r.account_id AND h.code6 = r.code6 WHERE rn <= 10),
t AS (SELECT *, CAST(floor(greatest(position, 0) * cap / price / 100) * 100 AS BIGINT) AS tv FROM z),
d AS (SELECT *, CASE WHEN tv > cv THEN 'buy' ELSE 'sell' END AS side, abs(tv - cv) // 100 * 100 AS dv FROM t WHERE tv <> cv),
e AS (SELECT *, CASE WHEN side = 'sell' THEN least(dv, cv // 100 * 100) ELSE dv END AS volume FROM d)
SELECT account_id, CASE WHEN code6 LIKE '6%' THEN 'SH' ELSE 'SZ' END || code6 AS code, side, volume, tv AS target_volume, cv AS current_volume FROM e WHERE volume > 0""")
def o2(spark, sf):
    c6 = lambda n: view(spark, sf, n).withColumnRenamed("code", "code6")
    quotes = c6("v_price").select("code6", F.col("price").alias("last_price"))
    out = sc.model_orders(c6("v_book_target"), c6("v_book_position"), view(spark, sf, "v_account"), quotes, KEYS)
    return out.select("account_id", "code", "side", "volume", "target_volume", "current_volume")


@query("o3_redistribute_limit_up", BOOK, """
, m AS (SELECT t.account_id, t.code, t.position, p.code IS NULL AND coalesce(q.high_limit, 0) > 0 AND q.price > 0 AND q.price >= q.high_limit AS gone FROM v_book_target t
  LEFT JOIN (SELECT DISTINCT account_id, code FROM v_book_position) p ON p.account_id = t.account_id AND p.code = t.code LEFT JOIN v_price q ON q.code = t.code),
s AS (SELECT account_id, sum(position) AS before, sum(CASE WHEN gone THEN 0 ELSE position END) AS after FROM m GROUP BY 1)
SELECT m.account_id, m.code AS code6, CASE WHEN before <> after AND after > 0 THEN position * (before / after) ELSE position END AS position FROM m JOIN s USING (account_id) WHERE NOT gone""")
def o3(spark, sf):
    c6 = lambda n: view(spark, sf, n).withColumnRenamed("code", "code6")
    return pf.redistribute_limit_up(c6("v_book_target").select("account_id", "code6", "position"), c6("v_book_position"), c6("v_price"), KEYS)


@query("o4_turnover_budget", "v_book_position v_account", """
, g AS (SELECT a.account_id, a.total_asset AS total, coalesce(sum(p.current_volume), 0)::DOUBLE / 1048576 AS gross, (a.account_id - 5)::DOUBLE * 8192 AS flow FROM v_account a
  LEFT JOIN v_book_position p USING (account_id) GROUP BY 1, 2)
SELECT account_id, CASE WHEN flow <= 0 THEN 0.375 ELSE least(1.0, greatest(0.375, least((1.0 - least(gross, 1.0)) + 0.0625, 0.375 + least(flow / total, 1.0)))) END::DOUBLE AS budget FROM g""")
def o4(spark, sf):
    held = view(spark, sf, "v_book_position").groupBy("account_id").agg(F.sum("current_volume").alias("v"))
    rows = view(spark, sf, "v_account").join(held, "account_id", "left").select(
        "account_id", "total_asset", (F.coalesce("v", F.lit(0)) / F.lit(1048576.0)).alias("gross"),
        ((F.col("account_id") - 5) * F.lit(8192.0)).alias("flow"))
    budget = values.turnover_budget(F.col("gross"), F.col("flow"), F.col("total_asset"), F.lit(0.375), F.lit(0.0625))
    return rows.select("account_id", budget.alias("budget"))


@query("o5_standard_account", "v_account", """
SELECT account_id, CASE WHEN account_id % 2 = 0 THEN total_asset END AS total_asset, total_asset - available_cash AS market_value,
  CASE WHEN account_id % 3 = 0 THEN 7.5 ELSE available_cash END::DOUBLE AS available_cash FROM v_account""")
def o5_account(spark, sf):
    c = F.col
    raw = view(spark, sf, "v_account").select(
        "account_id", F.when(c("account_id") % 2 == 0, c("total_asset").cast("string")).otherwise("n/a").alias("AssetAmt"),
        (c("total_asset") - c("available_cash")).cast("string").alias("MarketAmt"),
        F.when(c("account_id") % 3 != 0, c("available_cash").cast("string")).alias("EnBalance"), F.lit("7.5").alias("CrBalance"))
    return pf.standardise_account(raw, ["account_id"])


@query("o5_standard_positions", "v_book_position", """
SELECT account_id, CASE WHEN code LIKE '6%' THEN code || '.SH' WHEN code LIKE '0%' OR code LIKE '3%' THEN code || '.SZ' ELSE code END AS code,
  current_volume, available_volume, last_price, CAST(NULL AS DOUBLE) AS pnl FROM v_book_position""")
def o5(spark, sf):
    raw = view(spark, sf, "v_book_position").select(
        "account_id", F.concat(F.lit(" "), "code").alias("symbol"), F.col("current_volume").cast("string").alias("qty"),
        F.col("available_volume").alias("available_qty"), "last_price")
    return pf.standardise_positions(raw, KEYS).select("account_id", "code", "current_volume", "available_volume", "last_price", "pnl")


_VALUED = """
, v AS (SELECT p.account_id, p.code, coalesce(p.last_price, CASE WHEN q.price > 0 THEN q.price END) AS last_price, p.current_volume FROM v_book_position p LEFT JOIN v_price q ON q.code = p.code),
mv AS (SELECT *, coalesce(last_price, 0) * current_volume AS market_value FROM v)"""


def _valued(spark, sf):
    positions = view(spark, sf, "v_book_position").withColumn("market_value", F.lit(None).cast("double"))
    return pf.value_positions(positions, view(spark, sf, "v_price"))


@query("o6_value_positions", BOOK, _VALUED + " SELECT account_id, code, last_price, market_value FROM mv")
def o6(spark, sf):
    return _valued(spark, sf).select("account_id", "code", "last_price", "market_value")


@query("o6_value_accounts", BOOK, _VALUED + """
, t AS (SELECT account_id, sum(market_value) AS held FROM mv GROUP BY 1)
SELECT a.account_id, CASE WHEN a.account_id % 3 = 0 AND t.held > 0 THEN t.held WHEN a.account_id % 3 = 0 THEN 0.0 ELSE total_asset END AS total_asset,
  CASE WHEN t.held > 0 THEN t.held END AS market_value, available_cash FROM v_account a LEFT JOIN t USING (account_id)""")
def o6_accounts(spark, sf):
    account = view(spark, sf, "v_account").withColumn("market_value", F.lit(None).cast("double")).withColumn(
        "total_asset", F.when(F.col("account_id") % 3 == 0, 0.0).otherwise(F.col("total_asset")))
    return pf.value_accounts(account, _valued(spark, sf), KEYS)


@query("o7_paper_roll", BOOK, """
, px AS (SELECT code, price FROM v_price WHERE high_limit > 0),
b AS (SELECT coalesce(t.account_id, p.account_id) AS account_id, coalesce(t.code, p.code) AS code, t.position AS w, p.current_volume AS q, p.last_price AS lp, t.code IS NOT NULL AS is_t
  FROM v_book_target t FULL JOIN v_book_position p ON t.account_id = p.account_id AND t.code = p.code),
c AS (SELECT b.*, coalesce(px.price, 0.0) AS price FROM b LEFT JOIN px ON px.code = b.code)
SELECT account_id, code, coalesce(w, 0.0) AS weight, CASE WHEN is_t THEN price ELSE coalesce(lp, 0.0) END AS last_price,
  CAST(CASE WHEN NOT is_t THEN q WHEN price > 0 THEN floor(w * 4000000 / price / 100) * 100 ELSE 0 END AS BIGINT) AS qty
FROM c WHERE is_t OR (price <= 0 AND coalesce(q, 0) >= 100)""")
def o7(spark, sf):
    c6 = lambda n: view(spark, sf, n).withColumnRenamed("code", "code6")
    previous = c6("v_book_position").withColumnRenamed("current_volume", "qty")
    return pf.roll_paper_positions(c6("v_book_target"), previous, c6("v_price").where("high_limit > 0"), KEYS, 4_000_000.0)


@query("o8_gateway_orders", BOOK, _ORDERS + """
, g AS (SELECT account_id, CASE WHEN code LIKE '6%' THEN code || '.SH' WHEN code LIKE '0%' OR code LIKE '3%' THEN code || '.SZ' ELSE code END AS symbol, side, volume,
  CASE WHEN volume > 500 THEN 'slices=3:max=' || CAST(volume AS VARCHAR) ELSE 'slices=2' END AS algo_param FROM ord)
SELECT account_id, 'open_' || substr(md5(concat_ws('|', '20240131', '093000', symbol, side, CAST(volume AS VARCHAR), 'sim', 'open', 'vwap', algo_param)), 1, 12) AS order_id,
  symbol, side, volume, 'open_20240131093000_' || symbol || '_' || side AS note, algo_param FROM g""")
def o8(spark, sf):
    big = F.concat(F.lit("slices=3; Price=9.9;max="), F.col("volume").cast("string"))
    orders = book_orders(spark, sf).withColumn("strategy", F.lit("open")).withColumn(
        "algo_param", F.when(F.col("volume") > 500, big).otherwise("slices=2"))
    out = pf.gateway_orders(orders, F.lit("20240131"), F.lit("093000"), "sim", "vwap", KEYS)
    return out.select("account_id", "order_id", "symbol", "side", "volume", "note", "algo_param")


@query("o9_order_words", "v_order", """
SELECT seq_num, CASE side WHEN 0 THEN 'buy' WHEN 1 THEN 'sell' ELSE '' END AS order_side, CASE WHEN order_type = 5 THEN 0 ELSE volume END::BIGINT AS order_volume FROM v_order""")
def o9(spark, sf):
    c = F.col
    words = F.when(c("side") == 0, F.element_at(F.array(F.lit(" Buy"), F.lit("买入"), F.lit("23")), (c("seq_num") % 3 + 1).cast("int"))).when(
        c("side") == 1, F.element_at(F.array(F.lit("S"), F.lit("short"), F.lit("卖")), (c("seq_num") % 3 + 1).cast("int"))).otherwise("hold")
    raw = view(spark, sf, "v_order").select("seq_num", words.alias("action"), F.when(c("order_type") == 5, F.lit("none")).otherwise(
        F.concat(c("volume").cast("string"), F.lit(".9"))).alias("qty"))
    return pf.normalise_orders(raw).select("seq_num", "order_side", "order_volume")


@query("o10_flatten_all", "v_book_position", "SELECT account_id, code, 'sell' AS side, available_volume AS volume FROM v_book_position WHERE available_volume > 0")
def o10(spark, sf):
    return pf.flatten_all(view(spark, sf, "v_book_position"), KEYS).select("account_id", "code", "side", "volume")


@query("o11_deal_latency", "v_target v_deal_ev v_tick", """
, p AS (SELECT DISTINCT account_id, code, 36000.0::DOUBLE AS push FROM v_target), f AS (SELECT code, max(latency_ms) AS ms FROM v_tick WHERE latency_ms > 100 AND latency_ms < 60000 GROUP BY 1),
d AS (SELECT code, seq_num, 35990 + (seq_num % 256)::DOUBLE AS deal FROM v_deal_ev),
t AS (SELECT p.account_id, p.code, d.deal, d.deal - (push - 6.0 - coalesce(f.ms, 1000) / 1000) AS lat FROM p JOIN d ON d.code = p.code LEFT JOIN f ON f.code = p.code),
l AS (SELECT account_id, code, max(lat) AS lat FROM t WHERE lat > 0 AND lat < 180 GROUP BY 1, 2)
SELECT account_id, count(*) AS deals, floor(max(lat) * 1000 + 0.5) / 1000 AS max_latency, floor(sum(lat) * 1000 + 0.5) / 1000 AS total_latency FROM l GROUP BY 1""")
def o11(spark, sf):
    code6 = F.col("code").alias("code6")
    pushed = view(spark, sf, "v_target").select("account_id", code6, F.lit(36000.0).alias("push_sec"))
    moment = (F.lit(35990) + F.col("seq_num") % 256).cast("double")
    deals = view(spark, sf, "v_deal_ev").select(code6, moment.alias("deal_sec")).join(pushed.select("account_id", "code6").distinct(), "code6")
    out = pf.deal_latency(pushed, deals, view(spark, sf, "v_tick").select(code6, "latency_ms"), KEYS)
    return out.select("account_id", "deals", values.round_to(F.col("max_latency"), 3).alias("max_latency"),
                      values.round_to(F.col("total_latency"), 3).alias("total_latency"))


@query("o12_limit_prices", "v_price v_book_position", """
, t AS (SELECT code, max(last_price) AS hl, min(last_price) AS ll FROM v_book_position GROUP BY 1)
SELECT coalesce(d.code, t.code) AS code, coalesce(CASE WHEN d.high_limit > 0 THEN d.high_limit END, t.hl, 0.0)::DOUBLE AS high_limit, coalesce(t.ll, 0.0) AS low_limit
FROM v_price d FULL JOIN t ON t.code = d.code WHERE coalesce(CASE WHEN d.high_limit > 0 THEN d.high_limit END, t.hl, 0.0) > 0 OR coalesce(t.ll, 0.0) > 0""")
def o12(spark, sf):
    daily = view(spark, sf, "v_price").select("code", F.col("high_limit").cast("double").alias("high_limit"), F.lit(0.0).alias("low_limit"))
    tick = view(spark, sf, "v_book_position").groupBy("code").agg(F.max("last_price").alias("high_limit"), F.min("last_price").alias("low_limit"))
    return pf.limit_prices(daily, tick)


@query("o12_fallback_limits", "v_price", """
SELECT code, CASE WHEN high_limit > 0 THEN high_limit ELSE floor(price * (1 + 0.1) * 100 + 0.5) / 100 END::DOUBLE AS high_limit, floor(price * (1 - 0.1) * 100 + 0.5) / 100 AS low_limit FROM v_price""")
def o12_fallback(spark, sf):
    df = view(spark, sf, "v_price").select("code", F.col("high_limit").cast("double").alias("high_limit"), F.lit(0.0).alias("low_limit"), F.col("price").alias("pre_close"))
    return pf.fallback_limits(df).select("code", "high_limit", "low_limit")


@query("a15_budget_check", BOOK, _ORDERS + """
, bs AS (SELECT account_id, coalesce(sum(CASE WHEN side = 'buy' THEN volume * price END), 0.0) AS b, coalesce(sum(CASE WHEN side = 'sell' THEN volume * price END), 0.0) AS sl FROM ord GROUP BY 1)
SELECT account_id, b AS buy_amount, sl AS sell_amount, available_cash + sl * 0.9::DOUBLE AS budget, greatest(b - (available_cash + sl * 0.9::DOUBLE), 0.0) AS excess,
  b > available_cash + sl * 0.9::DOUBLE AS over_budget FROM bs JOIN v_account USING (account_id)""")
def a15(spark, sf):
    out = pf.budget_check(book_orders(spark, sf), view(spark, sf, "v_account"), KEYS)
    return out.select("account_id", "buy_amount", "sell_amount", "budget", "excess", "over_budget")


@query("a20_position_totals", "v_book_position v_account", """
, p AS (SELECT account_id, substr(code, 1, 3) || '000' AS code6, current_volume, available_volume, last_price FROM v_book_position)
SELECT account_id, code6, sum(current_volume)::DOUBLE AS held_volume, sum(available_volume)::DOUBLE AS available_volume, coalesce(sum(current_volume * last_price), 0.0) AS held_value FROM p GROUP BY 1, 2""")
def a20(spark, sf):
    positions = view(spark, sf, "v_book_position").withColumn("code", F.concat(F.substring("code", 1, 3), F.lit("000.SZ")))
    out = pf.aggregate_positions(positions, KEYS)
    return out.select("account_id", "code6", "held_volume", "available_volume", F.coalesce("_broker_value", F.lit(0.0)).alias("held_value"))


@query("a20_invested_fraction", BOOK, _VALUED + """
SELECT account_id, sum(market_value) AS held_value, count(*) AS holdings, sum(market_value) / any_value(total_asset) AS invested FROM mv JOIN v_account USING (account_id) GROUP BY 1""")
def a20_invested(spark, sf):
    return pf.invested_fraction(_valued(spark, sf), view(spark, sf, "v_account"), KEYS).drop("total_asset")
