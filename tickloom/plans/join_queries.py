"""Joins, index membership, backfills and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import codes
from tickloom.operators import calendar as cal
from tickloom.operators import membership as mem
from tickloom.operators import panel as pan
from tickloom.operators import portfolio as pf
from tickloom.operators import reconcile as rec
from tickloom.operators.keyed import latest_per_key
from tickloom.plans.registry import query
from tickloom.plans.views import day, view
from tickloom.sources import vendor


def text_date(name, alias=None):
    return F.col(name).cast("string").alias(alias or name)


def _coded_daily(spark, sf):
    return view(spark, sf, "v_daily").withColumnRenamed("id_qi", "code")


@query("j1_panel_join", "v_daily v_security v_tick", """
, adj AS (SELECT security_id, trade_date, close * 2 AS adj_close FROM v_daily WHERE volume >= 200),
ex AS (SELECT security_id, trade_date, max(latency_ms) AS beta FROM v_tick WHERE event_type = 'click' GROUP BY 1, 2),
ix AS (SELECT trade_date, max(high) AS idx_close FROM v_daily WHERE trade_date <> DATE '2024-01-07' GROUP BY 1)
SELECT CAST(d.trade_date AS VARCHAR) AS trade_date, d.security_id, d.close, adj.adj_close, s.industry,
       CAST(ex.beta AS DOUBLE) AS beta, ix.idx_close
FROM v_daily d JOIN adj USING (security_id, trade_date) LEFT JOIN v_security s USING (security_id)
LEFT JOIN ex USING (security_id, trade_date) LEFT JOIN ix USING (trade_date)""")
def j1(spark, sf):
    daily = view(spark, sf, "v_daily")
    adjusted = daily.where("volume >= 200").select("security_id", "trade_date", (F.col("close") * 2).alias("adj_close"))
    exposure = view(spark, sf, "v_tick").where("event_type = 'click'").groupBy("security_id", "trade_date").agg(
        F.max("latency_ms").cast("double").alias("beta"))
    index = daily.where("trade_date <> DATE '2024-01-07'").groupBy("trade_date").agg(F.max("high").alias("idx_close"))
    out = pan.build_panel(daily, adjusted, view(spark, sf, "v_security").select("security_id", "industry"), exposure, index)
    return out.select(day(), "security_id", "close", "adj_close", "industry", "beta", "idx_close")


@query("j2_index_row_attach", "v_daily", """
SELECT CAST(d.trade_date AS VARCHAR) AS trade_date, d.id_qi, d.close, i.idx FROM v_daily d
LEFT JOIN (SELECT trade_date, sum(volume)::BIGINT AS idx FROM v_daily WHERE trade_date > DATE '2024-01-03' GROUP BY 1) i USING (trade_date)
WHERE i.idx IS NOT NULL OR d.trade_date <= DATE '2024-01-03'""".replace("i.idx FROM", "CAST(i.idx AS DOUBLE) AS idx FROM"))
def j2(spark, sf):
    daily = view(spark, sf, "v_daily")
    index = daily.where("trade_date > DATE '2024-01-03'").groupBy("trade_date").agg(F.sum("volume").cast("double").alias("idx"))
    out = pan.build_panel(daily.select("trade_date", "security_id", "id_qi"), daily.select("trade_date", "security_id", "close"),
                          view(spark, sf, "v_security").select("security_id"), index_rows=index)
    return out.select(day(), "id_qi", "close", "idx")


_CAL = """
, days AS (SELECT DISTINCT trade_date FROM v_daily),
cal AS (SELECT trade_date, lag(trade_date) OVER (ORDER BY trade_date) AS prev, lag(trade_date, 2) OVER (ORDER BY trade_date) AS prev2 FROM days)"""


@query("j3_membership_in_time", "v_daily v_idx_cons", _CAL + """
SELECT CAST(c.trade_date AS VARCHAR) AS trade_date, m.index_code, m.cons_id FROM cal c JOIN v_idx_cons m
ON m.into_date <= c.trade_date AND (m.out_date IS NULL OR m.out_date > c.trade_date)""")
def j3(spark, sf):
    days = cal.settled_calendar(view(spark, sf, "v_daily"))
    return mem.members_in_time(view(spark, sf, "v_idx_cons"), days).select(day(), "index_code", "cons_id")


@query("j3_newest_members", "v_idx_cons", """
SELECT index_code, index_exchange, cons_id FROM v_idx_cons WHERE out_date IS NULL""")
def j3_newest(spark, sf):
    log = view(spark, sf, "v_idx_cons").withColumn("is_new", F.when(F.col("out_date").isNull(), 1).otherwise(0))
    return mem.current_members(log).select("index_code", "index_exchange", "cons_id")


@query("j4_asof_close", "v_daily", _CAL + """
, x AS (SELECT c.trade_date, p.security_id, p.close, p.trade_date AS price_date,
   row_number() OVER (PARTITION BY c.trade_date, p.security_id ORDER BY p.trade_date DESC) AS rn
   FROM cal c JOIN v_daily p ON p.trade_date IN (coalesce(c.prev, c.trade_date), coalesce(c.prev2, c.prev, c.trade_date)))
SELECT CAST(trade_date AS VARCHAR) AS trade_date, security_id, close, CAST(price_date AS VARCHAR) AS price_date FROM x WHERE rn = 1""")
def j4(spark, sf):
    daily = view(spark, sf, "v_daily")
    out = mem.newest_close(daily.select("trade_date", "security_id", "close"), cal.calendar(daily))
    return out.select(day(), "security_id", "close", text_date("price_date"))


_SHARES = """
, sh AS (SELECT c.trade_date, s.security_id, f.free_shares, f.change_date,
   row_number() OVER (PARTITION BY c.trade_date, f.party_id ORDER BY f.change_date DESC, f.tie DESC) AS rn
   FROM cal c JOIN v_free_shares f ON f.change_date <= coalesce(c.prev, c.trade_date) JOIN v_security s ON s.party_id = f.party_id)"""


@query("j5_asof_free_shares", "v_daily v_free_shares v_security", _CAL + _SHARES + """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, security_id, free_shares, CAST(change_date AS VARCHAR) AS change_date FROM sh WHERE rn = 1""")
def j5(spark, sf):
    days = cal.settled_calendar(view(spark, sf, "v_daily"))
    out = mem.free_shares_asof(view(spark, sf, "v_free_shares"), days, view(spark, sf, "v_security"))
    return out.select(day(), "security_id", "free_shares", text_date("change_date"))


def _coded_security(spark, sf):
    return view(spark, sf, "v_security").select("id_qi", "exchange_cd", "security_id")


@query("j6_code_map", "v_tick v_security", """
SELECT t.seq_num, t.code || '.XSHG' AS code, s.security_id FROM v_tick t JOIN v_security s ON s.id_qi = t.code AND s.exchange_cd = 'XSHG'""")
def j6(spark, sf):
    ticks = view(spark, sf, "v_tick").select("seq_num", F.concat("code", F.lit(".XSHG")).alias("code"))
    return mem.map_codes(ticks, _coded_security(spark, sf)).select("seq_num", "code", "security_id")


@query("j7_panel_enrich", "v_daily v_tick", """
, f AS (SELECT trade_date, code, max(current_price) AS close, count(*) AS n FROM v_tick GROUP BY 1, 2)
SELECT CAST(f.trade_date AS VARCHAR) AS trade_date, f.code, f.close, f.n, d.close AS close_market, d.volume
FROM f LEFT JOIN v_daily d ON d.trade_date = f.trade_date AND d.id_qi = f.code""")
def j7(spark, sf):
    factors = view(spark, sf, "v_tick").groupBy("trade_date", "code").agg(
        F.max("current_price").cast("double").alias("close"), F.count("*").alias("n"))
    panel = _coded_daily(spark, sf).select("trade_date", "code", "close", "volume")
    return pan.attach_new_columns(factors, panel, ["trade_date", "code"], "_market").select(
        day(), "code", "close", "n", "close_market", "volume")


@query("j8_universe_enrich", "v_daily v_security", """
, c AS (SELECT DISTINCT id_qi FROM v_daily)
SELECT c.id_qi || '.XSHE' AS code, c.id_qi, s.security_id, s.industry FROM c LEFT JOIN v_security s USING (id_qi)""")
def j8(spark, sf):
    wanted = view(spark, sf, "v_daily").select(F.concat("id_qi", F.lit(".XSHE")).alias("code")).distinct()
    panel = view(spark, sf, "v_daily").select("id_qi", "security_id").join(
        view(spark, sf, "v_security").select("security_id", "industry"), "security_id")
    return pan.universe_frame(wanted, panel, ["security_id", "industry"])


@query("j9_outer_reconcile", "v_tick v_order", """
, l AS (SELECT code, seq_num, current_price AS v FROM v_tick WHERE event_type <> 'view'),
r AS (SELECT code, seq_num, price AS v FROM v_order WHERE side <> 0)
SELECT coalesce(l.code, r.code) AS code, coalesce(l.seq_num, r.seq_num) AS seq_num, CAST(l.v AS DOUBLE) AS v_left, r.v AS v_right,
  CASE WHEN r.code IS NULL THEN 'left_only' WHEN l.code IS NULL THEN 'right_only' ELSE 'both' END AS side
FROM l FULL JOIN r ON l.code = r.code AND l.seq_num = r.seq_num""")
def j9(spark, sf):
    left = view(spark, sf, "v_tick").where("event_type <> 'view'").select("code", "seq_num", F.col("current_price").cast("double").alias("v"))
    right = view(spark, sf, "v_order").where("side <> 0").select("code", "seq_num", F.col("price").alias("v"))
    return rec.outer_match(left, right, ["code", "seq_num"], ["v"])


@query("j10_key_sets", "v_daily v_tick", """
, l AS (SELECT DISTINCT trade_date, id_qi AS code FROM v_daily WHERE volume > 200),
r AS (SELECT DISTINCT trade_date, code FROM v_tick WHERE event_type = 'click')
SELECT CAST(trade_date AS VARCHAR) AS trade_date, code, CASE WHEN b THEN 'both' WHEN l THEN 'left_only' ELSE 'right_only' END AS side FROM (
  SELECT coalesce(l.trade_date, r.trade_date) AS trade_date, coalesce(l.code, r.code) AS code, l.code IS NOT NULL AND r.code IS NOT NULL AS b, l.code IS NOT NULL AS l
  FROM l FULL JOIN r ON l.trade_date = r.trade_date AND l.code = r.code)""")
def j10(spark, sf):
    left = _coded_daily(spark, sf).where("volume > 200")
    right = view(spark, sf, "v_tick").where("event_type = 'click'")
    return rec.key_sets(left, right, ["trade_date", "code"]).select(day(), "code", "side")


@query("j11_price_chain", "v_target v_quote v_position v_daily", """
, live AS (SELECT code, price FROM v_quote WHERE price >= 20),
broker AS (SELECT account_id, code, CAST(available_volume AS DOUBLE) / 100 AS price FROM v_position WHERE available_volume > 300000 OR current_volume % 2 = 0),
cl AS (SELECT id_qi AS code, max_by(close, trade_date) AS price FROM v_daily GROUP BY 1)
SELECT t.account_id, t.code AS code6, coalesce(CASE WHEN live.price > 0 THEN live.price END, CASE WHEN broker.price > 0 THEN broker.price END,
  CASE WHEN cl.price > 0 THEN cl.price END) AS price
FROM v_target t LEFT JOIN live ON live.code = t.code LEFT JOIN broker ON broker.account_id = t.account_id AND broker.code = t.code
LEFT JOIN cl ON cl.code = t.code""")
def j11(spark, sf):
    code6 = F.col("code").alias("code6")
    wanted = view(spark, sf, "v_target").select("account_id", code6)
    live = view(spark, sf, "v_quote").where("price >= 20").select(code6, "price")
    broker = view(spark, sf, "v_position").where("available_volume > 300000 OR current_volume % 2 = 0").select(
        "account_id", code6, (F.col("available_volume") / 100.0).alias("price"))
    close = latest_per_key(_coded_daily(spark, sf), ["code"], "trade_date", ["close"]).select(code6, F.col("close").alias("price"))
    return pf.price_chain(wanted, live, broker, close, ["account_id"]).select("account_id", "code6", "price")


@query("j12_history_attach", "v_daily", """
, c AS (SELECT trade_date, dense_rank() OVER (ORDER BY trade_date) AS o FROM (SELECT DISTINCT trade_date FROM v_daily)),
p AS (SELECT d.trade_date, d.id_qi AS code, d.close, c.o FROM v_daily d JOIN c USING (trade_date)),
k AS (SELECT unnest([0, 1, 3]) AS day_offset)
SELECT CAST(b.trade_date AS VARCHAR) AS trade_date, b.code, k.day_offset::INTEGER AS day_offset, h.close AS hist_close, CAST(h.trade_date AS VARCHAR) AS hist_trade_date
FROM p b CROSS JOIN k LEFT JOIN p h ON h.code = b.code AND h.o = b.o - k.day_offset""")
def j12(spark, sf):
    daily = _coded_daily(spark, sf).select("trade_date", "code", "close")
    out = cal.attach_history(daily.select("trade_date", "code"), daily, cal.calendar(daily), [0, 1, 3])
    return out.select(day(), "code", "day_offset", "hist_close", text_date("hist_trade_date"))


@query("j13_null_override", "v_daily v_tick", """
, cur AS (SELECT trade_date, id_qi AS code, CASE WHEN volume > 200 THEN NULL ELSE close END AS beta, CASE WHEN volume > 300 THEN '' ELSE CAST(open AS VARCHAR) END AS size FROM v_daily),
api AS (SELECT trade_date, code, max(latency_ms)::DOUBLE AS beta, min(latency_ms)::DOUBLE AS size FROM v_tick WHERE event_type <> 'view' GROUP BY 1, 2)
SELECT CAST(cur.trade_date AS VARCHAR) AS trade_date, cur.code, coalesce(cur.beta, api.beta) AS beta, coalesce(CAST(nullif(cur.size, '') AS DOUBLE), api.size) AS size
FROM cur LEFT JOIN api ON api.trade_date = cur.trade_date AND api.code = cur.code""")
def j13(spark, sf):
    c = F.col
    current = _coded_daily(spark, sf).select(
        "trade_date", "code", F.when(c("volume") > 200, None).otherwise(c("close")).alias("beta"),
        F.when(c("volume") > 300, "").otherwise(c("open").cast("string")).alias("size"))
    api = view(spark, sf, "v_tick").where("event_type <> 'view'").groupBy("trade_date", "code").agg(
        F.max("latency_ms").cast("double").alias("beta"), F.min("latency_ms").cast("double").alias("size"))
    return pan.fill_nulls_from(current, api, ["trade_date", "code"], ["beta", "size"]).select(day(), "code", "beta", "size")


@query("j14_seen_rows", "v_order v_deal_ev", """
SELECT o.code, o.seq_num, o.price FROM v_order o WHERE EXISTS (SELECT 1 FROM v_deal_ev d WHERE d.code = o.code AND d.seq_num = o.seq_num)""")
def j14(spark, sf):
    return rec.restrict_to_seen(view(spark, sf, "v_order"), view(spark, sf, "v_deal_ev"), ["code", "seq_num"]).select("code", "seq_num", "price")


@query("j15_latest_earlier_day", "v_daily", """
, f AS (SELECT trade_date, id_qi AS code, close FROM v_daily WHERE dayofweek(trade_date) BETWEEN 1 AND 5),
a AS (SELECT DISTINCT trade_date AS as_of FROM v_daily),
m AS (SELECT a.as_of, max(f.trade_date) AS d FROM a JOIN f ON f.trade_date < a.as_of GROUP BY 1)
SELECT CAST(m.as_of AS VARCHAR) AS as_of, CAST(f.trade_date AS VARCHAR) AS trade_date, f.code, f.close FROM m JOIN f ON f.trade_date = m.d""")
def j15(spark, sf):
    daily = _coded_daily(spark, sf).select("trade_date", "code", "close")
    asked = daily.select(F.col("trade_date").alias("as_of")).distinct()
    known = daily.where(~F.dayofweek("trade_date").isin(1, 7))  # results exist on weekdays
    return cal.latest_before(known, asked).select(text_date("as_of"), day(), "code", "close")


@query("j16_stock_selection", "v_daily v_security", """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, id_qi, close FROM v_daily WHERE id_qi IN (SELECT id_qi FROM v_security WHERE industry = 'BUILDING')""")
def j16(spark, sf):
    wanted = view(spark, sf, "v_security").where("industry = 'BUILDING'").select(
        F.concat("id_qi", F.lit("."), "exchange_cd").alias("code"))
    return pan.select_stock(view(spark, sf, "v_daily"), wanted).select(day(), "id_qi", "close")


_WEIGHT = _CAL + """
, px AS (SELECT c.trade_date, p.security_id, p.close, p.trade_date AS price_date,
   row_number() OVER (PARTITION BY c.trade_date, p.security_id ORDER BY p.trade_date DESC) AS rn
   FROM cal c JOIN v_daily p ON p.trade_date IN (coalesce(c.prev, c.trade_date), coalesce(c.prev2, c.prev, c.trade_date)))""" + _SHARES + """
, w AS (SELECT c.trade_date, m.index_code, m.index_exchange, s.id_qi, s.security_id, px.price_date,
   floor(sh.free_shares) * floor(px.close * 100 + 0.5) AS v
   FROM cal c JOIN v_idx_cons m ON m.into_date <= c.trade_date AND (m.out_date IS NULL OR m.out_date > c.trade_date)
   JOIN v_security s ON s.security_id = m.cons_id
   JOIN px ON px.trade_date = c.trade_date AND px.security_id = m.cons_id AND px.rn = 1
   JOIN sh ON sh.trade_date = c.trade_date AND sh.security_id = m.cons_id AND sh.rn = 1
   WHERE px.close > 0 AND sh.free_shares > 0 AND s.asset_class = 'E' AND s.list_status_cd = 'L'),
wt AS (SELECT trade_date, index_code, index_exchange, id_qi, security_id, price_date, v / sum(v) OVER (PARTITION BY trade_date, index_code, index_exchange) AS weight FROM w WHERE v > 0)"""

_WEIGHT_VIEWS = "v_daily v_idx_cons v_free_shares v_security"


def index_weights(spark, sf):
    """Weights over whole shares and cents, so that sums are exact."""
    daily, security = view(spark, sf, "v_daily"), vendor.listed_equities(view(spark, sf, "v_security"))
    days = cal.settled_calendar(daily)
    cents = daily.select("trade_date", "security_id", F.floor(F.col("close") * 100 + 0.5).cast("double").alias("close"))
    shares = view(spark, sf, "v_free_shares").withColumn("free_shares", F.floor("free_shares").cast("double"))
    members = mem.members_in_time(view(spark, sf, "v_idx_cons").withColumnRenamed("cons_id", "security_id"), days)
    named = members.join(security.select("security_id", "id_qi"), "security_id")
    return mem.index_weights(named, mem.newest_close(cents, days), mem.free_shares_asof(shares, days, security))


@query("a6_index_weights", _WEIGHT_VIEWS, _WEIGHT + """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, index_code, index_exchange, id_qi, weight FROM wt""")
def a6(spark, sf):
    return index_weights(spark, sf).select(day(), "index_code", "index_exchange", "id_qi", "weight")


INDEXES = ["000000", "000001", "000002", "000003", "000004"]


@query("a7_membership_flags", "v_idx_cons v_security", """
SELECT s.id_qi, """ + ", ".join(f"max(CASE WHEN index_code = '{i}' THEN 1 ELSE 0 END) = 1 AS in_idx_{i}" for i in INDEXES) + """
FROM v_idx_cons m JOIN v_security s ON s.security_id = m.cons_id GROUP BY 1""")
def a7(spark, sf):
    comp = view(spark, sf, "v_idx_cons").join(
        view(spark, sf, "v_security").select(F.col("security_id").alias("cons_id"), "id_qi"), "cons_id")
    return mem.membership_flags(comp, INDEXES, ["id_qi"])


_COMP = """
, comp AS (SELECT d.trade_date, d.id_qi, lpad(CAST(d.security_id % 5 AS VARCHAR), 6, '0') AS index_code, d.volume::DOUBLE AS weight FROM v_daily d)"""


def _composition(spark, sf):
    """Per day and stock one membership with its traded volume as weight."""
    index = F.lpad((F.col("security_id") % 5).cast("string"), 6, "0")
    return view(spark, sf, "v_daily").select("trade_date", "id_qi", index.alias("index_code"), F.col("volume").cast("double").alias("weight"))


@query("a8_weight_columns", "v_daily", _COMP + """
SELECT id_qi, """ + ", ".join(f"coalesce(avg(CASE WHEN index_code = '{i}' THEN weight END), 0.0) AS weight_{i}" for i in INDEXES) + """
FROM comp GROUP BY 1""")
def a8(spark, sf):
    return mem.weight_columns(_composition(spark, sf), INDEXES, ["id_qi"])


@query("a9_weight_rows", "v_daily", _COMP + """
SELECT id_qi, index_code, avg(weight) AS weight FROM comp GROUP BY 1, 2 HAVING avg(weight) > 0""")
def a9(spark, sf):
    return mem.weights_to_rows(mem.weight_columns(_composition(spark, sf), INDEXES, ["id_qi"]), ["id_qi"])


@query("a19_benchmark_norm", "v_daily", _COMP + """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, id_qi, index_code, weight / sum(weight) OVER (PARTITION BY trade_date, index_code) AS norm_weight FROM comp WHERE weight > 0""")
def a19(spark, sf):
    return mem.normalised_benchmark(_composition(spark, sf)).select(day(), "id_qi", "index_code", "norm_weight")


@query("w8_partition_share", "v_daily v_security", """
SELECT CAST(d.trade_date AS VARCHAR) AS trade_date, s.industry, d.id_qi, CAST(d.amount_cents AS DOUBLE) / sum(d.amount_cents) OVER (PARTITION BY d.trade_date, s.industry) AS share
FROM v_daily d JOIN v_security s USING (security_id)""")
def w8(spark, sf):
    from tickloom.operators.keyed import share_within
    rows = view(spark, sf, "v_daily").join(view(spark, sf, "v_security").select("security_id", "industry"), "security_id")
    return share_within(rows, ["trade_date", "industry"], "amount_cents", "share").select(day(), "industry", "id_qi", "share")


@query("q4_weight_freshness", _WEIGHT_VIEWS, _WEIGHT + """
SELECT CAST(w.trade_date AS VARCHAR) AS trade_date, count(*) AS members,
  count(*) FILTER (WHERE price_date < coalesce(c.prev, c.trade_date)) AS stale_prices,
  count(*) FILTER (WHERE index_code = '000003') AS benchmark_members,
  count(*) FILTER (WHERE price_date < coalesce(c.prev, c.trade_date)) > greatest(50, floor(count(*) * 0.01)) AS stale_alert,
  count(*) FILTER (WHERE index_code = '000003') BETWEEN 1 AND 4799 AS benchmark_alert
FROM wt w JOIN cal c USING (trade_date) GROUP BY 1""")
def q4(spark, sf):
    days = cal.settled_calendar(view(spark, sf, "v_daily"))
    return mem.weight_freshness(index_weights(spark, sf), days, "000003").withColumn("trade_date", day())


@query("q7_benchmark_checks", "v_daily v_tick", """
, comp AS (SELECT trade_date, CASE WHEN event_type = 'error' THEN 'none' ELSE code END AS id_qi, 'A' AS index_code,
    CASE WHEN event_type = 'view' THEN -1.0 ELSE ask_volume1 END::DOUBLE AS weight FROM v_tick),
k AS (SELECT trade_date, index_code, CASE WHEN id_qi = 'none' THEN NULL ELSE id_qi END AS c, count(*) AS n, sum(CASE WHEN weight < 0 THEN 1 ELSE 0 END) AS bad,
    sum(CASE WHEN weight > 0 THEN 1 ELSE 0 END) AS pos FROM comp GROUP BY 1, 2, 3)
SELECT CAST(trade_date AS VARCHAR) AS trade_date, index_code, sum(n)::BIGINT AS members, sum(bad)::BIGINT AS bad_weights,
  coalesce(sum(CASE WHEN c IS NULL THEN n END), 0)::BIGINT AS bad_codes, sum(CASE WHEN c IS NULL THEN 0 ELSE n - 1 END)::BIGINT AS duplicates,
  sum(pos)::BIGINT AS positive_weights, sum(bad) = 0 AND coalesce(sum(CASE WHEN c IS NULL THEN n END), 0) = 0
  AND sum(CASE WHEN c IS NULL THEN 0 ELSE n - 1 END) = 0 AND sum(pos) > 0 AS valid FROM k GROUP BY 1, 2""")
def q7(spark, sf):
    c = F.col
    comp = view(spark, sf, "v_tick").select(
        "trade_date", F.when(c("event_type") == "error", "none").otherwise(c("code")).alias("id_qi"), F.lit("A").alias("index_code"),
        F.when(c("event_type") == "view", -1.0).otherwise(c("ask_volume1").cast("double")).alias("weight"))
    return mem.benchmark_checks(comp).withColumn("trade_date", day())


@query("q13_panel_gate", "v_daily", """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, count(*) AS rows, 9 AS columns, count(*) >= 135 AS passed FROM v_daily GROUP BY 1""")
def q13(spark, sf):
    return pan.panel_gate(view(spark, sf, "v_daily"), 9, 135).withColumn("trade_date", day())


@query("u1_union_columns", "v_daily v_tick", """
SELECT id_qi AS code, close, NULL::BIGINT::DOUBLE AS seq FROM v_daily UNION ALL SELECT code, NULL, seq_num::DOUBLE FROM v_tick""")
def u1(spark, sf):
    a = view(spark, sf, "v_daily").select(F.col("id_qi").alias("code"), "close")
    b = view(spark, sf, "v_tick").select("code", F.col("seq_num").cast("double").alias("seq"))
    return a.unionByName(b, allowMissingColumns=True)


@query("u2_key_difference", "v_daily v_tick", """
, l AS (SELECT trade_date, id_qi AS code FROM v_daily WHERE volume > 200), r AS (SELECT trade_date, code FROM v_tick WHERE event_type = 'click')
SELECT CAST(trade_date AS VARCHAR) AS trade_date, code, 'common' AS part FROM (SELECT * FROM l INTERSECT SELECT * FROM r)
UNION ALL SELECT CAST(trade_date AS VARCHAR), code, 'missing' FROM (SELECT * FROM l EXCEPT SELECT * FROM r)""")
def u2(spark, sf):
    left, right = _coded_daily(spark, sf).where("volume > 200"), view(spark, sf, "v_tick").where("event_type = 'click'")
    keys = ["trade_date", "code"]
    return rec.common_keys(left, right, keys).select(day(), "code", F.lit("common").alias("part")).unionByName(
        rec.keys_missing(left, right, keys).select(day(), "code", F.lit("missing").alias("part")))


@query("u3_row_backfill", "v_daily", """
, c AS (SELECT trade_date, count(*) AS n, lag(trade_date) OVER (ORDER BY trade_date) AS prev FROM v_daily GROUP BY 1),
t AS (SELECT trade_date, prev FROM c WHERE n < 135 AND prev IS NOT NULL AND trade_date <> DATE '2024-01-30')
SELECT CAST(trade_date AS VARCHAR) AS trade_date, id_qi, close, NULL::VARCHAR AS stale_from FROM v_daily
UNION ALL SELECT CAST(t.trade_date AS VARCHAR), p.id_qi, p.close, CAST(t.prev AS VARCHAR) FROM t JOIN v_daily p ON p.trade_date = t.prev
WHERE NOT EXISTS (SELECT 1 FROM v_daily x WHERE x.trade_date = t.trade_date AND x.id_qi = p.id_qi)""")
def u3(spark, sf):
    out = pan.backfill_rows(view(spark, sf, "v_daily"), "id_qi", 135, F.lit("2024-01-30").cast("date"), mark=True)
    return out.select(day(), "id_qi", "close", text_date("stale_from"))


@query("u4_column_backfill", "v_daily", """
, c AS (SELECT trade_date, dense_rank() OVER (ORDER BY trade_date) AS o FROM (SELECT DISTINCT trade_date FROM v_daily)),
p AS (SELECT d.trade_date, d.id_qi, c.o, CASE WHEN c.o % 5 IN (3, 4) THEN NULL ELSE d.high END AS ind,
      CASE WHEN c.o % 7 = 0 THEN NULL ELSE d.low END AS beta, c.o % 5 IN (3, 4) AS gone FROM v_daily d JOIN c USING (trade_date)),
one AS (SELECT p.*, q.ind AS prev1, q.id_qi IS NOT NULL AS has1 FROM p LEFT JOIN p q ON q.id_qi = p.id_qi AND q.o = p.o - 1),
two AS (SELECT one.*, q.ind AS prev2 FROM one LEFT JOIN p q ON q.id_qi = one.id_qi AND q.o = one.o - 2)
SELECT CAST(trade_date AS VARCHAR) AS trade_date, id_qi, CASE WHEN o % 5 = 3 THEN prev1 WHEN o % 5 = 4 THEN CASE WHEN has1 THEN prev2 END ELSE ind END AS ind, beta,
  gone AS stable_missing, o % 7 = 0 AS moving_missing FROM two""")
def u4(spark, sf):
    daily = view(spark, sf, "v_daily")
    o = F.col("ordinal")
    holes = daily.join(cal.calendar(daily).select("trade_date", "ordinal"), "trade_date").select(
        "trade_date", "id_qi", F.when(~(o % 5).isin(3, 4), F.col("high")).alias("ind"), F.when(o % 7 != 0, F.col("low")).alias("beta"))
    out = pan.backfill_column_group(holes, "id_qi", ["ind"], ["beta"])
    return out.select(day(), "id_qi", "ind", "beta", "stable_missing", "moving_missing")
