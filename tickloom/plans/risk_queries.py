"""Risk exposures, snapshot selection and target checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import values
from tickloom.operators import calendar as cal
from tickloom.operators import membership as mem
from tickloom.operators import risk
from tickloom.plans.registry import query
from tickloom.plans.views import day, view

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
STYLES = ["size", "move"]

# Risk panel with whole-number styles, one-hot industries, and holes: a retired
# column is set on every ninth day and some members lose a style every seventh.
_PANEL = """
, pn AS (SELECT d.trade_date, d.id_qi, d.volume::DOUBLE AS size,
  CASE WHEN day(d.trade_date) % 7 = 3 AND d.volume > 400 THEN NULL ELSE floor(d.close * 100 + 0.5) - floor(d.open * 100 + 0.5) END AS move,
  CASE WHEN day(d.trade_date) % 9 = 0 THEN 1.0 END::DOUBLE AS retired, s.industry, """ + ", ".join(
    f"CASE WHEN s.industry = '{s}' THEN 1.0 ELSE 0.0 END::DOUBLE AS {s}" for s in SEGMENTS) + """
  FROM v_daily d JOIN v_security s USING (security_id)),
bm AS (SELECT trade_date, id_qi, 0.015625::DOUBLE AS weight FROM pn WHERE industry <> 'MACHINERY')"""


def panel(spark, sf):
    c = F.col
    daily = view(spark, sf, "v_daily").join(view(spark, sf, "v_security").select("security_id", "industry"), "security_id")
    hole = (F.dayofmonth("trade_date") % 7 == 3) & (c("volume") > 400)
    move = (F.floor(c("close") * 100 + 0.5) - F.floor(c("open") * 100 + 0.5)).cast("double")
    return daily.select(
        "trade_date", "id_qi", c("volume").cast("double").alias("size"), F.when(~hole, move).alias("move"),
        F.when(F.dayofmonth("trade_date") % 9 == 0, 1.0).alias("retired"), "industry",
        *[F.when(c("industry") == s, 1.0).otherwise(0.0).alias(s) for s in SEGMENTS])


def benchmark(pn):
    return pn.where("industry <> 'MACHINERY'").select("trade_date", "id_qi", F.lit(0.015625).alias("weight"))


_TARGET = ", tg AS (SELECT p.trade_date, t.account_id, p.id_qi, t.position AS weight FROM pn p JOIN v_target t ON t.code = p.id_qi)"


def target(spark, sf, pn):
    t = view(spark, sf, "v_target").select("account_id", F.col("code").alias("id_qi"), F.col("position").alias("weight"))
    return pn.select("trade_date", "id_qi").join(t, "id_qi")


_COLS = ["size", *SEGMENTS]
_ACTIVE = _PANEL + _TARGET + ", ex AS (" + " UNION ALL ".join(
    f"SELECT g.trade_date, account_id, '{c}' AS factor, sum(g.weight * p.{c}) AS exposure FROM tg g JOIN pn p USING (trade_date, id_qi) GROUP BY 1, 2" for c in _COLS) + "), bx AS (" + " UNION ALL ".join(
    f"SELECT b.trade_date, '{c}' AS factor, sum(b.weight * p.{c}) AS be, stddev_samp(p.{c}) AS sd FROM bm b JOIN pn p USING (trade_date, id_qi) GROUP BY 1" for c in _COLS) + """)
, ac AS (SELECT ex.trade_date, account_id, factor, exposure, be, sd, exposure - be AS active FROM ex JOIN bx USING (trade_date, factor))"""


def active(spark, sf):
    pn = panel(spark, sf)
    return risk.active_exposures(target(spark, sf, pn), benchmark(pn), pn, ["account_id"], ["trade_date"], "id_qi", _COLS)


@query("a13_active_exposures", "v_daily v_security v_target", _ACTIVE + """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, account_id, factor, exposure, be AS bench_exposure, active, floor(sd * 1000000 + 0.5) / 1000000 AS bench_std FROM ac""")
def a13(spark, sf):
    return active(spark, sf).select(day(), "account_id", "factor", "exposure", "bench_exposure", "active",
                                    values.round_to(F.col("bench_std"), 6).alias("bench_std"))


@query("q10_style_breaches", "v_daily v_security v_target", _ACTIVE + """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, account_id, factor, active FROM ac WHERE factor = 'size' AND abs(active) > sd * 2.75 + 1e-6""")
def q10(spark, sf):
    styles = active(spark, sf).where("factor = 'size'")
    return risk.style_breaches(styles, 2.75).select(day(), "account_id", "factor", "active")


@query("q10_industry_breaches", "v_daily v_security v_target", _ACTIVE + """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, account_id, factor, exposure FROM ac WHERE factor <> 'size' AND be > 1e-8
AND (exposure < be * 0.5 - 1e-6 OR exposure > be * 1.5 + 1e-6)""")
def q10_industry(spark, sf):
    groups = active(spark, sf).where("factor <> 'size'")
    return risk.industry_breaches(groups, 0.5).select(day(), "account_id", "factor", "exposure")


@query("q10_exposure_gaps", "v_daily v_security v_target", _PANEL + _TARGET + """
SELECT CAST(g.trade_date AS VARCHAR) AS trade_date, account_id, count(*) AS missing FROM tg g JOIN pn p USING (trade_date, id_qi) WHERE g.weight > 1e-10 AND p.move IS NULL GROUP BY 1, 2""")
def q10_gaps(spark, sf):
    pn = panel(spark, sf)
    return risk.exposure_gaps(target(spark, sf, pn), pn, ["trade_date", "account_id"], ["trade_date"], "id_qi", STYLES).withColumn("trade_date", day())


@query("a14_coverage", "v_daily", """
, c AS (SELECT trade_date, count(DISTINCT id_qi) AS stocks, row_number() OVER (ORDER BY trade_date) AS o FROM v_daily GROUP BY 1)
SELECT CAST(c.trade_date AS VARCHAR) AS trade_date, c.stocks, CASE WHEN count(p.o) = 5 THEN median(p.stocks) END AS baseline FROM c LEFT JOIN c p ON p.o BETWEEN c.o - 5 AND c.o - 1 GROUP BY 1, 2""")
def a14(spark, sf):
    return risk.coverage(view(spark, sf, "v_daily"), "id_qi").withColumn("trade_date", day())


@query("q5_sidecar_verdict", "v_tick", """
, a AS (SELECT trade_date, CASE WHEN event_type = 'error' AND ask_volume1 > 97 THEN 'x' WHEN event_type = 'view' AND ask_volume1 > 90 THEN '3' ELSE '0' END AS c FROM v_tick)
SELECT CAST(trade_date AS VARCHAR) AS trade_date, CASE WHEN max(c) = 'x' THEN 'invalid' WHEN max(c) = '3' THEN 'stale' ELSE 'clean' END AS verdict FROM a GROUP BY 1""")
def q5(spark, sf):
    c = F.col
    audit = view(spark, sf, "v_tick").select("trade_date", F.when((c("event_type") == "error") & (c("ask_volume1") > 97), "x").when(
        (c("event_type") == "view") & (c("ask_volume1") > 90), "3").otherwise("0").alias("count"))
    return risk.sidecar_verdict(audit).withColumn("trade_date", day())


@query("q6_holdings_check", "v_book_position v_account", """
, a AS (SELECT account_id, CASE WHEN account_id % 2 = 0 THEN 0.0 ELSE 5.0 END AS mv FROM v_account),
p AS (SELECT account_id, CASE WHEN current_volume > 9900 THEN 'none' ELSE code END AS code, CASE WHEN current_volume > 9950 THEN 'NaN' WHEN current_volume < 30 THEN '0' ELSE CAST(current_volume AS VARCHAR) END AS amount, last_price FROM v_book_position),
g AS (SELECT account_id, count(*) FILTER (WHERE amount <> '0') AS held, count(*) FILTER (WHERE amount = 'NaN') AS invalid_amounts,
  count(*) FILTER (WHERE amount = '0' AND last_price > 0) AS contradictions, count(*) FILTER (WHERE amount <> '0' AND code = 'none') AS bad_codes FROM p GROUP BY 1)
SELECT a.account_id, coalesce(held, 0) AS held, coalesce(invalid_amounts, 0) AS invalid_amounts, coalesce(contradictions, 0) AS contradictions, coalesce(bad_codes, 0) AS bad_codes,
  held IS NULL AND mv > 0 AS unproven_empty, coalesce(invalid_amounts, 0) = 0 AND coalesce(contradictions, 0) = 0 AND coalesce(bad_codes, 0) = 0 AND NOT (held IS NULL AND mv > 0) AS valid FROM a LEFT JOIN g USING (account_id)""")
def q6(spark, sf):
    v = F.col("current_volume")
    positions = view(spark, sf, "v_book_position").select(
        "account_id", F.when(v > 9900, "none").otherwise(F.col("code")).alias("code"),
        F.when(v > 9950, "NaN").when(v < 30, "0").otherwise(v.cast("string")).alias("amount"), "last_price")
    account = view(spark, sf, "v_account").select("account_id", F.when(F.col("account_id") % 2 == 0, 0.0).otherwise(5.0).alias("market_value"))
    return risk.holdings_check(positions, account, ["account_id"], "code", ["amount", "last_price"])


_QUALITY = _PANEL + """
, qd AS (SELECT p.trade_date, count(DISTINCT p.id_qi) AS stocks, count(DISTINCT b.id_qi) AS members, count(p.retired) AS legacy,
  count(*) FILTER (WHERE b.id_qi IS NOT NULL AND p.move IS NULL) AS incomplete FROM pn p LEFT JOIN bm b USING (trade_date, id_qi) GROUP BY 1),
ql AS (SELECT *, legacy = 0 AND incomplete = 0 AND members > 0 AND trade_date <> DATE '2024-01-12' AS qualifies FROM qd),
qn AS (SELECT *, count(*) FILTER (WHERE qualifies) OVER (ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM ql),
qq AS (SELECT *, row_number() OVER (ORDER BY trade_date) AS n FROM ql WHERE qualifies),
cd AS (SELECT a.trade_date, a.stocks, a.members, a.qualifies, CASE WHEN count(q.n) = 5 THEN median(q.stocks) END AS sb, CASE WHEN count(q.n) = 5 THEN median(q.members) END AS mb
  FROM qn a LEFT JOIN qq q ON q.n BETWEEN a.k - 4 AND a.k GROUP BY 1, 2, 3, 4),
us AS (SELECT *, coalesce(qualifies AND stocks / sb > 0.8 + 1e-12 AND members > mb * 0.8 + 1e-12, false) AS usable FROM cd)"""


def candidates(spark, sf):
    pn = panel(spark, sf)
    stale = cal.trading_days(pn).select("trade_date", F.when(F.col("trade_date") == F.lit("2024-01-12").cast("date"), 4).otherwise(0).alias("count"))
    quality = risk.day_quality(pn, benchmark(pn), "id_qi", [*STYLES, *SEGMENTS], ["retired"], SEGMENTS, stale)
    return risk.snapshot_candidates(quality)


@query("q8_day_quality", "v_daily v_security", _QUALITY + """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, stocks, members, qualifies, sb AS stock_baseline, mb AS member_baseline, usable FROM us""")
def q8_days(spark, sf):
    return candidates(spark, sf).select(day(), "stocks", "members", "qualifies", "stock_baseline", "member_baseline", "usable")


@query("q8_snapshot_selection", "v_daily v_security", _QUALITY + """
, asked AS (SELECT DISTINCT trade_date + 2 AS as_of FROM v_daily)
SELECT CAST(as_of AS VARCHAR) AS as_of, CAST(max(trade_date) AS VARCHAR) AS risk_date, CAST(as_of - max(trade_date) AS DOUBLE) AS age_days FROM asked LEFT JOIN us ON usable AND trade_date < as_of AND as_of - trade_date <= 14 GROUP BY as_of""")
def q8(spark, sf):
    asked = view(spark, sf, "v_daily").select(F.date_add("trade_date", 2).alias("as_of")).distinct()
    out = risk.select_snapshot(candidates(spark, sf), asked)
    return out.select(F.col("as_of").cast("string").alias("as_of"), F.col("risk_date").cast("string").alias("risk_date"),
                      F.col("age_days").cast("double").alias("age_days"))


_GROUPS = [s for s in SEGMENTS if s != "MACHINERY"]


@query("q8_held_snapshot", "v_daily v_security v_position", _QUALITY.replace("legacy = 0 AND", "day(trade_date) % 11 <> 5 AND legacy = 0 AND") + """
, own AS (SELECT DISTINCT account_id, code AS id_qi FROM v_position WHERE current_volume > 5000 AND code IN (SELECT id_qi FROM pn)),
need AS (SELECT account_id, count(*) AS need FROM own GROUP BY 1),
ok AS (SELECT o.account_id, p.trade_date FROM own o JOIN pn p USING (id_qi) JOIN need USING (account_id)
  WHERE p.move IS NOT NULL AND p.industry <> 'MACHINERY' GROUP BY 1, 2 HAVING count(*) = max(need)),
asked AS (SELECT DISTINCT n.account_id, d.trade_date + 1 AS as_of FROM need n, v_daily d)
SELECT a.account_id, CAST(a.as_of AS VARCHAR) AS as_of, CAST(max(u.trade_date) AS VARCHAR) AS risk_date
FROM asked a LEFT JOIN (SELECT ok.account_id, us.trade_date FROM us JOIN ok USING (trade_date) WHERE usable) u
  ON u.account_id = a.account_id AND u.trade_date < a.as_of AND a.as_of - u.trade_date <= 14 GROUP BY 1, 2""")
def q8_held(spark, sf):
    c = F.col
    pn = panel(spark, sf)
    sick = F.dayofmonth("trade_date") % 11 == 5
    bench = benchmark(pn).select("trade_date", "id_qi", F.lit("B").alias("index_code"), F.when(sick, -1.0).otherwise(c("weight")).alias("weight"))
    days = cal.trading_days(pn)
    stale = days.select("trade_date", F.when(c("trade_date") == F.lit("2024-01-12").cast("date"), 4).otherwise(0).alias("count"))
    quality = risk.day_quality(pn, bench, "id_qi", [*STYLES, *SEGMENTS], ["retired"], _GROUPS, stale, mem.benchmark_checks(bench))
    own = view(spark, sf, "v_position").where("current_volume > 5000").select("account_id", c("code").alias("id_qi")).join(
        pn.select("id_qi").distinct(), "id_qi", "left_semi")
    held = risk.held_complete(pn, own, "id_qi", STYLES, days, _GROUPS, ["account_id"])
    # One row per book and day asked for: the query's own result size.
    dates = days.agg(F.collect_set(F.date_add("trade_date", 1)).alias("dates")).scalar()
    asked = own.select("account_id").distinct().select("account_id", F.explode(dates).alias("as_of"))
    out = risk.select_snapshot(risk.book_candidates(risk.snapshot_candidates(quality), held), asked, book=["account_id"])
    return out.select("account_id", c("as_of").cast("string").alias("as_of"), c("risk_date").cast("string").alias("risk_date"))


@query("q9_holdings_coverage", "v_position v_daily", """
, e AS (SELECT DISTINCT id_qi FROM v_daily)
SELECT account_id, count(*) AS held, count(*) FILTER (WHERE e.id_qi IS NULL) AS missing, count(*) FILTER (WHERE e.id_qi IS NULL) > greatest(3, floor(count(*) * 0.2)) AS failed
FROM v_position p LEFT JOIN e ON e.id_qi = p.code GROUP BY 1""")
def q9(spark, sf):
    eligible = view(spark, sf, "v_daily").select(F.col("id_qi").alias("code"))
    return risk.holdings_coverage(view(spark, sf, "v_position"), eligible, ["account_id"], "code")


@query("q9_liquidation_list", "v_position v_daily", """
SELECT DISTINCT account_id, code FROM v_position WHERE code NOT IN (SELECT id_qi FROM v_daily)""")
def q9_list(spark, sf):
    eligible = view(spark, sf, "v_daily").select(F.col("id_qi").alias("code"))
    return risk.to_liquidate(view(spark, sf, "v_position"), eligible, ["account_id"], "code").select("account_id", "code")


@query("q11_target_contract", "v_target v_position", """
, c AS (SELECT account_id, code, current_volume::DOUBLE / 1048576 AS w FROM v_position),
j AS (SELECT coalesce(t.account_id, c.account_id) AS account_id, coalesce(t.position, 0.0) AS t, coalesce(c.w, 0.0) AS w FROM v_target t FULL JOIN c ON c.account_id = t.account_id AND c.code = t.code),
g AS (SELECT account_id, sum(t) AS target_sum, sum(abs(t - w)) AS turnover, count(*) FILTER (WHERE t > greatest(0.03, w) + 1e-6) AS too_large FROM j GROUP BY 1)
SELECT account_id, 0::BIGINT AS duplicates, target_sum, turnover, too_large, abs(target_sum - 1) <= 1e-5 AND turnover <= 0.5 + 1e-5 AND too_large = 0 AS valid FROM g""")
def q11(spark, sf):
    target_ = view(spark, sf, "v_target").withColumnRenamed("code", "code6")
    current = view(spark, sf, "v_position").select("account_id", F.col("code").alias("code6"), (F.col("current_volume") / F.lit(1048576.0)).alias("weight"))
    out = risk.target_contract(target_, current, ["account_id"], 0.5, max_weight=0.03)
    return out.select("account_id", "duplicates", "target_sum", "turnover", "too_large", "valid")


@query("q12_one_hot", "v_daily v_security", _PANEL + """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, id_qi, industry <> 'FURNITURE' AS one_hot FROM pn""")
def q12(spark, sf):
    pn = panel(spark, sf)
    return risk.one_hot_check(pn, [s for s in SEGMENTS if s != "FURNITURE"], ["trade_date", "id_qi"]).withColumn("trade_date", day())
