"""Reconciliation jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import times, values
from tickloom.operators import codec, quality as qual
from tickloom.operators import reconcile as rec
from tickloom.operators import state as st
from tickloom.operators.keyed import keep_first
from tickloom.plans.registry import query
from tickloom.plans.views import day, view
from tickloom.session import scratch_path
from tickloom.sources import archive, vendor


def _copies(spark, sf):
    """Raw orders, and an archived copy where some prices are ten times off and some volumes differ."""
    raw = view(spark, sf, "v_order").select("code", "seq_num", "price", "volume", "side")
    c = F.col
    price = F.when(c("side") == 0, c("price") * 10).otherwise(c("price"))
    volume = F.when(c("volume") > 90, c("volume") - 1).otherwise(c("volume"))
    return raw, raw.select("code", "seq_num", values.to_cents(price).alias("price"), volume.alias("volume"))


_DIFF = """
, a AS (SELECT code, seq_num, price, volume, CAST(floor(CASE WHEN side = 0 THEN price * 10 ELSE price END * 100 + 0.5) AS INTEGER) / 100 AS p2, CASE WHEN volume > 90 THEN volume - 1 ELSE volume END AS v2 FROM v_order),
l AS (SELECT 'price' AS field, price AS lv, p2 AS rv, abs(round_even((price - p2) * 1e8, 0) / 1e8) * 100 AS gap, abs(round_even((price - p2) * 1e8, 0) / 1e8) * 100 <= 1 AS ok FROM a
  UNION ALL SELECT 'volume', volume, v2, abs(volume - v2), volume = v2 FROM a),
m AS (SELECT field, floor(lv / rv * 10 + 0.5) / 10 AS r, count(*) AS n FROM l WHERE NOT ok AND rv <> 0 GROUP BY 1, 2),
u AS (SELECT field, r FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, r) AS k FROM m) WHERE k = 1)
SELECT l.field, count(*) AS total, count(*) FILTER (WHERE ok) AS matched, max(gap)::DOUBLE AS max_diff, any_value(u.r)::DOUBLE AS usual_ratio, count(*) FILTER (WHERE NOT ok) AS mismatched FROM l LEFT JOIN u USING (field) GROUP BY 1"""


@query("a17_field_diff", "v_order", _DIFF)
def a17(spark, sf):
    raw, stored = _copies(spark, sf)
    return qual.field_diff(raw, stored, ["code", "seq_num"], ["price"], ["volume"], right_scale=0.01)


@query("r1_feed_vs_archive", "v_order", _DIFF)
def r1(spark, sf):
    """The raw side goes through message files, the archived one through encoded tables."""
    raw, stored = _copies(spark, sf)
    path, root = scratch_path(spark, "messages"), scratch_path(spark, "archive")
    header = ["code", "seq_num", "price", "volume", "side"]
    raw.select(*header).write.option("header", "true").csv(path)
    stored.withColumn("trade_date", F.lit("2024-01-05").cast("date")).write.partitionBy("trade_date").parquet(archive.table_path(root, "order"))
    left = vendor.read_message_csv(spark, path, header, ["code", "seq_num", "price", "volume"]).select(
        "code", F.col("seq_num").cast("long").alias("seq_num"), values.number(F.col("price")).alias("price"), values.number(F.col("volume")).alias("volume"))
    right = archive.load_day(archive.scan(spark, root, "order"), "2024-01-05")
    return qual.field_diff(left, right, ["code", "seq_num"], ["price"], ["volume"], right_scale=0.01)


def _factor_copies(spark, sf):
    c = F.col
    left = view(spark, sf, "v_daily").select(
        "trade_date", c("id_qi").alias("code"), c("close").alias("F_close"), c("open").alias("F_open"), (c("high") - c("low")).alias("F_range"))
    right = left.where("trade_date <> DATE '2024-01-02'").select(
        "trade_date", "code", F.when(c("F_close") > 50, c("F_close") * 1.5).otherwise(c("F_close")).alias("F_close"),
        F.when(c("F_open") < 1, None).otherwise(c("F_open")).alias("F_open"), (c("F_range") + 1e-9).alias("F_range"))
    return left, right


_FDIFF = """
, l AS (SELECT trade_date, id_qi AS code, close, open, high - low AS range FROM v_daily),
r AS (SELECT trade_date, code, CASE WHEN close > 50 THEN close * 1.5::DOUBLE ELSE close END AS close, CASE WHEN open < 1 THEN NULL ELSE open END AS open, range + 1e-9 AS range FROM l WHERE trade_date <> DATE '2024-01-02'),
c AS (SELECT 'F_close' AS factor, trade_date, code, l.close AS lv, r.close AS rv FROM l JOIN r USING (trade_date, code) UNION ALL SELECT 'F_open', trade_date, code, l.open, r.open FROM l JOIN r USING (trade_date, code)
  UNION ALL SELECT 'F_range', trade_date, code, l.range, r.range FROM l JOIN r USING (trade_date, code)),
b AS (SELECT *, NOT coalesce(abs(lv - rv) <= 1e-8::DOUBLE + 1e-5::DOUBLE * abs(rv), lv IS NULL AND rv IS NULL) AS bad FROM c),
f AS (SELECT factor, count(*) AS cells, count(*) FILTER (WHERE bad) AS bad_cells, coalesce(max(CASE WHEN bad THEN abs(lv - rv) END), 0.0) AS max_abs,
  coalesce(max(CASE WHEN bad THEN abs(lv - rv) / greatest(abs(lv), abs(rv)) END), 0.0) AS max_rel FROM b GROUP BY 1)"""


@query("a18_factor_diff", "v_daily", _FDIFF + " SELECT * FROM f")
def a18(spark, sf):
    return rec.factor_diff(*_factor_copies(spark, sf), ["trade_date", "code"])


@query("t3_worst_factors", "v_daily", _FDIFF + " SELECT * FROM f WHERE bad_cells > 0 ORDER BY bad_cells DESC LIMIT 20")
def t3(spark, sf):
    return rec.worst_factors(rec.factor_diff(*_factor_copies(spark, sf), ["trade_date", "code"]))


@query("t3_mismatch_samples", "v_daily", _FDIFF + """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, code, factor, lv, rv FROM (SELECT * FROM b WHERE bad ORDER BY factor, trade_date, code LIMIT 20)""")
def t3_samples(spark, sf):
    return rec.mismatch_samples(*_factor_copies(spark, sf), ["trade_date", "code"]).withColumn("trade_date", day())


@query("r2_factor_copies", "v_daily", _FDIFF + """
SELECT (SELECT count(*) FROM l JOIN r USING (trade_date, code)) AS common_keys, (SELECT count(*) FROM l WHERE trade_date = DATE '2024-01-02') AS only_left, 0::BIGINT AS only_right,
  sum(bad_cells)::BIGINT AS bad_cells, count(*) FILTER (WHERE bad_cells > 0) AS bad_columns, max(max_abs) AS max_abs, 0 AS only_left_columns, 0 AS only_right_columns, sum(bad_cells) = 0 AS equal FROM f""")
def r2(spark, sf):
    return rec.compare_copies(*_factor_copies(spark, sf), ["trade_date", "code"])


@query("r3_store_diff", "v_deal", """
, l0 AS (SELECT *, row_number() OVER (PARTITION BY code, seq_num ORDER BY time, money, volume, side) AS rn FROM v_deal),
l AS (SELECT * FROM l0 WHERE rn = 1), r0 AS (SELECT code, seq_num, time, money, CASE WHEN side = 1 THEN volume + 1 ELSE volume END AS volume, side FROM v_deal WHERE channel <> 3),
r1 AS (SELECT *, row_number() OVER (PARTITION BY code, seq_num ORDER BY time, money, volume, side) AS rn FROM r0), r AS (SELECT * FROM r1 WHERE rn = 1)
SELECT coalesce(l.code, r.code) AS code, count(*) FILTER (WHERE l.code IS NOT NULL AND r.code IS NOT NULL) AS common, count(*) FILTER (WHERE r.code IS NULL) AS left_only, count(*) FILTER (WHERE l.code IS NULL) AS right_only,
  count(*) FILTER (WHERE l.volume <> r.volume) AS volume_diff, count(*) FILTER (WHERE l.money <> r.money) AS money_diff FROM l FULL JOIN r ON l.code = r.code AND l.seq_num = r.seq_num GROUP BY 1""")
def r3(spark, sf):
    deals = view(spark, sf, "v_deal")
    volume = F.when(F.col("side") == 1, F.col("volume") + 1).otherwise(F.col("volume"))
    other = deals.where("channel <> 3").withColumn("volume", volume)
    order = [F.col(c) for c in ("time", "money", "volume", "side")]
    return rec.store_diff(deals, other, ["code", "seq_num"], ["volume", "money"], ["code"], order, second=86_399)


@query("r4_duplicate_repair", "v_deal", """
, b AS (SELECT count(*) AS raw_rows, count(DISTINCT (code, seq_num)) AS distinct_keys FROM v_deal)
SELECT 'before' AS stage, raw_rows, distinct_keys, raw_rows - distinct_keys AS duplicate_rows FROM b UNION ALL SELECT 'after', distinct_keys, distinct_keys, 0 FROM b""")
def r4(spark, sf):
    deals = view(spark, sf, "v_deal")
    fixed = keep_first(deals, ["code", "seq_num"], [F.col(c) for c in ("time", "money", "volume", "side", "buy_order_id", "sale_order_id")])
    stats = lambda df, stage: qual.duplicate_stats(df, ["code", "seq_num"]).select(F.lit(stage).alias("stage"), "*")
    return stats(deals, "before").unionByName(stats(fixed, "after"))


@query("r5_encoded_vs_raw_state", "v_tick", """
SELECT 'F_high' AS factor, count(*) AS cells, 0::BIGINT AS bad_cells, 0.0::DOUBLE AS max_abs, 0.0::DOUBLE AS max_rel FROM (SELECT DISTINCT trade_date, code FROM v_tick)
UNION ALL SELECT 'F_latest', count(*), 0, 0.0, 0.0 FROM (SELECT DISTINCT trade_date, code FROM v_tick)""")
def r5(spark, sf):
    """Factors from the raw feed equal those from its archived copy up to half a cent."""
    ticks = view(spark, sf, "v_tick").withColumns({"security_id": F.col("code").cast("int"), "update_time": F.col("time")})
    stored = codec.decode(codec.encode(ticks, "tick", keep=("trade_date",)), keep=("trade_date", "code"))
    restored = stored.withColumn("code", F.lpad("code", 6, "0"))
    pick = lambda df: st.tick_state(df).select("trade_date", "code", F.col("high").cast("double").alias("F_high"), F.col("latest_price").cast("double").alias("F_latest"))
    return rec.factor_diff(pick(ticks), pick(restored), ["trade_date", "code"], atol=0.005)
