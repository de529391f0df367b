"""User factors, scoring and inference inputs (UD1-UD5, UD7, UD8, UD11, W4)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tickloom.operators import calendar as cal
from tickloom.operators import factors as fac
from tickloom.operators import panel as pan
from tickloom.operators import scoring as sc
from tickloom.operators import state as st
from tickloom.plans.join_queries import _COMP, _composition
from tickloom.operators.membership import membership_flags
from tickloom.plans.registry import query
from tickloom.plans.state_queries import event_feeds
from tickloom.plans.views import day, view
from tickloom.session import scratch_path
from tickloom.sources.hook import ParquetHook


@query("ud1_expression_factors", "v_tick", """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, code, max(bid_price1) - min(bid_price1) AS "F_range", count(*) FILTER (WHERE event_type = 'click') AS "F_clicks",
  arg_max(bid_price1, seq_num) / nullif(arg_min(bid_price1, seq_num), 0) AS "F_drift" FROM v_tick GROUP BY 1, 2""")
def ud1(spark, sf):
    out = fac.expression_factors(view(spark, sf, "v_tick"), ["trade_date", "code"], {
        "F_range": F.max("bid_price1") - F.min("bid_price1"), "F_clicks": F.count_if(F.col("event_type") == "click"),
        "F_drift": F.try_divide(F.max_by("bid_price1", "seq_num"), F.min_by("bid_price1", "seq_num"))})
    return out.withColumn("trade_date", day())


def _vwap_fold() -> fac.Fold:
    finish = lambda s: pd.DataFrame({"F_vwap": s["cents"] / s["volume"], "F_rows": s["rows"]})
    return fac.sum_fold(["cents", "volume", "rows"], "cents bigint, volume bigint, rows bigint", "F_vwap double, F_rows bigint", finish)


@query("ud1_fold_factors", "v_deal", """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, code, CAST(sum(CAST(floor(money * 100 + 0.5) AS BIGINT)) AS DOUBLE) / CAST(sum(volume) AS BIGINT) AS "F_vwap", count(*) AS "F_rows" FROM v_deal GROUP BY 1, 2""")
def ud1_fold(spark, sf):
    deals = view(spark, sf, "v_deal").select(
        "trade_date", "code", F.floor(F.col("money") * 100 + 0.5).cast("long").alias("cents"), F.col("volume").cast("long").alias("volume"), F.lit(1).cast("long").alias("rows"))
    return fac.fold_factors(deals, ["trade_date", "code"], _vwap_fold()).withColumn("trade_date", day())


def _slice_factor(data: fac.StockData, code: str, date, end_time: str) -> dict:
    """Last bid and deal volume as of the slice."""
    bids = data.column("tick", "bid_price1")
    if not len(bids):
        return {}
    return {"code": code, "F_bid": float(bids[-1]), "F_volume": float(np.nansum(data.column("deal", "volume")))}


_SLICED = """
, e AS (SELECT * FROM (VALUES ('103000', 37800), ('143000', 52200)) v(end_time, s)),
t AS (SELECT trade_date, code, seq_num, bid_price1, epoch_us(time) - epoch_us(CAST(trade_date AS TIMESTAMP)) AS us FROM v_tick),
d AS (SELECT trade_date, code, volume, epoch_us(time) - epoch_us(CAST(trade_date AS TIMESTAMP)) AS us FROM v_deal_ev),
b AS (SELECT trade_date, code, end_time, arg_max(bid_price1, seq_num) AS f_bid FROM t JOIN e ON us <= s * 1000000::BIGINT GROUP BY 1, 2, 3),
v AS (SELECT trade_date, code, end_time, sum(volume)::DOUBLE AS f_vol FROM d JOIN e ON us <= s * 1000000::BIGINT GROUP BY 1, 2, 3)
SELECT CAST(b.trade_date AS VARCHAR) AS trade_date, b.code, b.end_time, f_bid AS "F_bid", coalesce(f_vol, 0.0)::DOUBLE AS "F_volume" FROM b LEFT JOIN v USING (trade_date, code, end_time)"""


def _bundle(spark, sf, lookback=0):
    tick, deal, order = event_feeds(spark, sf)
    needs = fac.DataNeeds(tick=True, deal=True, lookback=lookback)
    return fac.bundle(needs, fac.load_needs(needs, {"tick": lambda: tick, "deal": lambda: deal, "order": lambda: order}))


@query("ud1_frame_factors", "v_tick v_deal_ev", _SLICED)
def ud1_frames(spark, sf):
    out = fac.frame_factors(_bundle(spark, sf), _slice_factor, "F_bid double, F_volume double", ("103000", "143000"))
    return out.withColumn("trade_date", day())


def _batch_factor(data: dict, codes: list, date, end_times: list) -> pd.DataFrame | None:
    """``_slice_factor`` of all stocks and slices, leaving out those without ticks."""
    ends, shown, bids, volumes = fac.end_micros(end_times), [], [], []
    for code in codes:
        last = data[code].last_rows("tick", ends)
        own = np.flatnonzero(last >= 0)
        shown.append(own)
        if len(own):
            bids.append(data[code].column("tick", "bid_price1")[last[own]])
            volumes.append(data[code].totals("deal", "volume", ends[own]))
    if not bids:
        return None
    return pd.DataFrame({"code": np.repeat(np.array(codes, object), [len(own) for own in shown]), "end_time": np.array(end_times, object)[np.concatenate(shown)],
                         "F_bid": np.concatenate(bids).astype(float), "F_volume": np.concatenate(volumes).astype(float)})


@query("ud1_streamed_factors", "v_tick v_deal_ev", """
, f AS (SELECT trade_date, code, seq_num, 0::DOUBLE AS v FROM v_tick UNION ALL SELECT trade_date, code, seq_num, volume::DOUBLE FROM v_deal_ev)
SELECT CAST(trade_date AS VARCHAR) AS trade_date, code, count(*)::DOUBLE AS "F_rows", max(seq_num)::DOUBLE AS "F_last", sum(v) AS "F_volume" FROM f GROUP BY 1, 2""")
def ud1_streamed(spark, sf):
    """Frames of a stock come one after the other; the function keeps three numbers."""
    def fold(code, date, frames) -> dict:
        rows, last, volume = 0, 0, 0.0
        for frame in frames:
            rows, last = rows + len(frame), int(frame["seq_num"].iloc[-1])
            volume += float(frame.loc[frame["kind"] == "deal", "volume"].sum())
        return {"F_rows": float(rows), "F_last": float(last), "F_volume": volume}

    return fac.streamed_factors(_bundle(spark, sf), fold, "F_rows double, F_last double, F_volume double").select(day(), "code", "F_rows", "F_last", "F_volume")


_ENDS = tuple(f"{9 + m // 60:02d}{m % 60:02d}00" for m in range(30, 360, 5))


@query("ud2_many_slices", "v_tick v_deal_ev", _SLICED.replace("(VALUES ('103000', 37800), ('143000', 52200)) v(end_time, s)",
    "(SELECT lpad(CAST(9 + m // 60 AS VARCHAR), 2, '0') || lpad(CAST(m % 60 AS VARCHAR), 2, '0') || '00' AS end_time, (9 * 60 + m) * 60 AS s FROM range(30, 360, 5) r(m))").replace(
    "SELECT CAST(b.trade_date", "SELECT code, count(*) AS slices, count(DISTINCT \"F_bid\") AS bids FROM (SELECT CAST(b.trade_date") + ") GROUP BY 1")
def ud2_many(spark, sf):
    """A slice every five minutes: each stock is cut once and every slice is a view."""
    out = fac.batch_factors(_bundle(spark, sf), _batch_factor, "F_bid double, F_volume double", 4, _ENDS)
    return out.groupBy("code").agg(F.count("*").alias("slices"), F.countDistinct("F_bid").alias("bids"))


@query("ud2_batch_factors", "v_tick v_deal_ev", _SLICED)
def ud2(spark, sf):
    out = fac.batch_factors(_bundle(spark, sf), _batch_factor, "F_bid double, F_volume double", 4, ("103000", "143000"))
    return out.withColumn("trade_date", day())


@query("ud3_bundle_history", "v_tick v_deal_ev", """
, c AS (SELECT trade_date, dense_rank() OVER (ORDER BY trade_date) AS o FROM (SELECT DISTINCT trade_date FROM v_tick)),
f AS (SELECT trade_date, code, 'tick' AS kind FROM v_tick UNION ALL SELECT trade_date, code, 'deal' FROM v_deal_ev),
a AS (SELECT DISTINCT trade_date, code FROM f), n AS (SELECT c.o, code, kind, count(*) AS n FROM f JOIN c USING (trade_date) GROUP BY 1, 2, 3)
SELECT CAST(a.trade_date AS VARCHAR) AS trade_date, a.code, n.kind, (c.o - n.o)::INTEGER AS day_offset, n.n AS rows FROM a JOIN c USING (trade_date) JOIN n ON n.code = a.code AND n.o BETWEEN c.o - 2 AND c.o""")
def ud3(spark, sf):
    return _bundle(spark, sf, lookback=2).groupBy(day(), "code", "kind", "day_offset").agg(F.count("*").alias("rows"))


@query("ud3_cogrouped_factors", "v_tick v_daily", """
, t AS (SELECT trade_date, code, count(*) AS n FROM v_tick WHERE event_type <> 'error' GROUP BY 1, 2)
SELECT CAST(d.trade_date AS VARCHAR) AS trade_date, d.id_qi AS code, coalesce(t.n, 0) * d.close AS "F_mix" FROM v_daily d LEFT JOIN t ON t.trade_date = d.trade_date AND t.code = d.id_qi""")
def ud3_cogroup(spark, sf):
    def mix(code, date, ticks: pd.DataFrame, market: pd.DataFrame) -> dict:
        return {"F_mix": float(len(ticks) * market["close"].iloc[0])}

    ticks = view(spark, sf, "v_tick").where("event_type <> 'error'").select("trade_date", "code", "seq_num")
    market = view(spark, sf, "v_daily").select("trade_date", F.col("id_qi").alias("code"), "close")
    return fac.cogrouped_factors(ticks, market, mix, "F_mix double").select(day(), "code", "F_mix")


@query("ud4_declared_inputs", "v_tick v_order", """
SELECT kind, count(*) AS rows FROM (SELECT 'tick' AS kind, code FROM v_tick UNION ALL SELECT 'order', code FROM v_order) WHERE code IN ('000001', '000002') GROUP BY 1""")
def ud4(spark, sf):
    def not_declared():
        raise AssertionError("an undeclared input was opened")

    needs = fac.DataNeeds(tick=True, order=True, securities=("000001", "000002"))
    frames = fac.load_needs(needs, {"tick": lambda: view(spark, sf, "v_tick"), "order": lambda: view(spark, sf, "v_order"), "deal": not_declared})
    return fac.bundle(needs, frames).groupBy("kind").agg(F.count("*").alias("rows"))


@query("ud5_result_shapes", "v_tick", """
, n AS (SELECT trade_date, code, count(*) AS n FROM v_tick GROUP BY 1, 2)
SELECT CAST(trade_date AS VARCHAR) AS trade_date, code, n::DOUBLE AS "F_n" FROM n WHERE n <> 3""")
def ud5(spark, sf):
    def any_shape(data, code, date, end_time):
        n = float(len(data.tick))
        if n == 1:
            return {"F_n": n}
        if n == 2:
            return {code: {"F_n": n}}
        if n == 3:
            return None
        if n == 4:
            return [{"code": code, "F_n": n, "extra": 1}]
        return pd.DataFrame([{"code": code, "F_n": n}])

    tick = view(spark, sf, "v_tick")
    needs = fac.DataNeeds(tick=True)
    return fac.frame_factors(fac.bundle(needs, {"tick": tick}), any_shape, "F_n double").select(day(), "code", "F_n")


@query("ud7_output_hook", "v_tick v_deal_ev", _SLICED.replace("SELECT CAST(b.trade_date", "SELECT end_time, count(*) AS rows FROM (SELECT CAST(b.trade_date") + ") GROUP BY 1")
def ud7(spark, sf):
    root = scratch_path(spark, "hook")
    fac.emit(fac.batch_factors(_bundle(spark, sf), _batch_factor, "F_bid double, F_volume double", 4, ("103000", "143000")), ParquetHook(root))
    rows = spark.read.schema("code STRING, F_bid DOUBLE, F_volume DOUBLE, trade_date DATE, end_time STRING").parquet(root)
    return rows.groupBy("end_time").agg(F.count("*").alias("rows"))


_MODEL = {"f_range": 0.5, "f_close": -0.25, "f_volume": 0.125}
_PRED = """
, x AS (SELECT trade_date, id_qi AS code, high - low AS f_range, close AS f_close, volume::DOUBLE AS f_volume FROM v_daily),
s AS (SELECT trade_date, code, 1.0::DOUBLE + f_range * 0.5::DOUBLE + f_close * (-0.25)::DOUBLE + f_volume * 0.125::DOUBLE AS pred FROM x)"""


def _features(spark, sf):
    return view(spark, sf, "v_daily").select(
        "trade_date", F.col("id_qi").alias("code"), (F.col("high") - F.col("low")).alias("f_range"),
        F.col("close").alias("f_close"), F.col("volume").cast("double").alias("f_volume"))


@query("ud8_linear_score", "v_daily", _PRED + " SELECT CAST(trade_date AS VARCHAR) AS trade_date, code, pred FROM s")
def ud8(spark, sf):
    x = sc.feature_matrix(_features(spark, sf), list(_MODEL), keep=["trade_date", "code"])
    return sc.linear_score(x, _MODEL, 1.0).select(day(), "code", "pred")


@query("ud8_model_batches", "v_daily", _PRED + " SELECT CAST(trade_date AS VARCHAR) AS trade_date, code, pred FROM s")
def ud8_model(spark, sf):
    def predict(x: pd.DataFrame) -> pd.Series:
        return 1.0 + x["f_range"] * 0.5 + x["f_close"] * -0.25 + x["f_volume"] * 0.125

    return sc.model_score(_features(spark, sf), list(_MODEL), predict, ["trade_date", "code"]).select(day(), "code", "pred")


@query("w4_tail_weights", "v_daily", _PRED + """
, r AS (SELECT trade_date, code, pred, row_number() OVER (PARTITION BY trade_date ORDER BY pred, code) AS a, count(*) OVER (PARTITION BY trade_date) AS n FROM s),
k AS (SELECT *, least(greatest(1, ceil(n * 0.1::DOUBLE)), n // 2) AS k FROM r)
SELECT CAST(trade_date AS VARCHAR) AS trade_date, code, CASE WHEN n < 2 THEN 0.0 WHEN a > n - k THEN 1.0::DOUBLE / k WHEN a <= k THEN -1.0::DOUBLE / k ELSE 0.0 END::DOUBLE AS position FROM k""")
def w4(spark, sf):
    scored = sc.linear_score(_features(spark, sf), _MODEL, 1.0).select("trade_date", "code", "pred")
    return sc.tail_weights(scored, ["trade_date"], 0.1).select(day(), "code", "position")


@query("ud11_inference_inputs", "v_daily v_security", _COMP + _PRED + """
, c AS (SELECT trade_date, lag(trade_date) OVER (ORDER BY trade_date) AS prev FROM (SELECT DISTINCT trade_date FROM v_daily))
SELECT CAST(s.trade_date AS VARCHAR) AS trade_date, s.code, s.pred, p.pred AS prev_pred, d.close, sec.industry, m.index_code = '000002' AS in_idx_000002
FROM s JOIN c USING (trade_date) LEFT JOIN s p ON p.trade_date = c.prev AND p.code = s.code JOIN v_daily d ON d.trade_date = s.trade_date AND d.id_qi = s.code
JOIN v_security sec ON sec.id_qi = s.code JOIN comp m ON m.trade_date = s.trade_date AND m.id_qi = s.code WHERE sec.industry <> 'MACHINERY'""")
def ud11(spark, sf):
    daily = view(spark, sf, "v_daily")
    days = cal.calendar(daily)
    scored = sc.linear_score(_features(spark, sf), _MODEL, 1.0).select("trade_date", "code", "pred")
    previous = cal.previous_day_values(scored, days, ["code"], ["pred"]).select("trade_date", "code", "prev_pred")
    names = view(spark, sf, "v_security").select("security_id", "industry")
    panel = daily.join(names, "security_id").select("trade_date", F.col("id_qi").alias("code"), "close", "industry")
    universe = panel.where("industry <> 'MACHINERY'").select("code").distinct()
    flags = membership_flags(_composition(spark, sf), ["000002"], ["trade_date", "id_qi"]).withColumnRenamed("id_qi", "code")
    out = fac.inference_inputs(scored, previous, panel, universe, flags)
    return out.select(day(), "code", "pred", "prev_pred", "close", "industry", "in_idx_000002")
