"""State, slices, factors in Python, panel repair, risk snapshots: brute force on small data."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import factors as fac
from tickloom.operators import panel as pan
from tickloom.operators import risk
from tickloom.operators import state as st
from tickloom.plans.state_queries import event_feeds, half_hours
from tickloom.plans.views import view

SF = "/root/testdata/sf0.001"


def feeds_of(spark):
    return event_feeds(spark, SF)


def test_slices_equal_state_of_cut_feeds(spark):
    sliced = st.sliced_state(*feeds_of(spark), half_hours(spark)).where("slice IN (5, 20, 47)")
    names = ["trade_date", "code", "open", "latest_price", "high", "low", "pre_close", "ask1", "bid1", "ask_volume1",
             "tick_count", "deal_count", "order_count", "cum_amount", "cum_volume", "buy_order_volume", "cancel_count", "last_market_time"]
    for slice_ in (5, 20, 47):
        limit = ((slice_ + 1) * 1800 - 1) * 1_000_000
        micros = (F.hour("time") * 3600 + F.minute("time") * 60).cast("long") * 1_000_000 + (F.date_part(F.lit("SECOND"), F.col("time")) * 1_000_000).cast("long")
        cut = [f.where(micros <= limit) for f in feeds_of(spark)]
        want = sorted(map(str, st.full_state(*cut).select(*names).collect()))
        assert sorted(map(str, sliced.where(F.col("slice") == slice_).select(*names).collect())) == want


def test_state_ignores_row_order(spark):
    tick = view(spark, SF, "v_tick")
    a = sorted(map(str, st.tick_state(tick).collect()))
    assert sorted(map(str, st.tick_state(tick.orderBy(F.xxhash64("seq_num"))).collect())) == a


def test_last_positive_value_wins(spark):
    rows = [(1, 10.0, 0.0, 5), (2, 0.0, 9.5, 6), (3, 12.0, 0.0, 7), (4, 0.0, 0.0, 0)]
    t = dt.datetime(2026, 1, 5, 9, 30)
    df = spark.createDataFrame([(dt.date(2026, 1, 5), "a", t, s, p, c, p, p, v, v) for s, p, c, v in rows],
                               "trade_date date, code string, time timestamp_ntz, seq_num bigint, current_price double, pre_close_price double, "
                               "ask_price1 double, bid_price1 double, ask_volume1 int, bid_volume1 int")
    r = st.tick_state(df).first()
    assert (r.open, r.latest_price, r.high, r.low, r.pre_close, r.ask1, r.ask_volume1, r.tick_count) == (10.0, 12.0, 12.0, 10.0, 9.5, 12.0, 0, 4)


@pytest.mark.parametrize("value, want", [
    (None, []), ({}, []), ({"F": 1}, [("a", "1", 1)]), ({"a": {"F": 1}}, [("a", "1", 1)]), ({"b": {"1": {"F": 1}, "2": {"F": 2}}}, [("b", "1", 1), ("b", "2", 2)]),
    ({"1": {"F": 1}, "2": {"F": 2}}, [("a", "1", 1), ("a", "2", 2)]), ([{"code": "c", "F": 1}, "junk"], [("c", "1", 1)]),
    (pd.DataFrame({"F": [1, 2]}), [("a", "1", 1), ("a", "1", 2)]),
])
def test_result_shapes(value, want):
    rows = fac.result_rows(value, "a", ["1", "2"])
    assert [(r["code"], r["end_time"], r["F"]) for r in rows] == want


def test_result_shape_error():
    with pytest.raises(TypeError):
        fac.result_rows(3, "a", [""])


def test_stock_with_most_rows_is_not_refused(spark):
    hot = F.when(F.col("seq_num") % 5 != 0, "999999").otherwise(F.col("code"))
    tick = view(spark, SF, "v_tick").withColumn("code", hot)
    want = {(r.trade_date, r.code): float(r["count"]) for r in tick.groupBy("trade_date", "code").count().collect()}
    tagged = fac.bundle(fac.DataNeeds(tick=True), {"tick": tick})
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        frames = fac.frame_factors(tagged, lambda data, *_: {"F": float(len(data.tick))}, "F double").collect()
        batches = fac.batch_factors(tagged, lambda data, codes, *_: {c: {"F": float(len(data[c].tick))} for c in codes},
                                    "F double", 2, codes_per_call=3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for out in (frames, batches):
        assert len(out) == len(want) and {(r.trade_date, r.code): r.F for r in out} == want


def test_runs_join_over_batches():
    batches = [pd.DataFrame({"k": ["a", "a"], "v": [1, 2]}), pd.DataFrame({"k": ["a", "b"], "v": [3, 4]}), pd.DataFrame({"k": [], "v": []}), pd.DataFrame({"k": ["b"], "v": [5]})]
    assert [(k, list(f["v"])) for k, f in fac._runs(iter(batches), ["k"])] == [(("a",), [1, 2, 3]), (("b",), [4, 5])]


def test_fold_merges_over_many_tasks(spark):
    finish = lambda s: pd.DataFrame({"F": s["v"] / s["n"]})
    fold = fac.sum_fold(["v", "n"], "v double, n bigint", "F double", finish)
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 11).alias("k"), (F.col("id") % 7).cast("double").alias("v"), F.lit(1).cast("long").alias("n"))
    got = {r.k: r.F for r in fac.fold_factors(df.repartition(7), ["k"], fold).collect()}
    assert got == {r.k: r.F for r in df.groupBy("k").agg((F.sum("v") / F.sum("n")).alias("F")).collect()}


def test_lookback_offsets():
    assert fac.DataNeeds(lookback=2).offsets() == [0, 1, 2]
    assert fac.DataNeeds(lookback=(3, 1)).offsets() == [1, 3]
    assert fac.DataNeeds().offsets() == []


def days(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("trade_date", F.col("trade_date").cast("date"))


def test_row_backfill_reads_raw_previous_day(spark):
    rows = [("2026-01-05", "a", 1.0), ("2026-01-05", "b", 2.0), ("2026-01-06", "a", 3.0), ("2026-01-07", "c", 4.0)]
    panel = days(spark, rows, "trade_date string, id_qi string, v double")
    out = {(str(r.trade_date), r.id_qi): r.v for r in pan.backfill_rows(panel, "id_qi", 2).collect()}
    # The 7th takes only what the 6th really had, not what was filled into it.
    assert out == {("2026-01-05", "a"): 1.0, ("2026-01-05", "b"): 2.0, ("2026-01-06", "a"): 3.0, ("2026-01-06", "b"): 2.0,
                   ("2026-01-07", "c"): 4.0, ("2026-01-07", "a"): 3.0}
    audit = {str(r.trade_date): (str(r.stale_from), r["count"], r.rows_after, r.still_short) for r in pan.backfill_audit(panel, "id_qi", 3).collect()}
    assert audit["2026-01-06"] == ("2026-01-05", 1, 2, True)


def test_column_backfill_chains_through_filled_days(spark):
    rows = [("2026-01-05", "a", "x", 1.0), ("2026-01-05", "b", "y", 1.0), ("2026-01-06", "a", None, 2.0), ("2026-01-07", "a", None, None), ("2026-01-07", "b", None, None)]
    panel = days(spark, rows, "trade_date string, id_qi string, ind string, beta double")
    out = {(str(r.trade_date), r.id_qi): (r.ind, r.moving_missing) for r in pan.backfill_column_group(panel, "id_qi", ["ind"], ["beta"]).collect()}
    assert out[("2026-01-06", "a")] == ("x", False)
    assert out[("2026-01-07", "a")] == ("x", True)
    assert out[("2026-01-07", "b")] == (None, True)  # absent on the 6th, so the chain broke


def risk_panel(spark, broken=()):
    rows = []
    for d in range(1, 10):
        for i in range(10):
            day = f"2026-01-{d:02d}"
            style = None if (d, i) in broken else float(i)
            rows.append((day, f"{i:06d}", style, 1.0 if i % 2 else 0.0, 0.0 if i % 2 else 1.0, None))
    panel = days(spark, rows, "trade_date string, id_qi string, BETA double, Banks double, Steel double, Mining double")
    bench = panel.where("id_qi < '000003'").select("trade_date", "id_qi")
    return panel, bench


@pytest.mark.parametrize("broken, want", [((), "2026-01-09"), (((9, 1),), "2026-01-08"), (((9, 7),), "2026-01-09"), (((4, 0), (3, 0), (2, 0), (1, 0)), None)])
def test_snapshot_selection(spark, broken, want):
    panel, bench = risk_panel(spark, broken)
    quality = risk.day_quality(panel, bench, "id_qi", ["BETA", "Banks", "Steel"], ["Mining"], ["Banks", "Steel"])
    asked = spark.createDataFrame([(dt.date(2026, 1, 10),)], "as_of date")
    got = risk.select_snapshot(risk.snapshot_candidates(quality), asked).first().risk_date
    assert (None if got is None else str(got)) == want


def test_snapshot_needs_held_stocks_and_age(spark):
    panel, bench = risk_panel(spark, ((9, 7),))
    quality = risk.day_quality(panel, bench, "id_qi", ["BETA"], ["Mining"], ["Banks", "Steel"])
    held = spark.createDataFrame([("000007",)], "id_qi string")
    ok = risk.held_complete(panel, held, "id_qi", ["BETA"], panel.select("trade_date").distinct())
    asked = spark.createDataFrame([(dt.date(2026, 1, 10),), (dt.date(2026, 1, 30),)], "as_of date")
    got = {str(r.as_of): r.risk_date for r in risk.select_snapshot(risk.snapshot_candidates(quality, ok), asked).collect()}
    assert str(got["2026-01-10"]) == "2026-01-08" and got["2026-01-30"] is None


def test_coverage_drop_disqualifies(spark):
    panel, bench = risk_panel(spark)
    thin = panel.where("NOT (trade_date = DATE '2026-01-09' AND id_qi >= '000007')")
    quality = risk.day_quality(thin, bench, "id_qi", ["BETA"], ["Mining"], ["Banks", "Steel"])
    usable = {str(r.trade_date): r.usable for r in risk.snapshot_candidates(quality).collect()}
    assert usable["2026-01-08"] and not usable["2026-01-09"] and not usable["2026-01-05"]


def test_target_contract(spark):
    target = spark.createDataFrame([("a", "1", 0.6), ("a", "2", 0.4), ("b", "1", 0.5)], "book string, code6 string, position double")
    current = spark.createDataFrame([("a", "1", 0.5), ("a", "3", 0.1)], "book string, code6 string, weight double")
    got = {r.book: r for r in risk.target_contract(target, current, ["book"], 0.7, max_weight=0.6).collect()}
    assert got["a"].turnover == pytest.approx(0.6) and got["a"].valid
    assert got["b"].turnover_limit == 1.0 and not got["b"].valid
