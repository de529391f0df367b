"""Cases that the registered queries do not reach."""

import datetime as dt

from pyspark.sql import functions as F

from tickloom.operators import risk, universe
from tickloom.sources import vendor

D1, D2 = dt.date(2024, 1, 2), dt.date(2024, 1, 3)


def test_universe_looks_at_the_newest_day_only(spark):
    rows = [(D1, "1", "*ST one"), (D2, "1", "one"), (D2, "2", "two"), (D2, "2", "ST two"), (D1, "3", "three"), (D2, "4", None)]
    panel = spark.createDataFrame(rows, "trade_date date, id_qi string, sec_short_name string")
    kept = universe.trading_universe(panel).collect()
    assert sorted(r.code6 for r in kept) == ["000001", "000004"]
    assert universe.trading_universe(panel.limit(0)).count() == 0


def test_held_stocks_need_finite_values_and_one_group_each(spark):
    rows = [(D1, "a", 1.0, 1.0, 0.0), (D1, "b", 1.0, 1.0, 1.0), (D2, "a", 1.0, 0.0, 1.0), (D2, "b", None, 1.0, 0.0)]
    panel = spark.createDataFrame(rows, "trade_date date, code string, beta double, g1 double, g2 double")
    held = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "book int, code string")
    out = risk.held_complete(panel, held, "code", ["beta"], panel.select("trade_date").distinct(), ["g1", "g2"], ["book"])
    assert {(r.book, r.trade_date): r.held_complete for r in out.collect()} == {
        (1, D1): True, (1, D2): True, (2, D1): False, (2, D2): False}


def test_baseline_takes_the_last_qualifying_days(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(10)]
    good = [True, False, True, True, False, False, True, True, True, True]
    rows = [(d, 10 * (i + 1), 10 * (i + 1), g) for i, (d, g) in enumerate(zip(days, good))]
    quality = spark.createDataFrame(rows, "trade_date date, stocks long, members long, qualifies boolean")
    out = {r.trade_date: r.stock_baseline for r in risk.snapshot_candidates(quality).collect()}
    assert [out[d] for d in days] == [None] * 8 + [40.0, 70.0]


def test_malformed_lines_are_counted_and_left_out(spark, tmp_path):
    path = str(tmp_path / "m")
    lines = ["a,b,c", "1,2,3", "4,5", "", ",,", "6,7,8,9"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    counts = vendor.message_line_counts(spark, path, ["x", "y", "z"], titled=False).first()
    assert (counts.lines, counts.bad_lines) == (5, 2)
    kept = vendor.read_message_csv(spark, path, ["x", "y", "z"], ["x"], titled=False)
    assert kept.count() == 3 and kept.where(F.col("x").isNull()).count() == 1
