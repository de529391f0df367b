"""Order conversion cases, one book per case, all in one plan."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tickloom.operators import portfolio as pf

# case -> (targets, positions, quotes {code: (price, limit)}, expected {code: (side, volume)})
CASES = {
    "first_day": ([("000001", 0.10)], [], {"000001.XSHE": (10.0, None)}, {"000001": ("buy", 1000)}),
    "rebalance": ([("000001", 0.10), ("600000", 0.0)], [("600000.SH", 100, 100, 10.0)],
                  {"000001.XSHE": (10.0, None), "600000.XSHG": (10.0, None)}, {"000001": ("buy", 1000), "600000": ("sell", 100)}),
    "sell_clamped": ([("600000", 0.0)], [("600000.SH", 1000, 300, 10.0)], {"600000.XSHG": (10.0, None)}, {"600000": ("sell", 300)}),
    "no_price": ([("000001", 0.10)], [], {}, {}),
    "unpriced_held_target": ([("600000", 0.10)], [("600000.SH", 1000, 1000, 10.0)], {}, {}),
    "unpriced_and_priced": ([("000001", 0.10), ("600000", 0.20)], [("600000.SH", 100, 100, 0.0)],
                            {"000001.XSHE": (10.0, None)}, {"000001": ("buy", 1000)}),
    "below_one_lot": ([("000001", 0.00001)], [], {"000001.XSHE": (10.0, None)}, {}),
    "exits": ([("000001", 0.10)], [("600000.SH", 500, 200, 10.0), ("600000.SH", 500, 300, 10.0), ("000002.SZ", 100, 100, 10.0)],
              {}, {"000002": ("sell", 100), "600000": ("sell", 500)}),
    "limit_up_buy": ([("000001", 0.10)], [], {"000001.XSHE": (11.0, 11.0)}, {}),
    "below_limit": ([("000001", 0.10)], [], {"000001.XSHE": (10.99, 11.0)}, {"000001": ("buy", 900)}),
    "sell_at_limit": ([("000001", 0.0)], [("000001.SZ", 1000, 1000, 11.0)], {"000001.XSHE": (11.0, 11.0)}, {"000001": ("sell", 1000)}),
    "held_buy_at_limit": ([("000001", 0.10)], [("000001.SZ", 100, 100, 11.0)], {"000001.XSHE": (11.0, 11.0)}, {"000001": ("buy", 800)}),
    "unknown_limit": ([("600000", 0.10)], [], {"600000.XSHG": (10.0, None)}, {"600000": ("buy", 1000)}),
    "single_share_board": ([("688001", 0.0305), ("688002", 0.0199)], [], {"688001.XSHG": (10.0, None), "688002.XSHG": (10.0, None)},
                           {"688001": ("buy", 305)}),
    "single_share_exit": ([("000001", 0.0)], [("688001.SH", 137, 137, 10.0)], {}, {"688001": ("sell", 137)}),
    "one_lot_exit_keeps_lot": ([("000001", 0.0)], [("601398.SH", 100, 100, 8.35)], {}, {"601398": ("sell", 100)}),
}


def book(spark, name):
    """Prices differ between cases, so each case is its own conversion."""
    targets, positions, quotes, _ = CASES[name]
    frames = (
        spark.createDataFrame([(name, *t) for t in targets], "book string, code string, position double"),
        spark.createDataFrame([(name, *p) for p in positions], "book string, code string, current_volume bigint, available_volume bigint, last_price double"),
        spark.createDataFrame([(name, 100_000.0)], "book string, total_asset double"),
        spark.createDataFrame([(c, p, lim) for c, (p, lim) in quotes.items()], "code string, price double, high_limit double"),
    )
    return frames


@pytest.mark.parametrize("name", CASES)
def test_orders(spark, name):
    got = {r.code: (r.side, r.volume) for r in pf.positions_to_orders(*book(spark, name), ["book"]).collect()}
    assert got == CASES[name][3]


def test_reports(spark):
    frames = book(spark, "unpriced_and_priced")
    assert [r.code6 for r in pf.unpriced_targets(frames[0], frames[1], frames[3], ["book"]).collect()] == ["600000"]
    assert [r.code for r in pf.limit_up_buys(*book(spark, "limit_up_buy"), ["book"]).collect()] == ["000001"]


def test_modes_and_capital(spark):
    targets, positions, account, quotes = book(spark, "held_buy_at_limit")
    plain = pf.positions_to_orders(targets, positions, account, quotes.withColumn("high_limit", F.lit(None).cast("double")), ["book"], mode="absolute")
    assert plain.first().volume == 900
    double = pf.positions_to_orders(targets, positions, account, quotes, ["book"], capital=200_000.0)
    assert double.first().volume == 1700
    with pytest.raises(ValueError):
        pf.positions_to_orders(targets, positions, account, quotes, ["book"], mode="other")
    with pytest.raises(Exception, match="no positive capital"):
        pf.positions_to_orders(targets, positions, account.withColumn("total_asset", F.lit(0.0)), quotes, ["book"]).collect()


def test_order_ids(spark):
    rows = [("000001", "buy", 100, "tree", None, 10.0), ("000001", "buy", 100, "tree", None, 10.5),
            ("600000", "buy", 100, "tree", "UpLimitF=1.0:price=12.34", 1.0)]
    df = spark.createDataFrame(rows, "code string, side string, volume bigint, strategy string, algo_param string, price double")
    out = pf.gateway_orders(df, F.lit("20260807"), F.lit("093000"), "market", "vwap").collect()
    text = "|".join(["20260807", "093000", "000001.SZ", "buy", "100", "market", "tree", "vwap", ""])
    ids = {r.order_id for r in out if r.symbol == "000001.SZ"}
    assert ids == {"tree_" + hashlib.md5(text.encode()).hexdigest()[:12]}
    assert [r.algo_param for r in out if r.symbol == "600000.SH"] == ["UpLimitF=1.0"]
    assert "price" not in out[0].asDict()


def test_budget_reports_without_cutting(spark):
    orders = spark.createDataFrame([("a", "buy", 1000, 10.0), ("a", "sell", 100, 10.0)], "book string, side string, volume bigint, price double")
    account = spark.createDataFrame([("a", 500.0)], "book string, available_cash double")
    row = pf.budget_check(orders, account, ["book"]).first()
    assert (row.budget, row.excess, row.over_budget) == (1400.0, 8600.0, True)
