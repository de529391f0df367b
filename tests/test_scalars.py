import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom import schemas as S
from tickloom.functions import codes, times, values
from tickloom.operators import codec, feeds

DAY = dt.date(2026, 1, 5)


def one(spark, *columns, **data):
    """Evaluate columns over one row of literals."""
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'bigint'}" for k, v in data.items())
    return spark.createDataFrame([tuple(data.values())], schema).select(*columns).first()


@pytest.mark.parametrize("raw, full, gate, digits", [
    ("600000", "600000.XSHG", "600000.SH", "600000"), ("1", "000001.XSHE", "1", "000001"),
    ("300750", "300750.XSHE", "300750.SZ", "300750"), ("900901", "900901.XSHG", "900901", "900901"),
])
def test_code_forms(spark, raw, full, gate, digits):
    c = F.col("c")
    row = one(spark, codes.full_code(c), codes.gateway_symbol(c), codes.digits6(c), c=raw)
    assert tuple(row) == (full, gate, digits)


@pytest.mark.parametrize("raw, key", [("sh600000", "SH600000"), ("600000.xshg", "600000"), ("1.SZ", "000001"), ("SH600000.SH", "SH600000")])
def test_trade_key(spark, raw, key):
    assert one(spark, codes.key6(F.col("c")), c=raw)[0] == key


def test_gateway_prefix_and_unknown(spark):
    assert one(spark, codes.gateway_symbol(F.col("c")), c="sz000001")[0] == "000001.SZ"
    assert one(spark, codes.gateway_symbol(F.col("c")), c="830799")[0] == "830799"
    assert one(spark, codes.digits6(F.col("c")), c="none")[0] is None


def test_split_code(spark):
    assert tuple(one(spark, codes.split_code(F.col("c")), c="000001.XSHE")[0]) == ("000001", "XSHE")
    assert tuple(one(spark, codes.split_code(F.col("c")), c="000001")[0]) == ("000001", None)


@pytest.mark.parametrize("text, want", [
    ("09:30:00.500", dt.datetime(2026, 1, 5, 9, 30, 0, 500_000)), ("00:05:60.780", dt.datetime(2026, 1, 5, 0, 6, 0, 780_000)),
    ("9:5:3", dt.datetime(2026, 1, 5, 9, 5, 3)), ("23:59:60", None), ("x", None), ("09:30", dt.datetime(2026, 1, 5, 9, 30)),
])
def test_clock_text(spark, text, want):
    assert one(spark, times.parse_clock_text(F.col("t"), F.lit(DAY)), t=text)[0] == want


@pytest.mark.parametrize("raw, want", [
    (93000000, dt.datetime(2026, 1, 5, 9, 30)), (148182540, dt.datetime(2026, 1, 5, 15, 22, 22, 540_000)),
    (1767605400000, dt.datetime(2026, 1, 5, 9, 30)),
])
def test_clock_number(spark, raw, want):
    assert one(spark, times.parse_clock_number(F.col("n"), F.lit(DAY)), n=raw)[0] == want


def test_clock_columns_ignore_session_zone(spark):
    stamp = F.lit("2026-07-05 09:30:00.25").cast("timestamp_ntz")
    exprs = [times.epoch_micros(stamp), times.micros_of_day(stamp), times.label_hhmmss(stamp)]
    before = spark.conf.get("spark.sql.session.timeZone")
    got = []
    try:
        for zone in ("UTC", "America/New_York", "Asia/Shanghai"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got.append(tuple(spark.range(1).select(*exprs).first()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert set(got) == {(1783243800250000, 34200250000, "093000")}


def test_slices(spark):
    seconds = times.slice_seconds(60)
    table = times.slice_dimension(spark, 60).orderBy("slice").collect()
    assert len(table) == len(seconds) == 245
    assert (table[0].end_time, table[-1].end_time) == ("092500", "145900")
    assert [r.end_second for r in table] == seconds
    assert times.slice_dimension(spark, 0).first().end_time == ""


BUDGET = [
    (1.0, 1.0, 100.0, 0.35, 0.02, 0.35), (0.90, 1.0, 100.0, 0.35, 0.02, 0.35), (0.30, 4_900_000.0, 7_000_000.0, 0.35, 0.02, 0.72),
    (0.0, 7.0, 7.0, 0.35, 0.02, 1.0), (math.nan, 1.0, 100.0, 0.35, 0.02, 0.35), (-1.0, 1.0, 100.0, 0.35, 0.02, 0.35),
    (0.30, 1.0, 100.0, 1.0, 0.02, 1.0), (0.50, 1.0, 2.0, math.nan, math.nan, 0.52), (0.6499, 1.0, 1.0, 0.35, 0.02, 0.3701),
    (0.30, 0.0, 100.0, 0.35, 0.02, 0.35), (0.30, math.nan, 100.0, 0.35, 0.02, 0.35), (0.30, 100_000.0, 1_000_000.0, 0.35, 0.02, 0.45),
]


def test_turnover_budget(spark):
    df = spark.createDataFrame(BUDGET, "g double, f double, t double, b double, x double, want double")
    c = F.col
    for row in df.select("want", values.turnover_budget(c("g"), c("f"), c("t"), c("b"), c("x")).alias("got")).collect():
        assert row.got == pytest.approx(row.want, abs=1e-12)


def test_numeric_text_rule(spark):
    rows = [(str(i), "x" if i < 2 else str(i), None) for i in range(100)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    assert [t for _, t in values.coerce_numeric_text(df).dtypes] == ["double", "string", "double"]
    assert dict(values.coerce_numeric_text(df, share=0.98).dtypes)["b"] == "double"


def test_decode_bundle_and_empty_schema(spark):
    encoded = spark.createDataFrame(
        [(123, 1767605400000000, 7, 1234)], "code int, time bigint, seq_num bigint, price int")
    full, empty = codec.decode(encoded), codec.decode(encoded.where("false"))
    row = full.first()
    assert (row.code, row.price, row.time) == ("123", 12.34, dt.datetime(2026, 1, 5, 17, 30))
    assert full.dtypes == empty.dtypes == [("code", "string"), ("time", "timestamp_ntz"), ("seq_num", "bigint"), ("price", "double")]


def test_sentinel_price_is_clipped(spark):
    assert one(spark, values.to_cents(F.col("p")), p=999999999.9999)[0] == 2147483647


cents = st.integers(min_value=0, max_value=20_000_000)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(cents, st.integers(0, 86_399_999_999), st.integers(0, 10**9)), min_size=1, max_size=40))
def test_codec_round_trip(spark, rows):
    day = dt.datetime(2026, 1, 5)
    data = [(1, day + dt.timedelta(microseconds=us), day, i, i + 1, 1, p / 100, float(v), i) for i, (p, us, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "security_id int, time timestamp_ntz, update_time timestamp_ntz, sale_order_id bigint, "
                                     "buy_order_id bigint, side int, price double, volume double, seq_num bigint")
    back = codec.decode(codec.encode(df, "deal"), volume_scale=1.0)
    want = sorted(tuple(r) for r in df.select("seq_num", "time", "price", "volume").collect())
    assert sorted(tuple(r) for r in back.select("seq_num", "time", "price", "volume").collect()) == want


def test_merged_messages(spark):
    fields = "SecurityID string, TickTime bigint, LocalTime bigint, Type string, TickBSFlag string, Price double, Qty bigint, BuyOrderNO bigint, SellOrderNO bigint, Channel bigint, BizIndex bigint, TradeMoney double"
    rows = [
        ("600000", 93001500, 93001500, "T", "B", 10.0, 100, 600001, 600002, 1005, 12345, 0.0),
        ("600000", 93001500, 93001500, "T", "N", 10.0, 999999999999999, 1, 2, 1001, 1000, 55.5),
        ("600601", 150000000, 150000000, "T", "CLOSE", 0.0, 0, 0, 0, 1008, 999, 0.0),
        ("600601", 150000000, 150000000, "A", "ENDTR", 0.0, 0, 0, 0, 1008, 998, 0.0),
        ("510300", 93001500, 93001500, "A", "B", 4.0, 100, 9, 0, 1, 2, 0.0),
        ("688001", 93001500, 93001500, "D", "S", 5.0, 7, 0, 42, 3, 4, 0.0),
    ]
    orders, deals = feeds.split_merged_sh(spark.createDataFrame(rows, fields), F.lit(DAY))
    assert [(r.code, r.order_id, r.side, r.order_type) for r in orders.collect()] == [("688001.XSHG", 42, 1, 5)]
    got = {r.seq_num: (r.channel, r.side, r.volume, r.money) for r in deals.collect()}
    assert got == {12345: (1005, 0, 100.0, 1000.0), 1000: (1001, 10, 999999999999999.0, 55.5)}
    assert orders.schema.fieldNames() == S.ORDER.fieldNames()


def test_headers_round_trip(spark):
    df = spark.createDataFrame([], S.TICK)
    named = S.with_headers(df)
    assert {"TradingDay", "AskPrice10", "BidNum3", "IOPV", "SeqNum"} <= set(named.columns)
    assert S.from_headers(named).columns == df.columns and len(df.columns) == 81


def test_validate_feed(spark):
    base = S.conform(spark.createDataFrame([("600000.XSHG", 1, 1)], "code string, channel bigint, seq_num bigint"), "order")
    assert feeds.validate_feed(base, "order").first().valid
    assert not feeds.validate_feed(base.unionByName(base), "order").first().valid
    assert not feeds.validate_feed(base.drop("price"), "order").first().valid
    assert not feeds.validate_feed(base.where("false"), "order").first().valid
