"""Keyed helpers against brute force, with one key holding a third of the rows."""

import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tickloom.operators import keyed, quality
from tickloom.operators.calendar import calendar, expand_over_days, running_asof


@pytest.fixture(scope="module")
def skewed(spark):
    """(key, seq, value): key 0 has a third of 3,000 rows; some sequence numbers repeat or are missing."""
    n = F.col("id")
    key = F.when(n % 3 == 0, 0).otherwise(n % 29)
    seq = F.when(n % 97 == 0, n - 1).otherwise(n * 2 + F.when(n % 50 > 40, 7).otherwise(0))
    df = spark.range(3000).select(key.alias("key"), seq.alias("seq"), ((n * 7919) % 1009).cast("double").alias("value"), n.alias("tie"))
    rows = [tuple(r) for r in df.collect()]
    return df, rows


def by_key(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return out


def test_keep_first(skewed):
    df, rows = skewed
    want = {}
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        want.setdefault((r[0], r[1]), r)
    got = keyed.keep_first(df, ["key", "seq"], [F.col("value"), F.col("tie")]).collect()
    assert sorted(tuple(r) for r in got) == sorted(want.values())


def test_share_within(skewed):
    df, rows = skewed
    total = {k: sum(r[2] for r in g) for k, g in by_key(rows).items()}
    got = {r.tie: r.weight for r in keyed.share_within(df, ["key"], "value", spread_by=["tie"]).collect()}
    assert got == {r[3]: r[2] / total[r[0]] for r in rows}


def test_ordered_position(skewed):
    df, rows = skewed
    got = {r.tie: (r.position, r.group_rows) for r in keyed.ordered_position(df, ["key"], [F.col("value"), F.col("tie")]).collect()}
    want = {}
    for g in by_key(rows).values():
        for i, r in enumerate(sorted(g, key=lambda r: (r[2], r[3]))):
            want[r[3]] = (i + 1, len(g))
    assert got == want


def test_exact_median(skewed):
    df, rows = skewed
    got = {r.key: r.value_median for r in keyed.exact_median(df, ["key"], "value", [F.col("tie")]).collect()}
    assert got == {k: statistics.median(r[2] for r in g) for k, g in by_key(rows).items()}


def test_previous_in_ranges(skewed):
    df, rows = skewed
    got = keyed.previous_in_ranges(df, ["key"], F.floor(F.col("seq") / 100), [F.col("seq"), F.col("tie")], "tie", "prev")
    want = {}
    for g in by_key(rows).values():
        g = sorted(g, key=lambda r: (r[1], r[3]))
        for before, r in zip([None, *g], g):
            want[r[3]] = before[3] if before else None
    assert {r.tie: r.prev for r in got.collect()} == want


def test_sequence_gaps(skewed):
    df, rows = skewed
    unique = df.dropDuplicates(["key", "seq"])
    got = {r.key: (r.messages, r.missing, r.gaps, r.largest_gap) for r in quality.sequence_gaps(unique, ["key"], "seq", width=64).collect()}
    for k, g in by_key(rows).items():
        s = sorted({r[1] for r in g})
        gaps = [b - a - 1 for a, b in zip(s, s[1:])]
        assert got[k] == (len(s), sum(gaps), sum(x > 0 for x in gaps), max(gaps))


def test_running_asof(spark):
    days = spark.createDataFrame([("2026-01-05",), ("2026-01-06",), ("2026-01-08",)], "d string").select(F.col("d").cast("date").alias("trade_date"))
    log = spark.createDataFrame(
        [("a", "2025-12-01", 1, 10.0), ("a", "2026-01-06", 2, 20.0), ("a", "2026-01-06", 3, 30.0), ("a", "2026-01-09", 4, 99.0), ("b", "2026-01-07", 5, 7.0)],
        "k string, d string, tie int, v double").withColumn("d", F.col("d").cast("date"))
    strict = {(str(r.trade_date), r.k): r.v for r in running_asof(log, calendar(days), ["k"], "d", "tie", ["v"]).collect()}
    assert strict == {("2026-01-05", "a"): 10.0, ("2026-01-06", "a"): 10.0, ("2026-01-08", "a"): 30.0, ("2026-01-08", "b"): 7.0}
    loose = {(str(r.trade_date), r.k): r.v for r in running_asof(log, calendar(days), ["k"], "d", "tie", ["v"], strict=False).collect()}
    assert loose[("2026-01-06", "a")] == 30.0


def test_expand_over_days_is_half_open(spark):
    days = calendar(spark.createDataFrame([("2026-01-05",), ("2026-01-06",)], "d string").select(F.col("d").cast("date").alias("trade_date")))
    spans = spark.createDataFrame([("x", 1, 3), ("y", 2, 2), ("z", 2, 3)], "k string, a int, b int")
    got = sorted((r.k, str(r.trade_date)) for r in expand_over_days(spans, days, "a", "b").collect())
    assert got == [("x", "2026-01-05"), ("x", "2026-01-06"), ("z", "2026-01-06")]


def test_dedupe_plan_limits_before_the_shuffle(skewed):
    plan = keyed.keep_first(skewed[0], ["key", "seq"], [F.col("value"), F.col("tie")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning") < plan.rindex("WindowGroupLimit")


@pytest.mark.parametrize("rows_per_task", [1, 7, 100, 1_000_000])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_splits_heavy_keys_by_their_count(spark, rows_per_task, how):
    big = spark.range(1000).select(F.when(F.col("id") < 700, 1).when(F.col("id") < 990, F.col("id") % 40).alias("key"), F.col("id").alias("n"))
    small = spark.range(30).select(F.col("id").alias("key"), (F.col("id") * 10).alias("v"))
    got = keyed.salted_join(big, small, ["key"], how, ["n"], rows_per_task=rows_per_task)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, big.join(small, ["key"], how).collect()), key=str)


def test_only_rows_of_heavy_keys_are_copied(spark):
    counts = spark.createDataFrame([("hot", 25), ("warm", 10), ("cold", 1)], "key string, _rows long")
    assert {r["key"]: r["_salts"] for r in keyed.heavy_keys(counts, ["key"], rows_per_task=10).collect()} == {"hot": 3}
    assert keyed.heavy_keys(counts, ["key"]).count() == 0  # flat data: nothing is split


def test_totals_next_to_rows_whatever_is_split(skewed):
    df = skewed[0] if isinstance(skewed, tuple) else skewed
    want = sorted(map(str, keyed.attach_totals(df, ["key"], ["tie"], _total=F.sum("value")).collect()))
    for n in (1, 13):
        assert sorted(map(str, keyed.attach_totals(df, ["key"], ["tie"], rows_per_task=n, _total=F.sum("value")).collect())) == want
