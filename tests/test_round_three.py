"""Many stocks and slices in plain arrays, stocks dealt one by one, whole batches walked, gap state in blocks."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from tickloom.operators import factors as fac
from tickloom.plans import factor_queries as fq
from tickloom.streaming import live


def bundle(n: int, rising: bool, untimed: bool = False, seed: int = 3) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    us = rng.integers(0, 1000, n) * 1_000_000
    out = pd.DataFrame({"kind": rng.choice(["tick", "deal", "order"], n), "day_offset": rng.integers(0, 2, n), "time_us": np.sort(us) if rising else us,
                        "bid_price1": rng.random(n), "volume": rng.integers(1, 9, n).astype(float)})
    out.loc[out["kind"] != "deal", "volume"] = np.nan
    out.loc[out.index % 7 == 0, "volume"] = np.nan
    if untimed:
        out["time_us"] = out["time_us"].astype(float).mask(out.index % 5 == 0)
    return out


@pytest.mark.parametrize("rising, untimed", [(True, False), (False, False), (True, True)])
def test_all_slices_at_once_are_the_frames_of_each(rising, untimed):
    ends = ["", *(f"{s // 3600:02d}{s // 60 % 60:02d}{s % 60:02d}" for s in (0, 1, 250, 251, 999, 5000))]
    data, at = fac.StockData("a", bundle(400, rising, untimed)), fac.end_micros(ends)
    last, volume = data.last_rows("tick", at), data.totals("deal", "volume", at)
    for i, end in enumerate(ends):
        cut = data.until(fac.end_second(end))
        np.testing.assert_array_equal(cut.column("tick", "bid_price1"), cut.tick["bid_price1"].to_numpy())
        assert last[i] == -1 if cut.tick.empty else data.column("tick", "bid_price1")[last[i]] == cut.tick["bid_price1"].iloc[-1]
        assert volume[i] == cut.deal["volume"].sum() == np.nansum(cut.column("deal", "volume"))
    np.testing.assert_array_equal(data.column("deal", "volume", 1), data.history[1]["deal"]["volume"].to_numpy())


def test_slices_of_the_queries_open_no_frames(monkeypatch):
    """A frame for each stock and slice is what took the time."""
    rows = bundle(60, True)
    want = [fq._slice_factor(fac.StockData("a", rows).until(s), "a", None, "") for s in (100, 900)]

    def frame(*_):
        raise AssertionError("a frame was cut")

    monkeypatch.setattr(fac.StockData, "_frame", frame)
    day, ends = dt.date(2026, 1, 5), ["000140", "001500"]
    got = fq._batch_factor({"a": fac.StockData("a", rows), "b": fac.StockData("b", rows.iloc[:0])}, ["a", "b"], day, ends)
    assert got.to_dict("records") == [{**w, "end_time": e} for w, e in zip(want, ends)]
    assert [fq._slice_factor(fac.StockData("a", rows).until(fac.end_second(e)), "a", day, e) for e in ends] == want


def test_one_group_is_shared_by_all_tasks(spark):
    """Before, a day's group of stocks lay in one task."""
    tagged = spark.range(400).select(F.lit("2026-01-05").cast("date").alias("trade_date"), F.concat(F.lit("c"), F.col("id") % 100).alias("code"), F.col("id").alias("seq_num"))

    def fn(data, codes, date, ends):
        return pd.DataFrame({"code": codes, "F_task": float(TaskContext.get().partitionId()), "F_n": [float(len(data[c]._rows)) for c in codes], "extra": 1})

    got = fac.batch_factors(tagged, fn, "F_task double, F_n double, F_none double", 1, ("103000", "143000"), codes_per_call=10).collect()
    assert sorted((r.code, r.end_time, r.F_n, r.F_none, str(r.trade_date)) for r in got) == sorted((f"c{i}", "103000", 4.0, None, "2026-01-05") for i in range(100))
    assert len({r.F_task for r in got}) == 4


def test_gap_state_lies_in_blocks_that_add_up(spark, tmp_path):
    """A channel was one key: one task held all of its ranges and rewrote them in every batch."""
    path, out, cp = (str(tmp_path / p) for p in ("in", "out", "cp"))
    schema = "channel long, seq_num long"
    numbers = {1: [*range(-25, -3), 7, 8, 9, 10, 11, 19, 20, *range(40, 61), 95], 2: [5]}
    parts = [[(c, n) for c, own in numbers.items() for n in own[i::2]] for i in range(2)] + [[(1, 9), (1, 10), (3, 20), (3, 19)]]
    held = []
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        gaps = live.gap_stream(live.file_stream(spark, path, spark.createDataFrame([], schema).schema), ["channel"], block=10)
        with live.state_store(spark):
            live.run_available(gaps, "update", cp, batch=live.changelog_sink(out))
        held.append(spark.read.parquet(out).where(f"batch = {len(held)}").select("channel", "block").collect())
    newest = live.latest_from_changelog(spark, out, ["channel", "block"], gaps.schema)
    got = {r.channel: tuple(r)[1:] for r in live.gap_totals(newest, ["channel"]).collect()}

    def want(own):
        own = sorted(set(own))
        return len(own), own[0], own[-1], own[-1] - own[0] + 1 - len(own), sum(b > a + 1 for a, b in zip(own, own[1:]))

    assert got == {c: want(own) for c, own in (numbers | {3: [19, 20]}).items()}
    # The last batch rewrote only the blocks it touched.
    assert sorted(map(tuple, held[2])) == [(1, 0), (1, 1), (3, 1), (3, 2)] and newest.count() > 10


def test_stocks_are_cut_out_of_their_batch(spark):
    """A conversion of its own for each stock is what took the time; types and row numbers stay those of one."""
    day = F.lit("2026-01-05").cast("date").alias("trade_date")
    left = spark.range(3000).select(day, F.concat(F.lit("c"), F.col("id") % 300).alias("code"), F.col("id").alias("n"), (F.col("id") / 2).alias("x"))
    right = spark.range(0, 300, 3).select(F.concat(F.lit("c"), F.col("id")).alias("code"), day, F.when(F.col("id") % 2 == 0, F.col("id") + F.lit(2**60)).alias("flag"))

    def fn(code, date, a, b):
        assert list(a.index) == list(range(10)) and a["n"].dtype == np.int64 and a["x"].dtype == float and (a["code"] == code).all()
        flag = list(b["flag"])
        if flag and int(code[1:]) % 2 == 0:
            assert b["flag"].dtype == np.int64 and flag == [int(code[1:]) + 2**60]  # not by way of a float, whatever other stocks hold
        whole = a["x"].to_numpy().base
        return {"F_n": float(a["n"].sum()), "F_right": float(len(b)), "F_shared": float(whole is not None and max(whole.shape) > 10)}

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = {r.code: r for r in fac.cogrouped_factors(left, right, fn, "F_n double, F_right double, F_shared double").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {c: (r.F_n, r.F_right) for c, r in got.items()} == {f"c{i}": (float(sum(range(i, 3000, 300))), float(i % 3 == 0)) for i in range(300)}
    assert sum(r.F_shared for r in got.values()) > 200  # the others lie in two batches
