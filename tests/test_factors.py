"""User factors: slice cursor, frames one after the other, merge walk of two inputs, output hook."""

import os
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import factors as fac
from tickloom.sources.hook import ParquetHook


def rows(n: int, rising: bool, seed: int = 1) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    us = rng.integers(0, 1000, n)
    return pd.DataFrame({"kind": rng.choice(["tick", "deal", "order"], n), "day_offset": rng.integers(0, 2, n),
                         "time_us": np.sort(us) if rising else us, "seq_num": np.arange(n)}) \
        .assign(time_us=lambda d: d["time_us"] * 1_000_000)


@pytest.mark.parametrize("rising", [True, False])
def test_slices_are_those_of_a_full_filter(rising):
    whole = rows(500, rising)
    data = fac.StockData("a", whole)
    for end in (0, 1, 250, 251, 999, 5000):
        cut = data.until(end)
        for kind in ("tick", "deal", "order"):
            keep = (whole["kind"] == kind) & (whole["day_offset"] == 0) & (whole["time_us"] <= end * 1_000_000)
            pd.testing.assert_frame_equal(getattr(cut, kind), whole[keep])
        assert len(cut.history[1]["tick"]) == ((whole["kind"] == "tick") & (whole["day_offset"] == 1)).sum()
    assert len(data.tick) == ((whole["kind"] == "tick") & (whole["day_offset"] == 0)).sum()


def test_slices_share_one_cut():
    data, seen = fac.StockData("a", rows(3000, True)), []
    whole = fac.StockData._whole
    for end in range(1, 246):
        cut = data.until(end * 4)
        _ = cut.tick, cut.deal
        seen.append(id(whole(cut, "tick", 0)[0]))
    assert len(set(seen)) == 1 and set(data._feeds) == {("tick", 0), ("deal", 0)}


def test_streamed_frames_stay_small_and_may_be_left_unread(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        tagged = spark.range(2500).select(F.lit("2026-01-05").cast("date").alias("trade_date"), F.when(F.col("id") < 2200, "hot").otherwise(
            F.concat(F.lit("c"), F.col("id") % 7)).alias("code"), F.col("id").alias("seq_num"))

        def fn(code, date, frames):
            if code == "c3":
                return {"F_n": -1.0, "F_most": 0.0}
            sizes = [(len(f), f["seq_num"].is_monotonic_increasing) for f in frames]
            assert all(ok for _, ok in sizes)
            return {"F_n": float(sum(n for n, _ in sizes)), "F_most": float(max(n for n, _ in sizes))}

        got = {r.code: (r.F_n, r.F_most) for r in fac.streamed_factors(tagged, fn, "F_n double, F_most double").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got["hot"][0] == 2200 and got["hot"][1] <= 100 and got["c3"] == (-1.0, 0.0)
    assert sum(n for n, _ in got.values() if n > 0) + sum(1 for i in range(2200, 2500) if i % 7 == 3) == 2500


def test_merge_walk_with_one_stock_holding_most_rows(spark):
    left = spark.range(20_000).select(F.lit("2026-01-05").cast("date").alias("trade_date"), F.when(F.col("id") % 10 > 0, "hot").otherwise(
        F.concat(F.lit("c"), F.col("id") % 50)).alias("code"), F.col("id").alias("n"), (F.col("id") / 2).alias("x"))
    right = spark.createDataFrame([("hot", 2.0, 1), ("c0", 3.0, None), ("alone", 5.0, 7)], "code string, x double, flag int").withColumn(
        "trade_date", F.lit("2026-01-05").cast("date"))

    def fn(code, date, a, b):
        assert list(a.columns) == ["trade_date", "code", "n", "x"] and list(b.columns) == ["code", "x", "flag", "trade_date"]
        assert a["n"].dtype == np.int64 and (a["code"] == code).all() and (b["code"] == code).all()
        return {"F_sum": float(a["n"].sum()), "F_right": float(b["x"].sum())}

    out = fac.cogrouped_factors(left, right, fn, "F_sum double, F_right double")
    assert "CoGroup" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.code: (r.F_sum, r.F_right) for r in out.collect()}
    want = {r.code: r.s for r in left.groupBy("code").agg(F.sum("n").cast("double").alias("s")).collect()}
    assert got == {c: (want.get(c, 0.0), {"hot": 2.0, "c0": 3.0, "alone": 5.0}.get(c, 0.0)) for c in want.keys() | {"alone"}}


def results(spark, slices=5, days=2):
    return spark.range(slices * days * 30).select(
        F.date_add(F.lit("2026-01-05").cast("date"), (F.floor(F.col("id") / slices) % days).cast("int")).alias("trade_date"), F.col("id").cast("string").alias("code"),
        F.lpad(((F.col("id") % slices) * 100 + 93000).cast("string"), 6, "0").alias("end_time"), F.col("id").cast("double").alias("F_x"))


def files(root):
    return sorted(p for p in Path(root).rglob("*.parquet"))


def test_hook_takes_all_slices_in_one_job(spark, tmp_path):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("hook", "hook")
    try:
        fac.emit(results(spark, 40), ParquetHook(str(tmp_path)))
        jobs = [j for j in tracker.getJobIdsForGroup("hook")]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 2  # one for 80 (day, slice) pairs; a planning step may add one, never one per slice
    assert len(files(tmp_path)) == 80 and not files(tmp_path / "_staged")
    got = spark.read.schema("trade_date date, code string, end_time string, F_x double").parquet(str(tmp_path))
    assert got.count() == 2400 and got.exceptAll(results(spark, 40).select(*got.columns)).count() == 0


class Failing(ParquetHook):
    def stage(self, day, end_time, rows):
        name = super().stage(day, end_time, rows)
        if end_time == "093300":
            raise ValueError("hook fails")
        return name


def test_failed_job_leaves_nothing_behind(spark, tmp_path):
    spark.sparkContext.setLogLevel("OFF")
    try:
        with pytest.raises(Exception, match="hook fails"):
            fac.emit(results(spark), Failing(str(tmp_path)))
    finally:
        spark.sparkContext.setLogLevel("ERROR")
    left = [f for f in files(tmp_path) if "end_time=093300" not in str(f)]
    assert not left
    fac.emit(results(spark), ParquetHook(str(tmp_path)))
    assert spark.read.parquet(str(tmp_path)).count() == 300
    assert os.path.isdir(tmp_path / "_staged")
