"""Streams over several micro-batches: replays, restarts, disorder, late rows, snapshots."""

import os
import random

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tickloom.operators import state as st
from tickloom.plans.state_queries import event_feeds
from tickloom.plans.views import view
from tickloom.sources import archive, results
from tickloom.streaming import live

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def split(spark, tmp_path):
    """Ticks in five files, out of order between files."""
    path = str(tmp_path / "ticks")
    ticks = view(spark, SF, "v_tick")
    for i in range(5):
        ticks.where(F.pmod(F.xxhash64("seq_num"), F.lit(5)) == i).coalesce(1).write.mode("append").parquet(path)
    return path, ticks


def stream(spark, split):
    return live.file_stream(spark, split[0], split[1].schema, files_per_trigger=1)


def test_state_over_micro_batches_equals_batch(spark, split, tmp_path):
    out = str(tmp_path / "out")
    state = live.state_stream(stream(spark, split), delay="60 days")
    live.run_available(state, "update", str(tmp_path / "cp"), batch=live.changelog_sink(out))
    assert spark.read.parquet(out).select("batch").distinct().count() == 5
    got = live.latest_from_changelog(spark, out, ["trade_date", "code"], state.schema)
    names = ["trade_date", "code", "open", "latest_price", "high", "low", "pre_close", "tick_count"]
    assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, st.tick_state(split[1]).select(*names).collect()))


def test_restart_reads_only_new_files(spark, split, tmp_path):
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    live.append_chunks(stream(spark, split), out, cp)
    n = spark.read.parquet(out).count()
    view(spark, SF, "v_tick").limit(3).coalesce(1).write.mode("append").parquet(split[0])
    live.append_chunks(stream(spark, split), out, cp)
    assert spark.read.parquet(out).count() == n + 3


def test_dedupe_over_replayed_files(spark, split, tmp_path):
    split[1].coalesce(1).write.mode("append").parquet(split[0])  # the whole day again
    out = str(tmp_path / "out")
    once = live.distinct_stream(stream(spark, split).select("code", "seq_num", "time"), ["code", "seq_num"], delay="60 days")
    live.run_available(once, "append", str(tmp_path / "cp"), path=out)
    rows = spark.read.parquet(out)
    assert rows.count() == rows.select("code", "seq_num").distinct().count() == split[1].count()


def test_late_rows_are_counted(spark, split, tmp_path):
    bars = live.bar_stream(stream(spark, split), "30 minutes", "1 hour")
    query = live.run_available(bars, "append", str(tmp_path / "cp"), path=str(tmp_path / "out"))
    assert live.dropped_late(query) > 0


def test_gaps_and_snapshot(spark, split, tmp_path):
    out = str(tmp_path / "gaps")
    gaps = live.gap_stream(stream(spark, split), ["event_type"])
    with live.state_store(spark):
        live.run_available(gaps, "update", str(tmp_path / "cp1"), batch=live.changelog_sink(out))
    got = {r.event_type: (r.messages, r.missing) for r in live.latest_from_changelog(spark, out, ["event_type"], gaps.schema).collect()}
    want = split[1].groupBy("event_type").agg(F.count("*").alias("n"), (F.max("seq_num") - F.min("seq_num") + 1 - F.count("*")).alias("m"))
    assert got == {r.event_type: (r.n, r.m) for r in want.collect()}
    snap = str(tmp_path / "snap")
    with pytest.raises(FileNotFoundError):
        live.read_snapshot(spark, snap)
    rows = stream(spark, split).select("code", "seq_num", "bid_price1")
    live.run_available(rows, "append", str(tmp_path / "cp2"), batch=live.snapshot_sink(spark, snap, ["code"], "seq_num"))
    latest = split[1].groupBy("code").agg(F.max("seq_num").alias("seq_num"), F.max_by("bid_price1", "seq_num").alias("bid_price1"))
    assert sorted(map(str, live.read_snapshot(spark, snap).select("code", "seq_num", "bid_price1").collect())) == sorted(
        map(str, latest.select("code", "seq_num", "bid_price1").collect()))


def test_result_files(spark, tmp_path):
    rows = spark.createDataFrame([("20260105", "a", 1.0), ("20260105", "b", 2.0)], "date string, code string, F double")
    root = str(tmp_path / "r")
    rows.where("code = 'a'").coalesce(1).write.parquet(root + "/x")
    frame = spark.createDataFrame(
        [("/d/20260105_093000_s2_p1.parquet",), ("/d/20260105_093000.parquet",), ("/d/20260106.parquet",)], "_file string")
    parts = frame.withColumns(results.file_parts(F.col("_file")))
    assert [tuple(r)[1:] for r in parts.collect()] == [("20260105", "093000", 2, 1), ("20260105", "093000", None, None), ("20260106", None, None, None)]
    assert results.prefer_files(parts).count() == 2
    assert results.prefer_files(parts, "full").count() == 2
    assert results.prefer_files(parts, "all").count() == 3
    with pytest.raises(ValueError):
        results.prefer_files(parts, "none")


def test_json_payloads(spark, tmp_path):
    (tmp_path / "20260105_s0.json").write_text('[{"code": "a", "F": 1.0}, {"code": "b", "F": 2.0}]')
    (tmp_path / "20260106.json").write_text('{"records": [{"code": "c", "F": 3.0}]}')
    from pyspark.sql import types as T
    record = T.StructType([T.StructField("code", T.StringType()), T.StructField("F", T.DoubleType())])
    got = results.read_json_results(spark, str(tmp_path), record)
    assert sorted((r.file_date, r.code, r.F) for r in got.collect()) == [("20260105", "a", 1.0), ("20260105", "b", 2.0), ("20260106", "c", 3.0)]


def test_result_files_are_listed_unopened(spark, tmp_path):
    from tickloom.operators import factors
    from tickloom.sources.hook import NamedFilesHook
    rows = spark.sql("SELECT DATE '2026-01-05' + CAST(id % 2 AS INT) AS trade_date, CASE WHEN id % 3 = 0 THEN '' ELSE concat('_s', id % 3, '_p0') END AS end_time, id AS n FROM range(30)")
    factors.emit(rows, NamedFilesHook(str(tmp_path)))
    (tmp_path / "20260107_s1.parquet").write_bytes(b"not parquet")  # listing opens no file
    got = {(r.file_date, r.shard, r.part) for r in results.list_files(spark, str(tmp_path)).where("bytes > 0").collect()}
    assert got == {(d, s, p) for d in ("20260105", "20260106") for s, p in ((None, None), (1, 0), (2, 0))} | {("20260107", 1, None)}
    (tmp_path / "20260107_s1.parquet").unlink()
    read = results.read_results(spark, str(tmp_path))
    assert read.count() == 30 and results.prefer_files(read).count() == 20 and results.prefer_files(read, "full").count() == 10


def test_variant_payloads(spark, tmp_path):
    for name, text in (("20260105_s0", '[{"code": "a", "F": 1.5}, {"code": "b", "G": "x"}]'), ("20260106", '{"records": [{"code": "c", "H": [1]}]}'),
                       ("20260107", '{"code": "d"}'), ("20260108", "no json"), ("20260109", "[]")):
        (tmp_path / f"{name}.json").write_text(text)
    take = lambda n, t: F.try_variant_get("record", f"$.{n}", t).alias(n)
    got = results.read_json_variants(spark, str(tmp_path)).select("file_date", "shard", take("code", "string"), take("F", "double"), take("G", "string"), take("H", "array<int>"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([
        ("20260105", 0, "a", 1.5, None, None), ("20260105", 0, "b", None, "x", None), ("20260106", None, "c", None, None, [1]),
        ("20260107", None, "d", None, None, None)], key=str)


def test_archive_is_pruned_and_replaced_by_day(spark, tmp_path):
    root = str(tmp_path)
    ticks = view(spark, SF, "v_tick").withColumn("update_time", F.col("time"))
    archive.write_archive(ticks, root, "tick")
    table = archive.scan(spark, root, "tick")
    assert table.count() == ticks.count()
    archive.write_archive(ticks.where("trade_date = DATE '2024-01-05' AND code < '000005'"), root, "tick")
    day = archive.load_day(archive.scan(spark, root, "tick"), "2024-01-05", ["000001"])
    assert day.count() == ticks.where("trade_date = DATE '2024-01-05' AND code = '000001'").count()
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(trade_date" in plan and "EqualTo(code,000001)" in plan
    with pytest.raises(ValueError, match="exceed"):
        archive.load_range(archive.scan(spark, root, "tick"), "2024-01-01", "2024-01-30", kind="tick", max_days=1)


@pytest.fixture()
def feeds(spark, tmp_path):
    """Tick, deal and order in four files each, out of order between files."""
    batch = event_feeds(spark, SF)
    for kind, rows in zip(("tick", "deal", "order"), batch):
        for i in range(4):
            rows.where(F.pmod(F.xxhash64("seq_num", F.lit(kind)), F.lit(4)) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / kind))
    live_feeds = [live.file_stream(spark, str(tmp_path / kind), rows.schema, files_per_trigger=1)
                  for kind, rows in zip(("tick", "deal", "order"), batch)]
    return batch, live_feeds


def test_state_of_three_feeds_and_rounds_equal_batch(spark, feeds, tmp_path):
    batch, streams = feeds
    want = st.full_state(*batch)
    state = live.full_state_stream(*streams, delay="60 days")
    assert set(state.columns) == set(want.columns)
    out = str(tmp_path / "out")
    live.run_available(state, "update", str(tmp_path / "cp"), batch=live.changelog_sink(out))
    assert spark.read.parquet(out).select("batch").distinct().count() == 4
    got = live.latest_from_changelog(spark, out, ["trade_date", "code"], state.schema)
    names = sorted(want.columns)
    assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, want.select(*names).collect()))
    # A round dies after its factors were written and runs again.
    out = str(tmp_path / "rounds")
    sink = live.round_sink(st.factor_pack, out)
    with pytest.raises(StreamingQueryException, match="SinkFailure"):
        live.run_available(state, "update", str(tmp_path / "cp2"), batch=live.failing_once(sink, at=2))
    live.run_available(state, "update", str(tmp_path / "cp2"), batch=sink)
    pack = st.factor_pack(want)
    got = live.latest_round(spark, out, ["trade_date", "code"], st.factor_pack(state).schema).select(*pack.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, pack.collect()))


def test_a_round_holds_only_changed_keys_with_whole_state(spark, feeds, tmp_path):
    batch, streams = feeds
    state, sizes = live.full_state_stream(*streams, delay="60 days"), {}

    def count(rows, batch_id):
        sizes[batch_id] = [(r.code, str(r.trade_date), r.tick_count, r.order_count) for r in rows.select("code", "trade_date", "tick_count", "order_count").collect()]

    live.run_available(state, "update", str(tmp_path / "cp"), batch=count)
    first = batch[2].limit(1).collect()[0]
    batch[2].where(F.col("seq_num") == first.seq_num).withColumn("seq_num", F.lit(10**9).cast("long")).coalesce(1).write.mode("append").parquet(str(tmp_path / "order"))
    seen = set(sizes)
    live.run_available(state, "update", str(tmp_path / "cp"), batch=count)
    (new,) = [sizes[b] for b in set(sizes) - seen if sizes[b]]
    whole = batch[2].where((F.col("code") == first.code) & (F.col("trade_date") == first.trade_date)).count()
    assert [(c, d, o) for c, d, _, o in new] == [(first.code, str(first.trade_date), whole + 1)]


@pytest.mark.parametrize("after_write", [True, False])
@pytest.mark.parametrize("at", [0, 3])
def test_failed_batch_is_replayed_once(spark, split, tmp_path, at, after_write):
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    rows = stream(spark, split).select("code", "seq_num")
    sink = live.changelog_sink(out)
    with pytest.raises(StreamingQueryException, match="SinkFailure"):
        live.run_available(rows, "append", cp, batch=live.failing_once(sink, at, after_write))
    # The offset of the failed batch is logged, its commit is not.
    assert os.path.exists(f"{cp}/offsets/{at}") and not os.path.exists(f"{cp}/commits/{at}")
    assert os.path.exists(f"{out}/batch={at}") == after_write
    live.run_available(rows, "append", cp, batch=sink)
    got = spark.read.parquet(out)
    assert got.count() == got.select("seq_num").distinct().count() == split[1].count()


def test_merged_ranges():
    rng = random.Random(5)
    for _ in range(200):
        numbers = [rng.randrange(40) for _ in range(rng.randrange(30))]
        lo, hi = live.merge_ranges(np.array(numbers, np.int64), np.array(numbers, np.int64))
        assert [n for a, b in zip(lo, hi) for n in range(a, b + 1)] == sorted(set(numbers))
        assert all(hi[i] + 1 < lo[i + 1] for i in range(len(lo) - 1))


def test_gap_state_follows_gaps_not_messages(spark, tmp_path):
    path, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "channel long, seq_num long"

    def send(numbers):
        spark.createDataFrame([(c, n) for c in (1, 2) for n in numbers], schema).coalesce(1).write.mode("append").parquet(path)
        with live.state_store(spark):
            live.run_available(live.gap_stream(live.file_stream(spark, path, spark.createDataFrame([], schema).schema), ["channel"]),
                               "update", cp, batch=live.changelog_sink(out))
            held = spark.read.format("statestore").option("stateVarName", "ranges").load(cp).count()
        newest = live.latest_from_changelog(spark, out, ["channel"], gaps)
        return sorted((r.channel, r.messages, r.missing, r.gaps) for r in newest.collect()), held

    gaps = spark.createDataFrame([], "channel long, messages long, first_seq long, last_seq long, missing long, gaps long").schema
    got, few = send([*range(10, 20), *range(30, 40)])
    assert got == [(c, 20, 10, 1) for c in (1, 2)]
    # Every run is a restart from the checkpoint. A replay changes nothing.
    assert send([15, 16, 39])[0] == got
    got, held = send(range(40, 5000))
    assert got == [(c, 4980, 10, 1) for c in (1, 2)] and held == few  # 250 times the messages, as many state rows
    got, held = send([22, 25])
    assert got == [(c, 4982, 8, 3) for c in (1, 2)] and held > few
    got, held = send(range(20, 30))  # late numbers fill the gaps
    assert got == [(c, 4990, 0, 0) for c in (1, 2)] and held < few


def test_gap_state_of_past_days_is_dropped(spark, tmp_path):
    path, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    schema, held = "trade_date date, channel long, seq_num long, time timestamp_ntz", []
    for d in range(1, 7):
        rows = spark.sql(f"SELECT DATE '2026-03-0{d}' AS trade_date, id % 3 AS channel, id * 2 AS seq_num, TIMESTAMP_NTZ '2026-03-0{d} 10:00:00' AS time FROM range(30)")
        rows.coalesce(1).write.mode("append").parquet(path)
        gaps = live.gap_stream(live.file_stream(spark, path, rows.schema), ["trade_date", "channel"], day="trade_date", delay="1 day")
        with live.state_store(spark):
            query = live.run_available(gaps, "update", cp, batch=live.changelog_sink(str(tmp_path / "out")))
        held.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    assert held[-1] == held[-2] == held[-3]
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 18 and got.where("messages <> 10").count() == 0


def test_snapshot_rewrites_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "snap")
    sink = live.snapshot_sink(spark, path, ["code"], "seq_num", buckets=8)
    rows = lambda *own: spark.createDataFrame(list(own), "code string, seq_num long, price double")
    files = lambda: {f"{d}/{f}" for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}
    sink(rows(*[(f"c{i}", i, float(i)) for i in range(40)]), 0)
    first = files()
    assert len({f.split("_bucket=")[1].split("/")[0] for f in first}) == 8
    sink(rows(("c7", 100, 7.5)), 1)
    one = files() - first
    assert len(one) == 1 and "_version=1" in next(iter(one)) and first <= files()
    sink(rows(("c7", 50, 0.0), ("c7", 101, 8.5)), 2)  # an older row changes nothing
    assert len(files() - first - one) == 1
    # The version that batch 1 replaced is gone, that of batch 1 is still there for its readers.
    assert len(first - files()) == 1 and one <= files()
    before = files()
    sink(rows(("c7", 50, 0.0), ("c7", 101, 8.5)), 2)  # the batch again
    assert len(files()) == len(before)
    got = {r.code: (r.seq_num, r.price) for r in live.read_snapshot(spark, path).collect()}
    assert got == {f"c{i}": (i, float(i)) for i in range(40)} | {"c7": (101, 8.5)}
    sink(rows(), 3)
    assert live.read_snapshot(spark, path).count() == 40


def test_snapshot_of_an_unfinished_batch_does_not_count(spark, tmp_path):
    path = str(tmp_path / "snap")
    sink = live.snapshot_sink(spark, path, ["code"], "seq_num", buckets=2)
    rows = spark.createDataFrame([("a", 1, 1.0)], "code string, seq_num long, price double")
    sink(rows, 0)
    sink(rows.withColumn("seq_num", F.lit(5).cast("long")), 1)
    os.remove(f"{path}/lists/1/_SUCCESS")  # as if the batch had died while it wrote its list
    assert live.read_snapshot(spark, path).first().seq_num == 1
    sink(rows.withColumn("seq_num", F.lit(5).cast("long")), 1)
    assert live.read_snapshot(spark, path).first().seq_num == 5
