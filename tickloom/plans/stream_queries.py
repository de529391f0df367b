"""Streaming jobs replayed over the event table (S13, ST1-ST11)."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tickloom.functions import times
from tickloom.operators import reconcile as rec
from tickloom.operators import state as st
from tickloom.plans import views
from tickloom.plans.registry import query
from tickloom.plans.state_queries import _PACK, _STATE, event_feeds
from tickloom.plans.views import day, table, view
from tickloom.streaming import live


def events(spark, sf):
    """The event table as an append-only file source."""
    return live.file_stream(spark, sf, table(spark, sf, "events").schema, glob="events.parquet")


def arrivals(spark, sf, parts=3, files=4):
    """The event table cut by time into batches of files that arrive one after the other; a reader takes one batch at a time."""
    whole = table(spark, sf, "events")
    path, _ = live.stream_scratch(spark, "arrivals")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = whole.agg(F.min(us), F.max(us)).first()
    part = F.least(F.floor((us - lo) * parts / max(hi - lo, 1)), F.lit(parts - 1))
    for i in range(parts):
        whole.where(F.coalesce(part, F.lit(0)) == i).repartition(files).write.mode("append").parquet(path)
    return lambda *_: live.file_stream(spark, path, whole.schema, files_per_trigger=files)


def event_batches(spark, sf):
    return arrivals(spark, sf)()


def stream_view(spark, sf, name, source=events):
    """A stand-in view over the stream."""
    body = views.VIEWS[name].replace("FROM events", "FROM {events}")
    return spark.sql(body, events=source(spark, sf))


def stream_feeds(spark, sf):
    """Tick, deal and order rows of the same arrivals, three streams."""
    source = arrivals(spark, sf)
    deal = stream_view(spark, sf, "v_deal_ev", source).withColumn("amount", F.col("money_cents"))
    return stream_view(spark, sf, "v_tick", source), deal, stream_view(spark, sf, "v_order", source)


@query("s13_incremental_source", "v_tick", "SELECT code, seq_num, latency_ms FROM v_tick")
def s13(spark, sf):
    out, checkpoint = live.stream_scratch(spark, "append")
    ticks = stream_view(spark, sf, "v_tick").select("code", "seq_num", "latency_ms")
    live.append_chunks(ticks, out, checkpoint)
    live.append_chunks(ticks, out, checkpoint)  # a second run finds nothing new
    return spark.read.schema(ticks.schema).parquet(out)


@query("st1_restart_safe_ingest", "v_tick", "SELECT CAST(trade_date AS VARCHAR) AS trade_date, count(*) AS n, count(DISTINCT seq_num) AS keys FROM v_tick GROUP BY 1")
def st1(spark, sf):
    """The second batch dies between its write and its commit; the next run replays it."""
    out, checkpoint = live.stream_scratch(spark, "ingest")
    ticks = stream_view(spark, sf, "v_tick", event_batches).select("trade_date", "code", "seq_num")
    sink = live.changelog_sink(out)
    try:
        live.run_available(ticks, "append", checkpoint, batch=live.failing_once(sink, at=1))
    except StreamingQueryException as e:
        if "SinkFailure" not in str(e):
            raise
    else:
        raise RuntimeError("the injected failure did not stop the run")
    for _ in range(2):
        live.run_available(ticks, "append", checkpoint, batch=sink)
    per = spark.read.schema(ticks.schema).parquet(out).groupBy("trade_date", "seq_num").agg(F.count("*").alias("c"))
    return per.groupBy(day()).agg(F.sum("c").alias("n"), F.count("*").alias("keys"))


def _stream_state(spark, sf):
    out, checkpoint = live.stream_scratch(spark, "state")
    state = live.full_state_stream(*stream_feeds(spark, sf))
    live.run_available(state, "update", checkpoint, batch=live.changelog_sink(out))
    return live.latest_from_changelog(spark, out, ["trade_date", "code"], state.schema)


@query("st2_stream_state", "v_tick v_order v_deal_ev", _STATE + " SELECT * REPLACE (CAST(trade_date AS VARCHAR) AS trade_date) FROM s")
def st2(spark, sf):
    state = _stream_state(spark, sf)
    return state.drop("last_tick_time", "last_deal_time", "last_order_time", "last_market_time").withColumn("trade_date", day())


_TICKS = """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, code, arg_min(current_price, seq_num) FILTER (WHERE current_price > 0)::DOUBLE AS open, arg_max(current_price, seq_num) FILTER (WHERE current_price > 0)::DOUBLE AS latest_price,
  max(current_price) FILTER (WHERE current_price > 0)::DOUBLE AS high, count(*) AS tick_count FROM v_tick GROUP BY 1, 2"""


@query("st3_changed_stocks", "v_tick", "SELECT DISTINCT code FROM v_tick")
def st3(spark, sf):
    out, checkpoint = live.stream_scratch(spark, "dirty")
    changed = live.state_stream(stream_view(spark, sf, "v_tick", event_batches)).select("trade_date", "code")
    live.run_available(changed, "update", checkpoint, batch=live.changelog_sink(out))
    return spark.read.parquet(out).select("code").distinct()


@query("st4_stream_bars", "v_tick", """
SELECT code, epoch_us(time_bucket(INTERVAL 30 MINUTE, time)) AS time, arg_min(current_price, seq_num)::DOUBLE AS open, arg_max(current_price, seq_num)::DOUBLE AS close, count(*) AS ticks FROM v_tick GROUP BY code, time_bucket(INTERVAL 30 MINUTE, time)""")
def st4(spark, sf):
    out, checkpoint = live.stream_scratch(spark, "bars")
    bars = live.bar_stream(stream_view(spark, sf, "v_tick"), "30 minutes", "1 hour")
    live.run_available(bars, "update", checkpoint, batch=live.changelog_sink(out))
    rows = live.latest_from_changelog(spark, out, ["code", "time"], bars.schema)
    return rows.select("code", times.epoch_micros(F.col("time")).alias("time"), F.col("open").cast("double").alias("open"),
                       F.col("close").cast("double").alias("close"), "ticks")


@query("st5_stream_dedupe", "v_tick", "SELECT code, seq_num FROM v_tick")
def st5(spark, sf):
    out, checkpoint = live.stream_scratch(spark, "dedupe")
    feed = stream_view(spark, sf, "v_tick").select("code", "seq_num", "time")
    replayed = feed.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
    once = live.distinct_stream(replayed, ["code", "seq_num"])
    live.run_available(once.select("code", "seq_num"), "append", checkpoint, path=out)
    return spark.read.schema("code STRING, seq_num BIGINT").parquet(out)


@query("st6_out_of_order", "v_tick", _TICKS)
def st6(spark, sf):
    """Rows arrive in hash order; sequence-keyed aggregates give the same state."""
    out, checkpoint = live.stream_scratch(spark, "shuffled")
    mixed = stream_view(spark, sf, "v_tick").repartition(4, F.xxhash64("seq_num"))
    state = live.state_stream(mixed)
    live.run_available(state, "update", checkpoint, batch=live.changelog_sink(out))
    rows = live.latest_from_changelog(spark, out, ["trade_date", "code"], state.schema)
    return rows.select(day(), "code", *[F.col(c).cast("double").alias(c) for c in ("open", "latest_price", "high")], "tick_count")


_LATENCY = """
SELECT epoch_us(date_trunc('minute', time)) AS minute, event_type AS kind, count(*) AS n, min(latency_ms) AS min_ms, sum(latency_ms)::BIGINT AS sum_ms, max(latency_ms) AS max_ms FROM v_tick WHERE latency_ms BETWEEN 0 AND 600"""


@query("st7_push_latency", "v_tick", _LATENCY + " GROUP BY 1, 2")
def st7(spark, sf):
    out, checkpoint = live.stream_scratch(spark, "latency")
    stats = live.latency_stream(stream_view(spark, sf, "v_tick"), "event_type", "latency_ms", limit_ms=600)
    live.run_available(stats, "update", checkpoint, batch=live.changelog_sink(out))
    return live.latest_from_changelog(spark, out, ["minute", "kind"], stats.schema).withColumn("minute", times.epoch_micros(F.col("minute")))


@query("st7_push_latency_batch", "v_tick", _LATENCY.replace("sum(latency_ms)::BIGINT AS sum_ms", "sum(latency_ms) / count(*) AS avg_ms") + " GROUP BY 1, 2")
def st7_batch(spark, sf):
    from tickloom.operators.quality import push_latency
    out = push_latency(view(spark, sf, "v_tick"), limit_ms=600)
    return out.withColumn("minute", times.epoch_micros(F.col("minute")))


def _replayed(spark, sf):
    """Orders of which every message arrives twice."""
    return stream_view(spark, sf, "v_order", event_batches).withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")


def _gaps(spark, sf, keys, **more):
    out, checkpoint = live.stream_scratch(spark, "gaps")
    with live.state_store(spark):
        gaps = live.gap_stream(_replayed(spark, sf), keys, block=live.GAP_BLOCK, **more)
        live.run_available(gaps, "update", checkpoint, batch=live.changelog_sink(out))
    return live.gap_totals(live.latest_from_changelog(spark, out, [*keys, "block"], gaps.schema), keys)


@query("st8_stream_gaps", "v_order", """
SELECT channel, count(*) AS messages, min(seq_num) AS first_seq, max(seq_num) AS last_seq, max(seq_num) - min(seq_num) + 1 - count(*) AS missing FROM v_order GROUP BY 1""")
def st8(spark, sf):
    return _gaps(spark, sf, ["channel"]).drop("gaps")


@query("st8_daily_gaps", "v_order", """
, n AS (SELECT trade_date, channel, seq_num, seq_num - lag(seq_num) OVER (PARTITION BY trade_date, channel ORDER BY seq_num) AS step FROM v_order)
SELECT CAST(trade_date AS VARCHAR) AS trade_date, channel, count(*) AS messages, min(seq_num) AS first_seq, max(seq_num) AS last_seq,
  max(seq_num) - min(seq_num) + 1 - count(*) AS missing, count(*) FILTER (WHERE step > 1) AS gaps FROM n GROUP BY 1, 2""")
def st8_daily(spark, sf):
    """Per day and channel; a day's ranges leave the state once the watermark has passed it."""
    return _gaps(spark, sf, ["trade_date", "channel"], day="trade_date").withColumn("trade_date", day())


@query("st9_latest_snapshot", "v_tick", """
SELECT code, arg_max(current_price, seq_num)::DOUBLE AS price, arg_max(pre_close_price, seq_num)::DOUBLE AS pre_close, max(seq_num) AS seq_num FROM v_tick GROUP BY 1""")
def st9(spark, sf):
    out, checkpoint = live.stream_scratch(spark, "snapshot")
    latest = stream_view(spark, sf, "v_tick").select(
        "code", "seq_num", F.col("current_price").cast("double").alias("price"), F.col("pre_close_price").cast("double").alias("pre_close"))
    live.run_available(latest, "append", checkpoint, batch=live.snapshot_sink(spark, out, ["code"], "seq_num"))
    return live.read_snapshot(spark, out).select("code", "price", "pre_close", "seq_num")


def _round_factors(spark, sf):
    out, checkpoint = live.stream_scratch(spark, "rounds")
    state = live.full_state_stream(*stream_feeds(spark, sf))
    live.run_available(state, "update", checkpoint, batch=live.round_sink(st.factor_pack, out))
    return live.latest_round(spark, out, ["trade_date", "code"], st.factor_pack(state).schema)


@query("st10_round_factors", "v_tick v_order v_deal_ev", _STATE + _PACK)
def st10(spark, sf):
    return _round_factors(spark, sf).withColumn("trade_date", day())


@query("st11_chunks_to_archive", "v_order", """

, once AS (SELECT DISTINCT trade_date, code, seq_num FROM v_order),
late AS (SELECT count(*) FILTER (WHERE time IS NULL) AS bad, count(*) FILTER (WHERE CAST(time AS DATE) <> trade_date) AS moved FROM v_order)
SELECT (SELECT count(*) FROM v_order) AS src_rows, (SELECT count(*) FROM once) AS dst_rows, (SELECT count(*) FROM once JOIN v_order USING (trade_date, code, seq_num)) AS rows_checked,
  bad AS time_bad, moved AS update_bad, (SELECT count(*) FROM v_order) = (SELECT count(*) FROM once) AND bad = 0 AND moved = 0 AS valid FROM late""")
def st11(spark, sf):
    out, checkpoint = live.stream_scratch(spark, "chunks")
    orders = stream_view(spark, sf, "v_order").withColumn("update_time", F.col("time"))
    live.append_chunks(orders, out, checkpoint)
    root, _ = live.stream_scratch(spark, "archive")
    return live.compact_chunks(spark, out, root, "order")


_FACTORS = ("latest_price", "high", "low", "change_pct", "spread", "price_pos", "buy_pressure", "vwap", "total_vol", "deal_count", "vol_ratio",
            "order_imbalance", "order_buy_vol_ratio", "cancel_ratio", "order_count")


@query("r5_batch_vs_stream", "v_tick v_order v_deal_ev", _STATE + ", p AS (" + _PACK + "), c AS (" + " UNION ALL ".join(
    f"SELECT 'F_{n}' AS factor, CAST({n} AS DOUBLE) AS v FROM p" for n in _FACTORS) + """)
SELECT factor, count(*) AS cells, count(*) FILTER (WHERE v IS NOT NULL AND v <> v) AS bad_cells, 0.0::DOUBLE AS max_abs, 0.0::DOUBLE AS max_rel,
  count(v) AS known, CAST(sum(CAST(floor(v * 100) AS BIGINT)) AS BIGINT) AS hundredths FROM c GROUP BY 1""")
def r5_stream(spark, sf):
    """The whole factor pack of the stream against the batch, with the stream's own counts and sums."""
    pick = lambda df: df.select("trade_date", "code", *[F.col(n).cast("double").alias(f"F_{n}") for n in _FACTORS])
    streamed = pick(_round_factors(spark, sf))
    diff = rec.factor_diff(pick(st.factor_pack(st.full_state(*event_feeds(spark, sf)))), streamed, ["trade_date", "code"], 0.0, 0.0)
    cells = streamed.select(F.inline(F.array(*[F.struct(F.lit(f"F_{n}").alias("factor"), F.col(f"F_{n}").alias("v")) for n in _FACTORS])))
    own = cells.groupBy("factor").agg(F.count("v").alias("known"), F.sum(F.floor(F.col("v") * 100).cast("long")).alias("hundredths"))
    return diff.join(own, "factor")
