"""Live path: incremental state, bars, snapshots and archive chunks as Structured Streaming jobs.

A watermark needs a zoned timestamp, so event time is carried as the instant
whose UTC reading is the wall clock and turned back at the output: windows are
wall-clock days and minutes whatever the session zone. All aggregates are the
order-insensitive ones of the batch path, so a replay in any order or
micro-batch cut ends in the same values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tickloom.functions import times
from tickloom.operators.keyed import keep_first, latest_per_key
from tickloom.operators.quality import archive_check
from tickloom.operators.state import tag_feeds, tagged_aggregates, tick_aggregates
from tickloom.session import scratch_path, ship_package
from tickloom.sources.archive import write_archive

# Large key sets keep their state off heap, with changelog checkpoints.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's own settings come back after."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def file_stream(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None,
                files_per_trigger: int | None = None) -> DataFrame:
    """Append-only source of parquet files; its offsets live in the query's checkpoint."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def with_watermark(df: DataFrame, delay: str, time: str = "time") -> DataFrame:
    """Event time as an instant, with an allowed delay."""
    instant = F.timestamp_micros(times.epoch_micros(F.col(time)))
    return df.withColumn(time, instant).withWatermark(time, delay)


def wall_clock(instant: Column) -> Column:
    """Back from the instant to the zone-free wall clock."""
    return times.from_epoch_micros(F.unix_micros(instant))


def start_available(df: DataFrame, mode: str, checkpoint: str, batch: Callable[[DataFrame, int], None] | None = None,
                    path: str | None = None) -> StreamingQuery:
    """Start a run over everything available now.

    The checkpoint holds offsets and state: a restart after a loss goes on
    where the last committed batch ended, and file sinks stay exactly-once.
    """
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if batch is not None:
        return writer.foreachBatch(batch).start()
    return writer.format("parquet").option("path", path).start()


def run_available(*args, **kwargs) -> StreamingQuery:
    query = start_available(*args, **kwargs)
    query.awaitTermination()
    return query


def dropped_late(query: StreamingQuery) -> int:
    """Rows a watermark discarded over the recent progress reports."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0))
               for progress in query.recentProgress for op in progress["stateOperators"])


def append_chunks(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Land the stream as parquet chunks, each row once."""
    return run_available(stream, "append", checkpoint, path=path)


def keyed_stream(feed: DataFrame, aggregates: list[Column], delay: str = "1 day") -> DataFrame:
    """Running aggregates per stock and day. In update mode a batch emits the full state of just the
    stocks it changed. The day is an event-time window, so finished days leave the state store.
    """
    day = F.window("time", "1 day").alias("_day")
    out = with_watermark(feed, delay).groupBy(day, "code").agg(*aggregates)
    return out.withColumn("trade_date", F.to_date(wall_clock(F.col("_day.start")))).drop("_day")


def state_stream(tick: DataFrame, delay: str = "1 day") -> DataFrame:
    """Per-stock tick state by day."""
    return keyed_stream(tick, list(tick_aggregates()), delay).withColumn("last_tick_time", wall_clock(F.col("last_tick_time")))


def full_state_stream(tick: DataFrame, deal: DataFrame, order: DataFrame, delay: str = "1 day") -> DataFrame:
    """Per-stock state of all three feeds by day, in one keyed state.

    The feeds are laid under each other as tagged rows first: three streams aggregated apart could not
    be joined into one state later. A batch emits the whole state of the stocks that any feed changed.
    """
    state = keyed_stream(tag_feeds(tick, deal, order), tagged_aggregates(), delay)
    return state.withColumns({c: wall_clock(F.col(c)) for c in state.columns if c.startswith("last_") and c.endswith("_time")})


def bar_stream(tick: DataFrame, every: str = "1 minute", delay: str = "5 minutes") -> DataFrame:
    """Tumbling bars. Append mode emits a bar once the watermark has passed its end; update mode with a
    changelog also has the bars still open, so none is missing at the end of the data."""
    span = F.window("time", every).alias("_bin")
    return with_watermark(tick, delay).groupBy("code", span).agg(
        F.min_by("current_price", "seq_num").alias("open"), F.max("current_price").alias("high"),
        F.min("current_price").alias("low"), F.max_by("current_price", "seq_num").alias("close"),
        F.max_by("total_volume", "seq_num").alias("volume"), F.count("*").alias("ticks"),
    ).select("code", wall_clock(F.col("_bin.start")).alias("time"), "open", "high", "low", "close", "volume", "ticks")


def distinct_stream(feed: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Each (code, sequence number) once. A replay carries the same event time as the original."""
    once = with_watermark(feed, delay).dropDuplicatesWithinWatermark(keys)
    return once.withColumn("time", wall_clock(F.col("time")))


def latency_stream(feed: DataFrame, kind: str, latency: str, delay: str = "5 minutes", limit_ms: int = 600_000) -> DataFrame:
    """Plausible push latency per minute and kind."""
    inside = with_watermark(feed.where(F.col(latency).between(0, limit_ms)), delay)
    return inside.groupBy(F.window("time", "1 minute").alias("_m"), F.col(kind).alias("kind")).agg(
        F.count("*").alias("n"), F.min(latency).alias("min_ms"), F.sum(latency).alias("sum_ms"), F.max(latency).alias("max_ms"),
    ).select(wall_clock(F.col("_m.start")).alias("minute"), "kind", "n", "min_ms", "sum_ms", "max_ms")


def merge_ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Closed ranges of whole numbers, overlapping and adjoining ones made one, in order."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    first = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1] + 1])) if len(lo) else np.empty(0, np.int64)
    return lo[first], hi[np.append(first[1:], len(lo)) - 1] if len(lo) else hi


def _folded(owner: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows at which the closed ranges of each owner's numbers begin, and both ends of the ranges."""
    order = np.lexsort((numbers, owner))
    own, n = owner[order], numbers[order]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (n[1:] > n[:-1] + 1)])) if len(n) else np.empty(0, np.int64)
    return order[first], n[first], n[np.append(first[1:], len(n)) - 1] if len(n) else n


class _GapRanges(StatefulProcessor):
    """Seen numbers of one channel (or block of it) as a sorted list of closed ranges; the state follows its gaps."""

    def __init__(self, keys: list[str], expires: bool):
        self.keys, self.expires = keys, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ranges = handle.getListState("ranges", "lo long, hi long")

    def _known(self) -> pd.DataFrame:
        rows = list(self.ranges.get()) if self.ranges.exists() else []
        return pd.DataFrame(rows, columns=["lo", "hi"], dtype="int64")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts, latest = [self._known()], None
        for frame in rows:
            parts.append(frame[["lo", "hi"]])
            if self.expires:
                last = int(frame["expiry_ms"].max())
                latest = last if latest is None else max(latest, last)
        both = pd.concat(parts)
        lo, hi = merge_ranges(both["lo"].to_numpy(np.int64), both["hi"].to_numpy(np.int64))
        self.ranges.put(list(zip(lo.tolist(), hi.tolist())))
        if self.expires and latest > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(latest)
        seen = int((hi - lo + 1).sum())
        yield pd.DataFrame({**{k: [v] for k, v in zip(self.keys, key)}, "messages": [seen], "first_seq": [int(lo[0])], "last_seq": [int(hi[-1])],
                            "missing": [int(hi[-1] - lo[0] + 1 - seen)], "gaps": [len(lo) - 1]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.ranges.clear()
        yield from ()

    def close(self) -> None:
        pass


#: Numbers of a block; a block has half as many ranges at most.
GAP_BLOCK = 1 << 17


def gap_stream(feed: DataFrame, keys: list[str], seq: str = "seq_num", day: str | None = None, delay: str = "1 day",
               block: int | None = None) -> DataFrame:
    """Distinct and missing sequence numbers per channel so far.

    Each task first folds its own rows into ranges, so a busy channel ships ranges, not messages. Replays
    fall into ranges already held, late numbers close gaps, and the state has one row per range: it grows
    with gaps and not with messages. With ``day`` (a date column, one of the keys) a channel's ranges are
    dropped once the watermark has passed its day by ``delay``; otherwise they are kept.

    A channel's ranges are held by one task. With ``block`` each block of so many numbers is a key of its own
    (column ``block``, number // block): a task holds one block's ranges, a batch rewrites only the blocks it
    touches, and a channel is shared by many tasks. ``gap_totals`` adds the blocks up.
    Needs the RocksDB state store (``STATE_STORE``).
    """
    ship_package(feed.sparkSession)
    if block is not None:
        feed, keys = feed.withColumn("block", F.expr(f"(`{seq}` - pmod(`{seq}`, {block}L)) div {block}L")), [*keys, "block"]
    columns = [*keys, seq]
    if day is not None:
        feed = feed.withColumn("time", F.timestamp_micros(times.epoch_micros(F.col("time"))))
    # A day ends with the midnight behind it, in the reading of the watermark.
    end = F.unix_millis(F.date_add(F.col(day), 1).cast("timestamp")) if day is not None else F.lit(None).cast("long")
    extra = ["time"] if day is not None else []
    rows = feed.select(*columns, *extra, end.alias("expiry_ms"))
    ids = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    schema = f"{ids}, lo long, hi long, expiry_ms long" + (", time timestamp" if extra else "")
    names = [*keys, "lo", "hi", "expiry_ms", *extra]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if not len(frame):
                continue
            owner = frame.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            at, lo, hi = _folded(owner, frame[seq].to_numpy(np.int64))
            part = frame[[*keys, "expiry_ms"]].iloc[at].assign(lo=lo, hi=hi)
            if extra:
                part["time"] = frame["time"].groupby(owner).max().reindex(owner[at]).to_numpy()
            yield part[names]

    ranges = rows.where(F.col(seq).isNotNull()).mapInPandas(fold, schema)
    if extra:
        ranges = ranges.withWatermark("time", delay)
    out = f"{ids}, messages long, first_seq long, last_seq long, missing long, gaps long"
    return ranges.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_GapRanges(keys, day is not None), outputStructType=out, outputMode="Update",
        timeMode="EventTime" if day is not None else "None")


def gap_totals(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per channel from the newest row of each of its blocks, as a ``gap_stream`` with ``block`` gives them.

    A range that goes on in the next block is one range; only a channel's blocks are walked, not its numbers.
    """
    before = F.lag("last_seq").over(W.partitionBy(*keys).orderBy("block"))
    joined = blocks.withColumn("_on", F.coalesce((F.col("first_seq") == before + 1).cast("long"), F.lit(0)))
    out = joined.groupBy(*keys).agg(
        F.sum("messages").alias("messages"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"),
        F.sum(F.col("gaps") + 1 - F.col("_on")).alias("_ranges"))
    return out.select(*keys, "messages", "first_seq", "last_seq", (F.col("last_seq") - F.col("first_seq") + 1 - F.col("messages")).alias("missing"),
                      (F.col("_ranges") - 1).alias("gaps"))


def changelog_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Write each batch of an update-mode stream under its batch number; a retry overwrites itself."""
    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


class SinkFailure(RuntimeError):
    """Raised by ``failing_once``."""


def failing_once(sink: Callable[[DataFrame, int], None], at: int = 0, after_write: bool = True) -> Callable[[DataFrame, int], None]:
    """Fault injection: batch ``at`` fails between its write and its commit (or before the write).

    The offset of that batch is logged and not committed, so a restart replays exactly its rows. Only
    a sink whose output is named by the batch number ends with each row once.
    """
    def write(rows: DataFrame, batch_id: int) -> None:
        if batch_id != at:
            return sink(rows, batch_id)
        if after_write:
            sink(rows, batch_id)
        raise SinkFailure(f"batch {batch_id}")
    return write


def latest_from_changelog(spark: SparkSession, path: str, keys: list[str], schema: T.StructType) -> DataFrame:
    """Newest version of every key in a changelog."""
    versions = T.StructType(schema.fields + [T.StructField("batch", T.LongType())])
    rows = spark.read.schema(versions).parquet(path)
    return latest_per_key(rows, keys, "batch", [f.name for f in schema.fields if f.name not in keys]).drop("batch")


def snapshot_sink(spark: SparkSession, path: str, keys: list[str], by: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Keep one newest row per key in ``buckets`` hash buckets of keys.

    A batch reads and rewrites only the buckets its keys fall into, under its own number as the version,
    by dynamic partition overwrite, so a retried batch rebuilds the same files. A small list then says
    which version of each bucket counts; the batch is finished once that list is. Versions that the
    list before replaced are removed by the next batch, so readers of the last list keep their files.
    """
    def merge(rows: DataFrame, batch_id: int) -> None:
        before = _finished_lists(spark, path, batch_id)
        current = _bucket_versions(spark, path, before[-1]) if before else {}
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        fresh = keep_first(rows.withColumn("_bucket", bucket), keys, [F.desc(by)])
        # `buckets` numbers at most.
        touched = sorted(r[0] for r in rows.select(bucket.alias("b")).distinct().collect())
        held = _read_buckets(spark, path, {b: current[b] for b in touched if b in current})
        both = fresh if held is None else fresh.unionByName(held.withColumn("_bucket", bucket))
        if touched:
            newest = keep_first(both, keys, [F.desc(by)]).withColumn("_version", F.lit(batch_id).cast("long"))
            (newest.repartition(len(touched), "_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("_bucket", "_version").parquet(f"{path}/data"))
        listed = [(b, v) for b, v in (current | dict.fromkeys(touched, batch_id)).items()]
        # The batch counts once this list is finished.
        spark.createDataFrame(listed, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists/{batch_id}")
        if len(before) >= 2:
            for b, v in _bucket_versions(spark, path, before[-2]).items():
                if current.get(b) != v:
                    _remove(spark, f"{path}/data/_bucket={b}/_version={v}")
            for old in before[:-1]:
                _remove(spark, f"{path}/lists/{old}")
    return merge


def _files(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _remove(spark: SparkSession, path: str) -> None:
    fs, folder = _files(spark, path)
    fs.delete(folder, True)


def _finished_lists(spark: SparkSession, path: str, before: int | None = None) -> list[int]:
    """Numbers of the finished batches, optionally below ``before``; a list in writing does not count."""
    fs, folder = _files(spark, f"{path}/lists")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    done = [int(n) for n in names if n.isdigit() and fs.exists(_files(spark, f"{path}/lists/{n}/_SUCCESS")[1])]
    return sorted(n for n in done if before is None or n < before)


def _bucket_versions(spark: SparkSession, path: str, batch: int) -> dict[int, int]:
    return {r[0]: r[1] for r in spark.read.schema("bucket int, version long").parquet(f"{path}/lists/{batch}").collect()}


def _read_buckets(spark: SparkSession, path: str, versions: dict[int, int]) -> DataFrame | None:
    if not versions:
        return None
    folders = [f"{path}/data/_bucket={b}/_version={v}" for b, v in sorted(versions.items())]
    return spark.read.parquet(*folders)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """All keys as of the newest finished batch."""
    done = _finished_lists(spark, path)
    rows = _read_buckets(spark, path, _bucket_versions(spark, path, done[-1])) if done else None
    if rows is None:
        raise FileNotFoundError(f"no finished snapshot under {path}")
    return rows


def round_sink(compute: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """Per round: factors of the keys the round changed, from their whole state, under the round number.

    An update-mode stream of ``full_state_stream`` hands over just those states, so a round costs what it
    changed and never reads the other keys. A retried round overwrites itself; ``latest_round`` reads
    the newest value of every key.
    """
    def write(rows: DataFrame, batch_id: int) -> None:
        compute(rows).write.mode("overwrite").parquet(f"{path}/round={batch_id}")
    return write


def latest_round(spark: SparkSession, path: str, keys: list[str], schema: T.StructType) -> DataFrame:
    """Newest round of every key."""
    rounds = spark.read.schema(T.StructType(schema.fields + [T.StructField("round", T.LongType())])).parquet(path)
    return latest_per_key(rounds, keys, "round", [f.name for f in schema.fields if f.name not in keys]).drop("round")


def compact_chunks(spark: SparkSession, chunks: str, archive_root: str, kind: str) -> DataFrame:
    """Day-end step: chunks -> deduplicated sorted archive, then the time check row over the chunks' days."""
    rows = spark.read.parquet(chunks)
    write_archive(rows, archive_root, kind)
    written = spark.read.parquet(f"{archive_root.rstrip('/')}/{kind}")
    written = written.join(rows.select("trade_date").distinct(), "trade_date", "left_semi")
    return archive_check(rows, written, ["trade_date", "code", "seq_num"])


def stream_scratch(spark: SparkSession, label: str) -> tuple[str, str]:
    """(output path, checkpoint path) in the shared folder."""
    base = scratch_path(spark, label)
    return f"{base}/out", f"{base}/checkpoint"
