"""Sharding by a two-pass external shuffle.

Pass one scatters whole records into memory-sized buckets by a seeded hash of id and text; pass two
orders each bucket by content, so that it does not depend on arrival, and applies Spark's seeded
``shuffle`` (a Fisher-Yates permutation). Positions run on from bucket to bucket, and a position
modulo the shard count is the shard: counts differ by one at most (law ``rows``). ``shard_table`` reads
its figures off the same shuffled records that ``write_shards`` writes.

Records that share id and text would all fall into one bucket. Where such copies weigh more than a bucket
they are dealt over as many buckets as they fill, by their row number: copies are interchangeable.

Defined results: null texts have size 1 and checksum 0; null ids are hashed like any value; rows
equal in every column keep one place each; a single text longer than a bucket is a larger bucket; an
empty table gives no rows. Extra columns travel inside one struct and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.store import free_name, written

SEED = 20_240_601
BUCKET_BYTES = 32 << 20


def byte_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_crc(text: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long")


def _identity(records: DataFrame, seed: int) -> Column:
    """Seeded hash of id and text; of all columns where a table has neither."""
    own = [F.col("doc_id")] if "doc_id" in records.columns else []
    own += [text_crc(F.col("text")), byte_size(F.col("text"))] if "text" in records.columns else []
    return F.xxhash64(F.lit(seed), *(own or [F.col(f"`{c}`") for c in records.columns]))


def shuffled(records: DataFrame, shards: int = 8, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``record`` (a struct of all columns), ``shard`` and gapless ``slot`` of every row."""
    if shards < 1 or bucket_bytes < 1:
        raise ValueError("shards and bucket_bytes must be positive")
    key = _identity(records, seed)
    size = byte_size(F.col("text")) if "text" in records.columns else F.lit(64).cast("long")
    weights = written(records.select(key.alias("_key"), size.alias("_size")).groupBy("_key").agg(F.sum("_size").alias("_bytes")), "shuffle-weights")
    total = weights.agg(F.sum("_bytes")).first()[0] or 0
    buckets = max(1, round(total / bucket_bytes + 0.5))
    # Copies that weigh more than a bucket: total / bucket_bytes of them at most.
    heavy = weights.filter(F.col("_bytes") > bucket_bytes).select("_key", F.ceil(F.col("_bytes") / bucket_bytes).alias("_deals"))
    every = [F.col(f"`{c}`") for c in records.columns]
    keyed = records.select(F.struct(*every).alias("record"), key.alias("_key"), F.xxhash64(*every).alias("rest"), F.monotonically_increasing_id().alias("_row"))
    deal = F.when(F.col("_deals").isNotNull(), F.pmod(F.xxhash64("_row"), F.col("_deals"))).otherwise(F.lit(0))
    scattered = keyed.join(F.broadcast(heavy), "_key", "left").select(
        "record", F.col("_key").alias("key"), "rest", F.pmod(F.xxhash64("_key", deal), F.lit(buckets)).cast("int").alias("bucket"))
    # One numbered shuffle; sorting by content first makes the permutation the same on every run and retry.
    placed = (scattered.repartition(buckets, "bucket").sortWithinPartitions("bucket", "key", "rest")
              .groupBy("bucket").agg(F.collect_list("record").alias("rows"))
              .select("bucket", F.posexplode(F.shuffle("rows", seed)).alias("place", "record")))
    placed = written(placed, "shuffled")
    sizes = placed.groupBy("bucket").count()
    # One row per bucket: what fits in memory once is one row here.
    starts = F.sum("count").over(_by_bucket()) - F.col("count")
    # Sixteen bytes a bucket of `bucket_bytes`: records stay where they lie.
    at = placed.join(F.broadcast(sizes.select("bucket", starts.alias("start"))), "bucket")
    position = F.col("start") + F.col("place")
    return at.select("record", F.pmod(position, F.lit(shards)).cast("int").alias("shard"),
                     F.floor(position / shards).cast("long").alias("slot"))


def _by_bucket():
    from pyspark.sql import Window
    return Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)


def shard_table(docs: DataFrame, shards: int = 8, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Shard, slot, size and checksum of every document, off the shuffled records."""
    out = shuffled(docs, shards, seed, bucket_bytes)
    return out.select("record.doc_id", byte_size(F.col("record.text")).alias("size"), text_crc(F.col("record.text")).alias("text_crc32"),
                      F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Whole records in shuffled order, one folder per ``shard`` (underscores before the name where it clashes); the places are those of ``shard_table``."""
    shard, slot = free_name(docs, "shard"), free_name(docs, "slot")
    out = shuffled(docs, shards, seed, bucket_bytes).withColumnsRenamed({"shard": shard, "slot": slot})
    (out.repartition(shard, F.floor(F.col(slot) / 100_000)).sortWithinPartitions(shard, slot)
     .select(shard, slot, "record.*").write.partitionBy(shard).parquet(path))
