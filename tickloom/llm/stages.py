"""Operators as stages over ``documents``: whole rows in, whole rows out.

Extra columns of the rows pass through untouched, whatever their names. Null ids: kept by every
filter that goes by id. Rows that repeat an id share its verdict; in mixing, its larger copy count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import external_shuffle, lsh_forest, mixing, rule_ensemble, stats, winnowing
from tickloom.llm.store import free_name, read, same_join, written


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    return docs.join(gone.select(F.col("doc_id").alias("_gone")).distinct(), F.col("doc_id") == F.col("_gone"), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts."""
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_record")
    scored = rule_ensemble.score(docs.select("doc_id", "text", record), read(spark, sf_dir, "labels"), keep=("_record",))
    return scored.filter("predicted = 1").select("_record.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near copies."""
    return _without(docs, lsh_forest.near_copies(docs.select("doc_id", "text")).filter("not kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    return _without(docs, written(winnowing.leaking_ids(docs, read(spark, sf_dir, "benchmark")), "leaks"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    sized = written(docs.select("doc_id", "source", stats.word_count(F.col("text")).alias("size")), "mix-sizes")
    times = free_name(docs, "copies")
    taken = mixing.mixed(sized).groupBy("doc_id").agg(F.max("copies").cast("int").alias(times)).filter(F.col(times) > 0)
    rows = same_join(docs, taken, ["doc_id"])
    return rows.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in a global random order, cut into eight shards."""
    out = external_shuffle.shuffled(docs)
    return out.select("record.*", F.col("shard").alias(free_name(docs, "shard")), F.col("slot").alias(free_name(docs, "slot")))
