"""Corpus pipeline: quality, near copies, benchmark leaks, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import stages
from tickloom.llm.store import read, written

STAGES = [
    ("quality classifier", stages.quality),
    ("near-dedup", stages.near_dedup),
    ("decontamination", stages.decontaminate),
    ("mixing", stages.mix),
    ("sharding", stages.shard),
]
#: A learned classifier and a seeded shuffle cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
