"""The numbered queries and the pipeline, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import dialogue_repair, external_shuffle, license_digests, loss_difference, lsh_forest, mixing, packing, personal_data, rule_ensemble, rule_lists, sql, stats, substrings, token_alignment, winnowing
from tickloom.llm.store import read


def op1_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_copies(read(spark, sf_dir, "documents"))


def op2_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digests.scan(read(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.span_table(read(spark, sf_dir, "documents"))


def op4_rule_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rule_lists.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", *stats.COUNTS[:5], "base_failed", "kept")


def op5_loss_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loss_difference.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.leak_table(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rule_ensemble.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op8_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return external_shuffle.shard_table(read(spark, sf_dir, "documents"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(read(spark, sf_dir, "documents"), digest=True)


def op10_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(read(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.aligned(read(spark, sf_dir, "documents"))


def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue_repair.verdicts(*dialogue_repair.damaged(read(spark, sf_dir, "conversations")))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_lsh_forest, op2_license_digests, op3_personal_data, op4_rule_lists, op5_loss_difference, op6_winnowing,
    op7_rule_ensemble, op8_external_shuffle, op9_substrings, op10_systematic_mixing, op11_token_alignment,
    op12_dialogue_repair, op13_packing)}
ORACLES = {"op2_license_digests": license_digests.oracle(), **sql.ORACLES}
