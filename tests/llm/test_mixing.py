"""Mixing, sharding and the pipeline."""

import collections
import zlib

import pytest

import corpus_pipeline
from tests.llm.conftest import by_id
from pyspark.sql import functions as F

from tickloom.llm import external_shuffle, mixing


def exact_targets(sizes):
    """Excess reshared by weight, round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, open_, target = sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        for s in full:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def test_mix(docs, rows):
    got = by_id(mixing.mix_table(docs), "size", "source_size", "target", "taken")
    sizes = collections.Counter()
    for i, t, s in rows:
        sizes[s] += len((t or "").encode().split())
    want, taken = exact_targets(sizes), collections.Counter()
    for i, t, s in rows:
        size, of, target, took = got[i]
        assert size == len((t or "").encode().split()) and of == sizes[s]
        assert target == pytest.approx(want[s])
        assert took % max(size, 1) == 0 and took <= 3 * size
        taken[s] += took
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(got[i][0] for i, _, x in rows if x == s)
    assert by_id(mixing.mix_table(docs.repartition(5)), "taken") == {i: (g[3],) for i, g in got.items()}
    assert mixing.mix_table(docs.filter("false")).collect() == []


def test_excess_is_reshared(spark):
    rows = [(i, " ".join(["w"] * 100), "a") for i in range(100)] + [(i, "w " * 10, s) for i, s in ((200, "b"), (201, "c"), (202, None))]
    got = {r["doc_id"]: r for r in mixing.mix_table(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    want = exact_targets({"a": 10_000, "b": 10, "c": 10, None: 10})
    assert [got[i]["target"] for i in (0, 200, 201, 202)] == pytest.approx([want["a"], 30, 30, 30])
    assert [got[i]["taken"] for i in (200, 201, 202)] == [30, 30, 30]


def test_shards(docs, rows):
    got = external_shuffle.shard_table(docs).collect()
    assert sorted(r["doc_id"] for r in got) == [i for i, _, _ in rows]
    slots = collections.defaultdict(list)
    for r in got:
        raw = (dict((i, t) for i, t, _ in rows)[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = external_shuffle.shard_table(docs.repartition(7)).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in again} == {(r["doc_id"], r["shard"], r["slot"]) for r in got}
    assert external_shuffle.shard_table(docs.filter("false")).collect() == []


def test_shuffle_over_many_buckets_is_a_permutation(spark):
    rows = spark.range(5000).selectExpr("id as doc_id", "id % 3 as record", "cast(id as string) as text")
    got = external_shuffle.shuffled(rows, shards=3, bucket_bytes=2000).select("record.doc_id", "shard", "slot").collect()
    order = [r[0] for r in sorted(got, key=lambda r: (r["slot"], r["shard"]))]
    assert sorted(order) == list(range(5000))
    rising = sum(a < b for a, b in zip(order, order[1:]))
    assert 2300 < rising < 2700


def test_copies_heavier_than_a_bucket_are_dealt(spark):
    """A third of all rows share id and text; no bucket holds them whole, and every row keeps one place."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("long").alias("doc_id"),
                                    F.when(F.col("id") % 3 == 0, "copy " * 20).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    out = external_shuffle.shuffled(rows, shards=3, bucket_bytes=4000)
    got = out.select("record.doc_id", "shard", "slot").collect()
    places = sorted(r["slot"] * 3 + r["shard"] for r in got)
    assert places == list(range(3000))
    hot = sorted(r["slot"] * 3 + r["shard"] for r in got if r["doc_id"] == 7)
    assert len(hot) == 1000 + (7 % 3 != 0)
    longest, run = 1, 1
    for a, b in zip(hot, hot[1:]):
        run = run + 1 if b == a + 1 else 1
        longest = max(longest, run)
    assert longest < 200  # copies lie in many buckets, among other rows


def test_query_and_written_shards_agree(spark, docs, tmp_path):
    """Extra columns change neither shard nor slot."""
    external_shuffle.write_shards(docs, str(tmp_path / "out"), bucket_bytes=1 << 16)
    files = spark.read.parquet(str(tmp_path / "out"))
    assert files.count() == docs.count()
    want = {(r["doc_id"], r["shard"], r["slot"]) for r in external_shuffle.shard_table(docs, bucket_bytes=1 << 16).collect()}
    narrow = {(r["doc_id"], r["shard"], r["slot"]) for r in external_shuffle.shard_table(docs.select("text", "doc_id"), bucket_bytes=1 << 16).collect()}
    assert want == narrow == {(r["doc_id"], r["_shard"], r["slot"]) for r in files.collect()}


def test_written_shards(spark, docs, tmp_path):
    external_shuffle.write_shards(docs.select("doc_id", "text"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.columns == [*columns, "shard", "slot"] and last.count() == docs.count()


def test_stages_on_odd_rows(spark, docs):
    """Nulls, empties and clashing columns pass every stage."""
    sf = "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns[:len(docs.columns)] == docs.columns
        assert stage(spark, docs.filter("false"), sf).collect() == []
        out.collect()
