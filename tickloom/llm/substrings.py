"""Substring dedup: words inside a window of 13 that also starts in an earlier document go.

Suffix automata of reference shards broadcast in turn make every document meet every shard, work
that grows with the square of the corpus; so another method stands here (see README). It gives the
same maximal spans and is exact:

1. Every shared run of ``SPAN`` words shares a winnowed fingerprint, the smallest of each ``PICK``
   hashes of ``GRAM`` words. Fingerprints of two documents or more are marked in a bitmap of fixed size.
2. Windows around a marked fingerprint are counted as a whole by a hash of their ``SPAN`` words: the
   smallest document of each, and whether there is another.
3. Shared windows meet their documents again, and those with a smaller first document are taken out
   of the text, maximal spans at once.

A passage that a third of all documents share is pre-aggregated at every step before it is moved,
and joins on windows are plain joins that Spark splits where a key is hot.

Defined results: null, empty and short texts lose nothing; a null ``doc_id`` neither loses words nor
takes any from others; rows with one id do not take words from each other; no rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import tokens
from tickloom.llm.bitmaps import bitmap, holds
from tickloom.llm.store import written
from tickloom.session import ship_package

SPAN, GRAM = 13, 5
PICK = SPAN - GRAM + 1
#: Bits of the two bitmaps of hashes: 16 MiB each.
HASH_BITS = 27


def _per_document(batch: pa.RecordBatch):
    """(row, word hashes) of rows with SPAN words or more."""
    for first, h, bounds in tokens.word_groups(batch.column("text").to_pylist()):
        for i in range(len(bounds) - 1):
            if bounds[i + 1] - bounds[i] >= SPAN:
                yield first + i, h[bounds[i]:bounds[i + 1]]


def _ends(hashes: list[np.ndarray], docs: list[int]) -> pa.RecordBatch:
    """Each distinct hash once with its smallest and largest document."""
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    d = np.repeat(np.array(docs, np.int64), [len(x) for x in hashes])
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    last = np.concatenate([new[1:], [len(h)]])[:len(new)] - 1
    return pa.record_batch({"h": pa.array(h[new].view(np.int64)), "lo": pa.array(d[new]), "hi": pa.array(d[last])})


def _fingerprints(batches):
    for batch in batches:
        ids, hashes, docs = batch.column("doc_id").to_pylist(), [], []
        for row, h in _per_document(batch):
            g = tokens.grams(h, GRAM)
            hashes.append(np.unique(g[tokens.winnowed(g, PICK)]))
            docs.append(ids[row])
        yield _ends(hashes, docs)


def _near(h: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Window hashes of a document, and which of them hold a marked fingerprint."""
    g = tokens.grams(h, GRAM)
    places = tokens.winnowed(g, PICK)
    places = places[holds(marked, g[places].view(np.int64))]
    n = len(h) - SPAN + 1
    reach = np.zeros(n + 1, np.int64)
    np.add.at(reach, np.maximum(places - PICK + 1, 0), 1)
    np.add.at(reach, np.minimum(places + 1, n), -1)
    return np.cumsum(reach[:-1]) > 0


def _windows(h: np.ndarray, marked: np.ndarray) -> np.ndarray:
    near = _near(h, marked)
    return np.unique(tokens.grams(h, SPAN)[near]) if near.any() else np.empty(0, np.uint64)


def _shared(rows: DataFrame) -> DataFrame:
    """Hashes that occur in two documents or more, with the first."""
    return rows.groupBy("h").agg(F.min("lo").alias("first"), F.max("hi").alias("last")).filter("first < last").select("h", "first")


def removable(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the hashes of its windows that start in an earlier document."""
    spark = docs.sparkSession
    known = docs.filter("doc_id is not null").select("doc_id", "text")
    marked = spark.sparkContext.broadcast(bitmap(_shared(known.mapInArrow(_fingerprints, "h bigint, lo bigint, hi bigint")).select("h"), HASH_BITS))

    def counted(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            found = [(ids[row], w) for row, h in _per_document(batch) if len(w := _windows(h, marked.value))]
            yield _ends([w for _, w in found], [d for d, _ in found])

    shared = written(_shared(known.mapInArrow(counted, "h bigint, lo bigint, hi bigint")), "windows")
    common = spark.sparkContext.broadcast(bitmap(shared.select("h"), HASH_BITS))

    def asking(batches):
        for batch in batches:
            ids, docs_out, hashes = batch.column("doc_id").to_pylist(), [], []
            for row, h in _per_document(batch):
                w = _windows(h, marked.value).view(np.int64)
                w = w[holds(common.value, w)]
                docs_out.append(np.full(len(w), ids[row], np.int64))
                hashes.append(w)
            if hashes:
                yield pa.record_batch({"doc_id": pa.array(np.concatenate(docs_out)), "h": pa.array(np.concatenate(hashes))})

    asked = known.mapInArrow(asking, "doc_id bigint, h bigint")
    return written(asked.join(shared, "h").filter("first < doc_id").groupBy("doc_id").agg(
        F.collect_set("h").alias("windows")), "removable")


def _cut(batches):
    """Texts without the words of the given windows."""
    for batch in batches:
        texts, gone = batch.column("text").to_pylist(), batch.column("windows")
        n_words, n_removed, kept = [], [], []
        cover = {}
        if gone.null_count < len(gone):
            for row, h in _per_document(batch):
                if gone[row].is_valid:
                    hit = np.isin(tokens.grams(h, SPAN).view(np.int64), np.asarray(gone[row].values))
                    reach = np.zeros(len(h) + 1, np.int64)
                    starts = np.flatnonzero(hit)
                    reach[starts] += 1
                    reach[starts + SPAN] -= 1
                    cover[row] = np.cumsum(reach[:-1]) > 0
        for row, text in enumerate(texts):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            n_words.append(len(words))
            if row in cover:
                words = [w for w, c in zip(words, cover[row].tolist()) if not c]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.record_batch({
            "doc_id": batch.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})


def _digest(batches):
    for batch in _cut(batches):
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in batch.column("kept_text").to_pylist()]
        yield pa.record_batch({c: batch.column(c) for c in ("doc_id", "n_words", "n_removed")} | {"kept_sha256": pa.array(sha, pa.string())})


def without_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept_text`` (or ``kept_sha256``) of every document."""
    ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gone = removable(docs)
    touched = docs.sparkSession.sparkContext.broadcast(bitmap(gone.select("doc_id")))
    cut, last = (_digest, "kept_sha256 string") if digest else (_cut, "kept_text string")
    schema = f"doc_id bigint, n_words bigint, n_removed bigint, {last}"

    def side(inside: bool):
        def run(batches):
            for batch in batches:
                ids = batch.column("doc_id")
                hit = holds(touched.value, ids.fill_null(0).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(hit == inside))
        return run

    def untouched(batches):
        for batch in side(False)(batches):
            yield from cut([batch.append_column("windows", pa.nulls(batch.num_rows, pa.list_(pa.int64())))])

    there = docs.mapInArrow(side(True), "doc_id bigint, text string").join(gone, "doc_id", "left").select("doc_id", "text", "windows")
    return docs.mapInArrow(untouched, schema).unionByName(there.mapInArrow(cut, schema))
