"""LM scoring by cross-entropy difference.

Two bigram models with one vocabulary, one set of bigrams and one smoothing: the target model counts
documents labelled good, the background model counts all documents. A document's score is the mean
over its words of target loss less background loss; lower is closer to the target.

All words and bigrams of all documents are counted, however rare: what is counted grows with the
corpus. A bigram is one word and the word before it, so the counts that a word's loss needs meet in
one place if every word goes to a bucket of its own. Words and bigrams from ``SHARE`` of all counted
words on, 1 / share of each at most, are counted beforehand, broadcast and priced on the spot, so no
frequent key is moved; the bigrams left over of a frequent word are dealt by bigram, all rare words
by word. A bucket counts what it holds, prices each occurrence and sums them by document: one
shuffle of occurrences, with no table of bigrams written. Where a loss is found never changes it.

A task goes through its buckets one after the other and adds up their sums by document. Sums are
added as whole numbers, so scores do not depend on the order of arrival.

Defined results: null and empty texts have no words, null losses and score 0; without target rows
the target model is the smoothed uniform one; null and repeated ids are scored row by row, and a
repeated id is in the target with each of its rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import tokens
from tickloom.llm.store import written
from tickloom.session import ship_package

SHARE = 2e-6
PRIOR = 100.0
#: A bigram is looked at as a frequent one where a group of texts holds it this often.
OFTEN = 3
#: Distinct keys that a task holds before it hands their counts on.
HELD = 400_000
#: Moved occurrences of a bucket.
PER_BUCKET = 1_000_000
#: Documents whose sums a task holds over its buckets.
SUMS = 500_000
#: Target ids up to this number are broadcast; beyond it documents are marked by a shuffle, once.
TARGETS = 2_000_000
FIRST, LAST = 1, 2


class Group:
    """Occurrences of the words of some documents, equal documents once with their numbers."""

    def __init__(self, held: dict[int, list]):
        self.keys = np.fromiter(held, np.int64, len(held))
        self.t, self.b = (np.array([row[c] for row in held.values()], np.int64) for c in (1, 2))
        self.h = np.concatenate([row[0] for row in held.values()])
        sizes = np.array([len(row[0]) for row in held.values()])
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.first, self.last = np.zeros(len(self.h), bool), np.zeros(len(self.h), bool)
        self.first[self.starts] = True
        self.last[self.starts + sizes - 1] = True
        self.pair = np.concatenate([[np.uint64(0)], tokens.grams(self.h, 2)])


def _document(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def groups(batches) -> Iterator[Group]:
    """Groups of about ``tokens.GROUP`` bytes of the columns text and target."""
    for batch in batches:
        target = batch.column("target").to_pylist()
        for first, h, bounds in tokens.word_groups(batch.column("text").to_pylist(), lower=True):
            held: dict[int, list] = {}
            for i in range(len(bounds) - 1):
                own = h[bounds[i]:bounds[i + 1]]
                if len(own):
                    row = held.setdefault(_document(own), [own, 0, 0])
                    row[1] += target[first + i]
                    row[2] += 1
            if held:
                yield Group(held)


def _weighed(keys: np.ndarray, g: Group, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of the occurrences ``at`` with their counts on both sides."""
    k, place = np.unique(keys[at], return_inverse=True)
    return k.view(np.int64), *(np.bincount(place, weights=w[g.doc[at]], minlength=len(k)).astype(np.int64) for w in (g.t, g.b))


def _added(parts: list[tuple]) -> tuple:
    k, t, b = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(k)
    k, t, b = k[order], t[order], b[order]
    new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[new], np.add.reduceat(t, new), np.add.reduceat(b, new)


def _counts(batches) -> Iterator[pa.RecordBatch]:
    """Counts of all words, and of the bigrams that a group holds ``OFTEN``."""
    held: dict[bool, list] = {False: [], True: []}

    def handed(pair: bool, least: int):
        if any(len(p[0]) for p in held[pair]):
            held[pair] = [_added(held[pair])]
            if len(held[pair][0][0]) >= least:
                k, t, b = held[pair].pop()
                yield pa.record_batch({"pair": pa.array(np.full(len(k), pair)), "k": pa.array(k), "t": pa.array(t), "b": pa.array(b)})

    for g in groups(batches):
        held[False].append(_weighed(g.h, g, np.arange(len(g.h))))
        k, t, b = _weighed(g.pair, g, np.flatnonzero(~g.first))
        held[True].append((k[b >= OFTEN], t[b >= OFTEN], b[b >= OFTEN]))
        for pair, parts in held.items():
            if sum(len(p[0]) for p in parts) > 2 * HELD:
                yield from handed(pair, HELD)
    for pair in held:
        yield from handed(pair, 1)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key among sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Frequent:
    """Words and bigrams that are priced where they stand, with the counts of target and background."""

    def __init__(self, words: pa.Table, pairs: np.ndarray, totals: list[int], vocabulary: int):
        order = np.argsort(words.column("k").to_numpy().view(np.uint64))
        self.words = words.column("k").to_numpy().view(np.uint64)[order]
        self.own = [words.column(c).to_numpy()[order] for c in "tb"]
        self.pairs, self.counts = np.sort(pairs.view(np.uint64)), [np.zeros(len(pairs), np.int64) for _ in "tb"]
        # One more place is kept for a word never seen.
        self.places = [float(n + vocabulary + 1) for n in totals]

    def share(self, side: int, count: np.ndarray) -> np.ndarray:
        return (count + 1) / self.places[side]

    def hot(self, g: Group) -> tuple[np.ndarray, np.ndarray]:
        at, there = _found(self.pairs, g.pair)
        return at, there & ~g.first

    def here(self, g: Group):
        """Summed losses by document of what is priced here; the other occurrences, and their words' places."""
        at, known = _found(self.words, g.h)
        pair_at, hot = self.hot(g)
        sums = []
        for side in (0, 1):
            value = np.zeros(len(g.h))
            if len(self.words):
                count = self.own[side][at]
                share = self.share(side, count)
                value += np.where(known & ~g.last, np.log(count + PRIOR), 0.0) - np.where(known & g.first, np.log(share), 0.0)
                value[hot] -= np.log(self.counts[side][pair_at[hot]] + PRIOR * share[hot])
            sums.append(np.add.reduceat(value, g.starts))
        return *sums, np.flatnonzero(~known | ~(hot | g.first)), known, at


_KINDS = {"docs": np.int64, "t": np.uint32, "b": np.uint32, "doc": np.uint32, "flag": np.uint8, "known": np.uint32, "rare": np.uint64, "pair": np.uint64}
_REST = (1 << 50) - 1
_MOVED_SCHEMA = pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in ("docs", "t", "b", "doc", "flag", "known", "rare", "pair")])
MOVED = "bucket int, docs binary, t binary, b binary, doc binary, flag binary, known binary, rare binary, pair binary"


def _moved(g: Group, frequent: Frequent, buckets: int) -> Iterator[dict]:
    """Occurrences of each bucket: frequent words by their places first, then rare words by their hashes."""
    _, _, left, known, at = frequent.here(g)
    known = known[left]
    bucket = ((np.where(known, g.pair[left], g.h[left]) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(2 * bucket + ~known, kind="stable")
    left, known, bucket = left[order], known[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
    for start, end in zip(cuts, [*cuts[1:], len(bucket)]):
        own, is_known = left[start:end], known[start:end]
        docs, doc = np.unique(g.doc[own], return_inverse=True)
        columns = {"docs": g.keys[docs], "t": g.t[docs].astype(np.uint32), "b": g.b[docs].astype(np.uint32), "doc": doc.astype(np.uint32),
                   "flag": FIRST * g.first[own].astype(np.uint8) + LAST * g.last[own].astype(np.uint8),
                   "known": at[own[is_known]].astype(np.uint32), "rare": g.h[own[~is_known]], "pair": g.pair[own]}
        yield {"bucket": int(bucket[start])} | {c: v.tobytes() for c, v in columns.items()}


def _by_bucket(batches) -> Iterator[tuple[int, Iterator[tuple]]]:
    """(bucket, rows) of rows sorted by bucket."""
    rows = (row for batch in batches for row in zip(batch.column("bucket").to_pylist(), *(batch.column(c) for c in _KINDS)))
    yield from groupby(rows, key=lambda row: row[0])


def _limbs(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole parts, and the rest in units of 2**-50: they add up to the same in any order."""
    whole = np.floor(value)
    rest = np.rint((value - whole) * 2.0**50).astype(np.int64)
    return whole.astype(np.int64) + (rest >> 50), rest & _REST


def _joined(parts: list[tuple]) -> tuple:
    """Rows of ``_priced`` added up by document."""
    columns = [np.concatenate(c) for c in zip(*parts)]
    order = np.argsort(columns[0], kind="stable")
    words, n, *limbs = (c[order] for c in columns)
    new = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else np.empty(0, np.int64)
    if not len(new):
        return tuple(columns)
    out = [words[new], np.add.reduceat(n, new)]
    for whole, rest in zip(limbs[::2], limbs[1::2]):
        high, low = np.add.reduceat(rest >> 25, new), np.add.reduceat(rest & ((1 << 25) - 1), new)
        high += low >> 25
        out += [np.add.reduceat(whole, new) + (high >> 25), (high & ((1 << 25) - 1)) << 25 | low & ((1 << 25) - 1)]
    return tuple(out)


def _summed(batches, frequent: Frequent) -> Iterator[pa.RecordBatch]:
    """``words``, ``n`` and both summed losses of the occurrences of a task's buckets, by document. One bucket
    is held at a time, and the sums of ``SUMS`` documents; more go on before all buckets are read."""
    parts, size = [], 0

    def batch(part: tuple) -> pa.RecordBatch:
        return pa.record_batch({c: pa.array(v) for c, v in zip(("words", "n", "lt", "rt", "lb", "rb"), part)})

    for _, rows in _by_bucket(batches):
        parts.append(_priced(rows, frequent))
        size += len(parts[-1][0])
        if size > 2 * SUMS:
            parts = [_joined(parts)]
            size = len(parts[0][0])
            if size > SUMS:
                yield batch(parts.pop())
                size = 0
    if parts:
        yield batch(_joined(parts))


def _priced(rows: Iterator[tuple], frequent: Frequent) -> tuple:
    """Documents, numbers of occurrences and both summed losses (limbs) of a bucket."""
    held: dict[str, list] = {c: [] for c in _KINDS}
    known, docs = [], 0
    for row in rows:
        part = {c: np.frombuffer(v.as_py(), kind) for v, (c, kind) in zip(row[1:], _KINDS.items())}
        part["doc"] = part["doc"].astype(np.int64) + docs
        docs += len(part["docs"])
        known.append(np.arange(len(part["doc"])) < len(part["known"]))
        for c, v in part.items():
            held[c].append(v)
    all_ = {c: np.concatenate(held.pop(c)) for c in _KINDS}
    known, doc = np.concatenate(known), all_["doc"]
    first, last = all_["flag"] & FIRST > 0, all_["flag"] & LAST > 0
    weights = [all_[c].astype(np.float64) for c in "tb"]
    pair = np.unique(all_.pop("pair"), return_inverse=True)[1]
    word = np.unique(all_["rare"], return_inverse=True)[1]
    order = np.argsort(doc, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(doc[order]) > 0]))
    sums = []
    for side in (0, 1):
        own = np.zeros(len(doc))
        own[known] = frequent.own[side][all_["known"]] if known.any() else 0
        own[~known] = np.bincount(word, weights=weights[side][doc[~known]])[word] if len(word) else 0
        both = np.bincount(pair, weights=np.where(first, 0.0, weights[side][doc]))[pair]
        share = frequent.share(side, own)
        value = np.where(first, -np.log(share), -np.log(both + PRIOR * share)) + np.where(known | last, 0.0, np.log(own + PRIOR))
        sums.append(np.add.reduceat(value[order], starts))
    return all_["docs"][doc[order][starts]], np.diff([*starts, len(doc)]).astype(np.int64), *_limbs(sums[0]), *_limbs(sums[1])


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text`` and ``target``: whether it is labelled good and not toxic."""
    good = written(labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
                   .withColumn("target", F.lit(1)), "loss-targets")
    few = good.count() <= TARGETS
    out = docs.select("doc_id", "text").join(F.broadcast(good) if few else good, "doc_id", "left").select("text", F.coalesce("target", F.lit(0)).alias("target"))
    return out if few else written(out, "loss-marked")


def frequent_counts(texts: DataFrame) -> tuple[Frequent, int]:
    """Frequent words and bigrams with their counts over all texts, and how many occurrences are left."""
    counts = written(texts.mapInArrow(_counts, "pair boolean, k bigint, t bigint, b bigint").groupBy("pair", "k").agg(
        F.sum("t").alias("t"), F.sum("b").alias("b")), "loss-counts")
    totals = counts.filter("not pair").agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0)), F.count(F.lit(1))).first()
    # 1 / SHARE rows of each kind at most. A bigram from the share on has two words from the share on.
    often = counts.filter(F.col("b") >= F.lit(SHARE * totals[1]))
    out = Frequent(often.filter("not pair").select("k", "t", "b").toArrow(), often.filter("pair").select("k").toArrow().column("k").to_numpy(),
                   totals[:2], totals[2])
    sent = texts.sparkSession.sparkContext.broadcast(out)

    def exactly(batches):
        seen = [np.zeros(len(sent.value.pairs), np.int64) for _ in "tb"]
        for g in groups(batches):
            at, hot = sent.value.hot(g)
            k, place = np.unique(at[hot], return_inverse=True)
            for own, w in zip(seen, (g.t, g.b)):
                own[k] += np.bincount(place, weights=w[g.doc[hot]], minlength=len(k)).astype(np.int64)
        k = np.flatnonzero(seen[1])
        yield pa.record_batch({"k": pa.array(k), "t": pa.array(seen[0][k]), "b": pa.array(seen[1][k])})

    if len(out.pairs):
        rows = texts.mapInArrow(exactly, "k bigint, t bigint, b bigint").groupBy("k").agg(F.sum("t").alias("t"), F.sum("b").alias("b")).toArrow()
        for own, c in zip(out.counts, "tb"):
            own[rows.column("k").to_numpy()] = rows.column(c).to_numpy()
    sent.destroy()
    return out, totals[1] - int(out.counts[1].sum())


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, both losses per word and ``score`` of every document."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = marked(docs, labels)
    frequent, left = frequent_counts(texts)
    buckets = max(spark.sparkContext.defaultParallelism, -(-left // PER_BUCKET))
    sent = spark.sparkContext.broadcast(frequent)

    def moved(batches):
        for g in groups(batches):
            rows = list(_moved(g, sent.value, buckets))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _MOVED_SCHEMA)

    def held(batches):
        for batch in batches:
            out = []
            for _, h, bounds in tokens.word_groups(batch.column("text").to_pylist(), lower=True):
                for i in range(len(bounds) - 1):
                    own = h[bounds[i]:bounds[i + 1]]
                    out.append((0, 0, 0, 0.0, 0.0))
                    if len(own):
                        key = _document(own)
                        x, y, rest, _, _ = sent.value.here(Group({key: [own, 0, 1]}))
                        out[-1] = (key, len(own), len(rest), float(x[0]), float(y[0]))
            if out:
                columns = zip(("words", "n_words", "n_rest", "x", "y"), zip(*out))
                yield pa.record_batch({"doc_id": batch.column("doc_id")} | {c: pa.array(v) for c, v in columns})

    # Equal documents of several groups are summed more than once: by n / n_rest of them.
    # A task adds up its buckets, so what it gives back follows the documents and not the number of buckets;
    # sums it could not hold are added up before they are shuffled.
    tasks = min(buckets, 2 * spark.sparkContext.defaultParallelism)
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).cast("double")
    rest = texts.mapInArrow(moved, MOVED).repartitionById(tasks, F.pmod("bucket", F.lit(tasks))).sortWithinPartitions("bucket").mapInArrow(
        lambda batches: _summed(batches, sent.value), "words bigint, n bigint, lt bigint, rt bigint, lb bigint, rb bigint").groupBy("words").agg(
        F.sum("n").alias("n"), *[(total(f"l{c}") + total(f"r{c}") / 2.0**50).alias(f"l{c}") for c in "tb"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    each = docs.select("doc_id", "text").mapInArrow(held, f"doc_id {kind}, words bigint, n_words bigint, n_rest bigint, x double, y double")
    loss = {c: F.when(F.col("n_words") > 0, (F.col(own) + F.when(F.col("n_rest") > 0, F.col(f"l{c}") / (F.col("n") / F.col("n_rest"))).otherwise(0.0)) / F.col("n_words")) for c, own in (("t", "x"), ("b", "y"))}
    return each.join(rest, "words", "left").select(
        "doc_id", "n_words", loss["t"].alias("target_loss"), loss["b"].alias("background_loss")).withColumn(
        "score", F.coalesce(F.col("target_loss") - F.col("background_loss"), F.lit(0.0)))
