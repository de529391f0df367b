"""Packing: every id in exactly one piece, sequences full, patterns against a one-by-one version."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from tickloom.llm import packing

COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def encoder():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.vocabulary())
    return lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, packing.END]


def padding(rows, size):
    used = defaultdict(int)
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= size and sorted(used) == list(range(len(used)))
    return sum(0 if u & (u - 1) == 0 else size - u for u in used.values()), sum(used.values())


def check(rows, docs, size, least):
    """``docs`` is a list of (doc_id, text)."""
    encode = encoder()
    want = defaultdict(list)
    for i, t in docs:
        want[i].append(encode(t))
    places, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] > 0
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    assert set(by_doc) == set(want)
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
    for i, all_ids in want.items():
        pool = sorted(([r["doc_tokens"], r["start"], r["length"], r["ids_crc32"]] for r in by_doc[i]))
        assert sum(p[2] for p in pool) == sum(map(len, all_ids))
        if len(all_ids) == 1:
            at = 0
            for n, start, length, crc in pool:
                assert (n, start) == (len(all_ids[0]), at)
                assert crc == zlib.crc32(np.array(all_ids[0][start:start + length], "<u4").tobytes())
                at += length
    pad, _ = padding(rows, size)
    assert pad <= (least - 1) * len(places)


def one_by_one(lengths, size):
    """Used tokens of the packs when every length goes to the shortest pack with room."""
    packs = []
    for n in sorted(lengths, reverse=True):
        at = min((p for p in range(len(packs)) if packs[p] + n <= size), key=lambda p: packs[p], default=None)
        if at is None:
            packs.append(n)
        else:
            packs[at] += n
    return sorted(packs)


@pytest.mark.parametrize("seed", range(12))
def test_patterns_are_those_of_one_by_one(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [5, 20, 64, 65][seed % 4], [3, 40, 300][seed % 3]).tolist()
    hist = {n: lengths.count(n) for n in set(lengths)}
    patterns = packing.shortest_first(hist, 64)
    held, used = defaultdict(int), []
    for count, pattern in patterns:
        used += [sum(n * t for n, t in pattern)] * count
        for n, t in pattern:
            held[n] += count * t
    assert held == hist and sorted(used) == one_by_one(lengths, 64)


@pytest.mark.parametrize("hist", [{}, {1: 1}, {64: 5}, {40: 100}, {33: 1000, 31: 10}, {63: 9}, {50: 7, 3: 2}, {1: 1000}, {32: 3, 5: 1}])
@pytest.mark.parametrize("least", [1, 4])
def test_plan_covers_every_rank_once(hist, least):
    plan = packing.Plan(hist, 64, least)
    cells, used = set(), defaultdict(int)
    for length, n in hist.items():
        to, offset, cut = plan.places(np.full(n, length), np.arange(n))
        for t, o, c in zip(to.tolist(), offset.tolist(), cut.tolist()):
            parts = list(plan.cuts(t, length)) if c else [(0, length, t, o)]
            assert sum(p[1] for p in parts) == length
            for _, k, sequence, at in parts:
                used[sequence] += k
                cells |= {(sequence, x) for x in range(at, at + k)}
    total = sum(n * k for n, k in hist.items())
    assert len(cells) == total and all(x < u for s, u in used.items() for x in [max(a for q, a in cells if q == s)])
    assert sorted(used) == list(range(plan.sequences))
    assert all(u & (u - 1) == 0 or 64 - u < least for u in used.values())


def test_rows_with_nulls_copies_and_long_texts(spark, rows, docs):
    got = packing.packed(docs).select(*COLUMNS).collect()
    check(got, [(i, t) for i, t, _ in rows], packing.SIZE, packing.LEAST)


def test_small_sequences_cut_and_ids(spark, rows, docs):
    got = packing.packed(docs, size=64, least=2, with_ids=True).collect()
    check(got, [(i, t) for i, t, _ in rows], 64, 2)
    assert all(zlib.crc32(np.frombuffer(r["ids"], "<u2").astype("<u4").tobytes()) == r["ids_crc32"] for r in got)
    light = packing.packed(docs, size=64, least=2).select(*COLUMNS).collect()
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, light)) == sorted(map(key, got))


def test_one_length_holds_nearly_all_rows(spark):
    table = spark.createDataFrame([(i % 50 or None, "same words here") for i in range(3000)] + [(7, "one")], "doc_id int, text string").repartition(7)
    got = packing.packed(table, size=63, least=4).collect()
    pad, total = padding(got, 63)
    assert total == 3000 * 4 + 2 and pad <= 3 * len({r["sequence_id"] for r in got})
    cells = {(r["sequence_id"], x) for r in got for x in range(r["offset"], r["offset"] + r["length"])}
    assert len(cells) == total


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_on_the_given_table(spark):
    from tickloom.llm import queries
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    df = queries.op13_packing(spark, sf)
    assert df.columns == list(COLUMNS)
    check(df.collect(), docs, packing.SIZE, packing.LEAST)


def test_words_give_the_ids_of_the_whole_text():
    from tickloom.llm import word_tokens
    encode = encoder()
    texts = ["Hi<|endoftext|>.", "<|ENDOFTEXT|>, Ünḯ İx. \x1c a\x1cb 'S it'S don't. a.b,c. ΑΣ. Σ ß ﬁ 1.5, 12. 日本語. <|endoftext|>.", "́ ́a .́ a.́ Ķ,",
             "a b\xa0c\x0bd　e\x85f.", "ÀÉÎ ÀÉÎ. ŉa. Ǆ, ƀ! ª. µ, ĳ. Łódź, ŁÓDŹ!", "café́. é. İ. " + "x" * 60 + ". " + "é" * 70, "", " \n", "of%%% a|b [x], .,! ...", None]
    words = word_tokens.WordTokens(packing.vocabulary())
    word_tokens.REMEMBERED, keep = 5, word_tokens.REMEMBERED  # emptied between groups
    word_tokens.GROUP, group = 20, word_tokens.GROUP
    try:
        for _ in range(2):
            assert [np.frombuffer(b, words.dtype).tolist() for b in words.encode(texts)] == [encode(t)[:-1] for t in texts]
    finally:
        word_tokens.REMEMBERED, word_tokens.GROUP = keep, group
