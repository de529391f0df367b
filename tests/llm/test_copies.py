"""Near copies and repeated passages against brute force."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import by_id
from tickloom.llm import components, lsh_forest, store, substrings, tokens


def exact_components(rows):
    sets = {}
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return {i: (len(sets[i]), root[i], root[i] == i) for i in sets}


def test_near_copies(docs, rows):
    assert by_id(lsh_forest.near_copies(docs), "n_shingles", "component_id", "kept") == exact_components(rows)


def test_near_copies_of_nothing_and_null_ids(spark, docs):
    assert lsh_forest.near_copies(docs.filter("false")).collect() == []
    odd = spark.createDataFrame([(None, "a b c d e f"), (None, None), (5, "a b c d e f"), (5, "a b c d e f")], "doc_id long, text string")
    got = sorted((r[0] is None, r["n_shingles"], r["component_id"], r["kept"]) for r in lsh_forest.near_copies(odd).collect() if r["n_shingles"])
    assert got == [(False, 2, 5, True), (False, 2, 5, True), (True, 2, None, True)]


def test_large_group_of_near_copies_is_one(spark):
    from tests.llm.conftest import edited, prose
    base = prose(11, 200)
    rows = [(i, edited(base, [i % 190 + 3])) for i in range(600)] + [(i, prose(i, 60)) for i in range(600, 640)]
    got = by_id(lsh_forest.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), "component_id")
    assert all(got[i] == (0,) for i in range(600)) and all(got[i] == (i,) for i in range(600, 640))


def test_pairs_inside_a_template_just_below_the_threshold(spark):
    """500 pages of one template at about 0.73 of each other; every page of the first half has one partner above 0.75."""
    rng = np.random.default_rng(5)
    core = [f"core{k}" for k in range(844)]
    page = lambda own: " ".join([*core, *own])
    rows = []
    for k in range(250):
        own = [f"w{x}" for x in rng.integers(0, 1 << 40, 152)]
        rows += [(2 * k, page(own), None), (2 * k + 1, page(own[:20] + [f"w{x}" for x in rng.integers(0, 1 << 40, 132)]), None)]
    sets = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t, _ in rows)]
    share = lambda x, y: len(x & y) / len(x | y)
    assert 0.7 < share(sets[0], sets[2]) < 0.75 <= share(sets[0], sets[1]) < 0.78
    got = by_id(lsh_forest.near_copies(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)), "component_id")
    assert got == {i: (i - i % 2,) for i, _, _ in rows}


def test_lower_thresholds_than_the_forest_serves_are_refused(docs):
    with pytest.raises(ValueError, match="75"):
        lsh_forest.near_copies(docs, percent=60)


def test_components_of_a_long_chain(spark):
    nodes = np.random.default_rng(1).permutation(300).tolist()
    links = spark.createDataFrame([(a, b) for a, b in zip(nodes, nodes[1:])] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {n: 0 for n in nodes} | {1000: 1000, 1001: 1000}


def exact_cuts(rows):
    words = {i: (t or "").encode().split() for i, t, _ in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k:k + 13]), i)
    out = {}
    for i, w in words.items():
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k:k + 13])] < i for p in range(k, k + 13)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_passages(docs, rows):
    got = by_id(substrings.without_repeats(docs, digest=True), "n_words", "n_removed", "kept_sha256")
    assert got == exact_cuts(rows)
    assert got[15][1] == 35


def test_passages_null_ids_repeated_ids_and_nothing(spark, docs):
    text = " ".join(f"w{i}" for i in range(20))
    odd = spark.createDataFrame([(None, text), (4, text), (4, text), (9, text), (2, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in substrings.without_repeats(odd).collect())
    assert got == [("2", 0), ("4", 0), ("4", 0), ("9", 20), ("None", 0)]
    assert substrings.without_repeats(docs.filter("false")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n\x0bé ", max_size=40), min_size=1, max_size=6))
def test_words_are_told_apart(texts):
    seen, groups = {}, {}
    for first, h, bounds in tokens.word_groups(texts):
        for i in range(len(bounds) - 1):
            groups[first + i] = h[bounds[i]:bounds[i + 1]].tolist()
    for i, t in enumerate(texts):
        words = t.encode().split()
        assert len(groups[i]) == len(words)
        for w, h in zip(words, groups[i]):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("k", [1, 5, 13])
def test_gram_hashes_follow_words_only(k):
    h = np.arange(40, dtype=np.uint64)
    again = np.concatenate([h[20:], h])
    assert tokens.grams(again, k)[20:].tolist() == tokens.grams(h, k).tolist()
    assert len(tokens.grams(h, 41)) == 0


def test_batches_are_bounded_inside_only(spark):
    was = spark.conf.get(store.ARROW_ROWS)
    lengths = lambda: {n for (n,) in spark.range(0, 5000, 1, 1).mapInArrow(
        lambda it: (pa.record_batch({"n": pa.array([b.num_rows], pa.int64())}) for b in it), "n bigint").collect()}
    with store.batches_of(spark, 1000):
        assert lengths() == {1000}
        with store.batches_of(spark, 2000):
            assert lengths() == {1000}
    assert spark.conf.get(store.ARROW_ROWS) == was
    with pytest.raises(ZeroDivisionError):
        with store.batches_of(spark, 7):
            1 / 0
    assert spark.conf.get(store.ARROW_ROWS) == was
