"""Families of documents that are all just below the threshold, and the few links inside them."""

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import by_id
from tickloom.llm import lsh_forest


def brute_components(sets, ids):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (top(i),) for i in ids}


@pytest.fixture(scope="module")
def family():
    """Pages of one text with 18 of 200 places changed, at about 0.7 of each other; every tenth keeps 12 of the changes of the one before."""
    rng = np.random.default_rng(3)
    text = [f"w{k}" for k in range(1000)]
    rows, last = [], []
    for i in range(300):
        places = rng.choice(200, 18, replace=False).tolist()
        if i % 10 == 9:
            places = [*last[:12], *[p for p in places if p not in last][:6]]
        own = list(text)
        for p in places:
            own[5 * p] = f"own{i}x{p}"
        rows.append((i, " ".join(own)))
        last = places
    return rows


@pytest.mark.parametrize("block", [lsh_forest.BLOCK_NODES if hasattr(lsh_forest, "BLOCK_NODES") else None, 40])
def test_a_family_gives_back_links_and_no_pairs_below_the_threshold(spark, family, monkeypatch, block):
    made, write = {}, lsh_forest.written

    def counted(df, label):
        out = write(df, label)
        made[label] = made.get(label, 0) + out.count()
        return out
    monkeypatch.setattr(lsh_forest, "written", counted)
    monkeypatch.setattr(lsh_forest, "BLOCK_NODES", block, raising=False)
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in family)}
    want = brute_components(sets, list(sets))
    assert len(set(want.values())) > 200
    got = by_id(lsh_forest.near_copies(spark.createDataFrame(family, "doc_id long, text string").repartition(4)), "component_id")
    assert got == want
    assert made["forest-exact"] < len(family)  # of 44,850 pairs


@pytest.mark.parametrize("blocks", [1, 2])
@pytest.mark.parametrize("percent", [75, 90])
def test_linked_joins_what_all_pairs_join(blocks, percent):
    rng = np.random.default_rng(percent)
    sets = []
    for k in range(120):
        base = np.random.default_rng(k // 6).integers(0, 1 << 48, 5 + 9 * (k // 6), dtype=np.uint64)
        own = rng.integers(0, 1 << 48, rng.integers(0, 2 + len(base) // 5), dtype=np.uint64)
        sets.append(np.unique(np.concatenate([base[rng.random(len(base)) < 0.95], own, base[:1]])))
    root, block = np.arange(120) // 2, np.arange(120) // 3 % blocks

    def joined(pairs):
        up = list(range(60))
        for a, b in pairs:
            x, y = up[root[a]], up[root[b]]
            up = [min(x, y) if u in (x, y) else u for u in up]
        return up
    every = [(a, b) for a in range(120) for b in range(a) if blocks == 1 or block[a] != block[b]]
    links = [(a, b) for a, b in every if 100 * len(both := np.intersect1d(sets[a], sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - len(both))]
    got = list(lsh_forest.linked(root, block, sets, percent))
    assert set(map(frozenset, got)) <= set(map(frozenset, links))
    assert joined(got) == joined(links) and len(got) == 60 - len(set(joined(links)))


def test_units_are_whole_wherever_batches_are_cut():
    rows = [(r, 0, u, n) for r in (5, 7) for u in (0, 1) for n in range(r)]
    for cut in (1, 3, 100):
        batches = [pa.RecordBatch.from_pylist([dict(zip(("region", "lower", "upper", "node"), x)) for x in rows[k:k + cut]]) for k in range(0, len(rows), cut)]
        got = [u.column("node").to_pylist() for u in lsh_forest._units(iter([batches[0].slice(0, 0), *batches]))]
        assert got == [list(range(n)) for n in (5, 5, 7, 7)]
