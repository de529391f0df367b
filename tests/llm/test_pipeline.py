"""The whole pipeline against brute force, stage after stage, on planted documents."""

import collections
import math

import corpus_pipeline
from tests.llm.conftest import edited, prose
from tests.llm.test_copies import exact_components
from tests.llm.test_mixing import exact_targets
from tests.llm.test_quality import exact_leaks


def planted():
    """(id, text, source) of good prose, spam, near copies and leaked passages; ids of the spam; benchmark items."""
    items = [(i, prose(900 + i, 30)) for i in range(6)]
    texts, spam = [], set()
    for i in range(150):
        if i % 3 == 0:
            spam.add(i)
            texts.append("buy now $$$ !!! " * (20 + i % 7) + prose(i, 5))
        elif i % 10 == 1:
            texts.append(edited(prose(500, 120), [i % 110 + 5]))
        elif i % 10 == 4:
            leaked = " ".join(items[i % 6][1].split(" ")[4:16])
            texts.append(f"{prose(i, 50)} {leaked} {prose(i + 1000, 40)}")
        else:
            texts.append(prose(i, 70 + i % 60))
    return [(i, t, (None, "a", "b", "b", "b", "c")[i * 7 % 6]) for i, t in enumerate(texts)], spam, items


def survivors(rows, spam, items):
    left = [r for r in rows if r[0] not in spam]
    copies = exact_components(left)
    left = [r for r in left if copies[r[0]][2]]
    leaks = exact_leaks(left, items)
    return [r for r in left if not leaks[r[0]][-1]]


def test_run_is_the_brute_force_result(spark, tmp_path):
    rows, spam, items = planted()
    save = lambda data, schema, name: spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    save([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    save([(i, int(i not in spam), 0) for i, _, _ in rows], "doc_id long, quality int, toxic int", "labels")
    save(items, "item_id long, text string", "benchmark")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = survivors(rows, spam, items)
    assert 20 < len(left) < len(rows) - len(spam) - 10
    by_row = {i: (t, s) for i, t, s in rows}
    assert all((r["text"], r["source"]) == by_row[r["doc_id"]] for r in got)
    copies = collections.Counter(r["doc_id"] for r in got)
    assert set(copies) <= {r[0] for r in left}
    words = {i: len(t.split()) for i, t, _ in left}
    sizes = collections.Counter()
    for i, _, s in left:
        sizes[s] += words[i]
    targets, taken = exact_targets(sizes), collections.Counter()
    for i, _, s in left:
        each = targets[s] / sizes[s]
        assert math.floor(each + 1e-9) <= copies[i] <= math.ceil(each - 1e-9)
        taken[s] += copies[i] * words[i]
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= max(words[i] for i, _, x in left if x == s)

    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
