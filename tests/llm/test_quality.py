"""Rule lists, rule ensemble, leaks, personal data, licences, losses."""

import collections
import hashlib
import math
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import by_id, prose
from tickloom.llm import license_digests, loss_difference, personal_data, rule_ensemble, rule_lists, stats, tokens, winnowing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts_of(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    twice = {p for k in range(len(w) - 4) if grams[tuple(w[k:k + 5])] > 1 for p in range(k, k + 5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice))


def test_counts_and_base_rule(docs, labels, rows):
    got = by_id(rule_lists.judge(docs, labels), *stats.COUNTS[:5], "base_failed", "kept")
    for i, t, _ in rows:
        c = counts_of(t)
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        assert got[i][:6] == (*c, failed)
        assert not (failed and got[i][6])


def test_rule_list_finds_planted_rule():
    rng = np.random.default_rng(3)
    x = {"a": rng.random(3000), "b": rng.random(3000)}
    bad = (x["a"] > 0.8) & (x["b"] < 0.3)
    rules = rule_lists.learn_list(x, bad)
    caught = np.zeros(3000, bool)
    for r in rules:
        caught |= rule_lists._covers(r, x)
    assert (caught & bad).sum() > 0.9 * bad.sum() and (caught & ~bad).sum() < 0.02 * 3000
    assert rule_lists.learn_list(x, np.zeros(3000, bool)) == []


def test_rule_ensemble_finds_planted_rule():
    rng = np.random.default_rng(4)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.4)).astype(float)
    bias, rules = rule_ensemble.fit_rows(x[:3000], y[:3000], ["a", "b", "c"])
    z = bias + sum(w * rule_ensemble._fires([r], x[3000:], ["a", "b", "c"])[:, 0] for r, w in rules)
    assert ((z > 0) == y[3000:]).mean() > 0.97
    assert len(rules) < 150


def test_scores_are_defined_everywhere(docs, labels, spark):
    got = by_id(rule_ensemble.score(docs, labels), "score", "predicted", "held_out")
    assert len(got) == 23 and all(0 <= s <= 1 and p == int(s >= 0.7) for s, p, _ in got.values())
    none = labels.filter("false")
    assert {r["score"] for r in rule_ensemble.score(docs, none).collect()} == {0.5}
    assert rule_ensemble.score(docs.filter("false"), labels).collect() == []


def exact_leaks(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    windows = collections.defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").translate(low))
        for k in range(max(len(w) - 9, 1) if w else 0):
            windows[tuple(w[k:k + 10])].add(i)
    out = {}
    for i, t, _ in rows:
        w, hit, found = word.findall((t or "").translate(low)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out[i] = (len(w), len(hit), len(found), sha, bool(hit))
    return out


def test_leaks(spark, docs, rows, monkeypatch):
    items = [(1, prose(3, 40)), (2, " ".join(prose(1, 120).split(" ")[30:44]).upper()), (3, "one TWO three"), (4, None), (5, ""),
             (6, prose(1, 9)), (7, "again and again it goes on again and again it"), (12, "wörds äöü"), (13, prose(99, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    small = [r for r in rows if r[0] != 20]
    few = docs.filter("doc_id <> 20")
    assert by_id(winnowing.leak_table(few, bench), *columns) == exact_leaks(small, items)
    monkeypatch.setattr(winnowing, "BROADCAST_ROWS", 0)
    assert by_id(winnowing.leak_table(few, bench), *columns) == exact_leaks(small, items)
    assert not any(r["contaminated"] for r in winnowing.leak_table(few, bench.filter("false")).collect())


@pytest.mark.parametrize("short", [True, False])
@pytest.mark.parametrize("rows_broadcast", [500_000, 0])
def test_leaks_row_by_row(spark, monkeypatch, short, rows_broadcast):
    """Repeated and null ids are rows of their own; long texts, clashing columns, empty tables."""
    monkeypatch.setattr(winnowing, "BROADCAST_ROWS", rows_broadcast)
    items = [(1, prose(41, 30)), (1, prose(42, 12)), (None, prose(43, 15)), (7, prose(41, 30))] + ([(8, "zz top"), (9, prose(44, 4))] if short else [])
    own = [(1, prose(41, 12)), (1, prose(41, 24)), (1, "clean words"), (None, prose(41, 30)), (None, None), (2, ""), (2, "a zz TOP b zz top"), (3, prose(43, 15)),
           (3, prose(43, 15)), (4, prose(50, 60_000) + " " + prose(42, 12) + " " + prose(51, 40_000)), (None, prose(44, 4)), (5, "...")]
    docs = spark.createDataFrame([(*r, 1, "x", 0.5) for r in own], "doc_id long, text string, row long, item_id string, f double").repartition(3)
    bench = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, d string")
    got = winnowing.leak_table(docs, bench).collect()
    want = exact_leaks([(k, t, None) for k, (_, t) in enumerate(own)], [(None if i is None else i, t) for i, t in items])
    # A null item hits, and is not named.
    want = [(own[k][0], n, hit, *listed(own[k][1], items), leak) for k, (n, hit, _, _, leak) in want.items()]
    assert sorted(map(repr, (tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in got))) == sorted(map(repr, want))
    assert winnowing.leak_table(docs.filter("false"), bench).collect() == []
    assert {r[0] for r in winnowing.leaking_ids(docs, bench).collect()} == {w[0] for w in want if w[5] and w[0] is not None}


def listed(text, items):
    (found,) = exact_leaks([(0, text, None)], [(i, t) for i, t in items if i is not None]).values()
    return found[2], found[3]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return ([("email", *m.span()) for m in EMAIL.finditer(text)]
            + [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
            + [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and personal_data.luhn(digits(m))]
            + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15])


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@-+_ ()b2%3é04", max_size=60))
def test_base_spans_are_the_patterns(text):
    assert personal_data.base_spans(text) == plain_base(text)


def test_personal_data_table(docs, rows):
    got = by_id(personal_data.span_table(docs), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    for i, t, _ in rows:
        base = plain_base(t or "")
        assert got[i][:4] == tuple(sum(k == s[0] for s in base) for k in personal_data.KINDS)
        assert got[i][4] == personal_data.digest_of(base)
        assert {":".join(map(str, s)) for s in base} <= set(got[i][5].split(","))
    assert got[18][:4] == (1, 1, 0, 1) and got[19][2] == 1
    assert personal_data.span_table(docs.filter("false")).collect() == []


def test_reliabilities_follow_agreement():
    votes = [[1, 1, 1, 1, 0, 1], [-1, -1, -1, 0, -1, -1]]
    codes = np.array([personal_data._code(v) for v in votes])
    p = personal_data.reliabilities(np.zeros(2, int), codes, np.array([80, 20]))
    assert p[0] > 0.95 and p[1] < 0.05


def test_licences_against_sql(spark, docs):
    con = duckdb.connect()
    extra = [(100, "Intro\n  LICENSED under the apache licence version 2.0\nrest"), (101, "Copyright (c) 2020 X\nReleased under the MIT License."),
             (102, "Released under the MIT License"), (103, "Permission is not granted"), (None, "Licensed under CC BY 4.0.")]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    documents = table.toPandas().astype({"text": object})  # noqa: F841 - read by name below
    con.register("documents", documents.where(documents.notna(), None))
    want = sorted(con.execute(license_digests.oracle()).fetchall(), key=str)
    got = sorted(((None if r[0] is None else r[0], *r[1:]) for r in map(tuple, license_digests.scan(table).collect())), key=str)
    norm = lambda rows: sorted((str(None if a is None or a != a else int(a)), *r) for a, *r in rows)
    assert norm(got) == norm(want)
    assert {r[0]: r[3] for r in got if r[0] in (101, 102)} == {101: True, 102: True}


def test_losses_by_hand(spark, docs, labels):
    got = by_id(loss_difference.score(docs, labels), "n_words", "target_loss", "background_loss", "score")
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in docs.collect()}
    sides = [[texts[i] for i in texts if i % 2], list(texts.values())]
    counts = [(collections.Counter(w for t in s for w in t), collections.Counter(p for t in s for p in zip(t, t[1:]))) for s in sides]
    totals = [sum(c.values()) for c, _ in counts]
    vocab = {w for w, n in counts[1][0].items() if n >= loss_difference.SHARE * totals[1]}
    for i, w in texts.items():
        if not w:
            assert got[i] == (0, None, None, 0.0)
            continue
        for (uni, pairs), total, place in zip(counts, totals, (1, 2)):
            share = lambda x: (uni[x] + 1) / (total + len(vocab) + 1)  # noqa: E731,B023
            loss = -math.log(share(w[0])) - sum(
                math.log((pairs[a, b] + loss_difference.PRIOR * share(b)) / (uni[a] + loss_difference.PRIOR)) for a, b in zip(w, w[1:]))
            assert math.isclose(got[i][place], loss / len(w), rel_tol=1e-9)
    assert len(tokens.grams(np.empty(0, np.uint64), 5)) == 0


def test_losses_of_rare_words_are_their_own(spark):
    """However much else there is, words and bigrams of few documents keep their own counts."""
    texts = ["many words " * 600_000, "rare find here", "rare find there", "other thing here", "rare find here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = by_id(loss_difference.score(docs, labels), "target_loss", "background_loss")
    words = [t.split() for t in texts]
    for side, place in (([words[1], words[2]], 0), (words, 1)):
        uni = collections.Counter(w for t in side for w in t)
        pairs = collections.Counter(p for t in side for p in zip(t, t[1:]))
        total = sum(uni.values())
        share = lambda x: (uni[x] + 1) / (total + 8 + 1)  # noqa: E731,B023
        for i, w in enumerate(words):
            loss = -math.log(share(w[0])) - sum(
                math.log((pairs[p] + loss_difference.PRIOR * share(p[1])) / (uni[p[0]] + loss_difference.PRIOR)) for p in zip(w, w[1:]))
            assert math.isclose(got[i][place], loss / len(w), rel_tol=1e-9)


def test_losses_by_hand_when_most_words_move(spark, rows, labels, monkeypatch):
    """The same losses, bit by bit, wherever words and bigrams are priced, and with copies over many groups."""
    monkeypatch.setattr(tokens, "GROUP", 2000)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows * 2], "doc_id long, text string").repartition(5)
    near = loss_difference.score(docs, labels).collect()
    for share, bucket in ((2e-3, 500), (2e-2, 200), (2.0, 1000)):
        monkeypatch.setattr(loss_difference, "SHARE", share)
        monkeypatch.setattr(loss_difference, "PER_BUCKET", bucket)
        far = loss_difference.score(docs, labels).collect()
        key = lambda r: (r["doc_id"], r["n_words"])
        for x, y in zip(sorted(near, key=key), sorted(far, key=key), strict=True):
            assert key(x) == key(y)
            for c in ("target_loss", "background_loss"):
                assert x[c] == y[c] or math.isclose(x[c], y[c], rel_tol=1e-9)


def test_losses_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert loss_difference.score(docs, none).collect() == []
    one = spark.createDataFrame([(None, "a b a b"), (1, None), (1, "c")], "doc_id long, text string")
    got = loss_difference.score(one, none).collect()
    assert sorted(r["n_words"] for r in got) == [0, 1, 4] and all(r["score"] == 0.0 for r in got if r["n_words"] == 0)


def test_licence_files_and_wrapped_headers(spark):
    """Whole licence files as they are wrapped in repositories, with holders, and a header broken over lines."""
    import textwrap
    from pathlib import Path
    folder = Path(license_digests.__file__).parent / "licences"
    wrap = lambda t, n: "\n\n".join(textwrap.fill(p, n) for p in re.split(r"\n[ \t]*\n", t))
    rows, want = [], {}
    for path in sorted(folder.glob("*.txt")):
        text = path.read_text()
        for blank in ("<owner>", "<copyright holders>"):
            text = text.replace(f"<year> {blank}", "2021 A. Holder")
        for form in (text, *(wrap(text, n) for n in (60, 72, 100) if len(text) < 4000)):
            want[len(rows)] = (path.stem, True)
            rows.append((len(rows), form))
    want[len(rows)] = ("MPL-2.0", False)
    rows.append((len(rows), "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed with this\n"
                 "# file, You can obtain one at https://mozilla.org/MPL/2.0/.\n#\nx = 1\n"))
    want[len(rows)] = ("ISC", False)
    rows.append((len(rows), "Copyright (c) 2020 X\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\n"
                 "copyright notice and this permission notice appear in all copies.\n\nint x;\n"))
    want[len(rows)] = ("", False)
    rows.append((len(rows), "permission is\nnot granted"))
    assert by_id(license_digests.scan(spark.createDataFrame(rows, "doc_id long, text string")), "licenses", "whole_text") == want
    assert all(re.search(license_digests.MARK, t) for _, t in license_digests.NOTICES + license_digests.HEADERS + license_digests.bodies())
