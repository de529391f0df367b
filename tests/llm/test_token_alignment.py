"""Alignment against both tokenizer libraries on whole texts, group by group and link by link."""

import hashlib
from collections import Counter

import pytest

from tickloom.llm import token_alignment as ta

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def encoders():
    import sentencepiece
    from tokenizers import Tokenizer
    a_path, b_path = ta.vocabularies()
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    byte = {letter: i for i, letter in enumerate(ta.byte_letters())}
    spell_a = lambda i: bytes([byte[c] for c in a.id_to_token(i)])
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return (lambda t: [(i, spell_a(i)) for i in a.encode(" " + t, add_special_tokens=False).ids]), (lambda t: [(i, spell_b(i)) for i in b.encode(t)])


def by_hand(texts):
    cut_a, cut_b = encoders()
    docs = []
    for t in texts:
        a, b = (cut_a(t), cut_b(t)) if t else ([], [])
        spelling = (" " + (t or "")).encode()
        if b"".join(x for _, x in a) != spelling or b"".join(x for _, x in b) != spelling:
            docs.append(([], [], [], []))
            continue
        ends_a, ends_b = {}, {}
        for ends, ids in ((ends_a, a), (ends_b, b)):
            at = 0
            for i, x in ids:
                at += len(x)
                ends[at] = i
        groups, links, own = [], [], ([], [])
        for end in sorted(set(ends_a) | set(ends_b)):
            for ends, ids in zip((ends_a, ends_b), own):
                ids += [ends[end]] if end in ends else []
            if end in ends_a and end in ends_b:
                groups.append(own)
                links.append((ends_a[end], ends_b[end]))
                own = ([], [])
        docs.append((a, b, groups, links))
    count = Counter(x for d in docs for x in d[3])
    highest = {}
    for (_, b), n in count.items():
        highest[b] = max(highest.get(b, 0), n)
    out = []
    for a, b, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(count[x] == highest[x[1]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


ODD = ["a  b", " lead", "trail ", "tab\tin word", "line\n\nline", "end\n", "\n", " ", "  ", "a▁b", "▁", "<|endoftext|> <s> </s> <unk> <0x41>", "don't it's",
       "x y", "\x1c z", "a \tb", "日本語 テキスト", "😀 ok 😀", "a\n b", "é é", "\x00 nul \x00", "0123 4567", "ﬁ ①", "a\r\nb c", "."]


@pytest.mark.parametrize("share", [0.0, ta.PAIR_SHARE, 0.01, 1.0])
def test_rows_against_whole_texts(spark, rows, docs, share):
    """From all pairs broadcast to all pairs joined: the same counts."""
    want = by_hand([t if t is None or len(t) < 100_000 else "" for _, t, _ in rows] + ODD)
    table = docs.filter("doc_id is null or length(text) < 100000 or text is null").select("doc_id", "text").union(
        spark.createDataFrame([(i, "") for i, t, _ in rows if t and len(t) >= 100_000] + [(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in ta.aligned(table.repartition(3), share=share).collect()}
    assert got == dict(zip([i for i, _, _ in rows] + [1000 + i for i in range(len(ODD))], want))


def test_groups_ids_and_emptied_memory(spark, rows, monkeypatch):
    own = [(None, t) for t in ODD[:12]] + [(3, t) for _, t, _ in rows if t and len(t) < 5000] + [(4, "é" * 200_000 + " tail")]
    table = spark.createDataFrame([(*r, 0, "x") for r in own], "doc_id int, text string, n_a long, task string").repartition(2)
    got = ta.aligned(table, with_groups=True).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == sorted(by_hand([t for _, t in own]))
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in got if r["n_a"])
    # What a worker forgets it learns again.
    monkeypatch.setattr(ta, "REMEMBERED", 3)
    chunks, calls = ta.Chunks(*ta.vocabularies()), []
    for text in ("one two three four", "five six\nseven", "one two"):
        flat, bounds, spelt = chunks.group([text, ""], lambda: calls.append(len(chunks.known)))
        assert spelt.tolist() == [True, False]
    assert calls == [4] and len(chunks.known) == 5


def test_vector_counts_only_foreseen_links(spark):
    table = spark.createDataFrame([(1, "the the the"), (2, "the zzqxj")], "doc_id long, text string")
    vector, pairs = ta.link_counts(table, ta.vocabularies())
    chunks = ta.Chunks(*ta.vocabularies())
    the = chunks.encode_a(" the")
    assert len(the) == 1 and vector[the[0]] == 4
    assert all(chunks.same[r["pair"] // ta.WIDE] != r["pair"] % ta.WIDE for r in pairs.collect())


def test_empty_table(spark):
    assert ta.aligned(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_on_the_given_table(spark):
    from tickloom.llm import queries
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op11_token_alignment(spark, sf).collect()}
    assert got == dict(zip([i for i, _ in docs], by_hand([t for _, t in docs])))
