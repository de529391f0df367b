import datetime

import pytest

WORDS = "ash birch cedar dune elm fern grove heath iris juniper kelp larch moss nettle oak pine quartz reed sage thorn".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 2654435761 % 2**32
    for _ in range(n):
        x = (x * 1664525 + 1013904223) % 2**32
        out.append(WORDS[x >> 16 & 15] + str(x >> 20 & 63))
    return " ".join(out)


def edited(text: str, places: list[int]) -> str:
    words = text.split(" ")
    for p in places:
        words[p] = f"changed{p}"
    return " ".join(words)


@pytest.fixture(scope="session")
def rows():
    """Ids, texts and sources with nulls, empties, ties, copies, long and short texts."""
    base, long = prose(1, 120), prose(2, 6000)
    texts = [
        base, base, edited(base, [60]), edited(base, [5, 60]), edited(base, [3, 20, 50, 80, 110]), prose(3, 40), prose(4, 90),
        None, "", " \n\t ", "one", "one two three", "One two three", long, edited(long, [10, 3000]),
        prose(5, 30) + " " + " ".join(base.split(" ")[40:75]) + " " + prose(6, 30), "again and again it goes on " * 20,
        "Ünïcode wörds äöü " + prose(7, 20), "mail a.b+c@d.example.com, call +1 (555) 010-9999, at 10.20.30.40 or 300.1.1.1",
        "card 4111 1111 1111 1111 ok 4111 1111 1111 1112 not", "é" * 1_500_000 + " tail " + prose(8, 20),
        prose(9, 50), prose(9, 50)]
    return [(i, t, None if i % 7 == 3 else f"s{i % 4}") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows over several partitions, with columns whose names clash with those of the operators."""
    frame = [(i, t, "en", s, 0, 1, "x", datetime.date(2026, 1, 1)) for i, t, s in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, node string, shard date"
    return spark.createDataFrame(frame, schema).repartition(3, "doc_id")


@pytest.fixture(scope="session")
def labels(spark, rows):
    return spark.createDataFrame([(i, i % 2, 0) for i, _, _ in rows], "doc_id long, quality int, toxic int")


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}
