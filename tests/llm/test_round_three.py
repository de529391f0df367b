"""Losses: what a task gives back follows its documents, not its buckets."""

import math
from collections import defaultdict

import pyarrow as pa
import pytest

from tickloom.llm import loss_difference as ld


@pytest.mark.parametrize("sums", [1000, 7])
def test_sums_of_many_buckets_are_one_row_a_document(monkeypatch, sums):
    monkeypatch.setattr(ld, "SUMS", sums)
    texts = [" ".join(f"w{(i * j * 7) % 401}" for j in range(1, 60)) for i in range(1, 41)] * 2
    batch = pa.record_batch({"text": pa.array(texts), "target": pa.array([i % 2 for i in range(len(texts))])})
    frequent = ld.Frequent(pa.table({c: pa.array([], pa.int64()) for c in "ktb"}), pa.array([], pa.int64()).to_numpy(), [59 * 40, 59 * 80], 401)

    def sorted_rows(buckets):
        rows = sorted((row for g in ld.groups([batch]) for row in ld._moved(g, frequent, buckets)), key=lambda row: row["bucket"])
        return [pa.RecordBatch.from_pylist(rows[i:i + 9], ld._MOVED_SCHEMA) for i in range(0, len(rows), 9)]

    def total(buckets):
        out, n = defaultdict(lambda: [0, 0, 0, 0, 0]), 0
        for part in ld._summed(sorted_rows(buckets), frequent):
            for row in part.to_pylist():
                n += 1
                out[row["words"]] = [x + y for x, y in zip(out[row["words"]], (row[c] for c in ("n", "lt", "rt", "lb", "rb")))]
        return {w: (c, math.ldexp((t << 50) + rt, -50), math.ldexp((b << 50) + rb, -50)) for w, (c, t, rt, b, rb) in out.items()}, n

    one, rows = total(1)
    assert len(one) == len({tuple(t.split()) for t in texts}) and all(c == 59 for c, *_ in one.values())
    many, n = total(64)
    assert many.keys() == one.keys() and n >= rows
    if sums == 1000:
        assert n == len(one)  # before, a row for every document and bucket
    for w, (c, t, b) in one.items():
        assert many[w][0] == c and math.isclose(many[w][1], t, rel_tol=1e-12) and math.isclose(many[w][2], b, rel_tol=1e-12)
