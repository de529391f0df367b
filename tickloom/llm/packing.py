"""Packing by shortest-pack-first over the length histogram.

Every text becomes token ids and one end id; longer ones are cut into full sequences and a rest. Only the
histogram of piece lengths (at most ``SIZE`` numbers) comes to the driver. Lengths are placed longest
first, each into the shortest packs that still have room; what is kept are patterns of lengths with
counts, never packs. Pieces are ranked within their length, and patterns are joined back to them by rank.

What room is left is closed by cuts: the shortest packs are taken apart and laid, as one stream of
tokens, into the gaps of the others (gaps below ``LEAST`` stay); what is left over forms sequences of
powers of two, which need no padding. Gaps and packs are groups of equal ones, so cuts are arithmetic.

Tokenised pieces are written once. Ranks are counts per task and length, added up, not a sort: no
length binds to one task, however many pieces have it. Ids move only for pieces that are cut, or where
the caller wants them.

Defined results: null and empty texts have the end id alone; null and repeated ids are kept row by row; an
empty table gives no rows. Extra columns are not read. A rerun gives the same patterns and lengths;
which of two pieces of one length comes first follows the order in which the table is read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm import word_tokens
from tickloom.llm.store import written
from tickloom.session import ship_package

SIZE, END, LEAST = 4096, 2, 32
#: Cut pieces up to this number find their ids by a broadcast of 30 bytes each, more by a shuffle.
BROADCAST_ROWS = 500_000


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def shortest_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns as (count, ((length, times), ...)) that hold every length of the histogram, longest first.

    Each length goes to the shortest open pack with room for it, as if one by one: all packs of one
    pattern at once, a new pack only where none has room.
    """
    # Open packs by tokens used; a pattern is a chain (length, times, the pattern before).
    heap: list[tuple[int, int]] = []
    packs: dict[int, tuple[int, tuple | None]] = {}
    made = 0

    def put(used: int, count: int, chain: tuple | None) -> None:
        nonlocal made
        packs[made] = (count, chain)
        heapq.heappush(heap, (used, made))
        made += 1

    def longer(chain: tuple | None, length: int, times: int = 1) -> tuple:
        return (length, chain[1] + times, chain[2]) if chain and chain[0] == length else (length, times, chain)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not heap or heap[0][0] + length > size:
                times = size // length
                if left >= times:
                    put(times * length, left // times, longer(None, length, times))
                if left % times:
                    put(left % times * length, 1, longer(None, length, left % times))
                break
            used, name = heapq.heappop(heap)
            count, chain = packs.pop(name)
            take = min(count, left)
            if count > take:
                put(used, count - take, chain)
            put(used + length, take, longer(chain, length))
            left -= take
    out = []
    for count, chain in packs.values():
        pattern = []
        while chain:
            pattern.append(chain[:2])
            chain = chain[2]
        out.append((count, tuple(reversed(pattern))))
    return sorted(out, key=lambda p: p[1], reverse=True)


def _padding(used: int, size: int) -> int:
    return 0 if used & (used - 1) == 0 else size - used


class Plan:
    """Where every rank of every length goes. All arrays have a few thousand entries, set by ``size`` alone."""

    def __init__(self, histogram: dict[int, int], size: int = SIZE, least: int = LEAST):
        self.size, self.base = size, 1 << 40
        groups = [[count, pattern, sum(n * t for n, t in pattern)] for count, pattern in shortest_first(histogram, size)]
        groups.sort(key=lambda g: g[2])
        # The shortest packs are taken apart, as many as the gaps of the others hold, and one more.
        gap = sum(c * _padding(u, size) for c, _, u in groups if _padding(u, size) >= least)
        apart, stream, kept = [], 0, []
        for count, pattern, used in groups:
            pad = _padding(used, size)
            n = 0
            if pad >= least and gap > stream:
                n = min(count, -(-(gap - stream) // size))
                apart.append((n, pattern, used))
                stream, gap = stream + n * used, gap - n * pad
            if count > n:
                kept.append((count - n, pattern, used))
        starts: list[tuple] = []
        taken = dict.fromkeys(histogram, 0)

        def place(count: int, pattern: tuple, used: int, first: int, cut: bool) -> None:
            offset = 0
            for length, times in pattern:
                starts.append((length * self.base + taken[length], first, times, offset, cut, used))
                taken[length] += count * times
                offset += length * times

        # (start in the stream, gap, first sequence, offset there) of the gaps, groups of equal ones.
        gaps, at, sequence = [], 0, 0
        for count, pattern, used in kept:
            place(count, pattern, used, sequence, False)
            pad = _padding(used, size)
            if pad >= least and at < stream:
                gaps.append((at, pad, sequence, used))
                at += pad * count
            sequence += count
        at = min(at, stream)
        for bit in reversed(range((stream - at).bit_length())):
            if (stream - at) >> bit & 1 and at < stream:
                gaps.append((at, 1 << bit, sequence, 0))
                at, sequence = at + (1 << bit), sequence + 1
        first = 0
        for count, pattern, used in apart:
            place(count, pattern, used, first, True)
            first += count * used
        self.sequences = sequence
        self.starts = np.array(sorted(starts), np.int64).reshape(-1, 6)
        self.gaps = np.array(gaps, np.int64).reshape(-1, 4)

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence and offset of each piece; or, where the last is true, its place in the stream to be cut."""
        key = length * self.base + rank
        row = self.starts[np.searchsorted(self.starts[:, 0], key, side="right") - 1]
        nth, copy = np.divmod(key - row[:, 0], row[:, 2])
        offset, cut = row[:, 3] + copy * length, row[:, 4] == 1
        return np.where(cut, row[:, 1] + nth * row[:, 5] + offset, row[:, 1] + nth), np.where(cut, 0, offset), cut

    def cuts(self, at: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(tokens before, length, sequence, offset) of the parts of a piece that begins at ``at`` of the stream."""
        done = 0
        while done < length:
            start, width, sequence, offset = self.gaps[np.searchsorted(self.gaps[:, 0], at + done, side="right") - 1].tolist()
            nth, inside = divmod(at + done - start, width)
            n = min(length - done, width - inside)
            yield done, n, sequence + nth, offset + inside
            done += n


_PIECE = "task int, length int, rank_here long, doc_id {id}, start long, doc_tokens long, ids_crc32 long, ids binary"
_BATCH_BYTES = 4 << 20


def _wide(raw: bytes, dtype: np.dtype) -> bytes:
    return np.frombuffer(raw, dtype).astype("<u4").tobytes()


def tokenised(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """Pieces of all documents, written: at most ``size`` ids each, numbered per task and length."""
    path = path or vocabulary()
    ship_package(docs.sparkSession)
    ddl = _PIECE.format(id=docs.schema["doc_id"].dataType.simpleString())

    def run(batches):
        words = word_tokens.loaded(path)
        width, last = words.dtype.itemsize, np.array([end], words.dtype).tobytes()
        task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            names = ["task", "length", "rank_here", "start", "doc_tokens", "ids_crc32", "ids"]
            rows, at, held = {c: [] for c in names}, [], 0

            def full():
                ids = batch.column("doc_id").take(pa.array(at, pa.int32()))
                return pa.record_batch({"task": pa.array([task] * len(at), pa.int32()), "length": pa.array(rows["length"], pa.int32()),
                                        "rank_here": pa.array(rows["rank_here"], pa.int64()), "doc_id": ids,
                                        **{c: pa.array(rows[c], pa.int64()) for c in names[3:6]}, "ids": pa.array(rows["ids"], pa.binary())})

            for i, ids in enumerate(words.encode(batch.column("text").to_pylist())):
                ids += last
                n = len(ids) // width
                for start in range(0, n, size):
                    own = ids[start * width:(start + size) * width]
                    length = len(own) // width
                    for c, v in zip(names[1:], (length, int(seen[length]), start, n, zlib.crc32(_wide(own, words.dtype)), own)):
                        rows[c].append(v)
                    at.append(i)
                    seen[length] += 1
                    held += len(own)
                    if held > _BATCH_BYTES:
                        yield full()
                        rows, at, held = {c: [] for c in names}, [], 0
            if at:
                yield full()

    return written(docs.select("doc_id", "text").mapInArrow(run, ddl), "packing-pieces")


def packed(docs: DataFrame, path: str | None = None, size: int = SIZE, least: int = LEAST, with_ids: bool = False) -> DataFrame:
    """Per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and ``ids`` if wanted
    (little-endian, two bytes an id up to 65,536 ids, else four)."""
    path = path or vocabulary()
    pieces = tokenised(docs, path, size)
    tallies = written(pieces.groupBy("task", "length").count(), "packing-tallies")
    # At most `size` rows.
    plan = Plan({r[0]: r[1] for r in tallies.groupBy("length").agg(F.sum("count")).collect()}, size, least)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tallies.select("task", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    light = pieces.drop("ids").join(offsets, ["task", "length"]).withColumn("rank", F.col("rank_here") + F.col("_before")).drop("_before")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"task int, whole int, rank_here long, doc_id {id_type}, start long, doc_tokens long, ids_crc32 long, part long, length long, sequence_id long, offset long"
    shared = docs.sparkSession.sparkContext.broadcast(plan)

    def place(batches):
        plan = shared.value
        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            length, rank = (col[n].to_numpy().astype(np.int64) for n in ("length", "rank"))
            to, offset, cut = plan.places(length, rank)
            take, part, n, seq, off, crc = [np.flatnonzero(~cut)], [np.zeros((~cut).sum(), np.int64)], [length[~cut]], [to[~cut]], [offset[~cut]], []
            parts = [(i, *p) for i in np.flatnonzero(cut).tolist() for p in plan.cuts(int(to[i]), int(length[i]))]
            if parts:
                for held, new in zip((take, part, n, seq, off), np.array(parts, np.int64).T):
                    held.append(new)
            take, part, n, seq, off = map(np.concatenate, (take, part, n, seq, off))
            own = {c: col[c].take(pa.array(take)) for c in ("task", "rank_here", "doc_id", "start", "doc_tokens")}
            # The checksum of a whole piece holds; that of a part is taken from its ids.
            crc = pa.array(col["ids_crc32"].to_numpy()[take], mask=n < length[take])
            yield pa.record_batch({"task": own["task"], "whole": pa.array(length[take].astype(np.int32)), "rank_here": own["rank_here"],
                                   "doc_id": own["doc_id"], "start": pa.array(own["start"].to_numpy() + part), "doc_tokens": own["doc_tokens"],
                                   "ids_crc32": crc, "part": pa.array(part), "length": pa.array(n), "sequence_id": pa.array(seq), "offset": pa.array(off)})

    order = ["task", "length", "rank", "rank_here", "doc_id", "start", "doc_tokens", "ids_crc32"]
    placed = written(light.select(*order).mapInArrow(place, ddl), "packing-places")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    source = pieces.select("task", F.col("length").alias("whole"), "rank_here", "ids")
    if with_ids:
        return _sliced(placed, source, path, ids=True).select(*columns, "ids")
    parts = placed.filter("ids_crc32 is null")
    if (n := parts.count()) == 0:
        return placed.select(*columns)
    few = n <= BROADCAST_ROWS
    return placed.filter("ids_crc32 is not null").select(*columns).unionByName(_sliced(F.broadcast(parts) if few else parts, source, path).select(*columns))


def _sliced(parts: DataFrame, source: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """Parts with the ids of their pieces, cut to size, and the checksum of what is left."""
    joined = source.join(parts, ["task", "whole", "rank_here"])
    names = [c for c in joined.columns if c not in ("ids", "ids_crc32")]
    ddl = ", ".join(f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in names) + ", ids_crc32 long" + (", ids binary" if ids else "")

    def run(batches):
        dtype = word_tokens.loaded(path).dtype
        for batch in batches:
            raw, part, n = (batch.column(c).to_pylist() for c in ("ids", "part", "length"))
            own = [r[p * dtype.itemsize:(p + k) * dtype.itemsize] for r, p, k in zip(raw, part, n)]
            out = {c: batch.column(c) for c in names} | {"ids_crc32": pa.array([zlib.crc32(_wide(r, dtype)) for r in own], pa.int64())}
            yield pa.record_batch(out | ({"ids": pa.array(own, pa.binary())} if ids else {}))

    return joined.select(*names, "ids").mapInArrow(run, ddl)
