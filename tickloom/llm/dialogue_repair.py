"""Conversation structure repair by weighted interval parsing.

A conversation should read ``(s?(ua)+)?`` in the first letters of its roles. Edits: keep a row (0), give it the
role user or assistant (1), delete it (2), insert an empty row (5); a truncated row that stays costs 5
more; blank and repeated rows must go. The grammar in Chomsky normal form has one symbol ``[p q]`` per pair
of places in that pattern and the rules ``[p q] -> [p r] [r q]``; a row is an edit, the empty span derives
insertions (the closure). The cell of a span holds for every symbol the smallest (cost, audit), audit being
the initials of the edits. Symbols name the places at both ends, so any one split of a span gives its
cell, and spans are combined in pairs, bottom-up by length: work grows with rows, not their cube.
Two audits of equal cost over the same rows are never prefixes of each other (the longer would have
paid for an insertion more), so the smallest parts make the smallest whole.

Rows are dealt by range over (conversation, turn, role, digest), so a conversation of any length is spread
over tasks; each task parses its runs, and the runs of a conversation are merged sixteen at a time. Only
the last step, the hash over a whole repaired conversation, reads a conversation in one task, as a
stream: SHA-256 has no parallel form. An audit is one value and must fit in a string.

Defined results: a null turn comes first; null roles and texts are one space; rows that share a turn are
taken by role, then by the digest of the text; equal rows are repeats of the first; null conversation
ids are one conversation; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.store import written
from tickloom.session import ship_package

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
WORD = r"[^\x20\x09-\x0D]"
FAN = 16
# Places of the pattern: begin, after s, after u, after a. A whole conversation ends at begin or after a.
_BEGIN, _S, _U, _A = range(4)
_STEPS = {"s": [(_BEGIN, _S)], "u": [(_BEGIN, _U), (_S, _U), (_A, _U)], "a": [(_U, _A)]}
_EMPTY = (None,) * 16
#: Cells of a span: (cost, audit) or None at 4 * p + q.
Cells = tuple


def _with(cells: Iterable[tuple[int, int, int, str]]) -> Cells:
    out = list(_EMPTY)
    for p, q, cost, audit in cells:
        if out[4 * p + q] is None or (cost, audit) < out[4 * p + q]:
            out[4 * p + q] = (cost, audit)
    return tuple(out)


def combine(x: Cells, y: Cells) -> Cells:
    """Cells of two neighbouring spans together."""
    out = []
    for p in (0, 4, 8, 12):
        row = [(r, v) for r, v in enumerate(x[p:p + 4]) if v is not None]
        for q in range(4):
            best = None
            for r, v in row:
                w = y[4 * r + q]
                if w is not None and (best is None or v[0] + w[0] <= best[0]):
                    both = (v[0] + w[0], v[1] + w[1])
                    best = both if best is None or both < best else best
            out.append(best)
    return tuple(out)


def _closure() -> Cells:
    """The empty span: nothing, or inserted rows up to the same place."""
    one = _with([(p, p, 0, "") for p in range(4)] + [(p, q, INSERT, "I") for p, q in _STEPS["u"] + _STEPS["a"]])
    return combine(one, one)


@lru_cache(None)
def leaf(kind: str) -> Cells:
    """Cells of one row. ``kind``: d must go; s, u, a, x by first letter of the role, upper-case if truncated."""
    cells = [(p, p, DELETE, "D") for p in range(4)]
    if kind != "d":
        extra = TRUNCATED if kind.isupper() else 0
        cells += [(p, q, KEEP + extra, "K") for p, q in _STEPS.get(kind.lower(), [])]
        cells += [(p, q, REROLE + extra, "R") for p, q in _STEPS["u"] + _STEPS["a"]]
    return combine(combine(_closure(), _with(cells)), _closure())


def _pairs(spans: list[Cells]) -> list[Cells]:
    return [combine(*spans[i:i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]


@lru_cache(1 << 15)
def _short(kinds: str) -> Cells:
    spans = [leaf(k) for k in kinds]
    while len(spans) > 1:
        spans = _pairs(spans)
    return spans[0]


def parse(kinds: str) -> Cells:
    """Cells of a run of rows, bottom-up by span length."""
    spans = [_short(kinds[i:i + 8]) for i in range(0, len(kinds), 8)] or [_closure()]
    while len(spans) > 1:
        spans = _pairs(spans)
    return spans[0]


def cheapest(cells: Cells) -> tuple[int, str]:
    return min(v for v in (cells[_BEGIN], cells[_A]) if v is not None)


def damaged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows after the set damage by ``crc32(conv_id:turn) % 20``, and the ids of all conversations."""
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(say("conv_id"), F.lit(":"), say("turn")).cast("binary")) % 20
    read = rows.select("conv_id", "turn", say("role").alias("role"), say("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1)))
    kept = read.filter("code <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
    return kept, rows.select("conv_id")


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def _plain(rows: DataFrame) -> DataFrame:
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select("conv_id", "turn", say("role").alias("role"), say("text").alias("text"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Every row as its place (``part``, ``idx``) in the order of all conversations, without its text."""
    last = F.regexp_extract("text", rf"({WORD})[\x20\x09-\x0D]*$", 1)
    light = _plain(rows).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role", F.md5(F.col("text").cast("binary")).alias("digest"),
        (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"), F.monotonically_increasing_id().alias("_salt"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "_salt"]  # the salt parts even equal rows
    dealt = light.repartitionByRange(*order).sortWithinPartitions(*order).drop("_salt")

    def number(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            places = pa.array(range(at, at + batch.num_rows), pa.int64())
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([part] * batch.num_rows, pa.int32()), places, *batch.columns],
                                             ["part", "idx", *batch.schema.names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    return written(dealt.mapInArrow(number, "part int, idx long, " + kinds), "dialogue-order")


_SUMMARY = ("part int, conv_id {id}, blank long, duplicate long, truncated long, illegal long, head string, tail string, "
            "low long, high long, turns long, costs array<long>, audits array<string>")


class _Run:
    """Rows of one conversation in one task, in order."""

    def __init__(self, conv):
        self.conv, self.kinds, self.initials, self.turns = conv, [], [], []
        self.blank = self.duplicate = self.truncated = 0

    def add(self, turn, initial, blank, cut, first):
        fault = "blank" if blank else "duplicate" if not first else "truncated" if cut else None
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        self.kinds.append(initial if fault is None else initial.upper() if fault == "truncated" else "d")
        self.initials.append(initial)
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)

    def summary(self, part) -> dict:
        text = "".join(self.initials)
        return {"part": part, "conv_id": self.conv, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
                "illegal": sum(text[i:i + 2] not in ("su", "ua", "au") for i in range(len(text) - 1)), "head": text[0], "tail": text[-1],
                "low": min(self.turns, default=None), "high": max(self.turns, default=None), "turns": len(self.turns),
                **_columns(parse("".join(self.kinds)))}


def _columns(cells: Cells) -> dict:
    return {"costs": [None if v is None else v[0] for v in cells], "audits": [None if v is None else v[1] for v in cells]}


def _cells(row: dict) -> Cells:
    return tuple(None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"]))


def _joined(rows: list[dict], part: int) -> dict:
    """Summaries of neighbouring runs as one."""
    spans, out = [_cells(r) for r in rows], dict(rows[0])
    while len(spans) > 1:
        spans = _pairs(spans)
    for r in rows[1:]:
        for c in ("blank", "duplicate", "truncated"):
            out[c] += r[c]
        out["illegal"] += r["illegal"] + (out["tail"] + r["head"] not in ("su", "ua", "au"))
        out["turns"] += r["turns"] - (out["high"] is not None and out["high"] == r["low"])
        out["low"] = r["low"] if out["low"] is None else out["low"]
        out["high"] = out["high"] if r["high"] is None else r["high"]
        out["tail"] = r["tail"]
    return out | {"part": part} | _columns(spans[0])


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded letters."""
    held, letters = [], 0
    for r in rows:
        held.append(r)
        letters += 200 + sum(len(a or "") for a in r.get("audits") or ())
        if letters > size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, letters = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _summaries(order: DataFrame, id_type: str) -> DataFrame:
    """One summary per conversation and task of ``order``."""
    first = (order.filter("not blank").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("part", "idx")).alias("f"))
             .select("f.part", "f.idx", F.lit(True).alias("mark")))
    own = order.select("part", "idx", "conv_id", "turn", _initial(F.col("role")).alias("initial"), "blank", "cut", F.lit(False).alias("mark"))
    # A mark goes before the row that it says is the first of its kind.
    both = own.unionByName(first, allowMissingColumns=True).repartition("part").sortWithinPartitions("part", "idx", F.desc("mark"))
    schema = _arrow(_SUMMARY.format(id=id_type), order.sparkSession)

    def runs(batches):
        run, at, marked = None, None, None
        for batch in batches:
            for part, idx, conv, turn, initial, blank, cut, mark in zip(*(c.to_pylist() for c in batch.columns)):
                if mark:
                    marked = (part, idx)
                    continue
                if run is None or run.conv != conv or at != part:
                    if run is not None:
                        yield run.summary(at)
                    run, at = _Run(conv), part
                run.add(turn, initial, blank, cut, marked == (part, idx))
        if run is not None:
            yield run.summary(at)

    return both.mapInArrow(lambda batches: _batched(runs(batches), schema), _SUMMARY.format(id=id_type))


def _arrow(ddl: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


def _merged(summaries: DataFrame, id_type: str) -> DataFrame:
    """FAN neighbouring summaries of a conversation as one."""
    ddl = _SUMMARY.format(id=id_type)
    schema = _arrow(ddl, summaries.sparkSession)

    def groups(batches):
        held = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (held[0]["conv_id"] != row["conv_id"] or held[0]["part"] // FAN != row["part"] // FAN):
                    yield _joined(held, held[0]["part"] // FAN)
                    held = []
                held.append(row)
        if held:
            yield _joined(held, held[0]["part"] // FAN)

    dealt = summaries.repartition("conv_id", F.floor(F.col("part") / FAN)).sortWithinPartitions("conv_id", "part")
    return dealt.mapInArrow(lambda batches: _batched(groups(batches), schema), ddl)


class _Writer:
    """Applies an audit to the rows of a conversation as they come."""

    def __init__(self, audit: str):
        self.audit, self.at = audit, 0
        self.odd = sum(map(audit.count, "KRI")) % 2
        self.done = 0

    def _role(self, own: str | None) -> str:
        place = self.done - self.odd
        self.done += 1
        return own if own is not None else ("user", "assistant")[place % 2]

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield self._role(None), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._role(role if edit == "K" else None), text


class _Digest:
    def __init__(self):
        self.hash, self.empty = hashlib.sha256(), True

    def add(self, role: str, text: str) -> None:
        self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.empty = False


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _streamed(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, str]:
    """For each conversation its verdict (kind 0), then its rows in order (kind 1); ids alone (kind 2) come last."""
    id_type = rows.schema["conv_id"].dataType.simpleString()
    order = _ordered(rows)
    summaries = _summaries(order, id_type)
    parts, level = (order.agg(F.max("part")).first()[0] or 0) + 1, 0
    while level == 0 or parts > 1:
        summaries, parts, level = _merged(summaries, id_type), -(-parts // FAN), level + 1
    span = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    # Both cells always exist: all rows can go, and two rows can be inserted.
    best = F.array_min(F.array(*[F.struct(F.col("costs")[k].alias("cost"), F.col("audits")[k].alias("audit")) for k in (_BEGIN, _A)]))
    verdicts = summaries.select("conv_id", F.lit(0).alias("kind"), span.alias("gaps"), "blank", "duplicate", "truncated", "illegal", best.alias("v")).select(
        "conv_id", "kind", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("v.cost").alias("cost"), F.col("v.audit").alias("text"))
    texts = _plain(rows).select("conv_id", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "role", "text",
                                F.md5(F.col("text").cast("binary")).alias("digest"))
    bare = ids.select("conv_id", F.lit(2).alias("kind"))
    every = verdicts.unionByName(texts, allowMissingColumns=True).unionByName(bare, allowMissingColumns=True)
    dealt = every.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "digest")
    return dealt.select("conv_id", "kind", "role", "text", *_COUNTS), id_type


def _conversations(batches, begin, row, end):
    """Calls ``begin`` at each new conversation, ``row`` for each repaired row, ``end`` after the last."""
    held, conv, writer = False, None, None

    def finish():
        if writer is not None:
            for piece in writer.inserted():
                yield from row(*piece)
        yield from end()

    for batch in batches:
        for values in zip(*(c.to_pylist() for c in batch.columns)):
            own, kind, role, text = values[:4]
            if not held or own != conv:
                if held:
                    yield from finish()
                held, conv, writer = True, own, None
                begin(own)
            if kind == 0:
                writer = _Writer(text)
                begin(own, dict(zip(_COUNTS, values[4:])) | {"audit": text})
            elif kind == 1:
                for piece in writer.row(role, text):
                    yield from row(*piece)
    if held:
        yield from finish()


def verdicts(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Per conversation its faults, ``cost``, ``audit`` and the hash of the repaired rows (``role:text`` joined by newlines).

    ``rows`` has conv_id, turn, role, text; conversations named only in ``ids`` have no rows: zeros and an empty audit.
    """
    ship_package(rows.sparkSession)
    stream, id_type = _streamed(rows, rows.select("conv_id").limit(0) if ids is None else ids)
    ddl = f"conv_id {id_type}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
    schema = _arrow(ddl, rows.sparkSession)

    def run(batches):
        state = {}

        def begin(conv, found=None):
            state["out"] = {"conv_id": conv} | (found or dict.fromkeys(_COUNTS, 0) | {"audit": ""})
            state["digest"] = _Digest()

        def row(role, text):
            state["digest"].add(role, text)
            return ()

        def end():
            yield state["out"] | {"repaired_sha256": state["digest"].hash.hexdigest()}

        return _batched(_conversations(batches, begin, row, end), schema)

    return stream.mapInArrow(run, ddl)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id``, ``place`` from 0, ``role``, ``text``."""
    ship_package(rows.sparkSession)
    stream, id_type = _streamed(rows, rows.select("conv_id").limit(0))
    ddl = f"conv_id {id_type}, place long, role string, text string"
    schema = _arrow(ddl, rows.sparkSession)

    def run(batches):
        state = {}

        def begin(conv, found=None):
            state.update(conv=conv, place=-1)

        def row(role, text):
            state["place"] += 1
            yield {"conv_id": state["conv"], "place": state["place"], "role": role, "text": text}

        def pieces():
            held, size = [], 0
            for r in _conversations(batches, begin, row, lambda: ()):
                held.append(r)
                size += 100 + len(r["text"])
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)

        return pieces()

    return stream.mapInArrow(run, ddl)
