"""Alignment of two tokenizers by byte offsets, with an identity-map fast path.

Every text is cut by both vocabularies; where a token of A and one of B end at the same byte, a group
ends, and the two tokens are linked. An array made once gives the B id with the same bytes for each A
id. Groups of one A and one B token that this array foresees are counted in a vector as long as the
vocabulary; only links of other groups become pairs and enter a shuffle.

Both vocabularies cut a text at a single blank or newline between words before they merge anything
(checked for B when it is loaded), so groups never cross one. Workers keep the groups of the chunks
between, emptied once ``REMEMBERED`` are held, and ask the tokenizers only for new ones.

A second pass looks the counts up: those of the vector and of pairs from ``PAIR_SHARE`` of all links on (at most
1 / share) are broadcast, rarer pairs are joined by a shuffle, per document and pair. Pairs are never
dropped: the table of pairs grows with the corpus. Where a count is looked up does not change it.

Defined results: null and empty texts, and texts whose tokens do not spell space + text in both
vocabularies, have no tokens: zeros and an empty digest; null and repeated ids are kept row by row; an
empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.store import written
from tickloom.llm.word_tokens import byte_letters
from tickloom.session import ship_package

PAIR_SHARE = 2e-6
REMEMBERED, LONG, GROUP = 400_000, 64, 1 << 20
#: A pair of ids as one number.
WIDE = 1 << 20
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def vocabularies() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_vocabulary(path: str):
    """Encoder of a byte-level vocabulary file without its special tokens, and the bytes of each id."""
    import public_tokenizers
    import tiktoken
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    special = {t["id"] for t in told["added_tokens"]}
    byte = {letter: b for b, letter in enumerate(byte_letters())}
    spelt = {i: bytes([byte[c] for c in token]) for token, i in told["model"]["vocab"].items() if i not in special}
    encoding = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in spelt.items()}, special_tokens={})
    return encoding.encode_ordinary, [spelt.get(i, b"") for i in range(max(spelt) + 1)]


def _piece_vocabulary(path: str):
    """Encoder of a piece vocabulary, and the bytes of each id."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelt, blank = [], None
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            spelt.append(bytes([int(piece[3:5], 16)]))
            continue
        if model.is_control(i) or model.is_unknown(i):
            spelt.append(b"\xff")  # in no text
            continue
        if "▁" in piece.lstrip("▁") or "\n" in piece:
            raise ValueError(f"piece {piece!r} crosses a blank or newline")
        blank = i if piece == "▁" else blank
        spelt.append(piece.replace("▁", " ").encode())

    def encode(chunks: list[str]) -> list[list[int]]:
        """A space comes before each text; it stands for the first one of a chunk, or is taken off again."""
        own = model.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        for c, ids in zip(chunks, own):
            if c[0] != " " and ids[:1] != [blank]:
                raise ValueError("the piece vocabulary puts no space before a text")
        return [ids if c[0] == " " else ids[1:] for c, ids in zip(chunks, own)]

    return encode, spelt


def identity_map(a: list[bytes], b: list[bytes], is_byte=lambda i: False) -> np.ndarray:
    """For each A id the B id with the same bytes, -1 where there is none; a piece goes before a bare byte."""
    same: dict[bytes, int] = {}
    for i, spelling in enumerate(b):
        if spelling not in same or is_byte(same[spelling]):
            same[spelling] = i
    return np.array([same.get(x, -1) if x else -1 for x in a], np.int64)


class Chunks:
    """Groups of the chunks a worker has met. Chunk ``i`` has the links ``bounds[i]:bounds[i + 1]``."""

    def __init__(self, a_path: str, b_path: str):
        self.encode_a, self.bytes_a = _byte_vocabulary(a_path)
        self.encode_b, self.bytes_b = _piece_vocabulary(b_path)
        self.size_a = np.array([len(x) for x in self.bytes_a])
        self.size_b = np.array([len(x) for x in self.bytes_b])
        import sentencepiece
        self.same = identity_map(self.bytes_a, self.bytes_b, sentencepiece.SentencePieceProcessor(model_file=b_path).is_byte)
        ids = max(len(self.bytes_a), len(self.bytes_b))
        written_out = [str(i).encode() for i in range(ids)]
        self.width = np.array([len(x) for x in written_out])
        most = int(self.width.max())
        self.digits = np.frombuffer(b"".join(x.ljust(most) for x in written_out), np.uint8).reshape(ids, most)
        self.clear()

    def clear(self) -> None:
        self.known: dict = {}
        self.texts: list[bytes] = []
        #: n_a, n_b, n_groups, not spelt alike, not to be cut at blanks alone.
        self.stat = np.empty((0, 5), np.int64)
        self.pairs, self.exact, self.bounds = np.empty(0, np.int64), np.empty(0, bool), np.zeros(1, np.int64)

    def learn(self, keys: list) -> None:
        """Groups of new chunks. A key is the chunk after its blank, or with its newline; or the chunk itself in a tuple."""
        raw = [k[0] if type(k) is tuple else k if k[:1] == "\n" else " " + k for k in keys]
        odd = [type(k) is str and not _regular(k) for k in keys]
        a = [self.encode_a(c) for c in raw]
        b = self.encode_b(raw)
        bad = [(spelling := c.encode("utf-8", "surrogatepass")) != b"".join([self.bytes_a[i] for i in x])
               or spelling != b"".join([self.bytes_b[i] for i in y]) for c, x, y in zip(raw, a, b)]
        n_a = np.array([0 if off else len(x) for x, off in zip(a, bad)])
        n_b = np.array([0 if off else len(y) for y, off in zip(b, bad)])
        ids_a = np.array([i for x, off in zip(a, bad) if not off for i in x], np.int64)
        ids_b = np.array([i for y, off in zip(b, bad) if not off for i in y], np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        at = np.searchsorted(ends_a, ends_b)
        last_b = np.flatnonzero(ends_a[at] == ends_b) if len(ends_b) else np.empty(0, np.int64)
        last_a, common = at[last_b], ends_b[last_b]
        in_a, in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        pa_, pb = ids_a[last_a], ids_b[last_b]
        per_chunk = np.cumsum(n_b)
        n_groups = np.diff(np.searchsorted(last_b, per_chunk, side="left"), prepend=0)
        # Tokens in the order they are written: those of A, then those of B, group by group.
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        start_a, start_b = last_a - in_a + 1, last_b - in_b + 1
        place_a = np.arange(len(ids_a)) + start_b[group_a]
        place_b = np.arange(len(ids_b)) + last_a[group_b] + 1
        ids, mark = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = ids_a, ids_b
        mark[place_a[start_a]] = ord(";")
        mark[place_b[start_b]] = ord("|")
        shown = np.concatenate([mark[:, None], self.digits[ids]], axis=1)
        text = shown[np.arange(shown.shape[1]) <= self.width[ids][:, None]].tobytes()
        cuts = np.concatenate([[0], np.cumsum(self.width[ids] + 1)])[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        self.known.update(zip(keys, range(len(self.known), len(self.known) + len(keys))))
        self.texts += [text[x + 1:y] for x, y in zip(cuts[:-1], cuts[1:])]
        self.stat = np.concatenate([self.stat, np.array([n_a, n_b, n_groups, bad, odd], np.int64).T])
        self.pairs = np.concatenate([self.pairs, pa_ * WIDE + pb])
        self.exact = np.concatenate([self.exact, (in_a == 1) & (in_b == 1) & (self.same[pa_] == pb)])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(n_groups)])

    def group(self, texts: list[str], emptied) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks of the texts one after the other, bounds of each text, and which texts have tokens.

        ``emptied`` is called before what is known is forgotten.
        """
        if len(self.known) > REMEMBERED:
            emptied()
            self.clear()
        keys = [t.replace("\n", " \n").split(" ") if t else [] for t in texts]
        self._learn_new(set().union(*keys))
        found = [list(map(self.known.__getitem__, k)) for k in keys]
        flat = np.array([i for f in found for i in f], np.int64)
        bounds = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
        odd = np.flatnonzero(_sums(self.stat[flat, 4], bounds) > 0).tolist()
        if odd:
            for i in odd:
                keys[i] = [(c,) for c in _CUT.split(" " + texts[i])]
            self._learn_new({k for i in odd for k in keys[i]})
            for i in odd:
                found[i] = list(map(self.known.__getitem__, keys[i]))
            flat = np.array([i for f in found for i in f], np.int64)
            bounds = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
        return flat, bounds, (_sums(self.stat[flat, 3], bounds) == 0) & (np.diff(bounds) > 0)

    def _learn_new(self, keys: set) -> None:
        if new := list(keys - self.known.keys()):
            self.learn(new)


def _regular(key: str) -> bool:
    """Neither begins nor ends with white space besides its own newline, so both vocabularies cut here."""
    own = key[1:] if key[:1] == "\n" else key
    return own != "" and not own[0].isspace() and not own[-1].isspace()


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(values)])
    return run[bounds[1:]] - run[bounds[:-1]]


_LOADED: dict[tuple[str, str], Chunks] = {}


def _loaded(a_path: str, b_path: str) -> Chunks:
    """The chunks of this worker process."""
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = Chunks(a_path, b_path)
    return _LOADED[a_path, b_path]


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive rows of about GROUP characters; a longer text is alone."""
    first, held, size = 0, [], 0
    for i, t in enumerate(batch.column("text").to_pylist()):
        t = t or ""
        if held and size + len(t) > GROUP:
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def link_counts(docs: DataFrame, paths: tuple[str, str]) -> tuple[np.ndarray, DataFrame]:
    """Corpus-wide counts: of foreseen links per A id (a vector), and of all other pairs (``pair``, ``n``)."""

    def run(batches):
        chunks = _loaded(*paths)
        vector, seen, out = np.zeros(len(chunks.same), np.int64), np.zeros(0, np.int64), []

        def flush():
            nonlocal vector, seen
            links = np.diff(chunks.bounds)[:len(seen)]
            times, upto = np.repeat(seen, links), int(chunks.bounds[len(seen)])
            pairs, exact = chunks.pairs[:upto], chunks.exact[:upto]
            vector += np.bincount(pairs[exact] // WIDE, times[exact], len(vector)).astype(np.int64)
            own, at = np.unique(pairs[~exact & (times > 0)], return_inverse=True)
            out.append((own, np.bincount(at, times[~exact & (times > 0)], len(own)).astype(np.int64)))
            seen = np.zeros(0, np.int64)

        def rows(kind, keys, n):
            return pa.record_batch({"foreseen": pa.array(np.full(len(keys), kind)), "pair": pa.array(keys), "n": pa.array(n)})

        for batch in batches:
            for _, texts in _groups(batch):
                flat, bounds, spelt = chunks.group(texts, flush)
                seen = np.pad(seen, (0, len(chunks.known) - len(seen)))
                seen += np.bincount(flat[np.repeat(spelt, np.diff(bounds))], minlength=len(seen))
            while out:
                yield rows(False, *out.pop())
        if len(seen):
            flush()
        while out:
            yield rows(False, *out.pop())
        ids = np.flatnonzero(vector)
        yield rows(True, ids, vector[ids])

    counted = written(docs.select("text").mapInArrow(run, "foreseen boolean, pair long, n long"), "alignment-counts")
    vector = np.zeros(len(_byte_vocabulary(paths[0])[1]), np.int64)
    # As many rows as the vocabulary of A at most.
    for i, n in counted.filter("foreseen").groupBy("pair").agg(F.sum("n")).collect():
        vector[i] = n
    return vector, written(counted.filter("not foreseen").groupBy("pair").agg(F.sum("n").alias("n")), "alignment-pairs")


class Counts:
    """What is looked up on the spot: the vector, the frequent pairs, and the highest count of each B id."""

    def __init__(self, vector: np.ndarray, same: np.ndarray, highest: np.ndarray, pairs: np.ndarray, counts: np.ndarray):
        for i in np.flatnonzero((vector > 0) & (same >= 0)):
            highest[same[i]] = max(highest[same[i]], vector[i])
        order = np.argsort(pairs)
        self.vector, self.same, self.highest, self.pairs, self.counts = vector, same, highest, pairs[order], counts[order]

    def look(self, pairs: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count of each link, whether it is the highest of its B id, and whether it is not held here."""
        n = np.where(exact, self.vector[pairs // WIDE], 0)
        other = np.flatnonzero(~exact)
        rare = np.zeros(len(pairs), bool)
        if len(other) and len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, pairs[other]), len(self.pairs) - 1)
            held = self.pairs[at] == pairs[other]
            n[other[held]] = self.counts[at[held]]
            rare[other[~held]] = True
        else:
            rare[other] = True
        return n, ~rare & (n == self.highest[pairs % WIDE]), rare


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None, share: float = PAIR_SHARE, with_groups: bool = False) -> DataFrame:
    """Per document its counts of tokens, groups and links, how well they agree with the corpus, and the digest
    of its groups (``a1,a2|b1;a3|b2,b3``), with the groups themselves if wanted."""
    ship_package(docs.sparkSession)
    paths = paths or vocabularies()
    sc = docs.sparkSession.sparkContext
    vector, pairs = link_counts(docs, paths)
    bytes_a, bytes_b = _byte_vocabulary(paths[0])[1], _piece_vocabulary(paths[1])[1]
    import sentencepiece
    same = identity_map(bytes_a, bytes_b, sentencepiece.SentencePieceProcessor(model_file=paths[1]).is_byte)
    highest = np.zeros(len(bytes_b), np.int64)
    # As many rows as the vocabulary of B at most.
    for b, n in pairs.groupBy((F.col("pair") % WIDE).alias("b")).agg(F.max("n")).collect():
        highest[b] = n
    total = int(vector.sum()) + (pairs.agg(F.sum("n")).first()[0] or 0)
    least = share * total
    often = pairs.filter(F.col("n") >= least).toArrow()  # 1 / share rows at most
    shared = sc.broadcast(Counts(vector, same, highest, *(often.column(c).to_numpy() for c in ("pair", "n"))))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = (f"task int, row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_best long, count_sum long, groups_sha256 string, "
           "rare array<struct<pair:long,n:long>>" + (", groups string" if with_groups else ""))

    def run(batches):
        chunks, counts, task, row = _loaded(*paths), shared.value, TaskContext.get().partitionId(), 0
        # Per chunk: n_a, n_b, n_groups, links that are best, sum of counts, rare links.
        table, rare = np.empty((0, 6), np.int64), np.empty(0, bool)

        def forget():
            nonlocal table, rare
            table, rare = table[:0], rare[:0]

        def catch_up():
            nonlocal table, rare
            if (done := len(table)) < len(chunks.known):
                lo = int(chunks.bounds[done])
                n, best, new = counts.look(chunks.pairs[lo:], chunks.exact[lo:])
                own = chunks.bounds[done:] - lo
                added = [chunks.stat[done:, 0], chunks.stat[done:, 1], chunks.stat[done:, 2], _sums(best, own), _sums(n, own), _sums(new, own)]
                table, rare = np.concatenate([table, np.array(added).T]), np.concatenate([rare, new])

        for batch in batches:
            for first, texts in _groups(batch):
                flat, bounds, spelt = chunks.group(texts, forget)
                catch_up()
                sums = [np.where(spelt, _sums(table[flat, c], bounds), 0) for c in range(5)]
                own = flat.tolist()
                shown = [b";".join([chunks.texts[i] for i in own[x:y]]) if ok else None
                         for x, y, ok in zip(bounds[:-1].tolist(), bounds[1:].tolist(), spelt.tolist())]
                at = np.flatnonzero((table[flat, 5] > 0) & np.repeat(spelt, np.diff(bounds)))
                doc = np.searchsorted(bounds, at, side="right") - 1
                n_links = np.diff(chunks.bounds)[flat[at]]
                link = np.repeat(chunks.bounds[flat[at]] - np.cumsum(n_links) + n_links, n_links) + np.arange(n_links.sum())
                doc, link = np.repeat(doc, n_links)[rare[link]], link[rare[link]]
                order = np.lexsort((chunks.pairs[link], doc))
                doc, pair = doc[order], chunks.pairs[link][order]
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])])) if len(doc) else np.empty(0, np.int64)
                ends = np.searchsorted(doc[new], np.arange(len(texts) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(pair[new]), pa.array(np.diff(new, append=len(doc)))], ["pair", "n"]))
                out = {"task": pa.array([task] * len(texts), pa.int32()), "row": pa.array(range(row, row + len(texts)), pa.int64()),
                       "doc_id": batch.column("doc_id").slice(first, len(texts)),
                       **{c: pa.array(v) for c, v in zip(("n_a", "n_b", "n_groups", "n_best", "count_sum"), sums)},
                       "groups_sha256": pa.array([hashlib.sha256(s).hexdigest() if s is not None else "" for s in shown]), "rare": lists}
                if with_groups:
                    out["groups"] = pa.array([(s or b"").decode() for s in shown], pa.string())
                row += len(texts)
                yield pa.record_batch(out)

    each = written(docs.select("doc_id", "text").mapInArrow(run, ddl), "alignment-documents")
    # Links of rare pairs: each document asks once per pair.
    ask = each.select("task", "row", F.explode("rare").alias("r")).select("task", "row", "r.pair", F.col("r.n").alias("times"))

    def judged(batches):
        for batch in batches:
            pair, n = (batch.column(c).to_numpy() for c in ("pair", "n"))
            yield pa.record_batch({"pair": batch.column("pair"), "n": batch.column("n"), "best": pa.array(n == shared.value.highest[pair % WIDE])})

    table = pairs.filter(F.col("n") < least).mapInArrow(judged, "pair long, n long, best boolean")
    more = ask.join(table, "pair").groupBy("task", "row").agg(
        F.sum(F.col("n") * F.col("times")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"))
    plus = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).cast("long").alias(c)
    return each.join(more, ["task", "row"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), plus("n_best", "_best"), plus("count_sum", "_sum"),
        "groups_sha256", *(["groups"] if with_groups else []))
