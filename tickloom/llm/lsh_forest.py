"""Near copies by an LSH forest over MinHash signatures.

A document's set is its distinct 5-word shingles. Signatures are cut into ``TREES`` sorted orders of
``DEPTH`` slots. In each order the documents that agree in the first ``SHALLOW`` slots form a
region; a region above ``REGION`` rows is cut again one slot deeper, and so on, and inside what
remains all are candidates, as are the ``NEXT`` rows on, whatever their depth. Rows on both sides
of a partition's edge are looked at once more together. Candidates whose signatures agree too
little for a similarity near the threshold are dropped (five deviations away), the others are
confirmed on full sets: first a forest of candidate pairs, then only pairs between different
components, so a group of copies costs about as many confirmations as it has members.

Regions above ``REGION`` rows that hold more than one component afterwards (templates that share
much text) get an exact pass (``exact_links``): the full sets of a region meet in one task, or in
one task per pair of blocks where it is large, and all pairs between its components are compared
there. A task gives back a forest of its links, so what leaves it grows with documents, not pairs.
Every pair that shares a region in any of the orders is thus looked at, whatever the region's size;
at the threshold itself two in a million share none.

Defined results: null, empty and blank texts have an empty set, link with nothing and are kept;
equal sets are one node however many documents share it; a null ``doc_id`` gets no component and is
kept; rows that repeat an id are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import tokens
from tickloom.llm.bitmaps import bitmap, holds
from tickloom.llm.components import components
from tickloom.llm.store import batches_of, written
from tickloom.session import ship_package

SHINGLE = 5
TREES, DEPTH, SHALLOW = 24, 8, 3
REGION, NEXT = 16, 3
SLOTS = TREES * DEPTH
#: Signatures of pairs at the threshold agree in 0.75 of 192 slots, with a deviation of 0.031.
LEAST_AGREEMENT = 0.59
ROWS_PER_TASK = 200_000
#: Rows of a batch that a Python worker holds: texts, full sets or pairs of full sets.
BATCH_ROWS = 1_000
#: Blocks of a region hold about so many shingles, and so many nodes at most; a task holds two blocks at a time.
BLOCK_SHINGLES, BLOCK_NODES = 1_000_000, 4_096
#: Shingles that a task of the exact pass is dealt, one pair of blocks after the other.
SHINGLES_PER_TASK = 8_000_000
_rng = np.random.default_rng(20_240_607)
_FLIP = _rng.integers(0, 1 << 32, SLOTS, dtype=np.uint32)
_TIMES = _rng.integers(0, 1 << 31, SLOTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes)."""
    for first, h, bounds in tokens.word_groups(texts, lower=True):
        for i in range(len(bounds) - 1):
            own = h[bounds[i]:bounds[i + 1]]
            yield first + i, np.unique(tokens.grams(own, min(SHINGLE, len(own)))) if len(own) else own


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash slots, 16 bits each."""
    v = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(v), 1024):
        np.minimum(out, ((v[at:at + 1024, None] ^ _FLIP) * _TIMES).min(axis=0), out=out)
    return (tokens.mix(out.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def node_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id``, set size, node (hash of the set) and signature of every document."""
    def run(batches):
        for batch in batches:
            n, nodes, sigs = [], [], []
            for _, s in shingle_sets(batch.column("text").to_pylist()):
                n.append(len(s))
                nodes.append(node_of(s) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_shingles": pa.array(n, pa.int64()),
                                   "node": pa.array(nodes, pa.int64()), "sig": pa.array(sigs, pa.binary())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, node bigint, sig binary")


def _entries(signed: DataFrame) -> DataFrame:
    """One sortable key per node and tree: tree, slots (high byte first), node, set size."""
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            out = []
            for node, n, sig in zip(*(batch.column(c).to_pylist() for c in ("node", "n_shingles", "sig"))):
                if node in seen:
                    continue
                seen.add(node)
                slots = np.frombuffer(sig, np.uint16).reshape(TREES, DEPTH).astype(">u2")
                keys = np.zeros((TREES, 29), np.uint8)
                keys[:, 0] = np.arange(TREES)
                keys[:, 1:17] = slots.view(np.uint8).reshape(TREES, 16)
                keys[:, 17:25] = np.frombuffer((node + (1 << 63)).to_bytes(8, "big"), np.uint8)
                keys[:, 25:29] = np.frombuffer(int(n).to_bytes(4, "big"), np.uint8)
                out.extend(k.tobytes() for k in keys)
            yield pa.record_batch({"key": pa.array(out, pa.binary())})

    return signed.filter("node is not null").select("node", "n_shingles", "sig").mapInArrow(run, "key binary")


def neighbours(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of nodes among sorted keys, each unsigned 29 bytes."""
    keys = keys[np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])] if len(keys) else keys
    n = len(keys)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    node = (keys[:, 17:25].copy().view(">u8").ravel() ^ np.uint64(1 << 63)).astype(np.uint64).view(np.int64)
    size = keys[:, 25:29].copy().view(">u4").ravel().astype(np.int64)
    differs = keys[1:, :17] != keys[:-1, :17]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), 17)  # bytes in common with the row before
    region = np.zeros((DEPTH + 1, n), np.int64)
    leaf, whole = np.full(n, -1), np.zeros(n, np.int64)
    for depth in range(SHALLOW, DEPTH + 1):
        ids = np.concatenate([[0], np.cumsum(shared < 1 + 2 * depth)])
        if depth == SHALLOW:
            whole = ids
        small = np.bincount(ids)[ids] <= REGION
        region[depth] = ids
        leaf = np.where((leaf < 0) & small, depth, leaf)
    left, right = [], []
    for step in range(1, min(REGION, n)):
        i, j = np.arange(n - step), np.arange(step, n)
        same = (leaf[i] >= 0) & (leaf[i] == leaf[j]) & (region[np.maximum(leaf[i], 0), i] == region[np.maximum(leaf[i], 0), j])
        if step <= NEXT:
            same |= whole[i] == whole[j]
        same &= 4 * np.minimum(size[i], size[j]) >= 3 * np.maximum(size[i], size[j])
        left.append(node[i[same]])
        right.append(node[j[same]])
    a, b = np.concatenate(left), np.concatenate(right)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0)
    return pairs[:, 0], pairs[:, 1]


def _pairs_of(sorted_keys: DataFrame, edges: int) -> DataFrame:
    """Pairs of each partition, and its outermost ``edges`` keys on either side."""
    def run(batches):
        held = [k for batch in batches for k in batch.column("key").to_pylist()]
        keys = np.frombuffer(b"".join(held), np.uint8).reshape(-1, 29)
        a, b = neighbours(keys)
        rim = list(dict.fromkeys(held[:edges] + held[-edges:])) if edges else []
        none = [None] * len(rim)
        yield pa.record_batch({"a": pa.array([*a.tolist(), *none], pa.int64()), "b": pa.array([*b.tolist(), *none], pa.int64()),
                               "key": pa.array([*[None] * len(a), *rim], pa.binary())})

    return sorted_keys.mapInArrow(run, "a bigint, b bigint, key binary")


def candidates(keys: DataFrame) -> DataFrame:
    """Distinct candidate pairs ``a`` < ``b`` of nodes from all sorted orders.

    The keys at the edges of partitions are sorted and cut again, until one task holds them all: no
    region loses a pair to where it happened to be cut, and every round is some thousand times smaller.
    """
    parallel, found = keys.sparkSession.sparkContext.defaultParallelism, None
    tasks = max(parallel, -(-keys.count() // ROWS_PER_TASK))
    while True:
        edges = 2 * REGION if tasks > 1 else 0
        cut = keys.coalesce(1) if tasks == 1 else keys.repartitionByRange(tasks, "key")
        out = written(_pairs_of(cut.sortWithinPartitions("key"), edges), "forest-pairs")
        pairs = out.filter("a is not null").select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        if tasks == 1:
            return found.distinct()
        keys = out.filter("key is not null").select("key")
        tasks = max(1, -(-keys.count() // ROWS_PER_TASK))


def agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs with the share of equal signature slots, where it allows the threshold. A slot counts with its low byte."""
    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SLOTS) for c in ("sig_a", "sig_b"))
            near = (x == y).mean(axis=1)
            keep = near >= LEAST_AGREEMENT
            yield pa.record_batch({c: pa.array(batch.column(c).to_numpy()[keep]) for c in ("a", "b")} | {"near": pa.array(near[keep])})

    small = lambda end: nodes.select(F.col("node").alias(end), F.col("sig").alias(f"sig_{end}"))
    return pairs.join(small("a"), "a").join(small("b"), "b").mapInArrow(run, "a bigint, b bigint, near double")


def _packed(shingles: np.ndarray) -> bytes:
    """The upper 48 bits of each hash."""
    return (shingles >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def full_sets(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """``node``, ``shingles`` of documents whose id the bitmap may hold; one row per node and task."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            rows, out = batch.filter(pa.array(holds(shared.value, ids))), {}
            for _, s in shingle_sets(rows.column("text").to_pylist()):
                if len(s) and (node := node_of(s)) not in seen:
                    seen.add(node)
                    out[node] = _packed(s)
            yield pa.record_batch({"node": pa.array(list(out), pa.int64()), "shingles": pa.array(list(out.values()), pa.binary())})

    return docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(run, "node bigint, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(*(batch.column(c) for c in ("set_a", "set_b"))):
                x, y = _unpacked(x.as_py()), _unpacked(y.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = np.array(keep, bool)
            yield pa.record_batch({c: pa.array(batch.column(c).to_numpy()[keep]) for c in ("a", "b")})

    end = lambda e: sets.select(F.col("node").alias(e), F.col("shingles").alias(f"set_{e}"))
    return pairs.select("a", "b").join(end("a"), "a").join(end("b"), "b").mapInArrow(run, "a bigint, b bigint")


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs between different components, with those components."""
    end = lambda e: labels.select(F.col("node").alias(e), F.col("root").alias(f"root_{e}"))
    out = pairs.join(end("a"), "a", "left").join(end("b"), "b", "left")
    out = out.withColumns({f"root_{e}": F.coalesce(f"root_{e}", e) for e in "ab"})
    return out.filter("root_a <> root_b")


def _crossing(near: DataFrame, tested: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``found`` and the confirmed pairs of ``near`` that join what ``found`` leaves apart."""
    for every in (False, True):
        left = written(_across(near.join(tested, ["a", "b"], "left_anti"), components(found)), "forest-left")
        if left.isEmpty():
            break
        pick = left if every else left.groupBy(F.least("root_a", "root_b").alias("_x"), F.greatest("root_a", "root_b").alias("_y")).agg(
            F.max_by(F.struct("a", "b"), "near").alias("p")).select("p.a", "p.b")
        pick = written(pick.select("a", "b"), "forest-pick")
        tested = tested.unionByName(pick)
        found = found.unionByName(written(confirmed(pick, sets, percent), "forest-links"))
    return found


def links(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Enough confirmed pairs to connect all that candidates connect; every pair left out is
    inside one component or fails on full sets."""
    first = near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(
        near.groupBy("b").agg(F.max_by("a", "near").alias("a")).select("a", "b")).distinct()
    tested = written(first, "forest-first")
    return _crossing(near, tested, written(confirmed(tested, sets, percent), "forest-links"), sets, percent)


def _regions(keys: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``region`` (tree and first ``SHALLOW`` slots), ``node`` and set size of every key, or of those in the
    regions ``wanted`` and of few others; no key of a large region is moved to one task."""
    shared = keys.sparkSession.sparkContext.broadcast(None if wanted is None else bitmap(wanted))

    def run(batches):
        for batch in batches:
            k = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.uint8).reshape(-1, 29)
            region = np.zeros((len(k), 8), np.uint8)
            region[:, 7 - 2 * SHALLOW:] = k[:, :1 + 2 * SHALLOW]
            node = (k[:, 17:25].copy().view(">u8").ravel() ^ np.uint64(1 << 63)).astype(np.uint64).view(np.int64)
            region = region.view(">i8").ravel().astype(np.int64)
            size = k[:, 25:29].copy().view(">u4").ravel().astype(np.int64)
            keep = np.ones(len(k), bool) if shared.value is None else holds(shared.value, region)
            yield pa.record_batch({"region": pa.array(region[keep]), "node": pa.array(node[keep]), "size": pa.array(size[keep])})

    return keys.mapInArrow(run, "region bigint, node bigint, size bigint")


def crowded(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """``region``, ``node``, ``root``, ``size`` of the nodes of all regions above ``REGION`` rows with more than one
    component, and the ``blocks`` that the region is cut into."""
    large = written(_regions(keys).groupBy("region").count().filter(F.col("count") > REGION).select("region"), "forest-large")
    # No rows of a region that is small: the forest has looked at all its pairs.
    held = _regions(keys, large).join(labels, "node", "left").select("region", "node", F.coalesce("root", "node").alias("root"), "size")
    held = written(held, "forest-held")
    mixed = held.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("sum"), F.min("root").alias("x"), F.max("root").alias("y"))
    blocks = F.ceil(F.greatest(F.col("sum") / BLOCK_SHINGLES, F.col("n") / BLOCK_NODES))
    mixed = mixed.filter((F.col("n") > REGION) & (F.col("x") < F.col("y"))).select("region", blocks.alias("blocks"))
    return held.join(mixed, "region").distinct()


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Neighbouring rows of one region and pair of blocks."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in ("region", "lower", "upper")], axis=1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for start, end in zip(cuts, cuts[1:]):
            if held and (key[start] != last).any():
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key[start]
    if held:
        yield pa.Table.from_batches(held)


def _parities(shingles: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One row of bits a set: whether an odd number of its shingles falls on each, about eight bits a shingle."""
    bits = 1 << min(max(int(8 * size.mean()).bit_length(), 8), 14)
    odd = np.zeros(len(size) * bits, np.uint8)
    np.add.at(odd, np.repeat(np.arange(len(size)) * bits, size) + (shingles & np.uint64(bits - 1)).astype(np.int64), 1)
    return np.packbits(odd & 1).view(np.uint64).reshape(len(size), -1)


def linked(root: np.ndarray, block: np.ndarray, sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of rows that join every two ``root`` which links between them join: all pairs of different roots are
    compared on full sets, those of different blocks if there are two. Sets are distinct hashes and not empty."""
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size, root, block = size[order], root[order].copy(), block[order]
    two = block.min() != block.max()
    values = np.concatenate([sets[i] for i in order])
    begin, bits = np.cumsum(size) - size, _parities(values, size)
    known, ids = np.unique(values, return_inverse=True)
    own = np.zeros(len(known), bool)
    until = np.searchsorted(size, 100 * size // percent, "right")
    for i in range(len(size)):
        j = np.arange(i + 1, until[i])
        j = j[(root[j] != root[i]) & (block[j] != block[i])] if two else j[root[j] != root[i]]
        # Two sets differ in as many shingles as their bits do, or in more.
        differ = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
        both = size[i] + size[j]
        j = j[both - differ >= 2 * -(-percent * both // (100 + percent))]
        if not len(j):
            continue
        mine = ids[begin[i]:begin[i] + size[i]]
        own[mine] = True
        at = np.cumsum(size[j]) - size[j]
        common = np.add.reduceat(own[ids[np.repeat(begin[j] - at, size[j]) + np.arange(size[j].sum())]], at, dtype=np.int64)
        own[mine] = False
        for k in j[100 * common >= percent * (size[i] + size[j] - common)].tolist():
            if root[k] != root[i]:
                root[root == root[k]] = root[i]
                yield int(order[i]), int(order[k])


def exact_links(crowd: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a`` < ``b`` that join all components which links inside a region of ``crowd`` join."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    rows = crowd.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("region", F.least("block", "other").alias("lower"), F.greatest("block", "other").alias("upper"), "block", "node", "root")
    shingles = crowd.agg(F.sum(F.col("size") * F.col("blocks"))).first()[0]
    tasks = max(crowd.sparkSession.sparkContext.defaultParallelism, -(-shingles // SHINGLES_PER_TASK))

    def run(batches):
        for unit in _units(batches):
            node, root, block = (unit.column(c).to_numpy() for c in ("node", "root", "block"))
            pairs = list(linked(root, block, [_unpacked(x) for x in unit.column("shingles").to_pylist()], percent))
            ends = np.sort(node[np.array(pairs, np.int64).reshape(-1, 2)], axis=1)
            yield pa.record_batch({"a": pa.array(ends[:, 0]), "b": pa.array(ends[:, 1])})

    unit = ["region", "lower", "upper"]
    return rows.join(sets, "node").repartition(tasks, *unit).sortWithinPartitions(*unit).mapInArrow(run, "a bigint, b bigint")


def _sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node``, ``shingles`` of the nodes of ``wanted``."""
    marked = bitmap(nodes.join(wanted, "node", "left_semi").select(F.xxhash64("first")))
    keyed = docs.select(F.xxhash64("doc_id").alias("doc_id"), "text")
    return written(full_sets(keyed, marked).join(wanted, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")), "forest-sets")


def near_copies(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` of every row of ``docs``."""
    if percent < 75:
        raise ValueError("candidates are made for 75 percent and more; below, links would be lost")
    ship_package(docs.sparkSession)
    with batches_of(docs.sparkSession, BATCH_ROWS):
        signed, nodes, labels = _grouped(docs, percent)
    smallest = (nodes.select("node", "first").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node")))
    lowest = smallest.groupBy("root").agg(F.min("first").alias("component_id"))
    by_node = smallest.join(lowest, "root").select("node", "component_id")
    out = signed.select("doc_id", "n_shingles", "node").join(by_node, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _grouped(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: signatures of all documents, their nodes, and the root of every linked node."""
    signed = written(signatures(docs), "forest-signed")
    nodes = written(signed.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("first"), F.first("sig").alias("sig")).mapInArrow(
            _low_bytes, f"node bigint, first {docs.schema['doc_id'].dataType.simpleString()}, sig binary"), "forest-nodes")
    keys = written(_entries(signed), "forest-keys")
    near = written(agreeing(candidates(keys), nodes), "forest-near")
    involved = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    sets = _sets_of(docs, nodes, involved)
    found = links(near, sets, percent)
    labels = components(found)
    crowd = written(crowded(keys, labels), "forest-crowd")
    if not crowd.isEmpty():
        more = written(exact_links(crowd, _sets_of(docs, nodes, crowd.select("node")), percent), "forest-exact")
        labels = components(found.unionByName(more))
    return signed, nodes, labels


def _low_bytes(batches):
    for batch in batches:
        sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, SLOTS).astype(np.uint8)
        yield pa.record_batch({"node": batch.column("node"), "first": batch.column("first"),
                               "sig": pa.array([s.tobytes() for s in sigs], pa.binary())})
