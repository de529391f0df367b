"""Benchmark decontamination by winnowing.

Of every ``WINDOW`` consecutive hashes of ``GRAM`` words the leftmost smallest is kept; a shared run of
``GRAM + WINDOW - 1`` words therefore shares a kept hash. Fingerprints of documents and items are
joined, and a hit is extended word by word to both sides; where it reaches ``SPAN`` words, all of
them are hit. Items shorter than ``SPAN`` are one window each and are joined by the hash of their
whole sequence, of at most nine lengths, in the same pass over the documents.

Each document is read once. Beside its fingerprints it sends one row for itself, so its count of words
needs no join back, and rows are told apart by a number given in that pass.

The item side is broadcast while its fingerprints fit ``BROADCAST_ROWS``; beyond, Spark joins the
two sides by shuffling fingerprints, each with the words around it.

Defined results: null and empty texts have no words, are never hit and hit nothing; repeated items
count each under its own id, repeated and null document ids row by row; null item ids are not listed. All
words of a text lie in one row as hashes, eight bytes a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm import stats
from tickloom.llm.store import let, written

SPAN, GRAM = 10, 5
WINDOW = SPAN - GRAM + 1
REACH = SPAN - GRAM
BROADCAST_ROWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_hashes(text: Column) -> Column:
    """Hashes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z only."""
    text = F.coalesce(text, F.lit(""))
    # Without bytes beyond ASCII the plain function lower-cases the same letters.
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    cut = F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    return F.transform(cut, lambda w: F.xxhash64(w))


def hashed(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys``, word hashes ``h`` and gram hashes ``g`` of every row."""
    return rows.select(*keys, word_hashes(F.col("text")).alias("h")).select(
        *keys, "h", stats.gram_hashes(F.col("h"), GRAM).alias("g"))


def windows(rows: DataFrame, keys: list[str], lengths: list[int] = ()) -> DataFrame:
    """``keys``, place ``p``, span ``n``, hash ``f`` and the words ``c`` from REACH before to REACH behind.

    Kept gram hashes have the span SPAN; with ``lengths``, every run of so many words has its own row as
    well. The first place of a row, or none, is always there, if only with a null hash.
    """
    # The outer form keeps Spark from testing the array's size in a pushed filter that would build it anew.
    spread = rows.select(*keys, "h", "g", F.posexplode_outer("h" if lengths else "g").alias("p", "_own"))
    f = F.get("g", F.col("p")) if lengths else F.col("_own")
    larger = lambda step: F.coalesce(F.get("g", F.col("p") + step) > f, F.lit(False)) if step < 0 else F.coalesce(
        F.get("g", F.col("p") + step) >= f, F.lit(False))

    def run(sign: int) -> Column:
        """How many neighbours in a row are larger on this side, WINDOW - 1 at most."""
        out = F
        for step in range(1, WINDOW):
            out = out.when(~larger(sign * step), F.lit(step - 1))
        return out.otherwise(F.lit(WINDOW - 1))

    around = F.array(*[F.get("h", F.col("p") + step) for step in range(-REACH, GRAM + REACH)]).alias("c")
    kept, always = f.isNotNull() & (run(-1) + run(1) >= WINDOW - 1), F.col("p").isNull() | (F.col("p") == 0)
    if not lengths:
        marked = spread.select(*keys, "h", "g", "p", "_own", kept.alias("_kept")).filter(F.col("_kept") | always)
        return marked.select(*keys, "p", F.lit(SPAN).alias("n"), F.when(F.col("_kept"), F.col("_own")).alias("f"), around)
    runs = [F.when(F.col("p") + n <= F.size("h"), F.struct(F.lit(n).alias("n"), F.xxhash64(F.array(*[
        F.get("h", F.col("p") + j) for j in range(n)])).alias("f"))) for n in lengths]
    # No lambda after the first explode, and the arrays left behind before the second: rows stay small.
    each = F.array(F.when(kept, F.struct(F.lit(SPAN).alias("n"), f.alias("f"))), *runs)
    return spread.select(*keys, "p", around, each.alias("_each")).select(*keys, "p", "c", F.explode_outer("_each").alias("_w")).filter(
        F.col("_w").isNotNull() | always).select(*keys, "p", "_w.n", "_w.f", "c")


def item_windows(items: DataFrame) -> DataFrame:
    """Spans and hashes of all items, with the words around (``d``) where a hit must be extended; written."""
    own = hashed(items, "item_id").filter(F.size("h") > 0)
    long = windows(own.filter(F.size("h") >= SPAN), ["item_id"]).filter(F.col("f").isNotNull()).select("item_id", "n", "f", F.col("c").alias("d"))
    short = own.filter(F.size("h") < SPAN).select("item_id", F.size("h").alias("n"), F.xxhash64("h").alias("f"), F.lit(None).cast("array<bigint>").alias("d"))
    return written(long.unionByName(short), "winnow-items")


def _hit_range() -> tuple[Column, Column, Column]:
    """Whether a joined pair is a hit, and its range [lo, hi) of words."""
    equal = lambda j: F.coalesce(F.col("c")[j] == F.col("d")[j], F.lit(False))
    left = right = F
    for step in range(REACH):
        left = left.when(~equal(REACH - 1 - step), F.lit(step))
        right = right.when(~equal(REACH + GRAM + step), F.lit(step))
    left, right = left.otherwise(F.lit(REACH)), right.otherwise(F.lit(REACH))
    short = F.col("d").isNull()
    lo = F.when(short, F.col("p")).otherwise(F.col("p") - left)
    hi = F.when(short, F.col("p") + F.col("n")).otherwise(F.col("p") + GRAM + right)
    return F.col("item").isNotNull() & (hi - lo >= F.least("n", F.lit(SPAN))), lo, hi


def _checked(side: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side


def hits(docs: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` of every row at least once, with ``item_id``, ``lo``, ``hi`` of the word ranges that occur as windows of items,
    null where there is none. ``docs`` is hashed, ``items`` comes from ``item_windows``."""
    lengths = sorted(r[0] for r in items.filter(F.col("n") < SPAN).select("n").distinct().collect())  # nine at most
    # Without a hash a row meets nothing; a hash of its own keeps such rows from one join partition.
    found = windows(docs, keys, lengths).withColumns({
        "_f": F.coalesce("f", F.xxhash64(F.lit("none"), *keys)), "_n": F.when(F.col("f").isNull(), 0).otherwise(F.col("n"))})
    side = _checked(items.select(F.col("n").alias("_n"), F.col("f").alias("_f"), F.struct("item_id").alias("item"), "d"), items.count())
    joined = found.join(side, ["_n", "_f"], "left")
    hit, lo, hi = _hit_range()
    return joined.select(*keys, hit.alias("hit"), "item", lo.alias("lo"), hi.alias("hi")).select(
        *keys, F.when(F.col("hit"), F.col("item.item_id")).alias("item_id"),
        F.when(F.col("hit"), F.struct("lo", "hi")).alias("range"))


def union_length(ranges: Column) -> Column:
    """Length of the union of sorted (lo, hi) pairs."""
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(x["hi"] - F.greatest(x["lo"], acc["end"]), F.lit(0))).alias("n"),
        F.greatest(acc["end"], x["hi"]).alias("end"))
    return F.aggregate(ranges, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"])


def leak_table(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Counts, items and verdict of every row of ``docs``, one by one."""
    # One pass gives number, words and fingerprints of a row, so the number needs to hold within a task's output alone.
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    keyed = hashed(numbered, "row", "doc_id").withColumn("n_words", F.size("h").cast("long"))
    found = hits(keyed, item_windows(benchmark), ["row", "doc_id", "n_words"])
    per_row = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_set("range").alias("_ranges"),
        F.collect_set(F.col("item_id").cast("string")).alias("_items"))
    listed = per_row.select(
        "doc_id", "n_words", union_length(F.sort_array("_ranges")).cast("long").alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.array_join(F.sort_array("_items"), ",").alias("_list"))
    return listed.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.col("_list").cast("binary"), 256).alias("items_sha256"),
                         (F.col("n_hit") > 0).alias("contaminated"))


def leaking_ids(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id`` of rows with a hit; null ids are not named."""
    # Asked of the finished rows: a filter on single hits would be pushed below the hashes and build them again.
    return leak_table(docs, benchmark).filter("contaminated and doc_id is not null").select("doc_id").distinct()
