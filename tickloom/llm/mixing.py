"""Mixing sources to target weights by systematic sampling.

A source's documents stand in one order: by size class, then by a digest of the id. Every document
of a source is expected ``target / source size`` times; the running sum of these, moved by one
random offset, emits a document once per whole number it crosses. The size classes spread each
offset over short and long documents, so taken words stay near the target. Of ``DRAWS`` seeded
offsets the one nearest the target is used.

Ranks come from counts per (source, class, digest prefix) and a row number inside such a bin: no
window holds a source. Defined results: null texts have size 0; a null source comes last and is a
source like any other; null or repeated ids are ranked by their digest and stay separate rows; a
source without words has target 0 and takes nothing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm import stats
from tickloom.llm.store import same_join, written

SEED = "mix-1"
DRAWS = 16
MOST = 3
#: Size classes per doubling.
STEPS = 8


def unit(digest: Column) -> Column:
    """A number in [0, 1) from the first eight hex digits."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sized: DataFrame) -> DataFrame:
    """One row per source: size, target. ``sized`` has ``source`` and ``size``.

    Shares follow the weights; what exceeds a source's limit goes to the others by weight. Sorted by
    limit per weight, a source is full exactly if its limit lies below its share of what is left.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    ranked = Window.orderBy(F.col("source").isNull(), F.col("source"))
    per = per.withColumn("weight", (F.row_number().over(ranked) - 1) % 3 + 1).withColumn("limit", MOST * F.col("source_size"))
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"))
    per = per.withColumn("full", F.col("limit") * F.col("weight_left").cast("double") < F.col("weight") * F.col("left").cast("double"))
    first_open = lambda c: F.first(F.when(~F.col("full"), F.col(c)), ignorenulls=True).over(
        filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    open_left, open_weight = first_open("left"), first_open("weight_left")
    return per.select(
        "source", "source_size", "docs",
        F.when(F.col("full"), F.col("limit").cast("double"))
        .otherwise(F.least(open_left.cast("double") * F.col("weight") / open_weight, F.col("limit").cast("double"))).alias("target"))


def size_class(size: Column) -> Column:
    """Classes of eight per doubling, exact in integers of the size's leading bits."""
    octave = F.floor(F.log2(size.cast("double") + 1.0)).cast("int")
    return (octave * STEPS + F.floor(((size + 1).cast("double") / F.pow(F.lit(2.0), octave.cast("double")) - 1.0) * STEPS).cast("int")).cast("int")


def ranked(sized: DataFrame) -> DataFrame:
    """``sized`` with ``place``, the 1-based rank inside its source."""
    keyed = sized.withColumns({"_digest": F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
                               "_class": size_class(F.col("size"))}).withColumn("_bin", F.substring("_digest", 1, 2))
    keys = ["source", "_class", "_bin"]
    bins = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    upto = lambda *part: Window.partitionBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    inner = bins.withColumn("_inner", F.coalesce(F.sum("_n").over(upto("source", "_class").orderBy("_bin")), F.lit(0)))
    classes = bins.groupBy("source", "_class").agg(F.sum("_n").alias("_n"))
    outer = classes.select("source", "_class", F.coalesce(F.sum("_n").over(upto("source").orderBy("_class")), F.lit(0)).alias("_outer"))
    starts = same_join(inner, outer, ["source", "_class"]).select(*keys, (F.col("_inner") + F.col("_outer")).alias("_start"))
    inside = keyed.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy("_digest", "doc_id", "size")))
    return same_join(inside, starts, keys).select(*sized.columns, (F.col("_start") + F.col("_at")).cast("long").alias("place"))


def copies(place: Column, each: Column, offset: Column) -> Column:
    return (F.floor(place.cast("double") * each + offset) - F.floor((place - 1).cast("double") * each + offset)).cast("long")


def mixed(sized: DataFrame, draws: int = DRAWS) -> DataFrame:
    """Every row of ``sized`` with ``source_size``, ``target`` and ``copies``."""
    joined = written(
        same_join(ranked(sized), source_targets(sized), ["source"])
        .select(*sized.columns, "place", "source_size", "target",
                F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("each")), "mix-ranked")
    offsets = [unit(F.md5(F.concat(F.lit(f"{SEED}-{j}-"), F.coalesce(F.col("source"), F.lit(""))))) for j in range(draws)]
    sums = joined.groupBy("source").agg(
        F.max("target").alias("_goal"),
        *[F.sum(F.col("size") * copies(F.col("place"), F.col("each"), offsets[j])).alias(f"_s{j}") for j in range(draws)])
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"_s{j}") - F.col("_goal")).alias("gap"), F.lit(j).alias("draw"))
                                    for j in range(draws)]))
    chosen = sums.select("source", nearest["draw"].alias("draw"))
    chosen = chosen.select("source", F.array(*offsets)[F.col("draw")].alias("offset"))
    return same_join(joined, chosen, ["source"]).select(
        *sized.columns, "source_size", "target", copies(F.col("place"), F.col("each"), F.col("offset")).alias("copies"))


def mix_table(docs: DataFrame) -> DataFrame:
    sized = written(docs.select("doc_id", "source", stats.word_count(F.col("text")).alias("size")), "mix-sizes")
    return mixed(sized).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
