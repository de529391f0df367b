"""Comparing two copies of the same data: keys, rows, fields, factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import times, values
from tickloom.operators.keyed import keep_first


def outer_match(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Full outer join with both versions of each field and ``side``: both, left_only, right_only."""
    l = left.select(*keys, *[F.col(f).alias(f"{f}_left") for f in fields], F.lit(1).alias("_l"))
    r = right.select(*keys, *[F.col(f).alias(f"{f}_right") for f in fields], F.lit(1).alias("_r"))
    side = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    return l.join(r, keys, "full_outer").withColumn("side", side).drop("_l", "_r")


def key_sets(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Every key of either copy with ``side``; one shuffle over the stacked keys."""
    lay = lambda df, l, r: df.select(*keys, F.lit(l).alias("_l"), F.lit(r).alias("_r"))
    both = lay(left, 1, 0).unionByName(lay(right, 0, 1)).groupBy(*keys).agg(
        F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    side = F.when(F.col("_r") == 0, "left_only").when(F.col("_l") == 0, "right_only").otherwise("both")
    return both.select(*keys, side.alias("side"))


def common_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.select(*keys).intersect(right.select(*keys))


def keys_missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.select(*keys).subtract(right.select(*keys))


def restrict_to_seen(history: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """History rows whose (code, seq) the live copy holds as well."""
    return history.join(live.select(*keys).distinct(), keys, "left_semi")


def _cells(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    common = sorted(c for c in set(left.columns) & set(right.columns) if c.startswith(prefix))
    first = lambda df: keep_first(df.select(*keys, *common), keys, [F.col(c) for c in common])
    l = first(left).select(*keys, *[values.number(F.col(c)).alias(f"l_{c}") for c in common])
    r = first(right).select(*keys, *[values.number(F.col(c)).alias(f"r_{c}") for c in common])
    cells = F.array(*[F.struct(F.lit(c).alias("factor"), F.col(f"l_{c}").alias("lv"), F.col(f"r_{c}").alias("rv"))
                      for c in common])
    return l.join(r, keys).select(*keys, F.inline(cells))


def _close(atol: float, rtol: float) -> Column:
    """Within tolerance of the right value; two gaps agree, one gap does not."""
    lv, rv = F.col("lv"), F.col("rv")
    near = F.abs(lv - rv) <= F.lit(float(atol)) + F.lit(float(rtol)) * F.abs(rv)
    return F.when(lv.isNull() & rv.isNull(), True).otherwise(F.coalesce(near, F.lit(False)))


def factor_diff(left: DataFrame, right: DataFrame, keys: list[str], atol: float = 1e-8, rtol: float = 1e-5,
                prefix: str = "F_") -> DataFrame:
    """Per factor over common keys: cells, bad cells, largest absolute and relative difference among the bad."""
    lv, rv = F.col("lv"), F.col("rv")
    judged = _cells(left, right, keys, prefix).withColumn("_bad", ~_close(atol, rtol))
    absolute = F.when(F.col("_bad"), F.abs(lv - rv))
    relative = F.when(F.col("_bad"), F.abs(lv - rv) / F.nullif(F.greatest(F.abs(lv), F.abs(rv)), F.lit(0.0)))
    return judged.groupBy("factor").agg(
        F.count("*").alias("cells"), F.count_if("_bad").alias("bad_cells"),
        F.coalesce(F.max(absolute), F.lit(0.0)).alias("max_abs"),
        F.coalesce(F.max(relative), F.lit(0.0)).alias("max_rel"))


def worst_factors(diff: DataFrame, n: int = 20) -> DataFrame:
    """The report's list of worst columns; the limit is the report size."""
    return diff.where("bad_cells > 0").orderBy(F.desc("bad_cells"), "factor").limit(n)


def mismatch_samples(left: DataFrame, right: DataFrame, keys: list[str], n: int = 20,
                     atol: float = 1e-8, rtol: float = 1e-5, prefix: str = "F_") -> DataFrame:
    bad = _cells(left, right, keys, prefix).where(~_close(atol, rtol))
    return bad.orderBy("factor", *keys).limit(n)


def rows_before(df: DataFrame, second: int, time: str = "time") -> DataFrame:
    """Rows up to a second of the day, inclusive."""
    return df.where(times.micros_of_day(F.col(time)) <= F.lit(second * 1_000_000))


def store_diff(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], by: list[str],
               order: list, second: int | None = None) -> DataFrame:
    """Per ``by``: rows on one side only, common rows, and rows differing in each field.

    Both stores are cut at the same second and deduplicated the same way.
    """
    ready = lambda df: keep_first(df if second is None else rows_before(df, second), keys, order)
    matched = outer_match(ready(left), ready(right), keys, fields)
    is_both = F.col("side") == "both"
    differs = lambda f: F.count_if(is_both & ~F.col(f"{f}_left").eqNullSafe(F.col(f"{f}_right")))
    return matched.groupBy(*by).agg(
        F.count_if(is_both).alias("common"), F.count_if(F.col("side") == "left_only").alias("left_only"),
        F.count_if(F.col("side") == "right_only").alias("right_only"),
        *[differs(f).alias(f"{f}_diff") for f in fields])


def compare_copies(left: DataFrame, right: DataFrame, keys: list[str], atol: float = 1e-8,
                   rtol: float = 1e-5, prefix: str = "F_") -> DataFrame:
    """One verdict row for two factor tables: key counts, column counts, bad cells, equal or not."""
    sides = key_sets(left, right, keys).groupBy().agg(
        F.count_if(F.col("side") == "both").alias("common_keys"),
        F.count_if(F.col("side") == "left_only").alias("only_left"),
        F.count_if(F.col("side") == "right_only").alias("only_right"), F.lit(1).alias("_one"))
    diff = factor_diff(left, right, keys, atol, rtol, prefix).agg(
        F.coalesce(F.sum("bad_cells"), F.lit(0)).alias("bad_cells"),
        F.count_if(F.col("bad_cells") > 0).alias("bad_columns"),
        F.coalesce(F.max("max_abs"), F.lit(0.0)).alias("max_abs"), F.lit(1).alias("_one"))
    lc, rc = ({c for c in d.columns if c.startswith(prefix)} for d in (left, right))
    return sides.join(diff, "_one").drop("_one").withColumns({
        "only_left_columns": F.lit(len(lc - rc)), "only_right_columns": F.lit(len(rc - lc)),
        "equal": (F.col("bad_cells") == 0) & F.lit(lc == rc),
    })
