"""Text statistics as built-in expressions, shared by the rule learners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.store import let

SPACE = r"[\x20\x09-\x0D]+"
GRAM = 5


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; null and empty text have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def gram_hashes(hashed: Column, k: int) -> Column:
    """Hash of every ``k`` consecutive entries; empty when there are fewer."""
    return F.when(F.size(hashed) >= k, F.transform(
        F.sequence(F.lit(0), F.size(hashed) - k),
        lambda i: F.xxhash64(*[F.get(hashed, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def _covered(grams: Column, k: int) -> Column:
    """Words inside windows whose hash occurs twice: sort (hash, place), keep neighbours that agree,
    and add up the distance from each kept place to the next, ``k`` at most."""
    def agreeing(pairs: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(pairs, j)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(
            F.filter(pairs, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

    def spread(places: Column) -> Column:
        return F.aggregate(
            F.transform(places, lambda p, j: F.least(F.lit(k), F.coalesce(F.get(places, j + 1) - p, F.lit(k)))),
            F.lit(0), lambda total, step: total + step)

    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(
        let(pairs, lambda s: let(agreeing(s), spread)))


def repeated_words(word_array: Column, k: int = GRAM) -> Column:
    hashed = F.transform(word_array, lambda w: F.xxhash64(w))
    return let(hashed, lambda h: let(gram_hashes(h, k), lambda g: _covered(g, k))).cast("long")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_distinct_words", "n_upper", "n_marks", "n_digits")


def text_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` plus the counts in ``COUNTS`` (long) of the whole ``text``; null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    count = lambda pattern: F.regexp_count(F.col("_t"), F.lit(pattern)).cast("long")
    base = docs.select(*keep, text.alias("_t"))
    cut = base.select(
        *keep, "_t", words(F.col("_t")).alias("_w"),
        F.filter(F.split("_t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    return cut.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_w")).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct_words"),
        count(r"\p{Lu}").alias("n_upper"),
        count(r"[!?]").alias("n_marks"),
        count(r"[0-9]").alias("n_digits"))


def features(prefix: str = "") -> dict[str, Column]:
    """Ratios that a learner may threshold; all are defined for empty texts."""
    c = lambda name: F.col(prefix + name).cast("double")
    per = lambda a, b: c(a) / F.greatest(c(b), F.lit(1.0))
    return {
        "words": c("n_words"),
        "word_length": per("word_chars", "n_words"),
        "symbols": per("n_symbols", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"),
        "distinct": per("n_distinct_words", "n_words"),
        "upper": per("n_upper", "word_chars"),
        "marks": per("n_marks", "n_words"),
        "digits": per("n_digits", "word_chars"),
        "line_words": per("n_words", "n_lines"),
    }
