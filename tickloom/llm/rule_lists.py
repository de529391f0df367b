"""Quality rules by learned decision lists.

Sequential covering: grow a conjunction of thresholds against labelled statistics, prune it on
rows it was not grown on, take what it covers out, and go on. The ordered rules become one
conditional column expression.

Defined results: null and empty texts have zero counts and fail the base rule. Without labelled
rows of both classes no rule is learned and the base rule alone decides. Repeated documents are
judged one by one; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm import stats
from tickloom.llm.store import bounded_sample, written

Condition = tuple[str, str, float]
#: Labelled rows that a list is fitted on at most.
SAMPLE = 20_000
MIN_PRECISION, MIN_COVER, MAX_CONDITIONS, MAX_RULES = 0.9, 5, 4, 12


def _covers(rule: list[Condition], x: dict[str, np.ndarray]) -> np.ndarray:
    mask = np.ones(len(next(iter(x.values()))), bool)
    for name, sign, cut in rule:
        mask &= x[name] >= cut if sign == ">=" else x[name] < cut
    return mask


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, weight: np.ndarray) -> list[Condition]:
    """Add the threshold with the best information gain until no good row is covered."""
    rule: list[Condition] = []
    mask = weight.copy()
    while len(rule) < MAX_CONDITIONS:
        p, n = (mask & bad).sum(), (mask & ~bad).sum()
        if not p or not n:
            break
        base, best = np.log2(p / (p + n)), (0.0, None)
        for name, values in x.items():
            for cut in np.unique(np.quantile(values[mask], np.linspace(0.02, 0.98, 49))):
                above = values >= cut
                for sign, side in ((">=", above), ("<", ~above)):
                    cp, cn = (mask & side & bad).sum(), (mask & side & ~bad).sum()
                    if cp >= MIN_COVER and (gain := cp * (np.log2(cp / (cp + cn)) - base)) > best[0] + 1e-9:
                        best = (gain, (name, sign, float(cut)))
        if best[1] is None:
            break
        rule.append(best[1])
        mask = mask & _covers(rule[-1:], x)
    return rule


def _prune(rule: list[Condition], x: dict[str, np.ndarray], bad: np.ndarray, mask: np.ndarray) -> list[Condition]:
    def worth(r: list[Condition]) -> tuple[float, int]:
        hit = _covers(r, x) & mask
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        return ((p - n) / (p + n) if p + n else -1.0, -len(r))

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 7) -> list[list[Condition]]:
    """Ordered conjunctions that mark bad rows; the default is to keep."""
    if not len(bad) or bad.all() or not bad.any():
        return []
    grow = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < MAX_RULES and (left & grow & bad).sum() >= MIN_COVER:
        rule = _grow(x, bad, left & grow)
        if not rule:
            break
        rule = _prune(rule, x, bad, left & ~grow)
        hit = _covers(rule, x) & left
        if (hit & bad).sum() < MIN_COVER or (hit & bad).sum() < MIN_PRECISION * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def as_column(rules: list[list[Condition]]) -> Column:
    """True where no rule fires, as one ordered conditional."""
    by_name, verdict = stats.features(), F
    for rule in rules:
        test = F.lit(True)
        for name, sign, cut in rule:
            test = test & (by_name[name] >= F.lit(cut) if sign == ">=" else by_name[name] < F.lit(cut))
        verdict = verdict.when(test, F.lit(False))
    return verdict.otherwise(F.lit(True)) if rules else F.lit(True)


def fit(counted: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[Condition]]:
    """Learn from rows of ``labels`` (doc_id, quality) outside the held-out quarter."""
    known = labels.select("doc_id", "quality").filter(
        F.col("quality").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2))
    by_name = stats.features()
    rows = bounded_sample(
        counted.join(known, "doc_id").select("doc_id", *[c.alias(n) for n, c in by_name.items()], "quality"),
        "doc_id", sample)
    rows.sort(key=lambda r: tuple(r))
    x = {n: np.array([r[n] for r in rows], float) for n in by_name}
    return learn_list(x, np.array([r["quality"] == 0 for r in rows], bool))


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every document."""
    counted = written(stats.text_stats(docs, ["doc_id"]), "rule-stats")
    keep = as_column(fit(counted, labels, sample))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & keep)
