"""Quality classifier: a sparse ensemble of rules.

Shallow trees are boosted on labelled statistics; every path from a root becomes a conjunction;
a lasso logistic fit leaves a weight on few of them; the weighted rules are compiled into one
column expression, so scoring is a projection.

Defined results: null and empty texts have zero statistics and a score like any other. With no
labelled rows, or one class only, the score is the (smoothed) share of label 1. Inputs are
statistics of the text alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm import stats
from tickloom.llm.store import bounded_sample, written

#: Labelled rows that the ensemble is fitted on at most.
SAMPLE = 20_000
TREES, DEPTH, LEAF, BINS, RATE, LASSO = 30, 3, 20, 32, 0.3, 2e-3
Rule = tuple[tuple[str, str, float], ...]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _split(codes: np.ndarray, rows: np.ndarray, grad: np.ndarray, hess: np.ndarray):
    """Best (gain, feature, bin) by histograms of gradient and curvature."""
    best, g, h = (1e-6, -1, -1), grad[rows], hess[rows]
    whole = g.sum() ** 2 / (h.sum() + 1)
    for f in range(codes.shape[1]):
        c = codes[rows, f]
        gs, hs, ns = (np.cumsum(np.bincount(c, w, BINS + 1))[:-1] for w in (g, h, None))
        gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
        gain[(ns < LEAF) | (len(rows) - ns < LEAF)] = -1
        if gain.max() > best[0]:
            best = (gain.max(), f, int(gain.argmax()))
    return best


def tree_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> list[Rule]:
    """Conjunctions on the paths of boosted trees."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)], axis=1)
    raw, rules = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}
    for _ in range(TREES):
        p = _sigmoid(raw)
        grad, hess, step = y - p, p * (1 - p), np.zeros(len(y))

        def grow(rows: np.ndarray, path: Rule, depth: int) -> None:
            step[rows] = grad[rows].sum() / (hess[rows].sum() + 1)
            if path:
                rules.setdefault(path)
            if depth == DEPTH:
                return
            _, f, b = _split(codes, rows, grad, hess)
            if f < 0:
                return
            low, cut = codes[rows, f] <= b, float(cuts[f][b])
            grow(rows[low], (*path, (names[f], "<", cut)), depth + 1)
            grow(rows[~low], (*path, (names[f], ">=", cut)), depth + 1)

        grow(np.arange(len(y)), (), 0)
        raw += RATE * step
    return list(rules)


def _fires(rules: list[Rule], x: np.ndarray, names: list[str]) -> np.ndarray:
    at = {n: x[:, i] for i, n in enumerate(names)}
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for name, sign, cut in rule:
            out[:, j] *= at[name] >= cut if sign == ">=" else at[name] < cut
    return out


def lasso_weights(z: np.ndarray, y: np.ndarray, strength: float = LASSO, rounds: int = 400) -> tuple[float, np.ndarray]:
    """L1-penalised logistic regression by accelerated proximal steps."""
    n, k = z.shape
    centre, scale = z.mean(0), np.maximum(z.std(0), 1e-2)
    a = np.hstack([np.ones((n, 1)), (z - centre) / scale])
    v = np.ones(k + 1)
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    size = 4 * n / max(np.linalg.norm(a @ v) ** 2, 1e-9)
    w = u = np.zeros(k + 1)
    t = 1.0
    for _ in range(rounds):
        new = u - size * (a.T @ (_sigmoid(a @ u) - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - size * strength, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        u, w = new + (old - 1) / t * (new - w), new
    beta = w[1:] / scale
    return float(w[0] - beta @ centre), beta


def as_column(model: tuple[float, list[tuple[Rule, float]]]) -> Column:
    by_name = stats.features()
    total = F.lit(model[0])
    for rule, weight in model[1]:
        test = F.lit(True)
        for name, sign, cut in rule:
            test = test & (by_name[name] >= F.lit(cut) if sign == ">=" else by_name[name] < F.lit(cut))
        total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit_rows(x: np.ndarray, y: np.ndarray, names: list[str]) -> tuple[float, list[tuple[Rule, float]]]:
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return float(np.log(share / (1 - share))), []
    rules = tree_rules(x, y, names)
    z = _fires(rules, x, names)
    _, first = np.unique(z, axis=1, return_index=True)
    rules, z = [rules[i] for i in sorted(first)], z[:, sorted(first)]
    bias, weights = lasso_weights(z, y)
    return bias, [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(counted: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    by_name = stats.features()
    known = labels.select("doc_id", "quality").filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    rows = bounded_sample(
        counted.join(known, "doc_id").select("doc_id", *[c.alias(n) for n, c in by_name.items()], "quality"),
        "doc_id", sample)
    rows.sort(key=lambda r: tuple(r))
    names = list(by_name)
    x = np.array([[r[n] for n in names] for r in rows], float).reshape(len(rows), len(names))
    return fit_rows(x, np.array([float(r["quality"] == 1) for r in rows]), names)


def score(docs: DataFrame, labels: DataFrame, cut: float = 0.7, sample: int = SAMPLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Statistics, ``held_out``, ``score`` and ``predicted`` of every document, with the columns in ``keep``."""
    columns = list(dict.fromkeys(["doc_id", *keep]))
    counted = written(stats.text_stats(docs, columns), "ensemble-stats")
    model = fit(counted.drop(*keep), labels, sample)
    return (counted.withColumn("held_out", held_out(F.col("doc_id")))
            .withColumn("score", as_column(model))
            .withColumn("predicted", (F.col("score") >= cut).cast("int")))
