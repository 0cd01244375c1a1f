"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees are boosted on a bounded sample of labelled documents; every path from a root is a conjunctive rule; a
logistic model with an L1 penalty keeps the rules that matter; what is left is compiled to one Spark column expression
over the statistics of textstats, so scoring is one pass with no model object on the executors.

The fit sees statistics only (labels, language, source and doc_id are no inputs) and runs on the driver in memory bounded
by SAMPLE rows.  Labels are learned from rows with crc32(doc_id as text) mod FOLDS <> 0.

Defined results: null text is empty and gets the score of empty text; without labelled rows every score is 0.5, with one
class only it is that class's smoothed share; label rows with a null doc_id or quality are no labels, repeated label rows
count each time; of documents that share a doc_id one, the least by its statistics, is learned from, and all are scored; a null doc_id is not
held out; texts of any length are scored whole; an empty table has no rows; extra columns, also such as have a statistic's name, are ignored by
scored() and kept by accepted().
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textstats import as_given, keeping, measured

#: Labelled rows that are fitted on, at most; taken by a hash of doc_id.
SAMPLE = 20_000
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
TREES, DEPTH, BINS, RATE = 24, 3, 48, 0.3
PENALTY = 0.002

#: What rules look at, as SQL over the statistics.
FEATURES = {
    "words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "distinct_words": "n_distinct / greatest(n_words, 1)",
    "stays": "n_stay / greatest(n_words, 1)",
    "upper": "n_upper / greatest(n_letters, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "exclaims": "n_exclaim / greatest(n_words, 1)",
    "pipes": "n_pipes / greatest(n_words, 1)",
    "marks": "n_marks / greatest(n_words, 1)",
    "stops": "n_stops / greatest(n_lines, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}

#: A condition (feature, is it above, threshold); a rule is a set of them.
Condition = tuple[str, bool, float]
Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class Ensemble:
    """Rules with weights, and the intercept."""

    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def column(self) -> Column:
        """The score as an expression over FEATURES' statistics."""
        total = repr(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            test = " and ".join(f"({FEATURES[f]}) {'>' if above else '<='} {t!r}D" for f, above, t in rule)
            total += f" + case when {test} then {weight!r}D else 0D end"
        return F.expr(f"1D / (1D + exp(-({total})))")

    def score(self, x: dict[str, np.ndarray]) -> np.ndarray:
        """The same over arrays by feature."""
        total = np.full(len(next(iter(x.values()))), self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total += weight * applies(rule, x)
        return 1 / (1 + np.exp(-total))


def applies(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for f, above, t in rule:
        out &= (x[f] > t) if above else (x[f] <= t)
    return out


def grow(x: np.ndarray, edges: list[np.ndarray], codes: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, names: list[str]) -> tuple[list[Rule], np.ndarray]:
    """One tree by second-order gain: all its paths, and its output on every row."""
    rules: list[Rule] = []
    out = np.zeros(len(x))

    def split(rows: np.ndarray, path: Rule, depth: int) -> None:
        g, h = gradient[rows].sum(), hessian[rows].sum()
        best = (1e-3, None, None)
        if depth < DEPTH and len(rows) >= 10:
            for f in range(x.shape[1]):
                if len(edges[f]):
                    c = codes[rows, f]
                    gl = np.cumsum(np.bincount(c, gradient[rows], len(edges[f]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(c, hessian[rows], len(edges[f]) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], f, k)
        if best[1] is None:
            out[rows] = RATE * g / (h + 1)
            return
        f, k = best[1], best[2]
        right = codes[rows, f] > k
        for above, part in ((False, rows[~right]), (True, rows[right])):
            rule = (*path, (names[f], above, float(edges[f][k])))
            rules.append(rule)
            split(part, rule, depth + 1)

    split(np.arange(len(x)), (), 0)
    return rules, out


def lasso(a: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of logistic regression with an L1 penalty, by accelerated proximal gradient."""
    n, k = a.shape
    w = z = np.zeros(k + 1)
    b = np.hstack([a, np.ones((n, 1))])
    step = 4 * n / max(np.linalg.norm(b, 2) ** 2, 1e-9)
    t = 1.0
    for _ in range(steps):
        slope = b.T @ (1 / (1 + np.exp(-np.clip(b @ z, -30, 30))) - y) / n
        new = z - step * slope
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - step * penalty, 0)
        later = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / later * (new - w), new, later
    return w[:k], float(w[k])


def fit(x: dict[str, np.ndarray], y: np.ndarray) -> Ensemble:
    """The ensemble for features x and labels y (0 or 1)."""
    names = list(x)
    if len(y) == 0 or y.min() == y.max():
        share = (float(y.sum()) + 0.5) / (len(y) + 1)
        return Ensemble((), (), math.log(share / (1 - share)))
    m = np.column_stack([x[k] for k in names])
    edges = []
    for f in range(m.shape[1]):
        cuts = np.unique(np.quantile(m[:, f], np.linspace(0, 1, BINS + 1)[1:-1]))
        values = np.unique(m[:, f])
        after = np.searchsorted(values, cuts, side="right")
        edges.append(np.unique((cuts + values[np.minimum(after, len(values) - 1)]) / 2)[: BINS])
    codes = np.column_stack([np.searchsorted(edges[f], m[:, f], side="left") for f in range(m.shape[1])])
    margin = np.full(len(y), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rules: dict[frozenset, Rule] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        found, out = grow(m, edges, codes, y - p, p * (1 - p), names)
        margin += out
        for rule in found:
            rules.setdefault(frozenset(rule), rule)
    all_rules = list(rules.values())
    w, b = lasso(np.column_stack([applies(r, x) for r in all_rules]).astype(float), y) if all_rules else (np.zeros(0), float(margin[0]))
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    return Ensemble(tuple(all_rules[k] for k in keep), tuple(float(w[k]) for k in keep), b)


def fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ensemble:
    """Fit on up to sample labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold() != HELD_OUT))
    some = known.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", "quality").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stats = measured(texts.join(F.broadcast(some.select("doc_id").distinct()), "doc_id", "left_semi"))
    values = stats.select("doc_id", *(F.expr(v).cast("double").alias(k) for k, v in FEATURES.items()))
    values = values.groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("f")).select("doc_id", "f.*")  # one row for each label row, so sample rows at most
    rows = values.join(F.broadcast(some), "doc_id").toPandas().sort_values(["doc_id", "quality", *FEATURES], kind="stable")
    return fit({k: rows[k].to_numpy(float) for k in FEATURES}, rows["quality"].to_numpy(float))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text)."""
    score = learn(docs, labels, sample).column()
    out = measured(docs).select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all their columns, whose score is THRESHOLD or more."""
    score = learn(docs, labels, sample).column()
    return as_given(keeping(docs).where(score >= THRESHOLD), docs.columns)
