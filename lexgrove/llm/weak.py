"""Quality rules as weak supervision: rules vote or abstain, and a label model weighs their votes.

Each rule votes good or bad on a document, or abstains, by its statistics.  Expectation-maximisation estimates, without any
label, the share of good documents and each rule's accuracy on good documents and on each kind of bad ones (junk of one kind
trips one or two rules and passes the others, so bad documents are a mixture with a kind for each rule); the posterior
probability of good then decides.  The model needs only how many documents have each combination of votes (3**rules at most,
whatever the corpus), so the corpus is aggregated on the cluster and the fit runs on a table of bounded size.

Two constraints keep the model's meaning: a rule is no likelier to vote bad on a good document than on a bad one, and good
documents are half or more.  So a document that no rule votes against is always kept.

Defined results: a null text has no words and fails the base rule; an empty table has no rows; the verdict depends on the
votes' counts over the whole table, repeated rows counted each time; texts of any length are measured whole; extra columns, also such as have a
statistic's name, are ignored by judged() and kept by accepted().
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .textstats import as_given, keeping, measured

#: (name, votes bad if, votes good if), as SQL over the statistics; neither: abstains.
RULES = (
    ("length", "n_words < 3", "n_words >= 30"),
    ("word_length", "word_chars > 12 * n_words or word_chars < 2 * n_words", "word_chars between 3 * n_words and 7 * n_words"),
    ("symbols", "10 * n_symbols > 2 * n_words", "100 * n_symbols <= 2 * n_words"),
    ("capitals", "n_letters >= 30 and 10 * n_upper > 4 * n_letters", "10 * n_upper <= n_letters"),
    ("stays", "n_words >= 10 and 10 * n_stay > 2 * n_words", "100 * n_stay <= 5 * n_words"),
    ("variety", "n_words >= 20 and 100 * n_distinct < 15 * n_words", "2 * n_distinct >= n_words"),
    ("lines", "n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines", "10 * n_dup_lines <= n_lines"),
    ("repeats", "100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    ("ends", "n_lines >= 5 and 10 * n_stops < n_lines", "10 * n_stops >= 7 * n_lines"),
    ("exclaims", "n_words >= 10 and 2 * n_exclaim > n_words", "100 * n_exclaim <= 5 * n_words"),
    ("marks", "n_words >= 50 and 100 * n_marks < n_words", "n_marks between n_words / 20 and n_words / 2"),
)
BASE = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"
KEEP = 0.5
#: Share of all documents that a kind of bad documents has at least.
RARE = 0.002
_BAD, _ABSTAIN, _GOOD = 0, 1, 2


def vote(bad: str, good: str) -> Column:
    return F.expr(f"case when {bad} then {_BAD} when n_words > 0 and ({good}) then {_GOOD} else {_ABSTAIN} end")


@dataclass(frozen=True)
class LabelModel:
    """Share of each class (good first, then the kinds of bad), and for each class and rule the probability that a cast vote is bad."""

    share: tuple[float, ...]
    bad: tuple[tuple[float, ...], ...]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of each class (columns) for rows of votes."""
        theta = np.array(self.bad)
        like = np.log(np.array(self.share)) + (votes == _BAD) @ np.log(theta).T + (votes == _GOOD) @ np.log(1 - theta).T
        like = np.exp(like - like.max(1, keepdims=True))
        return like / like.sum(1, keepdims=True)

    def column(self, rules=RULES) -> Column:
        """The posterior probability of good, over the statistics: 1 / (1 + sum over bad kinds of their odds against good)."""
        cast = [vote(bad, good) for _, bad, good in rules]
        odds = F.lit(0.0)
        for share, theta in zip(self.share[1:], self.bad[1:], strict=True):
            total = F.lit(math.log(share / self.share[0]))
            for v, t, t0 in zip(cast, theta, self.bad[0], strict=True):
                total = total + F.when(v == _BAD, math.log(t / t0)).when(v == _GOOD, math.log((1 - t) / (1 - t0))).otherwise(0.0)
            odds = odds + F.exp(total)
        return 1 / (1 + odds)


def fit(votes: np.ndarray, count: np.ndarray, steps: int = 300) -> LabelModel:
    """EM from combinations of votes and how often each occurs.

    One kind of bad documents begins at each rule; a kind that ends with less than RARE of all documents is given up, so a
    rule that hardly ever votes bad is taken to be wrong when it does.
    """
    rules = votes.shape[1]
    bad, cast = (votes == _BAD).astype(float), (votes != _ABSTAIN).astype(float)
    kinds = list(range(rules))
    theta = np.full((rules + 1, rules), 0.02)
    theta[0] = 0.005
    theta[1 + np.arange(rules), np.arange(rules)] = 0.9
    share = np.array([0.9] + [0.1 / rules] * rules)
    total = max(count.sum(), 1.0)
    for step in range(steps):
        model = LabelModel(tuple(share), tuple(map(tuple, theta)))
        p = model.posterior(votes) * count[:, None]
        mass = p.sum(0)
        if step >= 20 and len(kinds) and (mass[1:] < RARE * total).any():
            keep = np.flatnonzero(mass[1:] >= RARE * total)
            kinds = [kinds[k] for k in keep]
            theta, share = theta[[0, *(keep + 1)]], share[[0, *(keep + 1)]]
            share = share / share.sum()
            continue
        old = theta, share
        hit, all_ = p.T @ bad, p.T @ cast
        theta = (hit + 0.02) / (all_ + 1.0)
        theta[0] = np.clip((hit[0] + 0.1) / (all_[0] + 20.0), 1e-6, 0.2)
        for row, k in enumerate(kinds, 1):
            theta[row, k] = max(0.5, (hit[row, k] + 9.0) / (all_[row, k] + 10.0))
        theta[1:] = np.clip(theta[1:], theta[0], 0.999)
        share = (mass + 1e-9) / (mass + 1e-9).sum()
        if share[0] < 0.5:
            share = np.concatenate([[0.5], share[1:] / share[1:].sum() / 2])
        if np.abs(theta - old[0]).max() < 1e-9 and np.abs(share - old[1]).max() < 1e-9:
            break
    return LabelModel(tuple(map(float, share)), tuple(tuple(map(float, x)) for x in theta))


def learn(stats: DataFrame, rules=RULES) -> LabelModel:
    """The label model of all rows of stats (columns of textstats)."""
    code = sum((vote(bad, good).cast("long") * 3**k for k, (_, bad, good) in enumerate(rules)), F.lit(0).cast("long"))
    rows = sorted(stats.groupBy(code.alias("code")).agg(F.count("*").alias("n")).collect())
    codes = np.array([r.code for r in rows], np.int64)
    votes = (codes[:, None] // 3 ** np.arange(len(rules))) % 3
    return fit(votes, np.array([r.n for r in rows], float))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the statistics of the base rules, base_failed, kept, posterior for each row of docs(doc_id, text)."""
    stats = cut(measured(docs))
    posterior = learn(stats).column()
    out = stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.expr(BASE).alias("base_failed"), posterior.alias("posterior"))
    kept = ~F.col("base_failed") & (F.col("posterior") >= KEEP)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "posterior")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, that neither the base rule nor the posterior rejects."""
    posterior = learn(measured(docs)).column()
    return as_given(keeping(docs).where(~F.expr(BASE) & (posterior >= KEEP)), docs.columns)
