"""A class-based bigram model (Brown): exchange clustering of words, class transitions, word emissions, smoothed log-probabilities.

All counts are over all training texts.  Words are told apart by a 64-bit hash of their bytes (with a billion distinct words the chance
that any two share one is 3 %; their counts would then be added).

1. Words are counted: each unit (about 8 MB of text) counts its own, and the counts meet by ranges of the hash.
2. Training texts are written as codes of the FREQUENT most frequent words, which are exchanged; the others are "rest".
3. Exchange rounds.  Each counts, for every frequent word, the classes to its left and right (a task sums its own units in one bounded
   array, blocks of words meet by key).  Each block moves its words, one after another, to the class where the likelihood of the class
   bigrams rises most, on its own copy of the class matrix; blocks move at once, and the matrix is counted anew each round.  The classes
   of the round of the greatest likelihood stay.  At first a word's class is that of the very frequent word it stands beside most.
4. Every rest word goes to the class that its left neighbours in all texts make likeliest; its count and class go back to each unit
   that has it, and units score their texts.

Model: ``P(w | u) = P(b | u) * c(w) / N(b)`` for a frequent word of class b after class u; a rest word has
``P(rest | u) * P(known) * P(b | rest, u) * c(w) / N_rest(b)``, an unseen one ``P(rest | u) * P(unseen)``, where P(unseen) comes from the
words seen once (Good-Turing); the end of a text has P(end | u).  Class probabilities are smoothed by PRIOR pseudo-counts spread as
the classes are overall, so all probabilities after u sum to one, taking the unseen as one word.

Nothing has the vocabulary in one place: only FREQUENT words and matrices of CLASSES are broadcast, whatever the corpus.

Defined results: a null text is empty and has one token, its end; rows that repeat are scored and learned from one by one; a null
doc_id is not learned from and counts as held out; with no training texts counts are 0 and all words are unseen; an empty table has no
rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import cut

CLASSES, FREQUENT, ROUNDS, PRIOR = 64, 1 << 15, 4, 5.0
#: Words of a block; tasks for all blocks, which are few rows but much work; bytes of text whose words meet in one range of hashes, about.
BLOCK, TASKS, RANGE_BYTES = 512, 32, 8 << 20
#: Classes of what is no frequent word, as places after CLASSES.
REST, END, START = CLASSES, CLASSES + 1, CLASSES + 2
KINDS = CLASSES + 3


class Unit(NamedTuple):
    """Texts of a slice: doc_ids, which are held out, hashes of all words, and where each text's begin (one more at the end)."""

    ids: list
    held: np.ndarray
    word: np.ndarray
    first: np.ndarray


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[Unit]:
    for whole in batches:
        for batch in tk.slices(whole, "text"):
            found, counts = [], []
            for part in tk.slices(batch, "text", tk.KERNEL_BYTES):
                w = tk.words(*tk.raw(tk.plain(part.column("text"))), lower=True)
                found.append(w.hash)
                counts.append(np.diff(w.first))
            if batch.num_rows:
                first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
                yield Unit(batch.column("doc_id").to_pylist(), batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool), np.concatenate(found), first)


def _ranges(words: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(range, begin, end) of sorted hashes."""
    which = (words >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), np.int64)
    if not len(which):
        return
    edge = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
    for a, b in zip(edge.tolist(), np.r_[edge[1:], len(which)].tolist(), strict=True):
        yield int(which[a]), a, b


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


_COUNTED = "range long, words binary, counts binary, ends long"


def _count(bits: int) -> Callable:
    @tk.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u in _units(batches):
            learned = np.repeat(~u.held, np.diff(u.first))
            words, counts = np.unique(u.word[learned], return_counts=True)
            rows = [(r, words[a:b].tobytes(), counts[a:b].astype(np.int64).tobytes(), 0) for r, a, b in _ranges(words, bits)]
            yield _batch([*rows, (0, b"", b"", int((~u.held).sum()))], _COUNTED)

    return run


_TALLY = "n long, v long, ends long, words binary, counts binary"


def _joined(rows: pd.Series, kind=np.int64) -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind)


def _tally(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a range of hashes: tokens, words, ends, and the most frequent words."""
    words, place = np.unique(_joined(rows["words"], np.uint64), return_inverse=True)
    counts = np.zeros(len(words), np.int64)
    np.add.at(counts, place, _joined(rows["counts"]))
    top = np.lexsort((words.view(np.int64), -counts))[:FREQUENT]
    return pd.DataFrame([(counts.sum(), len(words), rows["ends"].sum(), words[top].tobytes(), counts[top].tobytes())], columns=[x.split()[0] for x in _TALLY.split(", ")])


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w, c in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(w, np.int64)), pa.array(np.frombuffer(c, np.int64))], names=["word", "c"])


class Vocabulary(NamedTuple):
    """tokens and distinct tokens of the training texts (ends included), ends, and the frequent words in order of their hash with their counts."""

    n: int
    v: int
    ends: int
    words: np.ndarray
    counts: np.ndarray


def _vocabulary(docs: DataFrame, bits: int) -> Vocabulary:
    tally = cut(docs.mapInArrow(_count(bits), _COUNTED).groupBy("range").applyInPandas(_tally, _TALLY))
    one = tally.agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("ends").alias("ends")).first()
    top = tally.select("words", "counts").mapInArrow(_rows_of, "word long, c long").orderBy(F.col("c").desc(), "word").limit(FREQUENT).toArrow()
    words, counts = (top.column(k).to_numpy().astype(np.int64) for k in ("word", "c"))
    order = np.argsort(words.view(np.uint64))
    ends = one.ends or 0
    return Vocabulary((one.n or 0) + ends, (one.v or 0) + (ends > 0), ends, words.view(np.uint64)[order], counts[order])


def _codes(v: Vocabulary, words: np.ndarray) -> np.ndarray:
    """Places of words among the frequent ones; their number for others."""
    size = len(v.words)
    at = np.searchsorted(v.words, words)
    if not size:
        return at
    return np.where(v.words[np.minimum(at, size - 1)] == words, at, size)


def _sequence(u: Unit, code: np.ndarray, size: int, some: np.ndarray) -> np.ndarray:
    """Start, words and end of each of some texts, one after another. code: of all words; size: code of rest words, then end, start."""
    count = np.diff(u.first)[some]
    begin = np.concatenate([[0], np.cumsum(count + 2)])
    out = np.empty(int(begin[-1]), np.int32)
    out[begin[:-1]] = size + 2
    out[begin[1:] - 1] = size + 1
    inner = np.ones(len(out), bool)
    inner[begin[:-1]] = inner[begin[1:] - 1] = False
    out[inner] = code[np.repeat(some, np.diff(u.first))]
    return out


def _encode(v: Vocabulary) -> Callable:
    @tk.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u in _units(batches):
            yield _batch([(_sequence(u, _codes(v, u.word), len(v.words), ~u.held).astype(np.uint16).tobytes(),)], "codes binary")

    return run


_PART = "block int, cells binary, counts binary"


def _contexts(kind_of: np.ndarray, size: int) -> Callable:
    """Counts of classes beside each frequent word (cell: word in its block, side, class), and of class bigrams (block -1), of a task's units."""

    @tk.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, left = (np.zeros((size + 3) * KINDS, np.int64) for _ in range(2))
        for batch in batches:
            for codes in batch.column("codes").to_pylist():
                x = np.frombuffer(codes, np.uint16).astype(np.int32)
                for at in range(0, len(x), 1 << 20):  # END and the START after it are no bigram
                    part = x[at : at + (1 << 20) + 1]
                    a, b = part[:-1], part[1:]
                    ok = a != size + 1
                    a, b = a[ok], b[ok]
                    right += np.bincount(a * KINDS + kind_of[b], minlength=len(right))
                    left += np.bincount(b * KINDS + kind_of[a], minlength=len(left))
        both = np.stack([left.reshape(-1, KINDS), right.reshape(-1, KINDS)], 1)
        matrix = np.zeros((KINDS, KINDS), np.int64)
        np.add.at(matrix, kind_of, both[:, 1, :])
        for block, part in [(-1, matrix), *((k // BLOCK, both[k : min(k + BLOCK, size)]) for k in range(0, size, BLOCK))]:
            flat = part.ravel()
            cells = np.flatnonzero(flat)
            yield _batch([(block, cells.astype(np.int32).tobytes(), flat[cells].tobytes())], _PART)

    return run


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    cells, place = np.unique(_joined(rows["cells"], np.int32), return_inverse=True)
    counts = np.zeros(len(cells), np.int64)
    np.add.at(counts, place, _joined(rows["counts"]))
    return pd.DataFrame([(rows["block"].iloc[0], cells.tobytes(), counts.tobytes())], columns=["block", "cells", "counts"])


def _dense(cells: bytes, counts: bytes, *shape: int) -> np.ndarray:
    out = np.zeros(int(np.prod(shape)))
    out[np.frombuffer(cells, np.int32)] = np.frombuffer(counts, np.int64)
    return out.reshape(shape)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(m: np.ndarray) -> float:
    """Of class bigrams, up to what does not depend on classes."""
    return float(_xlogx(m).sum() - _xlogx(m.sum(0)).sum() - _xlogx(m.sum(1)).sum())


def _gains(m: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """By how much the likelihood rises for each class that a word outside all classes may join."""
    r, l_ = np.flatnonzero(right), np.flatnonzero(left)
    out = (_xlogx(m[:CLASSES, r] + right[r]) - _xlogx(m[:CLASSES, r])).sum(1)
    out += (_xlogx(m[l_, :CLASSES] + left[l_, None]) - _xlogx(m[l_, :CLASSES])).sum(0)
    d, dr, dl = m.diagonal()[:CLASSES], right[:CLASSES], left[:CLASSES]
    out += _xlogx(d + dr + dl) - _xlogx(d + dr) - _xlogx(d + dl) + _xlogx(d)
    rows, cols = (m.sum(1) + left)[:CLASSES], (m.sum(0) + right)[:CLASSES]  # its neighbours' classes gain the same, wherever it goes
    return out - (_xlogx(rows + right.sum()) - _xlogx(rows)) - (_xlogx(cols + left.sum()) - _xlogx(cols))


def _seeded(seeds: np.ndarray) -> Callable:
    """First classes: that of the seed beside which a word stands most, for how frequent the seed is. seeds: the seeds' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, cells, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                beside = _dense(cells, counts, BLOCK, 2, KINDS)[:, :, :CLASSES].sum(1) / np.sqrt(np.maximum(seeds, 1))
                kind = np.where(beside.max(1) > 0, beside.argmax(1), (np.arange(BLOCK) + block) % CLASSES)
                yield _batch([(block, kind.astype(np.uint8).tobytes())], "block int, kinds binary")

    return run


def _exchanged(m: np.ndarray, kind_of: np.ndarray, size: int) -> Callable:
    """Classes of a block's words after each has moved to where the likelihood rises most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, cells, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = m.astype(np.float64).copy()
                kinds = kind_of[block * BLOCK : min((block + 1) * BLOCK, size)].copy()
                beside = _dense(cells, counts, BLOCK, 2, KINDS)
                for k in range(len(kinds)):
                    left, right = beside[k]
                    a = kinds[k]
                    own[a] = np.maximum(own[a] - right, 0)  # its neighbours may have moved since they were counted
                    own[:, a] = np.maximum(own[:, a] - left, 0)
                    gain = _gains(own, left, right)
                    b = int(gain.argmax())
                    b = b if gain[b] > gain[a] + 1e-9 else int(a)
                    kinds[k] = b
                    own[b] += right
                    own[:, b] += left
                yield _batch([(block, kinds.astype(np.uint8).tobytes())], "block int, kinds binary")

    return run


def _classes(codes: DataFrame, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The class of each code (rest, end and start after the frequent words), and the matrix of class bigrams."""
    size = len(v.words)
    fixed = np.array([REST, END, START], np.uint8)

    def counted(kind_of: np.ndarray) -> tuple[DataFrame, np.ndarray]:
        sums = cut(codes.mapInArrow(_contexts(kind_of, size), _PART).repartition(TASKS, "block").groupBy("block").applyInPandas(_summed, _PART))
        got = sums.where("block = -1").collect()  # KINDS * KINDS numbers
        return sums.where("block >= 0"), _dense(got[0].cells, got[0].counts, KINDS, KINDS) if got else np.zeros((KINDS, KINDS))

    def gathered(blocks: DataFrame, run: Callable) -> np.ndarray:
        got = blocks.mapInArrow(run, "block int, kinds binary").collect()  # a byte for each frequent word
        kinds = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(r.kinds, np.uint8) for r in sorted(got))])[:size]
        return np.concatenate([kinds, fixed])

    seeds = np.argsort(-v.counts, kind="stable")[:CLASSES]
    kind_of = np.concatenate([np.full(size, REST, np.uint8), fixed])
    kind_of[seeds] = np.arange(len(seeds))
    blocks, _ = counted(kind_of)
    share = np.zeros(CLASSES)
    share[: len(seeds)] = v.counts[seeds]
    kind_of = gathered(blocks, _seeded(share))
    best, best_m, most = kind_of, None, -np.inf
    for turn in range(ROUNDS + 1):
        blocks, m = counted(kind_of)
        if likelihood(m) > most:
            best, best_m, most = kind_of, m, likelihood(m)
        if turn < ROUNDS:
            kind_of = gathered(blocks, _exchanged(m, kind_of, size))
    return best, best_m if best_m is not None else np.zeros((KINDS, KINDS))


class Model(NamedTuple):
    """Base-ten logarithms: step[u, b] of class b (rest and end included) after u; word of each frequent word in its class. kind_of: classes of codes."""

    v: Vocabulary
    kind_of: np.ndarray
    step: np.ndarray
    word: np.ndarray

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.v.n + 0.1 * (self.v.v + 1)))


def _smoothed(counts: np.ndarray, overall: np.ndarray) -> np.ndarray:
    """Rows of counts as probabilities, with PRIOR pseudo-counts as overall has them."""
    return (counts + PRIOR * overall) / (counts.sum(1, keepdims=True) + PRIOR)


def _model(v: Vocabulary, kind_of: np.ndarray, m: np.ndarray) -> Model:
    m = m.copy()
    m[:, START] = 0
    some = np.isin(np.arange(KINDS), [*kind_of[: len(v.words)], REST, END])  # nothing moves to the start or to a class without words
    overall = np.where(some, m.sum(0) + 0.5, 0)
    step = _smoothed(m, overall / overall.sum())
    step[:, ~some] = 1.0
    in_class = np.bincount(kind_of[: len(v.words)], weights=v.counts, minlength=KINDS)
    return Model(v, kind_of, np.log10(step), np.log10(v.counts / np.maximum(in_class[kind_of[: len(v.words)]], 1)))


#: kind 0: hashes of a unit's rest words in a range, from place first among all of the unit's, how often each occurs in training texts, and
#: (word, class to its left, times). 1: the unit's texts, as far as they can be scored without the rest words' counts and classes.
_SEEN = "kind int, unit long, range long, first int, words binary, counts binary, votes binary, texts binary"


def _partial(model: Model, bits: int) -> Callable:
    size = len(model.v.words)

    @tk.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for k, u in enumerate(_units(batches)):
            x = _sequence(u, _codes(model.v, u.word), size, np.ones(len(u.ids), bool))
            kind = model.kind_of[x]
            doc = np.repeat(np.arange(len(u.ids)), np.diff(u.first) + 2)
            a, b, of = kind[:-1], kind[1:], doc[1:]
            sum_ = lambda w, where: np.bincount(of[where], weights=w, minlength=len(u.ids))
            plain = (a != END) & (a != REST) & (b != REST)
            score = sum_(model.step[a[plain], b[plain]], plain)
            word = np.flatnonzero(x[1:] < size)
            at = x[1:][word]
            score += sum_(model.word[at], word)
            base = sum_(model.base(model.v.counts[at]), word) + model.base(np.array(float(model.v.ends)))
            known = np.bincount(of[word], minlength=len(u.ids)) + (model.v.ends > 0)
            rest = np.flatnonzero(x == size)
            inner = np.ones(len(x), bool)
            inner[(x == size + 1) | (x == size + 2)] = False
            words, place = np.unique(u.word[np.flatnonzero(x[inner] == size)], return_inverse=True)
            left, right = kind[rest - 1], kind[rest + 1]
            learned = ~u.held[doc[rest]]
            counts = np.bincount(place[learned], minlength=len(words))
            vote, times = np.unique(place[learned] * KINDS + left[learned], return_counts=True)
            edge = np.searchsorted(vote, np.arange(len(words) + 1) * KINDS)
            rows = []
            for r, i, j in _ranges(words, bits):
                own = slice(edge[i], edge[j])
                votes = np.stack([vote[own] // KINDS - i, vote[own] % KINDS, times[own]]).astype(np.int32)
                rows.append((0, part + k, r, i, words[i:j].tobytes(), counts[i:j].astype(np.int64).tobytes(), votes.tobytes(), None))
            texts = (u.ids, u.held, np.diff(u.first) + 1, known, base, score, place.astype(np.int32), doc[rest].astype(np.int32), left, right, len(words))
            rows.append((1, part + k, None, None, None, None, None, pickle.dumps(texts, protocol=5)))
            yield _batch(rows, _SEEN)

    return run


#: kind 0: for a unit, counts and classes (REST for a word that training lacks) of words from place first. 1: sums of a range.
_SOLVED = "kind int, unit long, first int, counts binary, kinds binary, sums binary"


def _solve(step: np.ndarray) -> Callable:
    """Counts and classes of the rest words of a range."""
    gain = (step - np.log10(np.maximum((10.0**step).mean(0, keepdims=True), 1e-300)))[:, :CLASSES]
    gain[:, step[START, :CLASSES] == 0] = -1e6  # classes without words

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sizes = np.array([len(w) // 8 for w in rows["words"]])
        begin = np.concatenate([[0], np.cumsum(sizes)])
        words, place = np.unique(_joined(rows["words"], np.uint64), return_inverse=True)
        counts = np.zeros(len(words), np.int64)
        np.add.at(counts, place, _joined(rows["counts"]))
        votes = [np.frombuffer(x, np.int32).reshape(3, -1) for x in rows["votes"]]
        who = place[np.concatenate([v[0] + b for v, b in zip(votes, begin, strict=False)])]
        left, times = (np.concatenate([v[k] for v in votes]).astype(np.int64) for k in (1, 2))
        kinds = np.full(len(words), REST, np.uint8)
        order = np.argsort(who, kind="stable")
        who, left, times = who[order], left[order], times[order]
        for at in range(0, len(words), 1 << 16):  # a matrix of words and classes, in parts
            end = min(at + (1 << 16), len(words))
            i, j = np.searchsorted(who, [at, end])
            fit = np.zeros((end - at, CLASSES))
            np.add.at(fit, who[i:j] - at, gain[left[i:j]] * times[i:j, None])
            kinds[at:end] = fit.argmax(1)
        kinds[counts == 0] = REST
        steps = np.zeros((KINDS, KINDS))
        np.add.at(steps, (left, kinds[who]), times)
        sums = (np.bincount(kinds, weights=counts, minlength=KINDS)[:CLASSES], int((counts == 1).sum()), steps[:, :CLASSES])
        out = [(0, unit, first, counts[place[a:b]].tobytes(), kinds[place[a:b]].tobytes(), None) for unit, first, a, b in zip(rows["unit"], rows["first"], begin[:-1], begin[1:], strict=True)]
        return pd.DataFrame([*out, (1, int(key[0]), 0, None, None, pickle.dumps(sums))], columns=[x.split()[0] for x in _SOLVED.split(", ")])

    return run


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    sums = [pickle.loads(x) for x in rows["sums"]]
    return pd.DataFrame([(pickle.dumps(tuple(sum(s[k] for s in sums) for k in range(3))),)], columns=["sums"])


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(model: Model, sums: tuple) -> Callable:
    of_class, once, steps = sums
    total = of_class.sum()
    unseen = (once + 0.5) / (total + once + 1.0)
    within = _smoothed(steps, of_class / total) if total else np.ones((KINDS, CLASSES))
    with np.errstate(divide="ignore"):
        within = np.log10(np.maximum(within, 1e-300))
    class_size = np.log10(np.maximum(of_class, 1))

    def run(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        ids, held, n, known, base, score, place, doc, left, right, size = pickle.loads(texts["texts"].iloc[0])
        counts, kinds = np.zeros(size, np.int64), np.full(size, REST, np.uint8)
        for first, c, k in zip(words["first"], words["counts"], words["kinds"], strict=True):
            counts[first : first + len(k)] = np.frombuffer(c, np.int64)
            kinds[first : first + len(k)] = np.frombuffer(k, np.uint8)
        if len(place):
            c, own = counts[place], kinds[place]
            before = np.where(left == REST, np.r_[[REST], own[:-1]], left)  # what stands before a rest word after another is that one
            seen = c > 0
            p = model.step[before, REST].copy()
            p[~seen] += np.log10(unseen)
            p[seen] += np.log10(1 - unseen) + within[before[seen], own[seen]] + np.log10(c[seen]) - class_size[own[seen]]
            then = right != REST
            p[then] += model.step[own[then], right[then]]
            add = lambda w: np.bincount(doc, weights=w, minlength=len(ids))
            score, base, known = score + add(p), base + add(model.base(c)), known + add(seen).astype(np.int64)
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "held_out": held, "n_tokens": n, "n_known": known, "train_tokens": model.v.n, "base_score": base, "score": score})

    return run


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs(doc_id, text, held_out); held_out texts are not learned from."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (size // RANGE_BYTES).bit_length())
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce("held_out", F.lit(True)).alias("held_out"))
    v = _vocabulary(docs, bits)
    model = _model(v, *_classes(cut(docs.mapInArrow(_encode(v), "codes binary")), v))
    seen = cut(docs.mapInArrow(_partial(model, bits), _SEEN))
    solved = cut(seen.where("kind = 0").select("unit", "range", "first", "words", "counts", "votes").groupBy("range").applyInPandas(_solve(model.step), _SOLVED))
    sums = solved.where("kind = 1").groupBy(F.pmod("unit", F.lit(16)).alias("g")).applyInPandas(_added, "sums binary").collect()
    none = (np.zeros(CLASSES), 0, np.zeros((KINDS, CLASSES)))
    sums = tuple(sum((pickle.loads(r.sums)[k] for r in sums), none[k]) for k in range(3))
    words = solved.where("kind = 0").select(F.col("unit").alias("of"), "first", "counts", "kinds")
    texts = seen.where("kind = 1").select("unit", "texts")
    return texts.groupBy("unit").cogroup(words.groupBy("of")).applyInPandas(_scored(model, sums), _SCORED)
