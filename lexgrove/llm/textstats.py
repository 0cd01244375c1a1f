"""Statistics of whole texts, in a few vectorised passes over the bytes of a batch.

Definitions (words: ``[^\\x20\\x09-\\x0D]+``; a null or empty text has none of anything):
n_words; word_chars (code points in words); n_symbols (characters of ``[#*$%&|<>]``); n_dup_lines (lines, split at \\n, that
have a word and equal an earlier line); n_repeat_words (words inside a window of five words that occurs twice or more in
the text, its first occurrence included); n_lines (lines with a word); n_distinct (different words); n_stay (words equal
to the word before); n_upper (A-Z); n_letters (A-Z, a-z and every code point beyond ASCII); n_digits (0-9); n_exclaim (!);
n_pipes (|); n_marks (characters of ``[.,;:]``); n_stops (lines whose last character is . ! ? or a quotation mark).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_stay", "n_upper", "n_letters", "n_digits", "n_exclaim", "n_pipes", "n_marks", "n_stops")


def _class(chars: str = "", other: bool = False) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[[ord(c) for c in chars]] = 1
    if other:
        t[0xC0:] = 1  # the first byte of every code point beyond ASCII
    return t


_UPPER = "".join(map(chr, range(65, 91)))
_CLASSES = {"n_symbols": _class("#*$%&|<>"), "n_upper": _class(_UPPER), "n_letters": _class(_UPPER + _UPPER.lower(), True), "n_digits": _class("0123456789"), "n_exclaim": _class("!"), "n_pipes": _class("|"), "n_marks": _class(".,;:")}
_POINT = np.ones(256, np.uint8)  # bytes that begin a code point outside white space
_POINT[0x80:0xC0] = 0
_POINT[tk.SPACE] = 0
_STOP = _class(".!?\"'")


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    out = np.zeros(len(off) - 1, np.int64)
    full = np.diff(off) > 0
    if full.any():
        out[full] = np.add.reduceat(flags, off[:-1][full], dtype=np.int64)
    return out


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    data, off = tk.raw(texts)
    n = len(off) - 1
    w = tk.words(data, off)
    out = {"n_words": np.diff(w.first), "word_chars": _per_text(_POINT[data], off)} | {k: _per_text(t[data], off) for k, t in _CLASSES.items()}
    stay = np.zeros(len(w.hash), bool)
    stay[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    out["n_stay"] = np.bincount(w.doc[stay], minlength=n)

    at, key = tk.windows(w, 5)
    key = tk.mix(key + w.doc[at].astype(np.uint64) * tk._STEP)
    inside = np.sort(key)
    twice = np.unique(inside[1:][inside[1:] == inside[:-1]])
    covered = np.zeros(n, np.int64)
    if len(twice):
        may = np.zeros(1 << 16, bool)
        may[(twice & np.uint64(0xFFFF)).astype(np.int64)] = True
        pick = np.flatnonzero(may[(key & np.uint64(0xFFFF)).astype(np.int64)])
        where = np.minimum(np.searchsorted(twice, key[pick]), len(twice) - 1)
        first = at[pick[twice[where] == key[pick]]]
        edge = np.zeros(len(w.hash) + 1, np.int32)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + 5, -1)
        covered = np.bincount(w.doc[np.cumsum(edge[:-1]) > 0], minlength=n)
    out["n_repeat_words"] = covered

    same = w.hash.copy()
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a > 1:
            same[a:b].sort()
    new = np.ones(len(same), bool)
    new[1:] = (same[1:] != same[:-1]) | (w.doc[1:] != w.doc[:-1])
    out["n_distinct"] = np.bincount(w.doc[new], minlength=n)

    start, end = tk.runs(data, off, data == 10)
    if len(w.start):
        has = np.searchsorted(w.start, start) < np.searchsorted(w.start, end)
        start, end = start[has], end[has]
    else:
        start, end = start[:0], end[:0]
    doc = np.searchsorted(off, start, side="right") - 1
    out["n_lines"] = np.bincount(doc, minlength=n)
    out["n_stops"] = np.bincount(doc[_STOP[data[end - 1]] > 0], minlength=n) if len(end) else np.zeros(n, np.int64)
    line = tk.mix(tk.hashes(data, start, end) + doc.astype(np.uint64) * tk._STEP)
    order = np.argsort(line, kind="stable")
    again = np.zeros(len(line), bool)
    again[1:] = line[order][1:] == line[order][:-1]
    out["n_dup_lines"] = np.bincount(doc[order][again], minlength=n)
    return out


@tk.frugal
def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in tk.slices(whole, "text", tk.KERNEL_BYTES):
            s = statistics(tk.plain(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(s[k], pa.int64()) for k in NAMES)], names=["doc_id", *NAMES])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and NAMES of docs(doc_id, text), one row for each row; other columns are dropped."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_measure, "doc_id long, " + ", ".join(f"{k} long" for k in NAMES))


def _aside(column: str) -> str:
    """Where a column of the input that has the name of a statistic waits."""
    return f"__input_{column}" if column.lower() in NAMES else column


def keeping(docs: DataFrame) -> DataFrame:
    """docs with NAMES beside; a column of docs that has such a name already is put aside until as_given()."""
    base = docs.select(*(F.col(f"`{c}`").alias(_aside(c)) for c in docs.columns))
    fields = [f.name for f in base.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tk.slices(whole, "text", tk.KERNEL_BYTES):
                s = statistics(tk.plain(batch.column("text")))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(fields))), *(pa.array(s[k], pa.int64()) for k in NAMES)], names=[*fields, *NAMES])

    return base.mapInArrow(tk.frugal(run), T.StructType([*base.schema.fields, *(T.StructField(k, T.LongType()) for k in NAMES)]))


def as_given(kept: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of keeping() with the input's own columns, in their order."""
    return kept.select(*(F.col(f"`{_aside(c)}`").alias(c) for c in columns))
