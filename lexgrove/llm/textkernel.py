"""Vectorised text kernels over Arrow string buffers.

Every kernel looks at the UTF-8 bytes of a whole batch at once, so the cost per document is a share of a few numpy
passes, and no Python object is made for a word.  Words are the maximal runs of bytes outside 0x20 and 0x09-0x0D,
which are the words of ``[^\\x20\\x09-\\x0D]+`` (those separators are single bytes in UTF-8).  A null text counts as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are taken at once (one longer text is taken alone): in general, and by kernels whose arrays take about fifty bytes
#: for each byte of text.
SLICE_BYTES, KERNEL_BYTES = 8 << 20, 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_COMB = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_power = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd multiplier, modulo 2**64."""
    global _power
    if len(_power) < n:
        _power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 4096) - 1, np.uint64(0xD6E8FEB86659FD93))]), dtype=np.uint64)
    return _power[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    """Gives free memory back to the system, where the C library can."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError, TypeError):
        return lambda _: 0


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after whose end the worker, which Spark keeps for later tasks, holds no free memory."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return wrapped


class Memory:
    """Ids of strings seen before, in limit bytes; beyond, it starts anew (a speed matter only).

    make: ids of an array of distinct strings, one after another, and where each begins (one more at the end).
    """

    def __init__(self, make: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], limit: int):
        self.make, self.limit = make, limit
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.begin, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def find(self, distinct: pa.Array) -> np.ndarray:
        """The place of each of some distinct strings among begin."""
        if self.known.nbytes + self.begin.nbytes + self.ids.nbytes > self.limit:
            self.forget()
        place = pc.index_in(distinct, value_set=self.known)
        if place.null_count:
            new = place.is_null()
            fresh = distinct.filter(new)
            ids, begin = self.make(fresh)
            count = len(self.known)
            self.begin = np.concatenate([self.begin, self.begin[-1] + begin[1:]])
            self.ids = np.concatenate([self.ids, ids])
            self.known = pa.concat_arrays([self.known, fresh])
            out = pc.fill_null(place, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            out[new.to_numpy(zero_copy_only=False)] = np.arange(count, count + len(fresh))
            return out
        return place.to_numpy(zero_copy_only=False).astype(np.int64)

    def rows(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all lists of strings, one after another, and where each list's begin."""
        coded = lists.values.dictionary_encode()
        code = self.find(coded.dictionary.cast(pa.string()))
        ids, size = gather(self.ids, self.begin, code[coded.indices.to_numpy()])
        return ids, np.concatenate([[0], np.cumsum(size)])[lists.offsets.to_numpy()]


def gather(values: np.ndarray, begin: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs named by code, one after another, and the size of each."""
    size = (begin[1:] - begin[:-1])[code]
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]) if len(ends) else 0)
    return values[at + np.repeat(begin[:-1][code] - (ends - size), size)], size


def plain(column) -> pa.Array:
    """A string column as one array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "")


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (one more at the end)."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    off = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, off - off[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold up to limit bytes together (or one row)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, n = 0, batch.num_rows
    while start < n:
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


@dataclass
class Words:
    """Words of a batch: where each begins and ends, its document, its hash; first word of each document."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def runs(data: np.ndarray, off: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs of bytes outside gap, broken at the ends of documents."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begins = ~gap
    ends = begins.copy()
    begins[1:] &= gap[:-1] | edge[1:n]
    ends[:-1] &= gap[1:] | edge[1:n]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes; runs are in order and do not overlap."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    size = end - start
    at = np.arange(int(size.sum()))
    first = np.cumsum(size) - size
    inside = at - np.repeat(first, size)
    value = _BYTE[data[inside + np.repeat(start, size)]]
    value *= powers(int(size.max()))[inside]
    total = np.zeros(len(start), np.uint64)
    full = size > 0
    if full.any():
        total[full] = np.add.reduceat(value, first[full])
    return mix(total + size.astype(np.uint64) * _STEP)


def words(data: np.ndarray, off: np.ndarray, lower: bool = False) -> Words:
    """All words with their hashes, A-Z lower-cased before hashing if asked."""
    start, end = runs(data, off, SPACE[data])
    first = np.searchsorted(start, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return Words(start, end, doc, hashes(LOWER[data] if lower else data, start, end), first)


def windows(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every window of width words inside one document."""
    n = len(w.hash)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(w.doc[: n - width + 1] == w.doc[width - 1 :])
    total = np.zeros(len(at), np.uint64)
    for k in range(width):
        total += w.hash[at + k] * _COMB[k]
    return at, mix(total)


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and where each set begins.

    A text with fewer words than width has one shingle, its whole sequence; one without words has none.
    """
    data, off = raw(texts)
    w = words(data, off, lower=True)
    count = np.diff(w.first)
    at, value = windows(w, width)
    doc = w.doc[at]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        total = np.full(len(short), _STEP, np.uint64)
        for k in range(width - 1):
            has = count[short] > k
            total[has] += w.hash[w.first[short[has]] + k] * _COMB[k]
        total = mix(total + count[short].astype(np.uint64) * _COMB[63])
        doc = np.concatenate([doc, short])
        value = np.concatenate([value, total])
        order = np.argsort(doc, kind="stable")
        doc, value = doc[order], value[order]
    begin = np.searchsorted(doc, np.arange(len(texts) + 1))
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if b - a > 1:
            value[a:b].sort()
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[keep], doc[keep]
    return value, np.searchsorted(doc, np.arange(len(texts) + 1))


def list_of(values: np.ndarray, begin: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values, kind))


def binaries(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """Runs of values as binary cells. begin: in items."""
    width = values.dtype.itemsize
    off = begin.astype(np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())
