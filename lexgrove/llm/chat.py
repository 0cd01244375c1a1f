"""Chat formatting by columnar byte assembly, and its reader.

A turn is ``<|im_start|>`` role newline text ``<|im_end|>`` newline.  In role and text a backslash goes before every backslash
and before a ``|`` that follows ``<``; in a role also before a newline.  So no control string occurs inside, and dropping
each first backslash restores the text.

All turns of an Arrow batch are assembled at once: segment lengths, their running sum, and for each byte of each segment its
place in one preallocated buffer; headers and contents are scattered into it, and the output column is a view of that buffer.

Output: one row for each conversation and batch that it spans: conv_id, part (from 0), formatted, loss_start and loss_end
(byte offsets in formatted of each assistant text, the loss mask).  A conversation of any size passes through in parts, one
batch in memory at a time.

Defined results: turns are ordered by turn (nulls first), then role, then text; repeated rows are turns of their own; null
role and text are empty; rows with a null conv_id are one conversation; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk

START, END = b"<|im_start|>", b"<|im_end|>\n"
LEARNED = b"assistant"
_BACK, _BAR, _LESS, _LINE = 0x5C, 0x7C, 0x3C, 0x0A
_ROLE = re.compile(rb"<\|im_start\|>((?:[^\\\n]|\\.)*)\n", re.S)
_ESCAPED = re.compile(rb"\\(.)", re.S)


def escapes(data: np.ndarray, off: np.ndarray, lines: bool) -> np.ndarray:
    """Bytes before which a backslash goes."""
    out = data == _BACK
    bar = data == _BAR
    bar[1:] &= data[:-1] == _LESS
    bar[off[:-1][off[:-1] < len(data)]] = False
    out |= bar
    return out | (data == _LINE) if lines else out


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The buffer of all turns, where each turn begins in it (one more at the end), and where its text begins and ends."""
    (rd, ro), (td, to) = tk.raw(roles), tk.raw(texts)
    n = len(ro) - 1
    role_mark, text_mark = escapes(rd, ro, True), escapes(td, to, False)
    total = lambda mark: np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])
    rs, ts = total(role_mark), total(text_mark)
    role_size = np.diff(ro) + rs[ro[1:]] - rs[ro[:-1]]
    text_size = np.diff(to) + ts[to[1:]] - ts[to[:-1]]
    size = len(START) + role_size + 1 + text_size + len(END)
    begin = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(begin[-1]), np.uint8)

    def scatter(data: np.ndarray, off: np.ndarray, mark: np.ndarray, marks: np.ndarray, where: np.ndarray) -> None:
        if len(data):
            at = np.repeat(where - off[:-1] - marks[off[:-1]], np.diff(off)) + np.arange(len(data)) + marks[1:]
            out[at] = data
            out[at[mark] - 1] = _BACK

    for head, where in ((START, begin[:-1]), (END, begin[1:] - len(END))):
        out[where[:, None] + np.arange(len(head))] = np.frombuffer(head, np.uint8)
    role_at = begin[:-1] + len(START)
    out[role_at + role_size] = _LINE
    text_at = role_at + role_size + 1
    scatter(rd, ro, role_mark, rs, role_at)
    scatter(td, to, text_mark, ts, text_at)
    return out, begin, text_at, text_at + text_size if n else text_at


@tk.frugal
def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, part = object(), 0
    for whole in batches:
        for batch in tk.slices(whole, "text"):
            ids = batch.column("conv_id").to_pylist()
            roles, texts = tk.plain(batch.column("role")), tk.plain(batch.column("text"))
            data, begin, start, end = assemble(roles, texts)
            first = [k for k in range(len(ids)) if k == 0 or ids[k] != ids[k - 1]] + [len(ids)]
            learned = np.array([r == LEARNED.decode() for r in roles.to_pylist()], bool)
            parts = []
            for k in first[:-1]:
                part = part + 1 if ids[k] == last else 0
                last = ids[k]
                parts.append(part)
            cuts = begin[first]
            text = pa.Array.from_buffers(pa.string(), len(parts), [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(data)])
            count = np.concatenate([[0], np.cumsum(learned)])[first]
            base = np.repeat(cuts[:-1], np.diff(first))
            spans = [tk.list_of((x - base)[learned], count, pa.int64()) for x in (start, end)]
            yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in first[:-1]], pa.int64()), pa.array(parts, pa.int32()), text, *spans], names=["conv_id", "part", "formatted", "loss_start", "loss_end"])


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, part, formatted, loss_start, loss_end; a conversation's parts are in order in one partition."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    # a call without a number lets the session's partitions count
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(_format, "conv_id long, part int, formatted string, loss_start array<long>, loss_end array<long>")


def unescape(x: bytes) -> bytes:
    return _ESCAPED.sub(rb"\1", x)


def parse(text: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn; an error if the whole is not a run of turns."""
    out, at = [], 0
    while at < len(text):
        m = _ROLE.match(text, at)
        end = text.find(END, m.end()) if m else -1  # an escaped text has no control string
        if end < 0:
            raise ValueError(f"no turn at byte {at}")
        out.append((unescape(m[1]), unescape(text[m.end() : end])))
        at = end + len(END)
    return out


@tk.frugal
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    open_ = None

    def close(o) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], pa.string() if k in (2, 4) else pa.int64()) for k, v in enumerate((o[0], o[1], o[2].hexdigest(), o[3], o[4].hexdigest(), o[5]))], names=names)

    for batch in batches:
        done = []
        for conv, part, text, starts, ends in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "part", "formatted", "loss_start", "loss_end")), strict=True):
            if part == 0:
                if open_:
                    done.append(close(open_))
                open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            raw = text.encode()
            turns = parse(raw)
            open_[1] += len(turns)
            open_[2].update(b"".join(x for r, t in turns for x in (r, b"\n", t, b"\n")))
            for a, b in zip(starts, ends, strict=True):
                said = unescape(raw[a:b])
                open_[3] += len(said.decode())
                open_[4].update(said)
            open_[5] += len(text)
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if open_:
        yield close(open_)


def digests(parts: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from formatted()'s rows as they lie."""
    return parts.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
