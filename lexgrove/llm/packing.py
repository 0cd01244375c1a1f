"""Best-fit packing of tokenised documents into sequences of fixed capacity, bulk-synchronously.

A document is its token ids and an end id.  A document longer than the capacity is cut into pieces of the capacity; only
its first piece may be shorter.  Pieces are range-sorted by falling length over the whole cluster and numbered from 0;
the numbers need one count for each partition.  Then rounds run from the longest length to the shortest: in a round all
pieces of one length are matched at once with the gaps, kept range-sorted by size as well, by a sweep that gives each piece
the successor of its length (the smallest gap that holds it); pieces of equal length compete for gaps of equal size, which
rank resolves (the k-th piece takes the k-th gap); what is taken shrinks, and the next round begins.  Since lengths and
gaps are whole numbers up to the capacity, pieces and gaps are run-length rows: (length, how many), (gap, first sequence,
how many).  Their number depends on the capacity alone, so the sweep needs the same small memory for any corpus, and its
result, the plan, has at most about (3 * capacity) * sqrt(2 * capacity) rows.  The plan goes back to the cluster as a broadcast
table, joined by length; no piece or token reaches the driver.

The outcome is that of best-fit decreasing: no piece opens a sequence while some sequence could hold it.

Defined results: a null text is empty, one piece that is only the end id; an empty table has no pieces; rows that repeat a
doc_id are packed one by one; null doc_ids are kept; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .bpe import cut_pieces
from .common import cut

#: Bytes of text worked on at once; bytes of pieces that a worker remembers.
SLICE, REMEMBER = 4 << 20, 16 << 20


def byte_of_char() -> dict[str, int]:
    """The printable characters that stand for bytes in vocabularies of byte-level BPE."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pieces:
    """ids of texts by a byte-level BPE file of the tokenizers library, as that library gives them, with a memory of distinct pieces.

    An added token inside a text has its own id, as by default there; what stands between two of them is matched by itself.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
        self.added = {t["content"]: t["id"] for t in added}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
        order = [model["vocab"].get(m, -1) for m in merged]
        if (
            model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or model.get("ignore_merges") or order != sorted(set(order)) or -1 in order
            or any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip"))
        ):
            raise ValueError(f"{path} is no plain byte-level BPE file whose merges are in order of their ids")
        back = byte_of_char()
        ranks = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if token not in self.added}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.pattern = regex.compile(pattern)
        self.marks = tuple(self.added)
        self.cut = re.compile("(" + "|".join(re.escape(m) for m in sorted(self.marks, key=len, reverse=True)) + ")") if self.marks else None
        self.encoding = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.seen = tk.Memory(self.coded, REMEMBER)

    def matches(self, text: str) -> list[str]:
        """Added tokens of a text and the pattern's matches between them."""
        parts = self.cut.split(text) if self.cut else [text]
        return [x for part in parts for x in ([part] if part in self.added else self.pattern.findall(part))]

    def coded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [[self.added[x]] if x in self.added else self.encoding.encode_ordinary(x) for x in pieces.to_pylist()]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.int32, int(size.sum())), np.concatenate([[0], np.cumsum(size)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, one after another, and where each text begins."""
        return self.seen.rows(cut_pieces(texts, self.matches, self.marks))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Pieces:
    """The tokenizer, made once in each Python worker."""
    return Pieces(path)


def piece_table(docs: DataFrame, path: str, capacity: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and ids if asked, for each piece of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for whole in batches:
            for batch in tk.slices(whole, "text", SLICE):
                ids, begin = t.encode(tk.plain(batch.column("text")))
                ids = np.insert(ids, begin[1:], end_id).astype("<u4")
                begin = begin + np.arange(len(begin))
                total = np.diff(begin)
                pieces = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = total - (pieces - 1) * capacity
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[row], capacity)
                at = begin[row] + start
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                out = [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if keep_ids:
                    out.append(tk.list_of(ids.astype(np.int32), np.append(at, len(ids)), pa.int32()))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tk.frugal(run), schema)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """The plan for counts[length] pieces: rows (length, from, to, sequence, each, offset).

    Pieces of that length ranked from <= rank < to go, each of them to a sequence, to sequences from the given one on,
    the first of a sequence at the given offset.
    """
    gaps: list[int] = []  # sizes in order
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first sequence, how many)
    plan, opened = [], 0

    def put(gap: int, first: int, many: int) -> None:
        if gap > 0:
            if gap not in runs or not runs[gap]:
                bisect.insort(gaps, gap)
            runs[gap].append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect.bisect_left(gaps, length)
            if k < len(gaps):
                gap = gaps[k]
                first, many = runs[gap].pop()
                if not runs[gap]:
                    gaps.pop(k)
            else:
                gap, first, many = capacity, opened, -(-left // (capacity // length))
                opened += many
            each = gap // length
            full, over = divmod(min(left, many * each), each)
            if full:
                plan.append((length, rank, rank + full * each, first, each, capacity - gap))
                put(gap - each * length, first, full)
            if over:
                plan.append((length, rank + full * each, rank + full * each + over, first + full, each, capacity - gap))
                put(gap - over * length, first + full, 1)
            used = full + (over > 0)
            if used < many:
                put(gap, first + used, many - used)
            left -= full * each + over
            rank += full * each + over
    return plan


def ranked(pieces: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """pieces with rank, their place among pieces of equal length, and how many there are of each length.

    A range sort by (length, doc_id, piece, start) splits lengths that many pieces share; a row's number is its
    partition's first number plus its place there.
    """
    spark = pieces.sparkSession
    order = [F.col("length").desc(), "doc_id", "piece", "ids_crc32"]
    ways = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = cut(pieces)  # a range sort reads its input twice, for the bounds and for the rows
    local = cut(pieces.repartitionByRange(ways, *order).sortWithinPartitions(*order).withColumn("m", F.monotonically_increasing_id()))
    part = F.shiftright("m", 33)
    groups = local.groupBy(part.alias("part"), "length").agg(F.count("*").alias("n"), F.min("m").alias("low")).collect()  # lengths x partitions at most
    before: dict[tuple[int, int], int] = {}
    counts: dict[int, int] = defaultdict(int)
    rows = []
    for g in sorted(groups, key=lambda g: (g.part, -g.length)):
        rows.append((g.part, g.length, counts[g.length] - g.low))
        counts[g.length] += g.n
    shift = spark.createDataFrame(rows, "part long, length long, shift long")
    out = local.withColumn("part", part).join(F.broadcast(shift), ["part", "length"]).withColumn("rank", F.col("m") + F.col("shift"))
    return out.drop("part", "m", "shift"), dict(counts)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces with sequence_id and offset."""
    placed, counts = ranked(pieces)
    plan = best_fit(counts, capacity)
    table = pieces.sparkSession.createDataFrame(
        pa.table(dict(zip(("length", "from", "to", "first", "each", "base"), (pa.array(c, pa.int64()) for c in (zip(*plan, strict=True) if plan else [[]] * 6)), strict=True)))
    )
    at = placed.join(F.broadcast(table), (placed.length == table.length) & (placed["rank"] >= table["from"]) & (placed["rank"] < table["to"])).drop(table.length)
    step = F.col("rank") - F.col("from")
    return at.withColumn("sequence_id", F.col("first") + F.floor(step / F.col("each"))).withColumn("offset", F.col("base") + (step % F.col("each")) * F.col("length")).drop("rank", "from", "to", "first", "each", "base")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset of every piece. See the module's text."""
    return pack(piece_table(docs, path, capacity, end_id, keep_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, of pieces with ids. A sequence holds capacity ids at most."""
    by = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return by.select("sequence_id", F.flatten("parts.ids").alias("ids"))
