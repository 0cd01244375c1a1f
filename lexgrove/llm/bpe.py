"""Byte-level BPE encoding and decoding with DuckDB recursive queries, one database for each Python worker.

Encoding: a batch's texts are cut into pieces at spaces (a cut that never changes the pattern's matches), pieces that
this worker has not seen are matched by the pattern, and words that it has not seen go to DuckDB as token-position rows.  A
recursive query joins neighbours with the merge table, contracts each word's leftmost pair of least rank, and ends when no
word has a pair left.  Its rows are keyed by (word, position), so a word takes memory in proportion to its bytes, whatever
the number of steps; and a step contracts, from the left, all pairs of the least rank at once where that cannot change what
comes after (see _SQL).  The pieces' ids are then laid out per text with one gather.  Decoding joins (text, position, id)
rows with the vocabulary and aggregates the bytes in order of position.

Defined results: null text is empty; empty text has no ids; ids outside the vocabulary are an error; any length works
(a batch is worked on in slices of a few MB; one longer text is taken alone, one long word too, and a database beyond its
memory spills to the worker's own folder for temporary files).  Order of rows does not matter, and
repeated rows give repeated results.  Columns named ids, tokens or decoded in the input are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import os
import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk

#: Bytes of text worked on at once; bytes of words in one query; bytes of pieces and of words that a worker remembers.
SLICE, WORDS, REMEMBER = 8 << 20, 400_000, 32 << 20
#: The database's memory; beyond, it spills.
DATABASE = "300MB"
#: Whitespace beside a space: there a cut at the space could change the pattern's matches, so such a text is matched whole.
#: Arrow's \s is ASCII without \x0b, the pattern's is Unicode, so the characters are listed.
_WHITE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_RUN = rf"{_WHITE} {_WHITE}|{_WHITE} \z"

#: A row is a token of a word; id -1: it is part of the one before. k: rank * 2**40, p below. A step works on words that
#: the step before has changed. Of pairs of least rank that overlap (x x x), every second one from the left counts. Contracting one pair could
#: make a pair of still lower rank only if its token is part of a token of lower rank (alone); then only the leftmost is contracted.
_SQL = """
with recursive t(w, p, id) using key (w, p) as (
  select w, p, id from chars
  union
  (with live as (
     select r.w, r.p, r.id, lead(r.id) over ws nx, lead(r.p) over ws np, row_number() over ws o
     from recurring.t r where r.id >= 0 and r.w in (select x.w from t x) window ws as (partition by r.w order by r.p)),
   pair as materialized (select w, p, np, o, m.k, m.alone from live join merges m on m.pair = live.id::bigint * 1048576 + live.nx),
   least as (select w, min(k + p) kp from pair group by w),
   hit as (
     select pair.w, p, np, o, (kp // 1099511627776)::int r, o - row_number() over (partition by pair.w order by o) run
     from pair join least on pair.w = least.w and k // 1099511627776 = kp // 1099511627776 where not alone or p = kp % 1099511627776),
   chosen as (select w, p, np, r from hit qualify row_number() over (partition by w, run order by o) % 2 = 1)
   select w, unnest([p, np]) p, unnest([r, -1]) id from chosen)
)
select w, id from t where id >= 0 order by w, p
"""


class Vocabulary:
    """Ranks of byte strings as (rank, bytes), with the DuckDB tables that encode and decode."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.byte = np.zeros(256, np.int32)
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            if len(token) == 1:
                self.byte[token[0]] = r
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        left, right, rank = (np.array(x, np.int64) for x in (left, right, rank))
        part_of_less = np.concatenate([left[left > rank], right[right > rank]])
        spill = os.path.join(tempfile.gettempdir(), f"lexgrove-bpe-{os.getpid()}")
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": DATABASE, "temp_directory": spill})
        self.db.register("merges_", pa.table({"pair": left << 20 | right, "k": rank << 40, "alone": np.isin(rank, part_of_less)}))
        self.db.execute("create table merges as select * from merges_")
        self.db.register("vocab_", pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "hex": [k.hex() for k in self.ranks]}))
        self.db.execute("create table vocab as select * from vocab_")
        self.seen_words = tk.Memory(lambda x: self.words([w.encode() for w in x.to_pylist()]), REMEMBER)
        self.seen_pieces = tk.Memory(self.matched, REMEMBER)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of each word, one after another, and where each begins. A word that is a token is that token, whatever its merges."""
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int64, len(words))
        size = np.where(whole < 0, np.fromiter(map(len, words), np.int64, len(words)), 0)
        total = np.cumsum(size)
        parts, count = [], (whole >= 0).astype(np.int64)
        a = 0
        while a < len(words):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + WORDS, side="right")))
            n = size[a:b]
            data = np.frombuffer(b"".join(w for w, k in zip(words[a:b], n, strict=True) if k), np.uint8)
            if len(data):
                chars = {"w": np.repeat(np.arange(a, b), n).astype(np.int32), "p": np.arange(len(data)) - np.repeat(np.cumsum(n) - n, n), "id": self.byte[data]}
                self.db.register("chars", pa.table(chars))
                got = self.db.sql(_SQL).to_arrow_table()
                parts.append(got["id"].to_numpy())
                count[a:b] += np.bincount(got["w"].to_numpy() - a, minlength=b - a)
            a = b
        begin = np.concatenate([[0], np.cumsum(count)])
        ids = np.empty(int(begin[-1]), np.int32)
        alone = np.zeros(len(ids), bool)
        alone[begin[:-1][whole >= 0]] = True
        ids[alone] = whole[whole >= 0]
        ids[~alone] = np.concatenate(parts) if parts else []
        return ids, begin

    def matched(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of each piece, match by match."""
        found = [self.pattern.findall(x) for x in pieces.to_pylist()]
        of = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
        return self.seen_words.rows(pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.array([w for x in found for w in x], pa.string())))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, one after another, and where each text begins."""
        return self.seen_pieces.rows(cut_pieces(texts, self.pattern.findall))

    def decode(self, ids: np.ndarray, begin: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids."""
        n = np.diff(begin)
        doc = np.repeat(np.arange(len(n)), n)
        out = [b""] * len(n)
        self.db.register("given", pa.table({"d": doc.astype(np.int32), "p": np.arange(len(ids)), "id": ids.astype(np.int32)}))
        lost, = self.db.execute("select count(*) from given anti join vocab using (id)").fetchone() if len(ids) and (ids.max() >= len(self.ranks) or ids.min() < 0) else (0,)
        if lost:
            raise ValueError(f"{lost} ids are not in the vocabulary")
        for d, text in self.db.execute("select d, unhex(array_to_string(list(hex order by p), '')) from given join vocab using (id) group by d").fetchall():
            out[d] = text
        return out


def cut_pieces(texts: pa.Array, matches: Callable[[str], list[str]], marks: tuple[str, ...] = ()) -> pa.ListArray:
    """Each text as pieces whose matches, in order, are the text's: cut before each single space, else (there too, where a text has one of marks) the matches."""
    risky = pc.match_substring_regex(texts, _RUN).to_numpy(zero_copy_only=False)
    for mark in marks:
        risky = risky | pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(texts, " ")
    off, flat = lists.offsets.to_numpy().astype(np.int64), lists.values
    lead = np.ones(len(flat), bool)
    lead[off[:-1][np.diff(off) > 0]] = False
    joined = pc.if_else(pa.array(lead), pc.binary_join_element_wise("", flat, " "), flat)
    keep = pc.not_equal(joined, "")
    kept = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])[off]
    joined = joined.filter(keep)
    if not risky.any():
        return pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), joined)
    parts, sizes, last = [], np.diff(kept), 0
    for i in np.flatnonzero(risky).tolist():
        parts.append(joined.slice(kept[last], kept[i] - kept[last]))
        found = matches(texts[i].as_py())
        parts.append(pa.array(found, pa.string()))
        sizes[i], last = len(found), i + 1
    parts.append(joined.slice(kept[last]))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.concat_arrays(parts))


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The vocabulary, made once in each Python worker."""
    return Vocabulary(path, pattern)


def _encoder(path: str, pattern: str, id_column: str, finish: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for whole in batches:
            for batch in tk.slices(whole, "text", SLICE):
                ids, begin = v.encode(tk.plain(batch.column("text")))
                yield finish(v, batch.column(id_column), ids, begin)

    return tk.frugal(run)


def _as_ids(v, key, ids, begin):
    return pa.RecordBatch.from_arrays([key, tk.list_of(ids, begin, pa.int32())], names=["doc_id", "ids"])


def _as_digests(v, key, ids, begin):
    wide = ids.astype("<u4").tobytes()
    decoded = v.decode(ids, begin)
    return pa.RecordBatch.from_arrays(
        [
            key,
            pa.array(np.diff(begin), pa.int64()),
            pa.array([hashlib.sha256(wide[4 * a : 4 * b]).hexdigest() for a, b in zip(begin[:-1], begin[1:], strict=True)], pa.string()),
            pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
        ],
        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) of docs(doc_id, text)."""
    return _input(docs).mapInArrow(_encoder(path, pattern, "doc_id", _as_ids), "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, decoded (binary) of coded(doc_id, ids). Null ids are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            lists = batch.column("ids")
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(v.decode(ids, np.concatenate([[0], np.cumsum(size)])), pa.binary())], names=["doc_id", "decoded"])

    return coded.select("doc_id", "ids").mapInArrow(tk.frugal(run), "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, decodes the ids, and digests both where they are made."""
    return _input(docs).mapInArrow(_encoder(path, pattern, "doc_id", _as_digests), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
