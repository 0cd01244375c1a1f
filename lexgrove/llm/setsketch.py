"""MinHash near-duplicates by SetSketch registers.

A document's set is its distinct shingles of five lower-cased words.  Its sketch has M registers; register i holds
``clip(floor(1 - log_BASE(x_i)), 0, TOP)`` where x_i is the least of the exponentially distributed values that the
set's shingles draw for that register: truncated, exponentially spaced minima.  Sketches merge by taking the greater
register, and two registers agree with a probability close to the Jaccard similarity.  Each shingle draws its values as
a Poisson process over the registers, in ascending order, and stops once it is above every register of its set: about
n + M ln M draws for a set of n shingles instead of n M.

Search: bands of registers are hashed to buckets; in each bucket members are compared with a hub, the links found are
joined to components, and members of different components of a bucket are compared pair by pair, block by block.  A pair is first judged by the
joint maximum-likelihood estimate of its similarity from both sketches and exact set sizes, with a margin of five
standard errors, and then confirmed on the full sets.

Defined results: null text is empty; a text without words links with nothing (component: itself); a row with a null
doc_id links with nothing; rows that repeat a doc_id are one document; equal sets are one class whatever their number.
Extra columns of the input are ignored.

Hot keys, be they a bucket, a hub, a component's label or a class of exact copies, are cut into parts (common.spread).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import components, cut, hot_in, hot_keys, release, spread

#: Registers, rows of a band, base, rate, largest register value.
M, ROWS, BASE, RATE, TOP = 200, 5, 1.001, 20.0, 65535
BANDS = M // ROWS
WIDTH, LINK_NUM, LINK_DEN = 5, 75, 100
#: Five standard errors of the share of equal registers at the threshold.
MARGIN = 5 * math.sqrt(0.75 * 0.25 / M)
#: Rounds against the hub of each bucket, which only spare work: 1 or 0.
HUB_ROUNDS = 1
#: Members of a block of a bucket; ids that are broadcast at most.
BLOCK, BROADCAST_IDS = 1024, 2_000_000
#: Pairs whose sketches are judged at once; memory of a task, not a limit.
AT_ONCE = 4_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def sketches(value: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Registers (uint16, one row for each set) of sets given as hashes, one set after another."""
    sets = len(begin) - 1
    least = np.full((sets, M), np.inf)
    flat = least.reshape(-1)
    doc = np.repeat(np.arange(sets), np.diff(begin))
    item, time = value, np.zeros(len(value))
    drawn = 0
    while len(item):
        k = int(np.clip(60_000 // len(item), 1, 128))
        r = tk.mix(item[:, None] + np.arange(drawn + 1, drawn + 1 + k, dtype=np.uint64) * _GOLD)
        at = time[:, None] + np.cumsum(-np.log(((r >> np.uint64(32)).astype(np.float64) + 0.5) / 2.0**32), axis=1) / (M * RATE)
        register = ((r & np.uint64(0xFFFFFFFF)) * np.uint64(M) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(flat, (doc[:, None] * M + register).reshape(-1), at.reshape(-1))
        time, drawn = at[:, -1], drawn + k
        open_ = np.unique(doc)
        limit = np.full(sets, -1.0)
        limit[open_] = least[open_].max(axis=1)
        more = time < limit[doc]
        item, time, doc = item[more], time[more], doc[more]
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(1.0 - np.log(least) / math.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of each pair, from registers that are greater, less and equal, and set sizes."""
    a, b = a.astype(np.int32), b.astype(np.int32)
    plus, minus = (a > b).sum(1), (a < b).sum(1)
    same = M - plus - minus
    u = na / (na + nb)
    v = 1.0 - u
    c, ln = (BASE - 1.0) / BASE, math.log(BASE)
    p = lambda x: -np.log1p(-np.clip(x, 0.0, 1.0) * c) / ln

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-300
        return plus * np.log(up + tiny) + minus * np.log(down + tiny) + same * np.log(np.maximum(1.0 - up - down, tiny))

    low, high = np.zeros(len(na)), np.minimum(u / v, v / u)
    for _ in range(40):  # the logarithm of the likelihood is concave
        x, y = low + (high - low) / 3, high - (high - low) / 3
        right = likelihood(x) < likelihood(y)
        low, high = np.where(right, x, low), np.where(right, high, y)
    return (low + high) / 2


@tk.frugal
def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in tk.slices(whole, "text", tk.KERNEL_BYTES):
            value, begin = tk.shingle_sets(tk.plain(batch.column("text")), WIDTH)
            n = np.diff(begin)
            total = lambda x: np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])
            one, two = total(tk.mix(value + np.uint64(1))), total(tk.mix(value ^ np.uint64(0x5851F42D4C957F2D)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array((one[begin[1:]] - one[begin[:-1]]).view(np.int64)),
                    pa.array((two[begin[1:]] - two[begin[:-1]]).view(np.int64)),
                    tk.binaries(sketches(value, begin).reshape(-1), np.arange(len(n) + 1) * M),
                ],
                names=["doc_id", "n_shingles", "k1", "k2", "sketch"],
            )


@tk.frugal
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in tk.slices(whole, "text", tk.KERNEL_BYTES):
            value, begin = tk.shingle_sets(tk.plain(batch.column("text")), WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column("node"), tk.binaries(value, begin)], names=["node", "items"])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (128 bits that stand for the set), sketch (M little-endian unsigned 16-bit registers)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_signatures, "doc_id long, n_shingles long, k1 long, k2 long, sketch binary")


@tk.frugal
def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, M) for c in ("sa", "sb"))
            na, nb = (batch.column(c).to_numpy().astype(np.float64) for c in ("na", "nb"))
            keep = joint_estimate(a, b, na, nb) >= LINK_NUM / LINK_DEN - MARGIN
            yield batch.select(["a", "b"]).filter(pa.array(keep))


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two full sets (sorted hashes) are as similar as asked."""
    both = np.concatenate([x, y])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return LINK_DEN * common >= LINK_NUM * (len(both) - common)


@tk.frugal
def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("ia").to_pylist(), batch.column("ib").to_pylist(), strict=True)
        keep = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in pairs]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of pairs (a, b) of class representatives whose sketches say that they may be as similar as asked."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    pairs = cut(pairs)
    return spread(pairs, side("a"), ["a"], hot_in(pairs, ["a"])).join(side("b"), "b").mapInArrow(_likely, "a long, b long")


_ROW = ("bucket", "x", "y", "side", "band", "node", "n", "component")
_ROW_SCHEMA = "bucket long, x int, y int, side int, band int, node long, n long, component long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables of whole runs of one (bucket, x, y), and where each run lies. A run holds two blocks at most."""

    def split(t: pa.Table) -> list[tuple[int, int]]:
        key = np.column_stack([t[c].to_numpy() for c in ("bucket", "x", "y")])
        edge = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        return list(zip(edge[:-1], edge[1:], strict=True))

    held = None
    for batch in batches:
        if batch.num_rows:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            *whole, (last, _) = split(t)
            held = t.slice(last)
            if whole:
                yield t.slice(0, last), whole
    if held is not None and held.num_rows:
        yield held, split(held)


def _pairs_inside(t: pa.Table, spans: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Likely pairs (i, j) of rows of different components in one run: all if x = y, else of side 0 with side 1.

    A pair that agrees in several bands is taken in the first of them only.
    """
    x, y, side, band, n, part = (t[c].to_numpy() for c in ("x", "y", "side", "band", "n", "component"))
    sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), "<u2").reshape(-1, M)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def judge():
        i, j = (np.concatenate(v) for v in zip(*waiting, strict=True))
        waiting.clear()
        keep = joint_estimate(sketch[i], sketch[j], n[i].astype(float), n[j].astype(float)) >= LINK_NUM / LINK_DEN - MARGIN
        i, j = i[keep], j[keep]
        first = (sketch[i] == sketch[j]).reshape(-1, BANDS, ROWS).all(2).argmax(1) == band[i]
        return i[first], j[first]

    for a, b in spans:
        if b - a < 2:
            continue
        same = x[a] == y[a]
        left, right = (np.arange(a, b), np.arange(a, b)) if same else (np.flatnonzero(side[a:b] == 0) + a, np.flatnonzero(side[a:b] == 1) + a)
        strip = max(1, 64 * AT_ONCE // max(1, len(right)))
        for begin in range(0, len(left), strip):
            i, j = (v.reshape(-1) for v in np.meshgrid(left[begin : begin + strip], right, indexing="ij"))
            fits = (part[i] != part[j]) & (n[i] * LINK_DEN >= n[j] * LINK_NUM) & (n[j] * LINK_DEN >= n[i] * LINK_NUM)
            if same:
                fits &= i < j
            i, j = i[fits], j[fits]
            for at in range(0, len(i), AT_ONCE):
                waiting.append((i[at : at + AT_ONCE], j[at : at + AT_ONCE]))
                if sum(len(v) for v, _ in waiting) >= AT_ONCE:
                    yield judge()
    if waiting:
        yield judge()


@tk.frugal
def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that have a likely partner in their run."""
    for t, spans in _blocks(batches):
        used = np.zeros(t.num_rows, bool)
        for i, j in _pairs_inside(t, spans):
            used[i] = used[j] = True
        yield from t.select(list(_ROW)).filter(pa.array(used)).to_batches()


@tk.frugal
def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of each run that their full sets confirm."""
    for t, spans in _blocks(batches):
        node, items = t["node"].to_numpy(), t["items"].to_pylist()
        for i, j in _pairs_inside(t, spans):
            keep = np.fromiter((alike(np.frombuffer(items[a], np.uint64), np.frombuffer(items[b], np.uint64)) for a, b in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i))
            i, j = node[i[keep]], node[j[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], names=["a", "b"])


def linked_inside(rest: DataFrame, nodes: DataFrame, docs: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Confirmed pairs (a, b) of different components among all members of each bucket of rest(bucket, band, node, n, component); hot: its hot buckets.

    A large bucket is cut into blocks of about BLOCK members and each pair of blocks is worked on by itself, so no task holds
    a whole bucket.  The largest component of a large bucket has blocks of its own, which meet the others' blocks but not each other: where a hub
    has gathered most of a bucket, the work grows with the bucket, not with its square.  Sketches are judged first; the full sets then go to those
    blocks alone that have a likely partner for them, once each; only confirmed pairs become rows.
    """
    parts = rest.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    size = parts.groupBy("bucket").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("c"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda x, small: F.expr(f"if(c <= {BLOCK}, {small}, ceil({x} / {BLOCK}))").cast("int")
    size = size.select("bucket", F.col("top.component").alias("main"), blocks("top.c", 0).alias("m"), blocks("(c - top.c)", 1).alias("o"))
    rows = spread(rest, size, ["bucket"], hot).withColumn("own", F.expr("if(component = main and m > 0, pmod(xxhash64(node, 3), m), m + pmod(xxhash64(node, 3), o))").cast("int"))
    pick = lambda x, y, side: ("bucket", x.alias("x"), y.alias("y"), F.lit(side).alias("side"), "band", "node", "n", "component")
    left = rows.withColumn("other", F.explode(F.expr("sequence(greatest(own, m), m + o - 1)"))).select(*pick(F.col("own"), F.col("other"), 0))
    right = rows.where("own > 0 and own >= m").withColumn("other", F.explode(F.expr("sequence(0, own - 1)"))).select(*pick(F.col("other"), F.col("own"), 1))
    by_run = lambda df: df.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    sketch = nodes.select("node", "sketch")
    wanted = cut(by_run(left.union(right).join(sketch, "node")).select(*_ROW, "sketch").mapInArrow(_wanted, _ROW_SCHEMA))
    release(docs.sparkSession)
    sets = full_sets(wanted.select("node"), docs)
    return cut(by_run(wanted.join(sketch, "node").join(sets, "node")).select(*_ROW, "sketch", "items").mapInArrow(_linked, "a long, b long"))


def full_sets(ends: DataFrame, docs: DataFrame) -> DataFrame:
    """node, items (sorted 64-bit hashes) of the documents in ends(node).

    The sets are made anew from their texts, so no set is kept or moved for any other document.  The ids, which may repeat, are counted: up
    to BROADCAST_IDS go to every executor, more are joined by shuffle.
    """
    ends = F.broadcast(ends) if ends.count() <= BROADCAST_IDS else ends.distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    return cut(texts.join(ends, "node", "left_semi").mapInArrow(_sets, "node long, items binary").dropDuplicates(["node"]))


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of pairs (a, b) of class representatives whose full sets are as similar as asked."""
    pairs = cut(pairs)
    sets = full_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), docs)
    have = lambda x: sets.select(F.col("node").alias(x), F.col("items").alias(f"i{x}"))
    # a hub has many pairs, another node one for each band at most
    return cut(spread(pairs, have("a"), ["a"], hot_in(pairs, ["a"])).join(have("b"), "b").mapInArrow(_confirm, "a long, b long"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text). See the module's text."""
    made = cut(signatures(docs))
    solid = made.where("n_shingles > 0 and doc_id is not null")
    classes = solid.groupBy("k1", "k2", F.col("n_shingles").alias("n")).agg(F.min(F.struct("doc_id", "sketch")).alias("r"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("c"))
    classes = cut(classes.select("k1", "k2", "n", F.col("r.doc_id").alias("node"), F.col("r.sketch").alias("sketch"), (F.col("low") < F.col("high")).alias("copied"), "c"))
    nodes = classes.select("node", "n", "sketch")
    bucket = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(substring(sketch, i * {2 * ROWS} + 1, {2 * ROWS}), i))")
    banded = nodes.select("node", "n", F.posexplode(bucket).alias("band", "bucket"))
    full = cut(banded.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"))
    hot = hot_keys(full, ["bucket"])
    shared = cut(spread(banded, full.select("bucket"), ["bucket"], hot))

    hub = shared.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("h")).select("bucket", F.col("h.node").alias("a"), F.col("h.n").alias("m"))
    fits = (F.col("n") * LINK_DEN >= F.col("m") * LINK_NUM) & (F.col("m") * LINK_DEN >= F.col("n") * LINK_NUM)
    pairs = spread(shared, hub, ["bucket"], hot).where((F.col("node") != F.col("a")) & fits).select("a", F.col("node").alias("b"))
    links = confirmed(likely((pairs if HUB_ROUNDS else pairs.where("false")).distinct(), nodes), docs)
    # these labels only spare pairs, so a few steps are enough
    label = components(links, rounds=2)
    release(docs.sparkSession)
    rest = cut(shared.join(label, "node", "left").withColumn("component", F.coalesce("component", "node")))
    links = links.union(linked_inside(rest, nodes, docs, hot))
    label = components(links, start=label)

    named = classes.join(label, "node", "left").select("k1", "k2", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"), "copied", "node")
    moved = named.where(F.col("copied") | (F.col("component_id") != F.col("node"))).select("k1", "k2", "n_shingles", F.col("component_id").alias("to"))
    key = ["k1", "k2", "n_shingles"]
    rows = spread(solid.select("doc_id", *key), moved, key, hot_keys(classes.withColumnRenamed("n", "n_shingles").select(*key, "c"), key), "left", numbered=True)
    rows = rows.select("doc_id", "n_shingles", F.coalesce("to", "doc_id").alias("component_id"))
    rows = rows.union(made.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
