"""Prefix trie of conversations from an LCP-aware mergesort.

A conversation's key is the digests of its turns, 16 bytes each.  Keys are dealt by range of (key, conv_id), so copies of one
conversation, and conversations that share turns, spread over tasks however many they are.  Inside a task each Arrow batch is sorted
into a run whose items carry their LCP (turns shared with the item before); a loser tree merges the runs, and of two heads the one of
the longer LCP wins without a look at its turns; equal ones are compared from there on.  The merged stream keeps the open path on a
stack; where an item shares fewer turns than the path has, the nodes below are finished and leave with their counts.

Nodes on the path of a task's first or last item may go on in other tasks.  They leave as one summary row a task, and the summaries,
in order, pass through the same stack once more (a stream with as many rows as there are tasks).  What ended in such a node is hashed
from the tasks' lists of conv_ids, joined in order, only where it spans several tasks: a SHA-256 is one chain, so that stream is
sequential, with one list of a task in memory at a time.

Memory: a task holds the keys of its range (by TURNS), and a conversation is one row of 16 bytes and a length a turn.  Texts are
digested where the turns are sorted and go no further.

Defined results: turns are ordered by turn (nulls first), then role, then text; repeated rows are turns of their own; null role and
text are empty; rows with a null conv_id belong to no conversation; an empty table has no nodes, not even a root; other columns are
ignored.  Two turns are the same if 16 bytes of the SHA-256 of role and text are.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

WIDTH = 16
#: Turns of a task's range, about.
TURNS = 1_000_000


class Item(NamedTuple):
    key: bytes
    conv: int
    chars: list


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each turn's place among those of its conversation in this partition; rows are in order."""
    part, last, at = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        places = []
        for c in batch.column("conv_id").to_pylist():
            at = at + 1 if c == last else 0
            last = c
            places.append(at)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(places, pa.int64())], names=[*batch.schema.names, "part", "place"])


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), digest, chars of every turn. Turns are ordered by a range sort, so one conversation may span tasks."""
    spark = conversations.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")).where("conv_id is not null")
    ways = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["conv_id", "turn", "role", "text"]
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)), 1, WIDTH)
    rows = rows.repartitionByRange(ways, *order).sortWithinPartitions(*order).select("conv_id", digest.alias("digest"), F.length("text").cast("long").alias("chars"))
    rows = cut(rows.mapInArrow(_number, "conv_id long, digest binary, chars long, part int, place long"))
    ends = rows.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"), F.max(F.struct("conv_id", "place")).alias("end")).orderBy("part").collect()  # a row for each partition
    shift, before = [], (None, 0)
    for p in ends:
        more = before[1] if p.first == before[0] else 0
        if more:
            shift.append((p.part, p.first, more))
        before = (p.last, p.end.place + 1 + (more if p.first == p.last else 0))
    if not shift:
        return rows.drop("part")
    carried = spark.createDataFrame(shift, "part int, conv_id long, more long")
    return rows.join(F.broadcast(carried), ["part", "conv_id"], "left").select("conv_id", (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), "digest", "chars")


def rebuilt(rows: DataFrame, head: Column, base: Column, most: int) -> DataFrame:
    """conv_id, key, chars: the first head (at most most) turns of conversation base, then the conversation's own after its first head.

    rows: as turns() gives them, computed. head, base: of column conv_id. Every conv_id has a row.
    """
    convs = rows.select("conv_id").distinct().select("conv_id", head.alias("head"), base.alias("base"))
    heads = rows.where(F.col("place") < most).select(F.col("conv_id").alias("base"), F.col("place").alias("p"), "digest", "chars")
    taken = convs.join(heads, "base").where(F.col("p") < F.col("head")).select("conv_id", F.struct(F.lit(0).alias("own"), F.col("p").alias("place"), "digest", "chars").alias("t"))
    own = rows.where(F.col("place") >= head).select("conv_id", F.struct(F.lit(1).alias("own"), "place", "digest", "chars").alias("t"))
    none = convs.select("conv_id", F.lit(None).cast(own.schema["t"].dataType).alias("t"))
    all_ = taken.unionByName(own).unionByName(none).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return all_.select("conv_id", F.col("t.digest").alias("key"), F.col("t.chars").alias("chars"))


def shared(a: bytes, b: bytes, at: int) -> int:
    """Turns that two keys share from their beginning, of which the first at are known."""
    most = min(len(a), len(b)) // WIDTH
    step = 1
    while at < most:
        step = min(step, most - at)
        if a[at * WIDTH : (at + step) * WIDTH] == b[at * WIDTH : (at + step) * WIDTH]:
            at, step = at + step, 2 * step
        elif step == 1:
            break
        else:
            step //= 2
    return at


def sorted_run(items: list[Item]) -> list[tuple[Item, int]]:
    """Items in order, each with the turns that it shares with the one before."""
    items.sort()
    return [(x, shared(items[k - 1].key, x.key, 0) if k else 0) for k, x in enumerate(items)]


def merged(runs: list[list[tuple[Item, int]]]) -> Iterator[tuple[Item, int]]:
    """All items of sorted runs in order, each with the turns that it shares with the one before: a loser tree over LCPs."""
    runs = [r for r in runs if r]
    n = len(runs)
    if not n:
        return
    at = [0] * n
    head: list = [r[0][0] for r in runs]
    lcp = [0] * n  # of each head, with what was last put out

    def before(a: int, b: int) -> bool:
        """Whether the head of run a comes first; the other's LCP is then the one with it."""
        if head[a] is None or head[b] is None:
            return head[a] is not None
        if lcp[a] != lcp[b]:
            return lcp[a] > lcp[b]
        both = shared(head[a].key, head[b].key, lcp[a])
        first = head[a] < head[b]
        lcp[b if first else a] = both
        return first

    losers = [0] * n
    winner = [0] * (2 * n)
    winner[n:] = range(n)
    for k in range(n - 1, 0, -1):
        a, b = winner[2 * k], winner[2 * k + 1]
        a, b = (a, b) if before(a, b) else (b, a)
        winner[k], losers[k] = a, b
    top = winner[1] if n > 1 else 0
    while head[top] is not None:
        yield head[top], lcp[top]
        at[top] += 1
        head[top], lcp[top] = runs[top][at[top]] if at[top] < len(runs[top]) else (None, 0)
        k = (top + n) // 2
        while k:
            if before(losers[k], top):
                losers[k], top = top, losers[k]
            k //= 2


class Node:
    """A node of the open path. n, low, leaves, saved gather what has ended below it; what has closed waits for low, its parent's name."""

    __slots__ = ("chars", "children", "depth", "ends", "hash", "leaves", "left", "low", "n", "place", "saved", "spans", "waiting")

    def __init__(self, depth: int, chars: int, left: bool = False):
        self.depth, self.chars, self.left = depth, chars, left
        self.n = self.children = self.leaves = self.saved = self.ends = 0
        self.low: int | None = None
        self.hash = None
        self.waiting: list = []
        self.place: list = []  # where summaries have parts of it
        self.spans = 0  # summaries in which something ends in it

    def gather(self, n: int, low: int | None) -> None:
        self.n += n
        if low is not None and (self.low is None or low < self.low):
            self.low = low

    def close(self, parent: Node | None) -> tuple:
        """Its counts: conv_id, depth, n_convs, n_children, n_leaves, saved_tokens, digest of its ends; the parent has them too from now on."""
        self.leaves = self.leaves if self.children else 1
        self.saved += (self.n - 1) * self.chars
        if parent:
            parent.gather(self.n, self.low)
            parent.children += 1
            parent.leaves += self.leaves
            parent.saved += self.saved
        return (self.low, self.depth, self.n, self.children, self.leaves, self.saved)


_NODE = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: kind 0: a finished node; its parent's conv_id, or, where the parent is on an end's path, side and level of that.  1: a task's summary.
#: 2: conv_ids that end in the last node of a side's path, joined.
_OUT = f"kind int, part int, {_NODE}, parent_conv_id long, side int, level int, payload binary"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]
_SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("parent_conv_id", pa.int64()), ("side", pa.int32()), ("level", pa.int32()), ("payload", pa.binary())])
_EMPTY = hashlib.sha256().hexdigest()


def _rows(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 8192):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 8192], strict=True), schema, strict=True)], schema=schema)


def _summary(nodes: list[Node]) -> list:
    return [(x.n, x.low, x.children, x.leaves, x.saved, x.ends, x.hash.hexdigest() if x.hash else _EMPTY, x.chars) for x in nodes]


def _trie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of this task's range."""
    import pickle

    part = TaskContext.get().partitionId()
    runs = []
    for batch in batches:
        keys, convs, chars = (batch.column(k).to_pylist() for k in ("key", "conv_id", "chars"))
        runs.append(sorted_run([Item(b"".join(k), c, x) for k, c, x in zip(keys, convs, chars, strict=True)]))
    path: list[Node] = []
    left: list[Node] = []
    out: list[tuple] = []
    first = last = None
    tally = {0: [], 1: []}  # conv_ids that end with the first and with the last item's key

    def finish(node: Node, parent: Node) -> None:
        if node.left:  # may have begun in an earlier task: what it has gathered goes into the summary
            return
        counts = node.close(parent)
        out.extend((0, part, *w, node.low, None, None, None) for w in node.waiting)
        parent.waiting.append((*counts, node.hash.hexdigest() if node.hash else _EMPTY))

    for item, lcp in merged(runs):
        depth = len(item.key) // WIDTH
        if first is None:
            first, lcp = item, -1
        while len(path) > lcp + 1:
            node = path.pop()
            if path:
                finish(node, path[-1])
        for d in range(len(path), depth + 1):
            path.append(Node(d, item.chars[d - 1] if d else 0, item is first))
        if item is first:
            left = list(path)
        node = path[-1]
        node.gather(1, item.conv)
        node.hash = node.hash or hashlib.sha256()
        node.hash.update((b"," if node.ends else b"") + str(item.conv).encode())
        node.ends += 1
        if item.key == first.key:
            tally[0].append(item.conv)
        else:
            if last is None or last.key != item.key:
                tally[1] = []
            tally[1].append(item.conv)
        last = item
        if len(out) >= 50_000:
            yield from _rows(out, _SCHEMA)
            out = []
    if first is None:
        return
    right = [x for x in path if not x.left]
    nothing = (None,) * 7
    for side, nodes in ((0, left), (1, right)):
        for x in nodes:
            out += [(0, part, *w, None, side, x.depth, None) for w in x.waiting]
    out.append((1, part, *nothing, None, None, None, pickle.dumps((first.key, last.key, _summary(left), len(path) - len(right), _summary(right)))))
    out.append((2, part, *nothing, None, 0, len(left) - 1, ",".join(map(str, tally[0])).encode()))
    if right and right[-1].ends:
        out.append((2, part, *nothing, None, 1, right[-1].depth, ",".join(map(str, tally[1])).encode()))
    yield from _rows(out, _SCHEMA)


_PATHS = f"kind int, {_NODE}, parent_conv_id long, spans int, part int, side int, level int"
_PATHS_SCHEMA = pa.schema([("kind", pa.int32()), *list(_SCHEMA)[2:9], ("parent_conv_id", pa.int64()), ("spans", pa.int32()), ("part", pa.int32()), ("side", pa.int32()), ("level", pa.int32())])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes on the paths of all tasks' first and last items (kind 0), and which node each place of a summary is (kind 1), from the summaries in order."""
    import pickle

    path: list[Node] = []
    out: list[tuple] = []
    before = None

    def finish(node: Node, parent: Node | None) -> None:
        counts = node.close(parent)
        digest = node.hash if node.spans < 2 else None
        out.extend((0, *w[0], node.low, w[1], None, None, None) for w in node.waiting)
        out.extend((1, node.low, node.depth, *(None,) * 5, None, node.spans, *at) for at in node.place)
        row = ((*counts, digest or _EMPTY if node.spans < 2 else None), node.spans)
        if parent:
            parent.waiting.append(row)
        else:
            out.append((0, *row[0], None, row[1], None, None, None))

    def meet(part: int, side: int, depth: int, of: tuple) -> None:
        n, low, children, leaves, saved, ends, digest, chars = of
        if depth == len(path):
            path.append(Node(depth, chars))
        node = path[depth]
        node.gather(n, low)
        node.children += children
        node.leaves += leaves
        node.saved += saved
        if ends:
            node.spans += 1
            node.hash = digest
        node.place.append((part, side, depth))

    def shorten(size: int) -> None:
        while len(path) > size:
            node = path.pop()
            finish(node, path[-1] if path else None)

    for batch in batches:
        for part, payload in zip(batch.column("part").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            first, last, left, both, right = pickle.loads(payload)
            shorten(0 if before is None else shared(before, first, 0) + 1)
            for d, of in enumerate(left):
                meet(part, 0, d, of)
            shorten(both)
            for d, of in enumerate(right):
                meet(part, 1, both + d, of)
            before = last
            yield from _rows(out, _PATHS_SCHEMA)
            out.clear()
    shorten(0)
    yield from _rows(out, _PATHS_SCHEMA)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's lists, which come in order."""
    at, h, out = None, None, []
    for batch in batches:
        for conv, depth, payload in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "depth", "payload")), strict=True):
            if (conv, depth) != at:
                if at:
                    out.append((*at, h.hexdigest()))
                at, h = (conv, depth), hashlib.sha256(payload)
            else:
                h.update(b"," + payload)
    if at:
        out.append((*at, h.hexdigest()))
    yield from _rows(out, pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("chained", pa.string())]))


def trie(keys: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of the nodes of keys(conv_id, key array<binary>, chars array<long>)."""
    spark = keys.sparkSession
    keys = cut(keys)
    total = keys.agg(F.sum(F.size("key") + 1)).first()[0] or 0
    ways = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), total // TURNS)
    rows = cut(keys.repartitionByRange(ways, "key", "conv_id").mapInArrow(_trie, _OUT))
    summaries = rows.where("kind = 1").select("part", "payload").coalesce(1).sortWithinPartitions("part")  # a row for each task
    paths = cut(summaries.mapInArrow(_paths, _PATHS))
    counts = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = rows.where("kind = 0 and side is null").select(*counts)
    place = paths.where("kind = 1").select("part", "side", "level", F.col("conv_id").alias("c"), F.col("depth").alias("d"), "spans")
    below = rows.where("kind = 0 and side is not null").drop("parent_conv_id").join(place, ["part", "side", "level"]).withColumn("parent_conv_id", F.col("c")).select(*counts)
    lists = rows.where("kind = 2").select("part", "side", "level", "payload").join(place.where("spans > 1"), ["part", "side", "level"]).select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), "part", "payload")
    chained = lists.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "part").mapInArrow(_chain, "conv_id long, depth long, chained string")
    ends = paths.where("kind = 0").join(chained, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", "chained")).select(*counts)
    return whole.unionByName(below).unionByName(ends)


def prefix_trie(conversations: DataFrame, head: Column, base: Column, most: int) -> DataFrame:
    """The trie of conversations(conv_id, turn, role, text), each rebuilt with the first head turns (at most most) of conversation base."""
    return trie(rebuilt(turns(conversations), head, base, most))
