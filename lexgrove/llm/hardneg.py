"""Hard negatives by exact search over K-means inverted lists with stored radii.

Centroids come from a bounded sample (the SAMPLE rows of smallest hash); every row is indexed.  A list's rows lie in order of their
distance from the centroid and are cut into shells of SHELL rows, and shells into cells of CELL rows, so a list of any size is many
small rows of a table.  For an anchor a and rows x of a shell with radius r around centroid c, Cauchy-Schwarz gives
``|<a, x> - <a, c>| <= |a| r``, both an upper and a lower bound.

A search has a window [low, high] of scores and wants the k best in it.  It visits the FIRST lists of the highest upper bound, and
then, with the kth score known, the others in order of their bounds: a list whose bounds lie outside the window is skipped, and the
search stops where the upper bound is strictly below the kth score (a tie may still win by its smaller vec_id).  Inside a list, shells
are visited from the outermost inwards under the same rules.  So results are exact, whatever the centroids are.

On the cluster: lists to visit are found for each anchor from the K centroids and radii (a bounded broadcast); anchors meet a list's
cells in a grouped join, at most about ANCHORS of them in one group; the best k of each search of a group are reduced by a window.

Defined results: rows with a null vec_id, label or vector or a null or non-finite component take no part, nor do those whose norm is
2**31 or more, whose scores may not fit a long; of rows that share a vec_id the one of smallest (label, vector) counts; a shorter
vector ends in zeros; ties go to the smaller vec_id; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Lists at most; rows a list is meant to have; rows and numbers of the sample; rounds of K-means.
LISTS, ROWS_A_LIST, SAMPLE, SAMPLE_NUMBERS, ROUNDS = 256, 256, 16_384, 4_000_000, 8
#: Rows of a shell and of a cell; anchors of a group; lists that are visited before a kth score is known.
SHELL, CELL, ANCHORS, FIRST = 1024, 32_768, 4096, 4
#: No bound, below and above.
NONE, ALL = -(1 << 63), (1 << 63) - 1


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, v of the rows(vec_id long, label, v array<long>) that take part, one for each vec_id."""
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = rows.where("vec_id is not null and label is not null and v is not null").where(~F.exists("v", lambda x: x.isNull())).where(norm2 < 4.0**31)
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", F.col("r.label").cast("long").alias("label"), "r.v")


def matrix(lists, width: int, kind=np.float64) -> np.ndarray:
    """Lists of numbers as rows of a matrix, padded with zeros."""
    out = np.zeros((len(lists), width), kind)
    for k, x in enumerate(lists):
        out[k, : min(len(x), width)] = x[:width]
    return out


def centroids(rows: DataFrame, count: int, width: int) -> np.ndarray:
    """K-means (Lloyd) over the sample, K by the number of rows."""
    size = max(1, min(SAMPLE, SAMPLE_NUMBERS // max(1, width)))
    got = rows.select(F.xxhash64("vec_id").alias("h"), "vec_id", "v").orderBy("h", "vec_id").limit(size).select("v").toArrow()
    x = matrix(got.column("v").to_pylist(), width)
    if not len(x):
        return np.zeros((1, width))
    k = max(1, min(LISTS, count // ROWS_A_LIST, len(x)))
    c = x[:k].copy()
    for _ in range(ROUNDS):
        near = np.argmin((c * c).sum(1)[None, :] - 2 * x @ c.T, axis=1)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def _vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    v = batch.column("v")
    sizes = np.diff(v.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return v.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), width).astype(np.float64)
    return matrix(v.to_pylist(), width)


def _assign(c: np.ndarray, width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x = _vectors(batch, width)
                near = np.argmin((c * c).sum(1)[None, :] - 2 * x @ c.T, axis=1)
                far = np.sqrt(((x - c[near]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(far), *batch.columns], names=["list", "far", "vec_id", "label", "v"])

    return run


_SHELLS = "list int, cell long, near double, far double, n int, ids binary, labels binary, vectors binary"


def _shells(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, state = [], [None, 0, -1]  # rows of the open shell; its list, rows in the open cell, number of the cell

        def close() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            far = rows.column("far").to_numpy()
            order = np.argsort(rows.column("vec_id").to_numpy(), kind="stable")
            ids, labels = (rows.column(k).to_numpy()[order].astype(np.int64) for k in ("vec_id", "label"))
            x = _vectors(rows, width)[order].astype(np.int32)
            values = (state[0], (part << 32) + state[2], float(far.min()), float(far.max()), len(ids), ids.tobytes(), labels.tobytes(), x.tobytes())
            kinds = (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=[x.split()[0] for x in _SHELLS.split(", ")])

        have = 0
        for batch in batches:
            lists = batch.column("list").to_numpy()
            at = 0
            while at < len(lists):
                if lists[at] != state[0] or state[1] >= CELL:
                    if held:
                        yield close()
                    state[:], have = [int(lists[at]), 0, state[2] + 1], 0
                end = int(np.searchsorted(lists, lists[at], side="right"))  # rows are in order of their lists
                end = min(end, at + SHELL - have)
                held.append(batch.slice(at, end - at))
                have, state[1], at = have + end - at, state[1] + end - at, end
                if have == SHELL:
                    yield close()
                    have = 0
        if held:
            yield close()

    return run


class Lists:
    """The index: shells (a table), centroids, and each list's greatest radius."""

    def __init__(self, rows: DataFrame):
        """rows: as usable() gives them, already computed."""
        spark = rows.sparkSession
        one = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
        self.count, self.width = one.n, max(1, one.width or 0)
        self.centroids = centroids(rows, self.count, self.width)
        ways = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), self.count // (4 * CELL))
        near = cut(rows.select("vec_id", "label", "v").mapInArrow(_assign(self.centroids, self.width), "list int, far double, vec_id long, label long, v array<long>"))
        dealt = near.repartitionByRange(ways, "list", "far", "vec_id").sortWithinPartitions("list", "far", "vec_id")
        self.shells = cut(dealt.mapInArrow(_shells(self.width), _SHELLS))
        self.cells = self.shells.select("list", "cell").distinct()
        self.radius = np.full(len(self.centroids), -1.0)
        for r in self.shells.groupBy("list").agg(F.max("far").alias("far")).collect():  # a row for each list
            self.radius[r.list] = r.far


def bounds(a: np.ndarray, c: np.ndarray, radius) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower bounds of the scores of anchors a with rows within radius of c, wide enough for rounding."""
    norm = np.sqrt((a * a).sum(1))
    mid = a @ c.T
    reach = norm[:, None] * np.atleast_1d(radius)[None, :]
    slack = 1e-9 * (np.abs(mid) + reach + 1) + 1e-9 * norm[:, None] * np.sqrt((np.atleast_2d(c) ** 2).sum(1))[None, :]
    return mid + reach + slack, mid - reach - slack


def _visits(lists_c: np.ndarray, radius: np.ndarray, width: int, first: bool) -> Callable:
    """The lists that each anchor visits: the FIRST of the highest bounds, or those after them that may still hold one of its results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                upper, lower = bounds(_vectors(batch, width), lists_c, np.maximum(radius, 0))
                upper[:, radius < 0] = -np.inf
                place = np.argsort(np.argsort(-upper, axis=1, kind="stable"), axis=1, kind="stable")
                low, high, kth = (_vectors_of(batch, n) for n in ("low", "high", "kth"))
                least = np.maximum(low, kth).astype(np.float64)
                some = ((upper[:, None, :] >= least[:, :, None]) & (lower[:, None, :] <= high.astype(np.float64)[:, :, None])).any(1)
                some &= (place < FIRST) if first else (place >= FIRST)
                some[:, radius < 0] = False
                who, which = np.nonzero(some)
                if len(who):
                    yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), *(col.take(pa.array(who)) for col in batch.columns)], names=["list", *batch.schema.names])

    return run


def _vectors_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """Arrays of one length as a matrix of longs; a missing place of a shorter one searches nothing."""
    lists = batch.column(name).to_pylist()
    width = max(map(len, lists), default=0)
    fill = {"low": ALL, "high": NONE, "kth": ALL}[name]
    return np.array([[fill if v is None else v for v in x] + [fill] * (width - len(x)) for x in lists], np.int64).reshape(len(lists), width)


_FOUND = "anchor_id long, search int, score long, vec_id long"


def best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each q by score, highest first, then id."""
    order = np.lexsort((ids, -score, q))
    q, score, ids = q[order], score[order], ids[order]
    begin = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.r_[begin, len(q)]))
    keep = rank < k
    return q[keep], score[keep], ids[keep]


def _search(lists_c: np.ndarray, width: int, same: bool, k: int) -> Callable:
    """The best k of each search of a group of anchors in one cell."""

    def run(anchors: pd.DataFrame, shells: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"anchor_id": np.zeros(0, np.int64), "search": np.zeros(0, np.int32), "score": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64)})
        if not len(anchors) or not len(shells):
            return empty
        a = matrix(list(anchors["v"]), width)
        batch = pa.RecordBatch.from_pandas(anchors[["low", "high", "kth"]], preserve_index=False)
        low, high, kth = (_vectors_of(batch, n) for n in ("low", "high", "kth"))
        own, searches = anchors["label"].to_numpy(np.int64), low.shape[1]
        ids_of = anchors["anchor_id"].to_numpy(np.int64)
        norm = math.sqrt(float((a * a).sum(1).max(initial=0)))
        q, score, found = (np.zeros(0, np.int64) for _ in range(3))
        c = lists_c[int(shells["list"].iloc[0])][None, :]
        for r in shells.sort_values("far", ascending=False).itertuples():
            upper, lower = bounds(a, c, r.far)
            need = np.maximum(low, kth)
            open_ = (upper >= need.astype(np.float64)) & (lower <= high.astype(np.float64))
            active = np.flatnonzero(open_.any(1))
            if not len(active):
                continue
            ids, labels = np.frombuffer(r.ids, np.int64), np.frombuffer(r.labels, np.int64)
            x = np.frombuffer(r.vectors, np.int32).reshape(r.n, width)
            exact = norm * math.sqrt(float((x.astype(np.float64) ** 2).sum(1).max(initial=0))) < 2.0**52
            for at in range(0, len(active), 256):
                some = active[at : at + 256]
                s = (a[some] @ x.astype(np.float64).T).astype(np.int64) if exact else a[some].astype(np.int64) @ x.astype(np.int64).T
                fit = (labels[None, :] == own[some][:, None]) == same
                fit &= ids[None, :] != ids_of[some][:, None]
                for j in range(searches):
                    ok = fit & (s <= high[some, j][:, None]) & (s >= need[some, j][:, None])
                    if not ok.any():
                        continue
                    if r.n > k:
                        value = np.where(ok, s, NONE)
                        ok &= s >= np.partition(value, r.n - k, axis=1)[:, r.n - k][:, None]
                    who, which = np.nonzero(ok)
                    q, score, found = (np.concatenate(x) for x in ((q, some[who] * searches + j), (score, s[who, which]), (found, ids[which])))
            q, score, found = best(q, score, found, k)
            full = np.bincount(q, minlength=a.shape[0] * searches) >= k
            worst = np.full(a.shape[0] * searches, NONE)
            last = np.flatnonzero(np.r_[q[1:] != q[:-1], True]) if len(q) else np.zeros(0, np.int64)
            worst[q[last]] = score[last]
            kth = np.maximum(kth, np.where(full, worst, NONE).reshape(kth.shape))
        return pd.DataFrame({"anchor_id": ids_of[q // searches], "search": (q % searches).astype(np.int32), "score": score, "vec_id": found}) if len(q) else empty

    return run


def _visit(anchors: DataFrame, index: Lists, same: bool, k: int, first: bool, ways: int) -> DataFrame:
    """What anchors(anchor_id, label, v, low, high, kth) find in the lists of one turn of visits."""
    schema = "list int, anchor_id long, label long, v array<long>, low array<long>, high array<long>, kth array<long>"
    asked = anchors.select("anchor_id", "label", "v", "low", "high", "kth").mapInArrow(_visits(index.centroids, index.radius, index.width, first), schema)
    asked = cut(asked.join(index.cells, "list").withColumn("chunk", F.pmod(F.xxhash64("anchor_id"), F.lit(ways)).cast("int")).drop("list"))
    wanted = asked.select(F.col("cell").alias("at"), F.col("chunk").alias("of")).distinct()
    shells = index.shells.join(wanted, F.col("cell") == F.col("at")).select("at", "of", "list", "far", "n", "ids", "labels", "vectors")
    return asked.groupBy("cell", "chunk").cogroup(shells.groupBy("at", "of")).applyInPandas(_search(index.centroids, index.width, same, k), _FOUND)


def find(anchors: DataFrame, index: Lists, same: bool, k: int) -> DataFrame:
    """anchor_id, search (from 0), rank (from 1), vec_id, score: the first k rows of each window of anchors(anchor_id, label, v, low, high).

    same: rows of the anchor's label, itself left out, or else those of other labels.
    """
    anchors = cut(anchors)
    ways = max(1, math.ceil(anchors.count() / ANCHORS))
    by = Window.partitionBy("anchor_id", "search").orderBy(F.col("score").desc(), "vec_id")
    top = lambda df: df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    begun = cut(top(_visit(anchors.withColumn("kth", F.transform("low", lambda _: F.lit(NONE))), index, same, k, True, ways)))
    full = begun.where(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("search", "score"))).alias("m"))
    known = F.transform("low", lambda _, j: F.coalesce(F.try_element_at("m", j), F.lit(NONE)))
    rest = anchors.join(full, "anchor_id", "left").withColumn("kth", F.when(F.col("m").isNull(), F.transform("low", lambda _: F.lit(NONE))).otherwise(known)).drop("m")
    return cut(top(begun.drop("rank").unionByName(_visit(rest, index, same, k, False, ways))))


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows(vec_id, label, v array<long>).

    An anchor's positives are its first other rows of its label; a positive's negatives the first rows of other labels whose score lies
    between share of the positive's (numerator, denominator) and the positive's.
    """
    rows = cut(usable(rows))
    index = Lists(rows)
    anchors = rows.where(is_anchor).select(F.col("vec_id").alias("anchor_id"), "label", "v")
    asked = anchors.withColumns({"low": F.array(F.lit(NONE)), "high": F.array(F.lit(ALL))})
    positive = find(asked, index, True, positives).select("anchor_id", (F.col("rank") - 1).alias("search"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    least, most = share
    p = F.col("positive_score").cast("decimal(38,0)")
    low = F.ceil(p * least / most).cast("long")
    windows = positive.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("search", low.alias("low"), F.col("positive_score").alias("high")))).alias("w"))
    asked = anchors.join(windows, "anchor_id").select("anchor_id", "label", "v", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    negative = find(asked, index, False, negatives).select("anchor_id", "search", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positive.join(negative, ["anchor_id", "search"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
