"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Unit vectors with cosine >= c are at most sqrt(2 - 2c) apart.  A cover tree has nested levels with halving radii: a node's
centre is also the centre of one of its children, children's centres are more than their level's radius apart, and each
node keeps its covering radius, the largest distance from its centre to what is below.  Two nodes can hold a linked pair
only if their centres' distance is at most the sum of both covering radii and the threshold distance; else the pair of nodes
is pruned with all below.

On the cluster: equal vectors are one class.  The upper levels are those of the cover tree of a bounded sample (SAMPLE rows in
all); of each label's the deepest level counts whose nodes hold FULL sampled rows on average and of whose node pairs at least half are
pruned, else the root alone.  Every class goes to its nearest node of its label, whose covering radius and size are then counted over all
rows.  Node pairs that survive pruning are cut into blocks of about BLOCK classes, and each pair of blocks is one task, which
builds the lower levels of both trees and traverses them level by level.  So where distances tell nothing (random directions in many
dimensions are all about as far apart) a vector goes to as many tasks as its label has blocks, and no upper level multiplies that.  A task returns what it found in a size that is
linear in its rows: a count for each class and a forest that connects what is linked, so a large group of near copies makes
no quadratic output.  A label without sampled rows has one unpruned node.

Defined results: a vector that is null, empty, zero or has a null or non-finite component links with nothing, nor does one
with a null label; vectors of different lengths never link; rows that repeat a vec_id count as vectors of their own in
n_links and share a component; a null vec_id links with nothing; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import components, cut, hot_keys, spread

SAMPLE, FULL, BLOCK = 2048, 8, 2048
#: Radius of the root's level; each level below halves it, down to LEAST.
ROOT, LEAST = 2.0, 0.25
#: More than the rounding of a distance that comes from a product of unit vectors.
SLACK = 1e-7


def distances(dot: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * dot, 0))


def net(dot: np.ndarray, radius: float) -> np.ndarray:
    """Greedy net: indices of centres more than radius apart that cover all points, whose products are given. The first point is one."""
    near = 1 - radius * radius / 2
    centres, left = [], np.arange(len(dot))
    while len(left):
        centres.append(left[0])
        left = left[dot[left[0], left] < near]
    return np.array(centres, np.int64)


class CoverTree:
    """Levels from the root down: centres (indices of points), parents, and covering radii; the last level is all points. It takes the square of the points in memory."""

    def __init__(self, points: np.ndarray):
        self.points = points
        n = len(points)
        dot = points @ points.T
        home = np.zeros(n, np.int64)  # node of each point at the level above
        radius = ROOT
        centres = np.zeros(1, np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(centres, np.zeros(1, np.int64), np.array([distances(dot[0]).max()]))]
        while radius / 2 >= LEAST and len(centres) < n:
            radius /= 2
            order = np.argsort(home, kind="stable")
            size = np.bincount(home, minlength=len(centres))
            end = np.cumsum(size)
            new_centres, parents, new_home = [centres[size == 1]], [np.flatnonzero(size == 1)], np.empty(n, np.int64)
            count = len(new_centres[0])
            new_home[new_centres[0]] = np.arange(count)  # a node of one point goes on as it is
            for node in np.flatnonzero(size > 1).tolist():
                members = order[end[node] - size[node] : end[node]]
                at = int(np.flatnonzero(members == centres[node])[0])
                members = np.concatenate([members[at : at + 1], members[:at], members[at + 1 :]])  # nested: the centre first
                own = dot if len(members) == n and at == 0 else dot[np.ix_(members, members)]
                chosen = net(own, radius)
                new_home[members] = count + own[:, chosen].argmax(1)
                new_home[members[chosen]] = count + np.arange(len(chosen))
                new_centres.append(members[chosen])
                parents.append(np.full(len(chosen), node))
                count += len(chosen)
            centres, home = np.concatenate(new_centres), new_home
            reach = np.zeros(len(centres))
            np.maximum.at(reach, home, distances(dot[np.arange(n), centres[home]]))
            self.levels.append((centres, np.concatenate(parents), reach))
        self.levels.append((np.arange(n), home, np.zeros(n)))


def survivors(points: np.ndarray, radii: np.ndarray, reach: float) -> np.ndarray:
    """Which pairs of nodes, by their centres and covering radii, can hold a pair within reach."""
    return distances(points @ points.T) <= radii[:, None] + radii[None, :] + reach


def upper(points: np.ndarray, reach: float) -> np.ndarray:
    """Centres of the sample's deepest level that is full enough and prunes half of its node pairs; else of the root."""
    for centres, _, radii in reversed(CoverTree(points).levels[1:]):
        if len(centres) * FULL <= len(points) and survivors(points[centres], radii, reach).mean() <= 0.5:
            return points[centres]
    return points[:1]


def linked(a: CoverTree, b: CoverTree, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs (of a's and b's points) with at least this cosine, by dual traversal."""
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    depth = max(len(a.levels), len(b.levels))

    def at(t: CoverTree, k: int):
        """Level k from the top; a tree that has fewer levels waits at its points."""
        if k < len(t.levels):
            return t.levels[k]
        n = len(t.points)
        return np.arange(n), np.arange(n), np.zeros(n)

    alive = np.ones((1, 1), bool)
    for k in range(depth):
        (ca, pa_, ra), (cb, pb, rb) = at(a, k), at(b, k)
        alive = alive[pa_][:, pb]
        rows, cols = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        here = alive[np.ix_(rows, cols)]
        if here.mean() < 0.05:  # few pairs are left: each by itself
            i, j = np.nonzero(here)
            dot = np.einsum("ij,ij->i", a.points[ca[rows[i]]], b.points[cb[cols[j]]])
            if k == depth - 1:
                hit = dot >= cosine
                return rows[i[hit]], cols[j[hit]]
            alive[rows[i], cols[j]] = distances(dot) <= ra[rows[i]] + rb[cols[j]] + reach
            continue
        dot = a.points[ca[rows]] @ b.points[cb[cols]].T
        if k == depth - 1:
            i, j = np.nonzero((dot >= cosine) & here)
            return rows[i], cols[j]
        alive[np.ix_(rows, cols)] = here & (distances(dot) <= ra[rows][:, None] + rb[cols][None, :] + reach)
    raise AssertionError


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For n nodes and edges (i, j), the least node that each is connected with."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        np.minimum.at(new, root[i], least)
        np.minimum.at(new, root[j], least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _task(cosine: float):
    def run(key, rows):
        out = {"a": [], "b": [], "n": []}
        for _, same in rows.groupby(rows["unit"].map(len)):  # vectors of one length
            left, right = same[same["side"] == 0], same[same["side"] == 1]
            if not len(left):
                continue
            one = CoverTree(np.stack(left["unit"].to_list()))
            if key[1] == key[2] and key[3] == key[4]:
                i, j = linked(one, one, cosine)
                i, j = i[i < j], j[i < j]
                other, shift = left, 0
            elif len(right):
                i, j = linked(one, CoverTree(np.stack(right["unit"].to_list())), cosine)
                other, shift = right, len(left)
            else:
                continue
            if not len(i):
                continue
            ids = np.concatenate([left["node"].to_numpy(), right["node"].to_numpy() if shift else []]).astype(np.int64)
            many = np.concatenate([left["many"].to_numpy(), right["many"].to_numpy() if shift else []]).astype(np.int64)
            j = j + shift
            count = np.bincount(i, many[j], len(ids)) + np.bincount(j, many[i], len(ids))
            root = forest(i, j, len(ids))
            for k in np.flatnonzero(count).tolist():
                out["a"].append(ids[k])
                out["b"].append(ids[root[k]])
                out["n"].append(int(count[k]))
        return pd.DataFrame(out).astype("int64")

    return run


@tk.frugal
def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision, of vectors already known to be finite and not zero."""
    for batch in batches:
        if batch.num_rows:
            units = [np.asarray(v, np.float64) for v in batch.column("vector").to_pylist()]
            units = [(v := u / np.abs(u).max()) / np.linalg.norm(v) for u in units]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("node", "label", "many")), pa.array(units, pa.list_(pa.float64()))], names=["node", "label", "many", "unit"])


def _assign(centres: dict[tuple[int, int], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, units = batch.column("label").to_pylist(), batch.column("unit").to_pylist()
            cell, apart = np.full(len(labels), -1), np.full(len(labels), ROOT)
            groups: dict[tuple[int, int], list[int]] = {}
            for k, (label, u) in enumerate(zip(labels, units, strict=True)):
                groups.setdefault((label, len(u)), []).append(k)
            for key, rows in groups.items():
                if (c := centres.get(key)) is not None:
                    d = distances(np.array([units[k] for k in rows]) @ c.T)
                    cell[rows] = d.argmin(1)
                    apart[rows] = d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(u) for u in units], pa.int32()), pa.array(cell, pa.int32()), pa.array(apart, pa.float64())], names=[*batch.schema.names, "dim", "cell", "apart"])

    return run


def near_duplicates(embeddings: DataFrame, cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of embeddings(vec_id, embedding, label). See the module's text."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    # a sum of magnitudes is null, NaN or infinite if a component is; a vector that overflows so is scaled down first
    big = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + F.abs(x * 1e-300))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(~F.isnan(big) & (big < float("inf")), F.lit(False)) & F.exists("vector", lambda x: x != 0.0)
    digest = F.sha2(F.array_join(F.transform("vector", lambda x: F.hex(F.when(x == 0.0, F.lit(0.0)).otherwise(x).cast("string"))), ","), 256)
    rows = cut(rows.select("vec_id", "label", "vector", F.coalesce(fit, F.lit(False)).alias("fit")).withColumn("same", F.when(F.col("fit"), digest)))
    classes = rows.where("fit").groupBy("label", "same").agg(F.min("vec_id").alias("least"), F.count("*").alias("many"), F.first("vector").alias("vector"))
    # a class has a number of its own, since rows that repeat a vec_id may be of several classes
    classes = cut(classes.select(F.monotonically_increasing_id().alias("node"), "least", "label", "many", "same", "vector"))
    units = classes.select("node", "label", "many", "vector").mapInArrow(_units, "node long, label long, many long, unit array<double>")

    sample = units.orderBy(F.xxhash64("node", F.lit(5)), "node").limit(SAMPLE).collect()
    grouped: dict[tuple[int, int], list] = {}
    for r in sample:
        grouped.setdefault((r.label, len(r.unit)), []).append(r.unit)
    reach = math.sqrt(2 - 2 * cosine) + SLACK
    centres = {key: upper(np.array(points), reach) for key, points in grouped.items()}
    placed = cut(units.mapInArrow(_assign(centres), "node long, label long, many long, unit array<double>, dim int, cell int, apart double"))
    cells = placed.groupBy("label", "dim", "cell").agg(F.count("*").alias("size"), F.max("apart").alias("radius"))
    cells = cells.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    sampled = {(r.label, r.dim, r.cell): r.radius for r in cells.where("cell >= 0").collect()}  # SAMPLE rows at most
    pairs = []
    for (label, dim), c in centres.items():
        radii = np.array([sampled.get((label, dim, x), -math.inf) for x in range(len(c))])  # a node without rows meets none
        pairs += [(label, dim, x, y) for x, y in np.argwhere(np.triu(survivors(c, radii, reach))).tolist()]
    known = spark.createDataFrame(pairs, "label long, dim int, a int, b int")
    alone = cells.where("cell < 0").select("label", "dim", F.col("cell").alias("a"), F.col("cell").alias("b"))
    size = lambda x: cells.select("label", "dim", F.col("cell").alias(x), F.col("blocks").alias(f"n{x}"))
    where = ["label", "dim", "cell"]
    hot = hot_keys(cells.select(*where, F.col("size").alias("c")), where)
    jobs = known.union(alone).join(size("a"), ["label", "dim", "a"]).join(size("b"), ["label", "dim", "b"])
    blocked = spread(placed, cells.select(*where, "blocks"), where, hot).withColumn("x", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    blocked = blocked.select("label", "dim", "cell", "x", "node", "many", "unit")
    left = spread(blocked, jobs.withColumnRenamed("a", "cell"), where, hot).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).where("cell <> b or y >= x")
    left = left.select("label", F.col("cell").alias("a"), "b", "x", "y", F.lit(0).alias("side"), "node", "many", "unit")
    right = spread(blocked.withColumnRenamed("x", "y"), jobs.withColumnRenamed("b", "cell"), where, hot).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).where("cell <> a or x < y")
    right = right.select("label", "a", F.col("cell").alias("b"), "x", "y", F.lit(1).alias("side"), "node", "many", "unit")
    found = cut(left.union(right).groupBy("label", "a", "b", "x", "y").applyInPandas(_task(cosine), "a long, b long, n long"))

    # hot keys: a class of many copies, a vec_id that many rows repeat, a component of many classes
    key = ["label", "same"]
    told = cut(spread(rows.where("fit").select("vec_id", *key), classes.select(*key, "node"), key, hot_keys(classes.select(*key, F.col("many").alias("c")), key), numbered=True).select("vec_id", "node"))
    twice = cut(told.groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count("*").alias("c")).where("a < z"))
    again = spread(told, twice.select("vec_id", "a"), ["vec_id"], hot_keys(twice.select("vec_id", "c"), ["vec_id"]), numbered=True).where("node <> a").select("a", F.col("node").alias("b"))
    label = components(found.select("a", "b").union(again))
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    named = cut(classes.select("node", "many", "least").join(counts, "node", "left").join(label, "node", "left").withColumn("component", F.coalesce("component", "node")))
    first = cut(named.groupBy("component").agg(F.min("least").alias("c0"), F.count("*").alias("c")))
    named = spread(named, first.select("component", "c0"), ["component"], hot_keys(first.select("component", "c"), ["component"]))
    named = named.select("node", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "c0")
    copies = hot_keys(classes.select("node", F.col("many").alias("c")), ["node"])
    out = spread(told, named, ["node"], copies, numbered=True).select("vec_id", F.col("n").cast("long").alias("n_links"), F.col("c0").alias("component_id"))
    out = out.union(rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
