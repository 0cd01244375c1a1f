"""What the operators share: tables, checkpoints, connected components."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch from Spark to Python, where the session has the default (64 MB, held on both sides for each task).
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_DEFAULT = str(64 << 20)
#: Rows of one key of a join that a task takes; a key with more is cut into parts. Keys that are known to all tasks as cut, at most.
HOT, HOT_KEYS = 100_000, 200_000


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of BATCH_BYTES, unless the session names another size."""
    if spark.conf.get(_BATCH, _BATCH_DEFAULT).rstrip("b") == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder that the session names in spark.checkpoint.dir."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir names no folder; executors of a cluster need a shared one")
            folder = tempfile.mkdtemp(prefix="lexgrove-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Have the driver find what nothing refers to any more, so that executors delete the shuffle files and checkpoints of steps
    that are over. Else they stay until the driver's heap happens to fill."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def hot_keys(counts: DataFrame, on: list[str]) -> DataFrame | None:
    """on, parts: into how many parts keys of counts(on, c) are cut, for those with more than HOT rows; None if there are none.

    Of n rows at most n / HOT keys are that hot. Should they be more than HOT_KEYS, the bound of a broadcast, only the hotter ones
    are cut; the others then hold less than 2 / HOT_KEYS of the rows each.
    """
    least = HOT
    counts = cut(counts.where(F.col("c") > least))
    while (many := counts.where(F.col("c") > least).count()) > HOT_KEYS:
        least *= 2
    return counts.where(F.col("c") > least).select(*on, F.ceil(F.col("c") / least).cast("int").alias("parts")) if many else None


def hot_in(df: DataFrame, on: list[str]) -> DataFrame | None:
    """The hot keys of df, which is read once more for them."""
    return hot_keys(df.groupBy(*on).agg(F.count("*").alias("c")), on)


def spread(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame | None, how: str = "inner", numbered: bool = False) -> DataFrame:
    """left joined with right on the columns on, with the rows of left of a hot key dealt to its parts and those of right copied to each.

    A row's part follows from its values, so a task that runs again deals alike. numbered: rows of left may repeat, and it is a
    checkpoint, whose order is fixed: rows are dealt by their place.
    """
    if hot is None:
        return left.join(right, on, how)
    parts = F.coalesce("parts", F.lit(1))
    place = F.monotonically_increasing_id() if numbered else F.xxhash64(*left.columns)
    dealt = left.withColumn("place", place).join(F.broadcast(hot), on, "left").withColumn("part", F.pmod(F.xxhash64("place", F.lit(7)), parts).cast("int")).drop("parts", "place")
    copied = right.join(F.broadcast(hot), on, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return dealt.join(copied, [*on, "part"], how).drop("part")


def components(edges: DataFrame, src: str = "a", dst: str = "b", start: DataFrame | None = None, rounds: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable from each end of an edge.

    Hooking and jumping: in each round a node takes the least label of its neighbours' labels, and so does the node that its own label
    names, the root of its tree, so whole trees hang themselves below their least neighbour; then labels jump to their label's label.
    Labels only fall, each round is a few equi-joins on partially aggregated tables, and trees at least pair up in a round, whatever the order
    of ids along a chain: the number of rounds grows with the logarithm of the component.  Nodes without an edge are not returned.

    start: earlier labels of some nodes, from which to go on.  rounds: stop after so many, with labels that may not be the
    least yet; even then nodes of one label are connected.

    A node with many edges, and a label that many nodes have, are hot keys and cut into parts.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    both = cut(pairs.union(pairs.select("v", "u")).distinct())
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component"))
    if start is not None:
        known = start.select(F.col("node").alias("k"), F.col("component").alias("kc"))
        labels = labels.join(known, labels.node == known.k, "left").select("node", F.least("component", F.coalesce("kc", "component")).alias("component"))
    labels = cut(labels)
    crowded = labels.count() > HOT  # else no key can be hot
    hubs = hot_in(both, ["v"]) if crowded else None
    done = 0
    while True:
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("grand"))
        grown = spread(labels, up, ["component"], hot_in(labels, ["component"]) if crowded else None, "left").select("node", "component", F.coalesce("grand", "component").alias("grand"))
        grown = cut(grown)
        near = spread(both, grown.select(F.col("node").alias("v"), "grand"), ["v"], hubs).groupBy(F.col("u").alias("n")).agg(F.min("grand").alias("c"))
        low = cut(grown.join(near, grown.node == near.n, "left").select("node", "component", F.least("grand", F.coalesce("c", "grand")).alias("low")))
        hooked = low.groupBy(F.col("component").alias("root")).agg(F.min("low").alias("least"))
        step = cut(low.join(hooked, low.node == hooked.root, "left").select("node", "component", F.least("low", F.coalesce("least", "low")).alias("new")))
        done += 1
        labels = step.select("node", F.col("new").alias("component"))
        if done == rounds or not step.where("new <> component").limit(1).count():
            return labels
