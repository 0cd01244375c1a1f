"""Where an application keeps what it builds: in the folder that the session names in spark.checkpoint.dir, which all executors share."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import index as I
from .checkpoints import cut, folder  # noqa: F401


def version(spark: SparkSession, path: str) -> str:
    """What a table's files look like: their number, bytes and latest change, as one short string with the path's."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length", "modificationTime")
    row = files.agg(F.count("*"), F.sum("length"), F.max("modificationTime")).first()
    return hashlib.sha256(repr((path, *row)).encode()).hexdigest()[:24]


def kept_index(passages: DataFrame, source: str, stemmed: bool = True, clustered: bool = False) -> I.Index:
    """The saved index of passages, which come from the files under source: built at first, read from then on, built anew if the files have changed."""
    spark = passages.sparkSession
    path = f"{folder(spark)}/index-{version(spark, source)}-{'stemmed' if stemmed else 'plain'}"
    return I.load_if_there(spark, path) or I.save(I.build(passages, stemmed, clustered), path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df, dealt over all cores if its files give fewer tasks than that; a larger table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
