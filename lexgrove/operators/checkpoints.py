"""The shared folder of an application, and tables that are computed once and kept there."""

from __future__ import annotations

import tempfile
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="lexgrove-")


def folder(spark: SparkSession) -> str:
    """A folder of this application's own; a machine-local one only where Spark runs in one process and names none."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder; executors of a cluster need a shared one")
        base = _own_folder(sc.applicationId)
    return f"{base.rstrip('/')}/lexgrove-{sc.applicationId}"


#: Bytes of an Arrow batch from Spark to Python, where the session has the default of 64 MB.
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Passages go to Python in batches of BATCH_BYTES, unless the session names another size."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, str(64 << 20)).rstrip("b") == str(64 << 20):
        spark.conf.set(name, str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()
