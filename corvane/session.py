"""Session helpers: the shared folder for written intermediates, and checked broadcasts."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the cluster names no folder (tests, a laptop).
LOCAL_SHARED_DIR = "file:///tmp/checkpoints/corvane"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one set for checkpoints.

    Where neither is set, a local folder on a local master; on a cluster an error, since executors don't see each other's disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or LOCAL_SHARED_DIR).rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, made and deleted again when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(place)
    store.deleteOnExit(place)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write `df` as Parquet to the shared folder and read it back.

    A lost executor then costs a re-read, not a recomputation.
    """
    path = scratch(df.sparkSession, label)
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only if `df` has at most `max_rows` rows; otherwise leave a shuffle join.

    `df` should be cheap to count (a written table).
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
