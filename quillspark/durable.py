"""Cut points and scratch folders in the folder that a session's executors and driver share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .errors import StorageError


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local session without one gets a folder of its own, a cluster is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise StorageError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="quillspark-")


def cut(df: DataFrame) -> DataFrame:
    """df written to a reliable checkpoint, so that what follows reads it however often it is needed."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def tidy(spark: SparkSession) -> None:
    """Have the driver collect its garbage: until then its heap grows, and shuffle files and checkpoints that nothing needs any more stay on disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def workspace(spark: SparkSession):
    """A scratch path that is removed at the end: what is returned from inside must not read it any more (see cut())."""
    path = scratch(spark)
    try:
        yield path
    finally:
        remove(spark, path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting of the session that holds within the block only."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
