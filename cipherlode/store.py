"""Tables in the folder that all executors share: they cut a plan's lineage and outlive lost executors."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_made: ContextVar[list[str] | None] = ContextVar("_made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where none is set (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: tables need a folder that all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, prefix: str) -> str:
    """A path in the shared folder, which alone() clears up after."""
    path = f"{shared_dir(spark)}/{prefix}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def settle(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """df written once to the shared folder and read again."""
    path = new_path(df.sparkSession, "settled")
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """df as a side of a join that is sorted and merged: never broadcast, since its rows grow with the tree, and Spark takes stored tables of narrow rows for far smaller than they are."""
    return df.hint("merge")


def alone(spark: SparkSession, build: Callable[[], DataFrame], codec: str = "snappy") -> DataFrame:
    """What build returns, stored; the tables that it stored on the way are deleted."""
    paths: list[str] = []
    token = _made.set(paths)
    try:
        made = build()
        _made.reset(token)
        return settle(made, codec)
    finally:
        if _made.get() is paths:
            _made.reset(token)
        for path in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
