"""Tables that driver and executors share, and the session's sizes."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open = threading.local()


def partitions(spark: SparkSession) -> int:
    """The session's width of a shuffle: the one knob that follows the data's size."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where the session names none and driver and executors are one process (tests)
    is one set here: other executors couldn't read it.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"/tmp/lodestrand-checkpoints-{uuid.uuid4().hex}"
        context.setCheckpointDir(named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; it goes when the session's JVM ends, or before by
    remove() or cleared()."""
    path = f"{shared_dir(spark)}/lodestrand-{what}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    for made in getattr(_open, "scopes", ()):
        made.append(path)
    return path


def settled(df: DataFrame, what: str) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends there,
    and lost executors take nothing along."""
    return settled_at(df, what)[0]


def settled_at(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """settled(), and the path of the table."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Removes a table that nothing will read any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[set[str]]:
    """Removes, at its end, what this thread has put into the shared folder in between, but
    for the paths in the set that it gives.  For work whose results are written elsewhere."""
    made, keep = [], set()
    _open.scopes = [*getattr(_open, "scopes", ()), made]
    try:
        yield keep
    finally:
        _open.scopes = _open.scopes[:-1]
        for path in made:
            if path not in keep:
                remove(spark, path)
