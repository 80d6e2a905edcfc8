"""Tables written once to the folder that driver and executors share.

A plan that builds on such a table stays small and reads only the columns it uses, and a
lost executor costs a reread.  The folder is the session's spark.checkpoint.dir.  Tables
live until `drop` or `release`, at the latest until the program ends.

Spark judges such a table by the size of its files, which for rows of few different values is
a small part of what they take in memory.  Joins of tables that both grow with the input
therefore ask for sorting (`hint("merge")`), else the driver would collect one side to
broadcast it.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths of this program's tables, stream results and logs that are not dropped yet.
_WRITTEN: set[str] = set()
#: Those of the running thread's `collected`.
_OWN: ContextVar[set[str] | None] = ContextVar("own", default=None)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder.

    Where the session names no folder, a local one is made if Spark runs on one machine
    (as in tests); on a cluster that is an error, since executors would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="verdigris-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    if (own := _OWN.get()) is not None:
        own.add(path)
    return path


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`df` as a Parquet table in the shared folder, read back, and the table's path."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """`store` without the path."""
    return store(df, "cut")[0]


def written() -> frozenset[str]:
    """Paths of all tables that are not dropped yet."""
    return frozenset(_WRITTEN)


@contextlib.contextmanager
def collected() -> Iterator[set[str]]:
    """The set of paths that this thread is given inside the block, and no other thread's."""
    own: set[str] = set()
    token = _OWN.set(own)
    try:
        yield own
    finally:
        _OWN.reset(token)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table of `store`, in whatever file system holds it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _WRITTEN.discard(path)
    if (own := _OWN.get()) is not None:
        own.discard(path)


def release(spark: SparkSession, keep: frozenset[str] = frozenset()) -> None:
    """Delete all tables but `keep`.  DataFrames that read a deleted one are of no use."""
    for path in written() - keep:
        drop(spark, path)


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the session may be gone by then
        if spark := SparkSession.getActiveSession():
            release(spark)
