"""Intermediate tables in the folder that all executors share.

Lineage is cut with written tables, never with local checkpoints, so that a lost executor costs
only the tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

#: Paths by scope, and the scope that new paths belong to.
_WRITTEN: dict[str, list[str]] = {}
_SCOPE = [""]


def shared_root(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; a temporary folder only in local mode, where driver and executors are one
    machine. On a cluster without that setting this raises: executors would write to their own disks."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="murmuration-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def unique() -> str:
    return uuid.uuid4().hex


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_root(spark)}/{label}-{unique()}"
    _WRITTEN.setdefault(_SCOPE[-1], []).append(path)
    # what no scope releases before goes with the session, as results may be read until then
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


#: Rows of narrow tables that one output file takes where their number is known beforehand; bytes of an operator's
#: input that stand for one file of each table it writes, and the files that a core of the cluster gets at least.
FILE_ROWS, FILE_BYTES, FILES_A_CORE = 250_000, 4 << 20, 4
_FILES: list[int | None] = [None]


def sized(work):
    """An operator whose intermediate tables get as many files as the size of its first argument asks for: small
    inputs don't leave hundreds of small files behind, however many partitions Spark is told to use."""

    @wraps(work)
    def run(docs: DataFrame, *more, **named):
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        _FILES.append(max(FILES_A_CORE * docs.sparkSession.sparkContext.defaultParallelism, -(-size // FILE_BYTES)))
        try:
            return work(docs, *more, **named)
        finally:
            _FILES.pop()

    return run


def materialize(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back; at most `rows` narrow rows go to no more files
    than they need, other tables to no more than `sized` says."""
    spark = df.sparkSession
    path = new_path(spark, label)
    files = _FILES[-1] if rows is None else max(1, -(-rows // FILE_ROWS))
    (df if files is None or files > 100_000 else df.coalesce(files)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(name: str) -> Iterator[None]:
    """Tables written inside belong to name."""
    _SCOPE.append(name)
    try:
        yield
    finally:
        _SCOPE.pop()


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession, name: str) -> None:
    """Delete the tables of a scope; call it when all that reads them has been written."""
    for path in _WRITTEN.pop(name, []):
        delete(spark, path)
