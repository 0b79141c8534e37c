"""Cutting lineage in iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str | None:
    """`spark.checkpoint.dir`, or None in local mode; on a cluster without it this raises: executors would write to their
    own disks."""
    folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not folder and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


def settle(df: DataFrame) -> DataFrame:
    """df evaluated once and kept in the shared checkpoint folder; a temporary one only in local mode."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_folder(spark) or tempfile.mkdtemp(prefix="murmuration-"))
    return df.checkpoint()


def stored(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """df evaluated once and written as Parquet to the same folder, in folders of `by`: other than a checkpoint it has a known size, by which
    Spark chooses its joins. The files go when the session ends."""
    path = _place(df.sparkSession, "table")
    df.write.partitionBy(*by or []).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Latest:
    """The table of a loop that replaces it round by round: `put` is `stored`, and then deletes the files of the table before
    the last, so a loop keeps two tables whatever its rounds."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def put(self, df: DataFrame) -> DataFrame:
        spark, path = df.sparkSession, _place(df.sparkSession, "table")
        df.write.parquet(path)
        self.paths.append(path)
        for old in self.paths[:-2]:
            p = spark._jvm.org.apache.hadoop.fs.Path(old)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        self.paths = self.paths[-2:]
        return spark.read.schema(df.schema).parquet(path)


def stored_stream(df: DataFrame) -> DataFrame:
    """All that a stream has by now, run to its end and written like `stored`."""
    path = _place(df.sparkSession, "stream")
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", _place(df.sparkSession, "offsets")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that goes when the session ends."""
    root = _folder(spark) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = tempfile.mkdtemp(prefix="murmuration-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path
