"""Tables and files in the folder that all machines of a cluster share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of this machine only where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
    return root if "://" in root else "file://" + os.path.abspath(root)


class Scratch:
    """A folder of one run below the shared folder.

    ``table`` writes a DataFrame as Parquet and reads it back: lineage ends there, and lost
    executors cost no more than the stage that was running. ``drop`` deletes what no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str):
    """A pyarrow file system and the path in it: local, HDFS or an object store, by the scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
