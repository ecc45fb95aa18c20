"""Shared scratch tables: lineage is cut by writing a table that every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from . import worker

#: Bytes of a row group, which a task holds in memory until it is full.
ROW_GROUP = 16 << 20


def shared_root(spark: SparkSession) -> str:
    """Folder the cluster names in spark.checkpoint.dir; where that is unset, a temporary one in local mode (tests), an error elsewhere."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = tempfile.mkdtemp(prefix="notemill-")
    spark.sparkContext.setCheckpointDir(f"file://{root}")
    return f"file://{root}"


class Scratch:
    """Tables of one run, in one folder of the shared root. All file access goes through Spark or Hadoop."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        self._fs(self.path).deleteOnExit(self._hadoop_path(self.path))

    def _hadoop_path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._hadoop_path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Write df as Parquet and return it read back, with its lineage cut."""
        path, schema = f"{self.path}/{name}", df.schema
        writer = df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP)
        for key, value in options.items():
            writer = writer.option(key.replace("__", "."), value)
        writer.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str) -> None:
        path = f"{self.path}/{name}"
        self._fs(path).delete(self._hadoop_path(path), True)

    def release(self) -> None:
        """Let the driver forget finished steps: their plans, broadcast tables and shuffle files, which Spark clears only once its garbage is collected."""
        worker.release()
        self.spark.sparkContext._jvm.System.gc()
