"""Tables that outlive a job's lineage, in the folder that the cluster names in `spark.checkpoint.dir`."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a fresh temporary one only where none is set and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillon-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def _folder(spark: SparkSession, path: str):
    """A path of the session's file systems, and the one that it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def committed(spark: SparkSession, path: str) -> list[str]:
    """Folders right below a path whose writing has been completed, in the order of their names; none where the path isn't there."""
    at, fs = _folder(spark, path)
    if not fs.exists(at):
        return []
    below = [str(x.getPath().toString()) for x in fs.listStatus(at) if x.isDirectory()]
    return sorted(x for x in below if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{x}/_SUCCESS")))


class Shelf:
    """Named tables of one operator call, below one new folder of the shared directory."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")
