"""Tables that outlive a job's lineage, for the text operators.

An intermediate result is written once, as Parquet, to the folder that the cluster names in `spark.checkpoint.dir`, and read
again from there: executors may be lost at any time without a long lineage being run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.shelf import Shelf as _Shelf


class Shelf(_Shelf):
    """Named tables of one operator call; large ones are compressed well, and dropped when no later step reads them."""

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def buckets(spark: SparkSession) -> int:
    """Hash buckets of a large exchange: as many as the session's shuffle partitions, which a user sizes to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
