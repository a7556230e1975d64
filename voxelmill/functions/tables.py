"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where it names none, the warehouse, or a local folder in local mode."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    return tempfile.mkdtemp(prefix="spark-") if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir")


class Tables:
    """Writes intermediate results once, so that loops neither recompute nor lose them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/steps-{uuid.uuid4().hex}"
        self.written = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.written += 1
        path = f"{self.root}/{self.written}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kept_at = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete kept tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._kept_at)
            path.getFileSystem(conf).delete(path, True)
