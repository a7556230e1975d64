"""Shared helpers: tables in the shared folder, plain sizes, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; where the session names none, the warehouse, or a local folder in local mode."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base
    return tempfile.mkdtemp(prefix="spark-") if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir")


#: Bytes of rows that a Python worker gets at once, about; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, so that long texts don't fill a worker; rows alone would not."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


class Scratch:
    """Tables that cut lineage: each is written once in the shared folder and read from there.

    A lost executor costs only tasks of the running job, as finished tables stay in the folder.
    """

    def __init__(self, spark: SparkSession) -> None:
        bound_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        self._delete(*(df._scratch_path for df in frames))

    def close(self) -> None:
        """Delete all tables written here."""
        self._delete(self.root)

    def _delete(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A prefix that no column of ``df`` starts with."""
    while any(c.lower().startswith(name) for c in df.columns):
        name = "_" + name
    return name


def thinned(rows: DataFrame, n: int, most: int, *by: str) -> DataFrame:
    """About ``most`` of the ``n`` rows, those whose hash of ``by`` lies under a cut; all where there are no more.

    The cut follows from the count, so every task drops its rows by itself and nothing is ordered.
    Columns ``by`` have to tell rows apart.
    """
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(*by), F.lit(1 << 40)) < int((1 << 40) * (most / n)))


def running(df: DataFrame, keys: list[str], by: Column, ties: list[str], slices: Column | int, sums: dict[str, Column]) -> DataFrame:
    """Sums over the rows before each row of its key, in the order of the hash ``by`` and then ``ties``.

    A key's rows are cut into slices of the hash's range. Only one sum per slice is ordered by key;
    rows are ordered inside slices, so no key is gathered in one task.
    """
    df = df.withColumn("_by", by).withColumn("_slice", F.floor((F.col("_by").cast("double") / 2.0**64 + 0.5) * slices).cast("long"))
    per = df.groupBy(*keys, "_slice").agg(*[F.sum(v).alias(f"_{k}") for k, v in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(*keys, "_slice", *[F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_{k}") for k in sums])
    inside = Window.partitionBy(*keys, "_slice").orderBy("_by", *ties).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumns({k: F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in sums.items()}).join(base, [*keys, "_slice"])
    return out.withColumns({k: F.col(k) + F.col(f"_{k}") for k in sums}).drop("_by", "_slice", *[f"_{k}" for k in sums])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _all_stars(e: DataFrame) -> bool:
    """Whether every u of ``e(u, v)`` has one v, and no v is a u."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    roles = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not roles.where("up > 1 or (up = 1 and down = 1)").limit(1).count()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component``: each node of ``edges(a, b)`` with the smallest node it reaches.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until only stars are left.
    Every step is a partial minimum per node and an equi-join, so a hub of any degree is never
    gathered in one place. The result has no row for nodes without edges; it is empty for no edges.
    """
    e = scratch.save(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    while not _all_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .where("v != m")
            .select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        small = scratch.save(small, "stars")
        scratch.drop(e)
        e = small
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
