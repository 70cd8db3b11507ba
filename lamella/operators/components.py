"""Connected components of edges, by alternating star steps over tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Where spark.checkpoint.dir points; a folder of our own only where it is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="lamella-arrays-"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for every node with an edge."""
    spark = edges.sparkSession
    root = f"{shared_folder(spark)}/components-{uuid.uuid4().hex}"

    def stored(df: DataFrame, k: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{k}")
        return spark.read.schema("u long, v long").parquet(f"{root}/{k}")

    def drop(k: int) -> None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{k}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    k = 0
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), k)
    state = None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        k += 1
        e = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), k)
        drop(k - 1)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
