"""Arrays made from the driver's tables: the inputs of the registered queries, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 64
IMG = """img AS (
  SELECT CAST(vec_id AS INT) AS y, CAST(i - 1 AS INT) AS x, CAST(floor((CAST(embedding[i] AS DOUBLE) + 1) * 127) AS BIGINT) AS v
  FROM embeddings, range(1, 65) r(i)
), dims AS (SELECT max(y) + 1 AS ny, max(x) + 1 AS nx FROM img)"""
#: A second operand of the same shape: the mirrored rows; w is small and positive.
IMG2 = IMG + ", img2 AS (SELECT CAST((SELECT ny FROM dims) - 1 - y AS INT) AS y, x, v, 1 + v % 7 AS w FROM img)"
NAN = IMG + ", nanimg AS (SELECT y, x, CASE WHEN v % 11 = 0 THEN CAST('nan' AS DOUBLE) ELSE CAST(v AS DOUBLE) END AS v FROM img)"
CUBE = """cube AS (
  SELECT CAST(c AS INT) AS c, CAST(t AS INT) AS t, CAST(x AS INT) AS x, CAST(coalesce(n, 0) AS BIGINT) AS v
  FROM (SELECT c.c, t.t, x.x FROM range(0, 5) c(c), range(0, 30) t(t), range(0, 24) x(x))
  LEFT JOIN (
    SELECT CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS c,
           date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t, extract('hour' FROM ts) AS x, count(*) AS n
    FROM events GROUP BY ALL
  ) USING (c, t, x)
)"""
CUBE_SHAPE = (5, 30, 24)


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, x, v): an integer image, one row of pixels per embedding."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "f"))
    return e.select("y", "x", F.floor((F.col("f").cast("double") + 1) * 127).alias("v"))


def height(spark: SparkSession, sf_dir: str) -> int:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").agg(F.max("vec_id")).first()[0] + 1


def mirrored(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = height(spark, sf_dir)
    return image(spark, sf_dir).select((n - 1 - F.col("y")).cast("int").alias("y"), "x", "v")


def nan_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("v") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("v").cast("double"))
    return image(spark, sf_dir).withColumn("v", v)


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c, t, x, v): events by type, day and hour, dense."""
    from ..operators.grid import densify

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kinds = F.array_position(F.array(*(F.lit(k) for k in ("click", "error", "purchase", "signup", "view"))), F.col("event_type"))
    e = e.select((kinds - 1).cast("int").alias("c"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01")).alias("t"), F.hour("ts").alias("x"))
    return densify(e.groupBy("c", "t", "x").agg(F.count(F.lit(1)).alias("v")), "ctx", CUBE_SHAPE)
