"""Statistics of moving boxes with reflected edges; exact zeros count as machine epsilon.

The local variance is the mean of squared deviations, each from its own element's local mean.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import median_filter, percentile_filter, unzero
from .neighbourhood import box


def local_statistics(df: DataFrame, axes: str, shape: tuple[int, ...], size: tuple[int, ...]) -> DataFrame:
    """Columns v, u (v without zeros), total, mean, var, std, low, high, midpoint, contrast and square (mean of squares)."""
    n = math.prod(size)
    df = df.select(*axes, F.col("v").cast("double").alias("v"), unzero(F.col("v")).alias("u"))
    df = df.withColumn("u2", F.col("u") * F.col("u"))
    df = box(df, axes, shape, size, {"total": ("u", F.sum), "low": ("u", F.min), "high": ("u", F.max), "squares": ("u2", F.sum)})
    df = df.withColumn("mean", F.col("total") / n)
    df = df.withColumn("dev", F.pow(F.col("u") - F.col("mean"), F.lit(2.0)))
    df = box(df, axes, shape, size, {"var": ("dev", F.sum)})
    return df.select(*axes, "v", "u", "total", "mean", (F.col("var") / n).alias("var"), F.sqrt(F.greatest(F.col("var"), F.lit(0.0)) / n).alias("std"), "low", "high",
                     ((F.col("high") + F.col("low")) / 2).alias("midpoint"), (F.col("high") - F.col("low")).alias("contrast"), (F.col("squares") / n).alias("square"))


def statistic(df: DataFrame, axes: str, shape: tuple[int, ...], size: tuple[int, ...], name: str) -> DataFrame:
    """One of: sum, mean, variance, std, contrast, midpoint, minimum, maximum."""
    column = {"sum": "total", "variance": "var", "minimum": "low", "maximum": "high"}.get(name, name)
    return local_statistics(df, axes, shape, size).select(*axes, F.col(column).alias("v"))


def weighted_midpoint(df, axes, shape, size, most: float = 1, least: float = 1) -> DataFrame:
    """(most * maximum + least * minimum) / (most + least) of the box, zeros as they are."""
    out = box(df.select(*axes, F.col("v").cast("double").alias("v")), axes, shape, size, {"low": ("v", F.min), "high": ("v", F.max)})
    return out.select(*axes, ((F.col("high") * most + F.col("low") * least) / (most + least)).alias("v"))


def interquartile(df, axes, shape, size, p0: float = 25, p1: float = 75) -> DataFrame:
    df = df.select(*axes, unzero(F.col("v")).alias("v"))
    a = percentile_filter(df, axes, shape, p1, size)
    return a.join(percentile_filter(df, axes, shape, p0, size).withColumnRenamed("v", "b"), list(axes)).select(*axes, (F.col("v") - F.col("b")).alias("v"))


def skewness(df, axes, shape, size, pearson: bool = False) -> DataFrame:
    """(mean - median) / std, 0 where std is 0; Pearson's is three times that."""
    stats = local_statistics(df, axes, shape, size).select(*axes, "mean", "std")
    median = median_filter(df.select(*axes, unzero(F.col("v")).alias("v")), axes, shape, size)
    value = F.when(F.col("std") > 0, (F.col("mean") - F.col("v")) / F.when(F.col("std") > 0, F.col("std"))).otherwise(F.lit(0.0))
    return stats.join(median, list(axes)).select(*axes, (value * (3 if pearson else 1)).alias("v"))
