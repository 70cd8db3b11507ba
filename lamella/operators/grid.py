"""Dense coordinate grids, cropping and the folding of coordinates beyond an edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODES = ("reflect", "nearest", "mirror", "wrap", "constant")


def grid(spark: SparkSession, axes: str, shape: tuple[int, ...]) -> DataFrame:
    """One row per coordinate, from a distributed range by division and remainder."""
    total = 1
    for n in shape:
        total *= n
    columns, below = [], total
    for a, n in zip(axes, shape):
        below //= n
        columns.append(F.pmod(F.floor(F.col("id") / below) if below > 1 else F.col("id"), F.lit(n)).cast("int").alias(a))
    return spark.range(total).select(*columns) if total else spark.range(0).select(*columns)


def full(spark: SparkSession, axes: str, shape: tuple[int, ...], value: Column) -> DataFrame:
    return grid(spark, axes, shape).withColumn("v", value)


def densify(df: DataFrame, axes: str, shape: tuple[int, ...], fill: float = 0) -> DataFrame:
    """Every coordinate of ``shape``, with ``fill`` where ``df`` has no row."""
    kind = df.schema["v"].dataType
    return grid(df.sparkSession, axes, shape).join(df, list(axes), "left").select(*axes, F.coalesce("v", F.lit(fill).cast(kind)).alias("v"))


def crop(df: DataFrame, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """Rows within [start, stop) on the given axes, moved to origin 0. The range test reaches the scan."""
    for a, (lo, hi) in bounds.items():
        df = df.where((F.col(a) >= lo) & (F.col(a) < hi))
    return df.withColumns({a: (F.col(a) - lo).cast("int") for a, (lo, _) in bounds.items() if lo})


def fold(c: Column, n: int, mode: str) -> Column:
    """A coordinate beyond [0, n) as the one that stands for it; NULL where a constant does."""
    if mode == "reflect":
        m = F.pmod(c, F.lit(2 * n))
        return F.when(m < n, m).otherwise(2 * n - 1 - m)
    if mode == "nearest":
        return F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))
    if mode == "mirror":
        m = F.pmod(c, F.lit(max(2 * n - 2, 1)))
        return F.when(m < n, m).otherwise(2 * n - 2 - m)
    if mode == "wrap":
        return F.pmod(c, F.lit(n))
    if mode == "constant":
        return F.when((c >= 0) & (c < n), c)
    raise ValueError(f"mode must be one of {MODES}")


def fold_int(c: int, n: int, mode: str) -> int | None:
    if mode == "reflect":
        m = c % (2 * n)
        return m if m < n else 2 * n - 1 - m
    if mode == "nearest":
        return min(max(c, 0), n - 1)
    if mode == "mirror":
        m = c % max(2 * n - 2, 1)
        return m if m < n else 2 * n - 2 - m
    if mode == "wrap":
        return c % n
    return c if 0 <= c < n else None


def delete(df: DataFrame, axis: str, obj: list[int]) -> DataFrame:
    """Rows without the given coordinates of ``axis``, closed up."""
    gone = sorted(set(obj))
    shift = sum((F.col(axis) > g).cast("int") for g in gone) if gone else F.lit(0)
    return df.where(~F.col(axis).isin(gone)).withColumn(axis, (F.col(axis) - shift).cast("int")) if gone else df


def pad(df: DataFrame, axes: str, shape: tuple[int, ...], widths: dict[str, tuple[int, int]], fill: float = 0) -> DataFrame:
    """The array with ``widths`` more rows before and after on each axis."""
    moved = df.withColumns({a: (F.col(a) + before).cast("int") for a, (before, _) in widths.items()})
    larger = tuple(n + sum(widths.get(a, (0, 0))) for a, n in zip(axes, shape))
    return densify(moved, axes, larger, fill)
