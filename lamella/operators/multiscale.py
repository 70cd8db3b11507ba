"""Downscaling by grouped blocks, and the loop that rebuilds a pyramid's layers from its full resolution.

Edge blocks count as padded with zeros, so a mean divides by the whole factor. Each level comes from the one above it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _soft(v: Column, whole: Column) -> Column:
    """Keeps foreground: the minimum where all of the block is positive, else the maximum."""
    low = F.when(whole, F.min(v)).otherwise(F.least(F.min(v), F.lit(0)))
    return F.when(low > 0, low).otherwise(F.greatest(F.max(v), F.when(whole, F.max(v)).otherwise(F.lit(0))))


def _padded(value: Callable[[Column], Column], pick: Callable[..., Column]) -> Callable[[Column, Column, int], Column]:
    return lambda v, whole, size: F.when(whole, value(v)).otherwise(pick(value(v), F.lit(0)))


def _median(v: Column, whole: Column, size: int) -> Column:
    """The median of a block with its padding zeros."""
    zeros = F.array_repeat(F.lit(0.0), (F.lit(size) - F.count(F.lit(1))).cast("int"))
    values = F.array_sort(F.concat(F.collect_list(v.cast("double")), zeros))  # a block has ``size`` elements at most
    return (F.element_at(values, (size + 1) // 2) + F.element_at(values, size // 2 + 1)) / 2


KERNELS: dict[str, Callable[[Column, Column, int], Column]] = {
    "mean": lambda v, whole, size: F.sum(v) / size,
    "min": _padded(F.min, F.least),
    "max": _padded(F.max, F.greatest),
    "median": _median,
    "softmax": lambda v, whole, size: _soft(v, whole),
}


def downscale(df: DataFrame, axes: str, factor: tuple[int, ...], kernel: str | Callable[[Column, Column, int], Column] = "mean") -> DataFrame:
    """One level down: coordinates divided by ``factor``, values by ``kernel(v, block is complete, block size)``."""
    size = 1
    for f in factor:
        size *= f
    build = KERNELS[kernel] if isinstance(kernel, str) else kernel
    keys = [F.floor(F.col(a) / f).cast("int").alias(a) if f > 1 else F.col(a) for a, f in zip(axes, factor)]
    return df.groupBy(*keys).agg(build(F.col("v"), F.count(F.lit(1)) == size, size).alias("v"))
