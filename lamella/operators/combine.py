"""Concatenation, stacking, mosaics and sums of arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def concatenate(parts: list[tuple[DataFrame, tuple[int, ...]]], axes: str, axis: str) -> tuple[DataFrame, tuple[int, ...]]:
    """Arrays one after another along ``axis``: a union with a shifted coordinate, without a shuffle."""
    k = axes.index(axis)
    first = parts[0][1]
    moved, at = [], 0
    for df, shape in parts:
        if shape[:k] + shape[k + 1 :] != first[:k] + first[k + 1 :]:
            raise ValueError(f"shapes differ beyond axis {axis!r}: {first} and {shape}")
        moved.append(df.withColumn(axis, (F.col(axis) + at).cast("int")).select(*axes, "v"))
        at += shape[k]
    return reduce(DataFrame.unionByName, moved), first[:k] + (at,) + first[k + 1 :]


def stack(parts: list[tuple[DataFrame, tuple[int, ...]]], axes: str, axis: str) -> tuple[DataFrame, str, tuple[int, ...]]:
    """Arrays of one shape along a new first axis."""
    if axis in axes or len({s for _, s in parts}) != 1:
        raise ValueError("stack needs a new axis and equal shapes")
    moved = [df.select(F.lit(k).alias(axis), *axes, "v") for k, (df, _) in enumerate(parts)]
    return reduce(DataFrame.unionByName, moved), axis + axes, (len(parts), *parts[0][1])


def mosaic(parts: dict[tuple[int, ...], tuple[DataFrame, tuple[int, ...]]], axes: str) -> tuple[DataFrame, tuple[int, ...]]:
    """Arrays at the cells of a grid; a cell's offset is the sum of the lengths before it on each axis."""
    lengths: list[dict[int, int]] = [{} for _ in axes]
    for cell, (_, shape) in parts.items():
        for d, (c, n) in enumerate(zip(cell, shape)):
            if lengths[d].setdefault(c, n) != n:
                raise ValueError(f"cells at {c} on axis {axes[d]!r} differ in length")
    starts = [{c: sum(n for o, n in per.items() if o < c) for c in per} for per in lengths]
    moved = [df.select(*((F.col(a) + starts[d][cell[d]]).cast("int").alias(a) for d, a in enumerate(axes)), "v") for cell, (df, _) in parts.items()]
    return reduce(DataFrame.unionByName, moved), tuple(sum(per.values()) for per in lengths)


def sum_arrays(parts: list[DataFrame], axes: str) -> DataFrame:
    """Element-wise sum of any number of arrays in one group-by."""
    return reduce(DataFrame.unionByName, [df.select(*axes, "v") for df in parts]).groupBy(*axes).agg(F.sum("v").alias("v"))
