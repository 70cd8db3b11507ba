"""Connected components of the foreground, their properties, boxes and colours.

Elements are nodes named by their place in the array. Each pair of touching foreground elements (any of the 3**n neighbours) is an edge, found
by equi-joins on shifted coordinates; a component's label is its smallest node plus one, 0 is the background.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .reduce import spread


def place(axes: str, shape: tuple[int, ...]) -> Column:
    """The index of an element in row-major order."""
    out: Column = F.lit(0).cast("long")
    for a, n in zip(axes, shape):
        out = out * n + F.col(a)
    return out


def label(df: DataFrame, axes: str, shape: tuple[int, ...], dense: bool = False) -> DataFrame:
    """``v`` as component labels; ``dense`` numbers them from 1 in order of their first element."""
    nodes = df.select(*axes, (F.col("v") > 0).alias("on"), place(axes, shape).alias("id"))
    on = nodes.where("on").select(*axes, "id")
    half = [d for d in itertools.product((-1, 0, 1), repeat=len(axes)) if d > (0,) * len(axes)]
    steps = F.array(*(F.struct(*(F.lit(x).alias(f"d{k}") for k, x in enumerate(d))) for d in half))
    moved = on.select(F.col("id").alias("a"), F.explode(steps).alias("s"), *axes).select("a", *((F.col(a) + F.col(f"s.d{k}")).alias(a) for k, a in enumerate(axes)))
    found = components(moved.join(on.withColumnRenamed("id", "b"), list(axes)).select("a", "b"))
    out = nodes.join(found, nodes["id"] == found["node"], "left").select(*axes, F.when(F.col("on"), F.coalesce("component", "id") + 1).otherwise(F.lit(0).cast("long")).alias("v"))
    if not dense:
        return out
    names = out.where("v > 0").select("v").distinct().withColumn("n", F.row_number().over(Window.orderBy("v")).cast("long"))
    return out.join(names, "v", "left").select(*axes, F.coalesce("n", F.lit(0).cast("long")).alias("v"))


def extract(df: DataFrame, axes: str, index: int) -> DataFrame:
    """1 where the label is ``index``, else 0."""
    return df.select(*axes, (F.col("v") == index).cast("long").alias("v"))


def properties(labels: DataFrame, image: DataFrame, axes: str, features: tuple[str, ...] = ("area", "intensity_mean", "intensity_max")) -> DataFrame:
    """One row per label: area, intensity_max, intensity_mean, intensity_min, area_convex and solidity, as asked."""
    both = labels.where("v > 0").withColumnRenamed("v", "label").join(image.withColumnRenamed("v", "i"), list(axes))
    simple = {"area": F.count(F.lit(1)), "intensity_max": F.max("i"), "intensity_min": F.min("i"), "intensity_mean": F.avg("i")}
    out = both.groupBy("label").agg(F.count(F.lit(1)).alias("area"), *(simple[f].alias(f) for f in features if f in simple and f != "area"))
    if {"area_convex", "solidity"} & set(features):
        # Hulls need only the ends of each label's lines along the last axis.
        rest = list(axes[:-1])
        ends = labels.where("v > 0").groupBy(F.col("v").alias("label"), *rest).agg(F.min(axes[-1]).alias("lo"), F.max(axes[-1]).alias("hi"))
        if len(axes) != 2:
            raise ValueError("convex areas are for two-dimensional labels")
        hulls = spread(ends, "label").groupBy("label").agg(F.sort_array(F.collect_list(F.struct(rest[0], "lo", "hi"))).alias("lines")).mapInArrow(_hulls, "label long, area_convex long")
        out = out.join(hulls, "label").withColumn("solidity", F.col("area") / F.col("area_convex"))
    return out.select("label", *features)


def _hulls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_hull`` for batches of (label, lines), lines as lists of (y, lo, hi) by y."""
    for batch in batches:
        y, lo, hi = (c.to_pylist() for c in batch["lines"].values.flatten())
        ends = batch["lines"].offsets.to_pylist()
        areas = [_hull(y[i:j], lo[i:j], hi[i:j]) for i, j in itertools.pairwise(ends)]
        yield pa.RecordBatch.from_arrays([batch["label"], pa.array(areas, pa.int64())], ["label", "area_convex"])


def _hull(y: list[int], lo: list[int], hi: list[int]) -> int:
    """Pixels whose centres lie in the hull of a label's pixels, each taken with the middles of its four edges; in whole numbers."""
    if len(y) == 1:
        return hi[0] - lo[0] + 1
    return y[-1] - y[0] + 1 - _first_pixels(y, lo) - _first_pixels(y, [-x for x in hi])


def _first_pixels(y: list[int], lo: list[int]) -> int:
    """The sum, over the rows from the first line to the last, of the first pixel in the hull; coordinates are doubled."""
    at: list[int] = []
    left: list[int] = []
    for i, (row, x) in enumerate(zip(y, lo)):
        upper, lower = (i and y[i - 1] == row - 1), (i + 1 < len(y) and y[i + 1] == row + 1)
        corners = [(2 * row, 2 * x - 1), (2 * row + 1, 2 * min(x, lo[i + 1]) if lower else 2 * x)]
        for b, a in corners if upper else [(2 * row - 1, 2 * x), *corners]:
            while len(at) > 1 and (at[-1] - at[-2]) * (a - left[-2]) <= (left[-1] - left[-2]) * (b - at[-2]):
                at.pop()
                left.pop()
            at.append(b)
            left.append(a)
    out = 0
    for b, a, d, c in zip(at, left, at[1:], left[1:]):
        run, rise = d - b, c - a
        for row in range(b + b % 2, d, 2):  # rows have even places, the ends of the chain odd ones
            out -= -(a * run + rise * (row - b)) // (2 * run)
    return out


def boxes(df: DataFrame, axes: str) -> DataFrame:
    """One row per label: the first and the last coordinate on each axis."""
    return df.where("v > 0").groupBy(F.col("v").alias("label")).agg(*(f(a).alias(f"{a}_{n}") for a in axes for n, f in (("min", F.min), ("max", F.max))))


def display_colors(df: DataFrame, limit: int = 255) -> DataFrame:
    """(label, position): labels by rising size, the largest first, at even places of a colour map of ``limit`` + 1 entries."""
    sizes = df.groupBy(F.col("v").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("n", "label")  # one row per label
    ranked = sizes.select("label", F.row_number().over(w).alias("r"), F.count(F.lit(1)).over(Window.partitionBy()).alias("k"))
    at = F.when(F.col("r") == F.col("k"), 0).otherwise(F.col("r"))
    return ranked.select("label", F.floor(at * limit / F.greatest(F.col("k") - 1, F.lit(1))).cast("int").alias("position"))


def upsert(old: DataFrame, new: DataFrame, key: str = "label") -> DataFrame:
    """Rows of both tables by key; values of ``new`` win where they aren't null."""
    o, n = old.alias("o"), new.alias("n")
    names = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c != key]
    pick = lambda c: F.coalesce(*(F.col(f"{s}.{c}") for s, d in (("n", new), ("o", old)) if c in d.columns)).alias(c)
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *map(pick, names))
