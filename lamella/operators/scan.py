"""Operators that follow an axis: cumulative sums and products, and gradients, as windows.

A line along the axis is a window partition. ``block`` restarts a scan every so many coordinates, as processing by
storage blocks does; without it the scan is over the whole axis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ufuncs import isnan

SCANS = ("cumsum", "cumprod", "nancumsum", "nancumprod")


def scan(df: DataFrame, axes: str, name: str, axis: str, block: int | None = None) -> DataFrame:
    rest: list[str | Column] = [a for a in axes if a != axis]
    if block:
        rest.append(F.floor(F.col(axis) / block))
    w = Window.partitionBy(*rest).orderBy(axis).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = F.col("v")
    if name.startswith("nan"):
        v = F.when(isnan(v), F.lit(0 if name == "nancumsum" else 1)).otherwise(v)
    out = F.sum(v).over(w) if name.endswith("cumsum") else F.product(v.cast("double")).over(w)
    return df.select(*axes, out.alias("v"))


def gradient(df: DataFrame, axes: str, axis: str) -> DataFrame:
    """Central differences inside, one-sided ones at the ends."""
    w = Window.partitionBy(*[a for a in axes if a != axis]).orderBy(axis)
    v, after, before = F.col("v").cast("double"), F.lead("v").over(w).cast("double"), F.lag("v").over(w).cast("double")
    out = F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2)
    return df.select(*axes, out.alias("v"))
