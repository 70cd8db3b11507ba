"""Neighbourhoods of dense arrays in three physical forms.

* ``line``: one window per axis (lag and lead, or a moving frame) after the edges of each line have been padded; for separable filters.
* ``scatter``: every padded element goes to the outputs whose footprint covers it, then one group-by; sums, minima and maxima
  combine before the shuffle, so it is the form for small footprints that don't separate.
* ``blocks``: elements are sent to the blocks they touch with a halo and a kernel sees each block as an array; for large footprints.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import fold_int


def pad_edges(df: DataFrame, axes: str, shape: tuple[int, ...], before: tuple[int, ...], after: tuple[int, ...], mode: str = "reflect", cval: float = 0.0, values: tuple[str, ...] = ("v",)) -> DataFrame:
    """``df`` with the elements that ``mode`` puts beyond its edges. Each axis adds rows by a small literal map, without a shuffle."""
    for a, n, lo, hi in zip(axes, shape, before, after):
        if not lo and not hi:
            continue
        beyond = [*range(-lo, 0), *range(n, n + hi)]
        if mode == "constant":
            outside = df.where(F.col(a) == 0).withColumn(a, F.explode(F.array(*(F.lit(p) for p in beyond))))
            outside = outside.withColumns({v: F.lit(cval).cast(df.schema[v].dataType) for v in values})
        else:
            by: dict[int, list[int]] = {}
            for p in beyond:
                by.setdefault(fold_int(p, n, mode), []).append(p)
            table = F.create_map(*itertools.chain.from_iterable((F.lit(s), F.array(*(F.lit(p) for p in ps))) for s, ps in by.items()))
            outside = df.where(F.col(a).isin(list(by))).withColumn(a, F.explode(F.element_at(table, F.col(a))))
        df = df.unionByName(outside.select(*df.columns))
    return df


def inside(df: DataFrame, axes: str, shape: tuple[int, ...]) -> DataFrame:
    for a, n in zip(axes, shape):
        df = df.where((F.col(a) >= 0) & (F.col(a) < n))
    return df


def line(df: DataFrame, axes: str, shape: tuple[int, ...], axis: str, reach: tuple[int, int], values: dict[str, Callable[[object], Column]], mode: str = "reflect", cval: float = 0.0) -> DataFrame:
    """New values along one axis; each is built from the window specification of its line."""
    k = axes.index(axis)
    lo = tuple(reach[0] if i == k else 0 for i in range(len(axes)))
    hi = tuple(reach[1] if i == k else 0 for i in range(len(axes)))
    old = tuple(c for c in df.columns if c not in axes)
    padded = pad_edges(df, axes, shape, lo, hi, mode, cval, old)
    w = Window.partitionBy(*[a for a in axes if a != axis]).orderBy(axis)
    kept = [c for c in old if c not in values]
    out = padded.select(*axes, *kept, *(build(w).alias(name) for name, build in values.items()))
    return out.where((F.col(axis) >= 0) & (F.col(axis) < shape[k]))


def correlate_line(df: DataFrame, axes: str, shape: tuple[int, ...], axis: str, weights: list[float], mode: str = "reflect", cval: float = 0.0) -> DataFrame:
    """Correlation with weights centred at their middle, along one axis."""
    r = len(weights) // 2
    right = len(weights) - 1 - r

    def build(w: object) -> Column:
        terms = [F.lead("v", k - r).over(w).cast("double") * float(x) if k > r else F.lag("v", r - k).over(w).cast("double") * float(x) if k < r else F.col("v").cast("double") * float(x) for k, x in enumerate(weights) if x]
        return sum(terms[1:], terms[0]) if terms else F.lit(0.0)

    return line(df, axes, shape, axis, (r, right), {"v": build}, mode, cval)


def box(df: DataFrame, axes: str, shape: tuple[int, ...], size: tuple[int, ...], values: dict[str, tuple[str, Callable[[str], Column]]], mode: str = "reflect", cval: float = 0.0) -> DataFrame:
    """Moving sums, minima or maxima over a box, one window per axis; ``values``: new column -> (source column, aggregate)."""
    df = df.withColumns({name: F.col(source) for name, (source, _) in values.items()})
    for a, n in zip(axes, size):
        if n > 1:
            lo, hi = n // 2, n - 1 - n // 2
            build = {name: (lambda w, f=f, name=name: f(name).over(w.rowsBetween(-lo, hi))) for name, (_, f) in values.items()}
            df = line(df, axes, shape, a, (lo, hi), build, mode, cval)
    return df


def offsets_of(footprint: np.ndarray) -> list[tuple[int, ...]]:
    """Offsets of a footprint's elements from its middle."""
    middle = [n // 2 for n in footprint.shape]
    return [tuple(int(i - m) for i, m in zip(at, middle)) for at in zip(*np.nonzero(footprint))]


def scatter(df: DataFrame, axes: str, shape: tuple[int, ...], taps: list[tuple[tuple[int, ...], float]], agg: Column, mode: str = "reflect", cval: float = 0.0) -> DataFrame:
    """``agg`` over columns v and w (the tap's weight) of the elements that each output's taps reach."""
    lo = tuple(max(0, -min(o[k] for o, _ in taps)) for k in range(len(axes)))
    hi = tuple(max(0, max(o[k] for o, _ in taps)) for k in range(len(axes)))
    padded = pad_edges(df.select(*axes, "v"), axes, shape, lo, hi, mode, cval)
    table = F.array(*(F.struct(*(F.lit(o).alias(f"d{k}") for k, o in enumerate(off)), F.lit(float(x)).alias("w")) for off, x in taps))
    spread = padded.select(*axes, "v", F.explode(table).alias("t"))
    spread = inside(spread.select(*((F.col(a) - F.col(f"t.d{k}")).alias(a) for k, a in enumerate(axes)), "v", F.col("t.w").alias("w")), axes, shape)
    return spread.groupBy(*axes).agg(agg.alias("v"))


def blocks(df: DataFrame, axes: str, shape: tuple[int, ...], kernel: Callable[[np.ndarray], np.ndarray], halo: tuple[int, ...], block: tuple[int, ...], mode: str = "reflect", cval: float = 0.0, out: str = "double") -> DataFrame:
    """``kernel`` on every block with its halo; it returns an array of the same shape, of which the inner part counts."""
    padded = pad_edges(df.select(*axes, "v"), axes, shape, halo, halo, mode, cval)
    keys = []
    for a, n, h, b in zip(axes, shape, halo, block):
        last = (n - 1) // b
        first_block = F.greatest(F.floor((F.col(a) - h) / b), F.lit(0))
        last_block = F.least(F.floor((F.col(a) + h) / b), F.lit(last))
        keys.append((f"__{a}", first_block, last_block))
    for name, first_block, last_block in keys:
        padded = padded.withColumn(name, F.explode(F.sequence(first_block.cast("int"), last_block.cast("int"))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        origin = [int(pdf[f"__{a}"].iloc[0]) * b for a, b in zip(axes, block)]
        size = [min(b, n - o) for b, n, o in zip(block, shape, origin)]
        array = np.zeros([s + 2 * h for s, h in zip(size, halo)], pdf["v"].dtype)
        array[tuple(pdf[a].to_numpy() - o + h for a, o, h in zip(axes, origin, halo))] = pdf["v"].to_numpy()
        result = kernel(array)[tuple(slice(h, h + s) for h, s in zip(halo, size))]
        at = np.indices(result.shape).reshape(len(axes), -1)
        return pd.DataFrame({a: (at[k] + origin[k]).astype(np.int32) for k, a in enumerate(axes)} | {"v": result.ravel()})

    schema = ", ".join([f"{a} int" for a in axes] + [f"v {out}"])
    return padded.groupBy(*(name for name, _, _ in keys)).applyInPandas(run, schema)
