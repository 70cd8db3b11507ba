"""Neighbourhood filters of the public image-filter family, on dense arrays with reflected, nearest, mirrored, wrapped or constant edges.

Integer arrays are truncated after each axis pass, as storage in the array's own type does.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dtypes import truncated
from .neighbourhood import blocks, box, correlate_line, offsets_of, scatter

EPS = float(np.finfo(np.float64).eps)
#: Footprints of more elements than this go to block kernels.
MOST_TAPS = 49


def _sizes(size: int | tuple[int, ...], axes: str) -> tuple[int, ...]:
    return (size,) * len(axes) if isinstance(size, int) else tuple(size)


def _stored(df: DataFrame, axes: str, integral: bool) -> DataFrame:
    return df.select(*axes, truncated(F.col("v")).alias("v")) if integral else df


def correlate(df: DataFrame, axes: str, shape: tuple[int, ...], weights: np.ndarray, mode: str = "reflect", cval: float = 0.0) -> DataFrame:
    w = np.asarray(weights, float)
    taps = [(o, float(w[tuple(i + n // 2 for i, n in zip(o, w.shape))])) for o in offsets_of(np.ones(w.shape))]
    return scatter(df, axes, shape, [t for t in taps if t[1]] or taps[:1], F.sum(F.col("v").cast("double") * F.col("w")), mode, cval)


def convolve(df: DataFrame, axes: str, shape: tuple[int, ...], weights: np.ndarray, mode: str = "reflect", cval: float = 0.0) -> DataFrame:
    w = np.asarray(weights, float)
    flipped = w[tuple(slice(None, None, -1) for _ in w.shape)]
    taps = [(tuple(i + (n + 1) % 2 for i, n in zip(o, w.shape)), float(flipped[tuple(i + n // 2 for i, n in zip(o, w.shape))])) for o in offsets_of(np.ones(w.shape))]
    return scatter(df, axes, shape, [t for t in taps if t[1]] or taps[:1], F.sum(F.col("v").cast("double") * F.col("w")), mode, cval)


def uniform_filter(df: DataFrame, axes: str, shape: tuple[int, ...], size: int | tuple[int, ...] = 3, mode: str = "reflect", cval: float = 0.0, integral: bool = False) -> DataFrame:
    for a, n in zip(axes, _sizes(size, axes)):
        if n > 1:
            one = tuple(n if b == a else 1 for b in axes)
            df = box(df.select(*axes, "v"), axes, shape, one, {"v": ("v", F.sum)}, mode, cval)
            df = _stored(df.withColumn("v", F.col("v") / n), axes, integral)
    return df


def _extreme(df: DataFrame, axes: str, shape: tuple[int, ...], size: int | tuple[int, ...] | None, footprint: np.ndarray | None, f: Callable[..., Column], mode: str, cval: float) -> DataFrame:
    if footprint is None or np.all(footprint):
        sizes = _sizes(size if footprint is None else footprint.shape, axes)
        return box(df.select(*axes, "v"), axes, shape, sizes, {"v": ("v", f)}, mode, cval)
    return scatter(df, axes, shape, [(o, 1.0) for o in offsets_of(footprint)], f("v"), mode, cval)


def minimum_filter(df, axes, shape, size=3, footprint=None, mode="reflect", cval=0.0):
    return _extreme(df, axes, shape, size, footprint, F.min, mode, cval)


def maximum_filter(df, axes, shape, size=3, footprint=None, mode="reflect", cval=0.0):
    return _extreme(df, axes, shape, size, footprint, F.max, mode, cval)


def unzero(v: Column) -> Column:
    """A double, with machine epsilon for exact zeros."""
    return F.when(v == 0, F.lit(EPS)).otherwise(v.cast("double"))


def mean_filter(df: DataFrame, axes: str, shape: tuple[int, ...], size: int | tuple[int, ...] = 3, footprint: np.ndarray | None = None) -> DataFrame:
    df = df.select(*axes, unzero(F.col("v")).alias("v"))
    if footprint is None or np.all(footprint):
        sizes = _sizes(size if footprint is None else footprint.shape, axes)
        return box(df, axes, shape, sizes, {"v": ("v", F.sum)}).withColumn("v", F.col("v") / math.prod(sizes))
    taps = [(o, 1.0) for o in offsets_of(footprint)]
    return scatter(df, axes, shape, taps, F.sum("v") / len(taps))


def rank_filter(df: DataFrame, axes: str, shape: tuple[int, ...], rank: Callable[[int], int], size=3, footprint=None, mode="reflect", cval=0.0, block: int = 128) -> DataFrame:
    """The element of rank ``rank(footprint size)`` among a footprint's sorted elements."""
    fp = np.ones(_sizes(size, axes), bool) if footprint is None else np.asarray(footprint, bool)
    offs = offsets_of(fp)
    k = rank(len(offs))
    if len(offs) <= MOST_TAPS:
        return scatter(df, axes, shape, [(o, 1.0) for o in offs], F.element_at(F.array_sort(F.collect_list("v")), k + 1), mode, cval)
    halo = tuple(n // 2 + 1 for n in fp.shape)

    def kernel(array: np.ndarray) -> np.ndarray:
        out = array.copy()
        windows = np.lib.stride_tricks.sliding_window_view(array, fp.shape)
        inner = tuple(slice(n // 2, n // 2 + w) for n, w in zip(fp.shape, windows.shape))
        rows = max(1, 2_000_000 // max(1, len(offs) * int(np.prod(windows.shape[1 : len(axes)]))))
        parts = [np.partition(windows[i : i + rows][..., fp], k, axis=-1)[..., k] for i in range(0, len(windows), rows)]
        out[inner] = np.concatenate(parts)
        return out

    return blocks(df, axes, shape, kernel, halo, tuple(min(block, n) for n in shape), mode, cval, df.schema["v"].dataType.simpleString())


def median_filter(df, axes, shape, size=3, footprint=None, mode="reflect", cval=0.0, **kw):
    return rank_filter(df, axes, shape, lambda n: n // 2, size, footprint, mode, cval, **kw)


def percentile_filter(df, axes, shape, percentile, size=3, footprint=None, mode="reflect", cval=0.0, **kw):
    percentile = percentile + 100 if percentile < 0 else percentile
    return rank_filter(df, axes, shape, lambda n: n - 1 if percentile == 100 else int(n * percentile / 100), size, footprint, mode, cval, **kw)


def gaussian_weights(sigma: float, order: int = 0, truncate: float = 4.0, radius: int | None = None) -> list[float]:
    """Samples of a Gaussian, or of its derivative, as correlation weights."""
    r = int(truncate * sigma + 0.5) if radius is None else radius
    x = np.arange(-r, r + 1, dtype=float)
    g = np.exp(-0.5 * (x / sigma) ** 2)
    g /= g.sum()
    q = np.polynomial.Polynomial([1.0])
    for _ in range(order):
        q = q.deriv() + q * np.polynomial.Polynomial([0.0, -1 / sigma**2])
    return [float(w) for w in (g * q(x))[::-1]]


def gaussian_filter(df, axes, shape, sigma, order=0, mode="reflect", cval=0.0, truncate=4.0, radius=None, over=None, integral=False):
    sigmas = (sigma,) * len(axes) if isinstance(sigma, (int, float)) else tuple(sigma)
    orders = (order,) * len(axes) if isinstance(order, int) else tuple(order)
    for a, s, o in zip(axes, sigmas, orders):
        if s > 0 and (over is None or a in over):
            df = _stored(correlate_line(df, axes, shape, a, gaussian_weights(s, o, truncate, radius), mode, cval), axes, integral)
    return df


def _summed(parts: list[DataFrame], axes: str, root: bool = False) -> DataFrame:
    value = F.sum(F.col("v") * F.col("v")) if root else F.sum("v")
    whole = parts[0].select(*axes, "v")
    for p in parts[1:]:
        whole = whole.unionByName(p.select(*axes, "v"))
    return whole.groupBy(*axes).agg((F.sqrt(value) if root else value).alias("v"))


def laplace(df, axes, shape, mode="reflect", cval=0.0):
    return _summed([correlate_line(df, axes, shape, a, [1, -2, 1], mode, cval) for a in axes], axes)


def gaussian_laplace(df, axes, shape, sigma, mode="reflect", cval=0.0, **kw):
    return _summed([gaussian_filter(df, axes, shape, sigma, tuple(2 if b == a else 0 for b in axes), mode, cval, **kw) for a in axes], axes)


def _derivative(df, axes, shape, axis, smooth, mode, cval):
    axis = axes[axis] if isinstance(axis, int) else axis
    df = correlate_line(df, axes, shape, axis, [-1, 0, 1], mode, cval)
    for a in axes:
        if a != axis:
            df = correlate_line(df, axes, shape, a, smooth, mode, cval)
    return df


def prewitt(df, axes, shape, axis=-1, mode="reflect", cval=0.0):
    return _derivative(df, axes, shape, axis, [1, 1, 1], mode, cval)


def sobel(df, axes, shape, axis=-1, mode="reflect", cval=0.0):
    return _derivative(df, axes, shape, axis, [1, 2, 1], mode, cval)


def generic_gradient_magnitude(df, axes, shape, derivative, mode="reflect", cval=0.0, **kw):
    """Root of summed squares of ``derivative(df, axes, shape, axis, mode, cval)`` over all axes."""
    return _summed([derivative(df, axes, shape, a, mode, cval, **kw) for a in axes], axes, True)


def gaussian_gradient_magnitude(df, axes, shape, sigma, mode="reflect", cval=0.0, **kw):
    return _summed([gaussian_filter(df, axes, shape, sigma, tuple(1 if b == a else 0 for b in axes), mode, cval, **kw) for a in axes], axes, True)


def gaussian_sobel_magnitude(df, axes, shape, sigma, mode="reflect", cval=0.0, **kw):
    df = gaussian_filter(df, axes, shape, sigma, 0, mode, cval, **kw) if not isinstance(sigma, (int, float)) or sigma > 0 else df
    return generic_gradient_magnitude(df, axes, shape, sobel, mode, cval)


def gaussian_prewitt_magnitude(df, axes, shape, sigma, mode="reflect", cval=0.0, **kw):
    df = gaussian_filter(df, axes, shape, sigma, 0, mode, cval, **kw) if not isinstance(sigma, (int, float)) or sigma > 0 else df
    return generic_gradient_magnitude(df, axes, shape, prewitt, mode, cval)
