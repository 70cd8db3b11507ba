"""Global thresholds from a histogram and local ones from moving boxes. A mask is 1 where the element is strictly above its threshold.

The histogram is a group-by of at most ``nbins`` rows; only these rows reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .local_stats import local_statistics


def histogram(df: DataFrame, nbins: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(counts, bin centres) over the range of v; the last bin is closed."""
    low, high = df.agg(F.min("v").cast("double"), F.max("v").cast("double")).first()
    if low is None:
        return np.zeros(nbins), np.zeros(nbins)
    if low == high:
        low, high = low - 0.5, high + 0.5
    b = F.least(F.floor((F.col("v").cast("double") - low) * float(nbins) / (high - low)), F.lit(nbins - 1)).cast("int")
    counts = np.zeros(nbins, np.int64)
    for k, n in df.groupBy(b.alias("b")).count().collect():
        counts[k] = n
    return counts, low + (np.arange(nbins) + 0.5) * (high - low) / nbins


def otsu(n: np.ndarray, c: np.ndarray) -> float:
    w1, s1 = np.cumsum(n).astype(float), np.cumsum(n * c)
    w2, s2 = w1[-1] - w1, s1[-1] - s1
    with np.errstate(divide="ignore", invalid="ignore"):
        q = w1 * w2 * (s1 / w1 - s2 / w2) ** 2
    return float(c[int(np.nanargmax(np.where(np.isfinite(q), q, -1)))])


def isodata(n: np.ndarray, c: np.ndarray) -> float:
    """The first centre that splits the histogram where the two means' middle falls into the same bin."""
    if np.count_nonzero(n) == 1:
        return float(c[int(np.argmax(n))])
    low, high = np.cumsum(n).astype(float), n.sum() - np.cumsum(n)
    sums = np.cumsum(n * c)
    ok = (low > 0) & (high > 0)
    middle = (sums[ok] / low[ok] + (sums[-1] - sums[ok]) / high[ok]) / 2
    gap = middle - c[ok]
    found = np.flatnonzero((gap >= 0) & (gap < c[1] - c[0]))
    return float(c[ok][found[0]])


def yen(n: np.ndarray, c: np.ndarray) -> float:
    p = n / n.sum()
    p1, q1 = np.cumsum(p), np.cumsum(p * p)
    q2 = np.cumsum((p * p)[::-1])[::-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.log(((q1[:-1] * q2[1:]) ** -1) * (p1[:-1] * (1 - p1[:-1])) ** 2)
    return float(c[int(np.nanargmax(np.where(np.isnan(value), -np.inf, value)))])


def minimum(n: np.ndarray, c: np.ndarray, max_num_iter: int = 10_000) -> float:
    """The lowest bin between the two maxima that are left after repeated smoothing over three bins."""
    h = n.astype(float)
    for _ in range(max_num_iter):
        peaks, up = [], True
        for k in range(len(h) - 1):
            if up and h[k + 1] < h[k]:
                up = False
                peaks.append(k)
            elif not up and h[k + 1] > h[k]:
                up = True
        if len(peaks) < 3:
            break
        padded = np.concatenate([h[:1], h, h[-1:]])
        h = (padded[:-2] + padded[1:-1] + padded[2:]) / 3
    if len(peaks) != 2:
        raise RuntimeError("the histogram doesn't come down to two maxima")
    a, b = peaks
    return float(c[a + int(np.argmin(h[a : b + 1]))])


def triangle(n: np.ndarray, c: np.ndarray) -> float:
    """The bin farthest from the line between the peak and the far end of the longer tail."""
    some = np.flatnonzero(n)
    first, last, peak = some[0], some[-1], int(np.argmax(n))
    flip = peak - first < last - peak
    h = n[::-1].astype(float) if flip else n.astype(float)
    centre = c[::-1] if flip else c
    start, top = (len(n) - 1 - last, len(n) - 1 - peak) if flip else (first, peak)
    if top == start:
        return float(c[peak])
    x = np.arange(top - start)
    width, height = top - start, h[top]
    norm = math.hypot(width, height)
    return float(centre[start + int(np.argmax(height / norm * x - width / norm * h[start + x]))])


def multiotsu(n: np.ndarray, c: np.ndarray, classes: int = 3) -> list[float]:
    """Bounds of ``classes`` classes with the largest variance between them, by dynamic programming over occupied bins."""
    keep = np.flatnonzero(n)
    if len(keep) < classes:
        raise ValueError("fewer different values than classes")
    n, v = n[keep].astype(float), c[keep]
    w, s = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * v)])
    size = len(n)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(w[None, :] > w[:, None], (s[None, :] - s[:, None]) ** 2 / (w[None, :] - w[:, None]), -np.inf)
    best, back = gain[0].copy(), []
    for _ in range(classes - 1):
        total = best[:, None] + gain
        back.append(total.argmax(0))
        best = total.max(0)
    cuts, at = [], size
    for b in reversed(back):
        at = int(b[at])
        cuts.append(at)
    return [float(v[k - 1]) for k in sorted(cuts)]


GLOBAL = {"otsu": otsu, "isodata": isodata, "yen": yen, "minimum": minimum, "triangle": triangle}


def global_threshold(df: DataFrame, method: str, nbins: int = 256, classes: int = 3, level: int = 0, max_num_iter: int = 10_000) -> float:
    n, c = histogram(df, nbins)
    if method == "multiotsu":
        return multiotsu(n, c, classes)[level]
    return minimum(n, c, max_num_iter) if method == "minimum" else GLOBAL[method](n, c)


def above(df: DataFrame, axes: str, threshold: float | Column) -> DataFrame:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return df.select(*axes, (F.col("v") > t).cast("bigint").alias("v"))


def _local(name: str, k: float, r: float, p: dict) -> Column:
    """The threshold image of a local method, over the columns of local_statistics and of the layer's statistics."""
    m, s, u, lo, hi, con = (F.col(c) for c in ("mean", "std", "u", "low", "high", "contrast"))
    n = p["n"]
    d = u - m
    safe = lambda a, b: a / F.when(b == 0, F.lit(1e-300)).otherwise(b)
    half = k * safe(1 + d * (1 - m), 1 - d * (1 - m))
    formulas = {
        "threshold_niblack": lambda: m - k * s,
        "threshold_sauvola": lambda: m * (1 + k * (s / r - 1)),
        "niblack": lambda: m + k * s,
        "sauvola": lambda: m * (1 - k * (1 - s / r)),
        "wolf": lambda: (1 - k) * m + k * safe(s, F.col("g_smax") * (m - F.col("g_min"))) + k * F.col("g_min"),
        "singh": lambda: k * (m + con * (1 - u)),
        "trsingh": lambda: m * (1 + k * (safe(d, 1 - d) - 1)),
        "wan": lambda: (hi + m) / 2 * (1 - k * (1 - s / r)),
        "nick": lambda: m + k * F.sqrt(F.greatest((F.col("square") * n - m * m) / n, F.lit(0.0))),
        "nick_v2": lambda: m + k * F.sqrt(F.greatest(m * m + F.col("square") - m * m, F.lit(0.0))),
        "nick_v3": lambda: m + k * F.sqrt(m * m + F.sqrt(s)),
        "contrast": lambda: F.when((u - lo) * k <= (hi - u) * (2 - k), F.col("g_max")).otherwise(F.lit(0.0)),
        "laab": lambda: 1 - safe(F.abs(1 - 2 * half) - (1 - 2 * half), 2 * F.abs(1 - 2 * half)),
        "bataineh": lambda: m - safe(m * m * s, (F.col("g_mean") + s) * (safe(s - F.col("g_smin"), F.col("g_smax") - F.col("g_smin")) * F.col("g_max") + s)),
        "rais": lambda: m + p.get("l", -0.3) * safe(F.col("g_mean") * F.col("g_std") - m * s, F.greatest(F.col("g_mean") * F.col("g_std"), m * s)) * s,
        "phansalkar": lambda: m * (1 + p.get("p", 2) * F.exp(-p.get("q", 10) * m) + k * (safe(s, F.col("g_smax")) - 1)),
    }
    return formulas[name]()


LOCAL = ("threshold_niblack", "threshold_sauvola", "niblack", "sauvola", "wolf", "singh", "trsingh", "wan", "nick", "nick_v2", "nick_v3", "laab", "contrast", "bataineh", "rais", "phansalkar")
#: What a method takes where k isn't given; all others take 0.6.
DEFAULT_K = {"niblack": -0.2, "wan": 0.33, "contrast": 1.0}


def local_threshold(df: DataFrame, axes: str, shape: tuple[int, ...], method: str, size: int | tuple[int, ...] = 9, k: float | None = None, r: float | None = None, **params: float) -> DataFrame:
    """Columns of the axes, v, contrast, midpoint and t, the threshold image. Whole-layer statistics are one broadcast row."""
    sizes = (size,) * len(axes) if isinstance(size, int) else tuple(size)
    stats = local_statistics(df, axes, shape, sizes)
    k = DEFAULT_K.get(method, 0.6) if k is None else k
    if method in ("wolf", "contrast", "bataineh", "rais", "phansalkar"):
        whole = stats.agg(F.max("std").alias("g_smax"), F.min("std").alias("g_smin"), F.min("u").alias("g_min"), F.max("u").alias("g_max"), F.avg("u").alias("g_mean"), F.stddev_pop("u").alias("g_std"))
        stats = stats.crossJoin(F.broadcast(whole))  # one row
    if r is None:
        low, high = df.agg(F.min("v").cast("double"), F.max("v").cast("double")).first()
        r = max((high - low) / 2, 1e-300) if low is not None else 1.0
    return stats.select(*axes, "v", "contrast", "midpoint", _local(method, k, r, params | {"n": math.prod(sizes)}).alias("t"))


def local_mask(df: DataFrame, axes: str, shape: tuple[int, ...], method: str, **params) -> DataFrame:
    return above(local_threshold(df, axes, shape, method, **params), axes, F.col("t"))


def bernsen(df, axes, shape, threshold: float, size=9, min_contrast: float = 15.0) -> DataFrame:
    """The box's midpoint where its contrast is large, the global threshold elsewhere."""
    t = local_threshold(df, axes, shape, "niblack", size=size)
    return above(t, axes, F.when(F.col("contrast") > min_contrast, F.col("midpoint")).otherwise(F.lit(float(threshold))))


def hybrid_bernsen(df, axes, shape, method: str, threshold: float, size=9, k: float | None = None, min_contrast: float = 15.0, **params) -> DataFrame:
    """The local threshold, and the global one where the box's contrast is small; Feng's has settings of its own here."""
    if method == "phansalkar":
        k, params = 0.05 if k is None else k, {"p": 10, "q": 30} | params
    t = feng(df, axes, shape, **(BERNSEN_FENG | params)) if method == "feng" else local_threshold(df, axes, shape, method, size=size, k=k, **params)
    return above(t, axes, F.when(F.col("contrast") < min_contrast, F.lit(float(threshold))).otherwise(F.col("t")))


BERNSEN_FENG = {"small": 3, "big": 5, "alpha": 0.12, "k1": 0.25, "k2": 0.04}


def feng(df, axes, shape, small: int = 5, big: int = 7, alpha: float = 0.18, k1: float = 0.66, k2: float = 0.15, gamma: float = 2.0) -> DataFrame:
    """Two boxes: the ratio of their deviations weighs mean and minimum of the small one."""
    one = local_statistics(df, axes, shape, (small,) * len(axes))
    two = local_statistics(df, axes, shape, (big,) * len(axes)).select(*axes, F.col("std").alias("big_std"))
    both = one.join(two, list(axes))
    ratio = F.col("std") / F.when(F.col("big_std") == 0, F.lit(1e-300)).otherwise(F.col("big_std"))
    a2, a3 = k1 * F.pow(ratio, F.lit(gamma)), k2 * F.pow(ratio, F.lit(gamma))
    t = (1 - alpha) * F.col("mean") + a2 * ratio * (F.col("mean") - F.col("low")) + a3 * F.col("low")
    return both.select(*axes, "v", "contrast", "midpoint", t.alias("t"))
