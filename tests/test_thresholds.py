"""Every local and global threshold against plain NumPy versions of the published formulas, written apart from the operators."""

import itertools

import numpy as np
import pytest

from lamella.operators import local_stats, threshold
from lamella.pyramid import Pyramid

rng = np.random.default_rng(8)
IMAGE = rng.integers(1, 60, (9, 11)) / 64.0
SIZE, N = 3, 9
EPS = np.finfo(float).eps


def windows(a, size):
    p = np.pad(a, size // 2, "symmetric")
    return np.lib.stride_tricks.sliding_window_view(p, (size, size)).reshape(*a.shape, -1)


def stats(a, size=SIZE):
    """mean, std, low, high; the deviation of a pixel is from its own window's mean."""
    m = windows(a, size).mean(2)
    s = np.sqrt(windows((a - m) ** 2, size).mean(2))
    return m, s, windows(a, size).min(2), windows(a, size).max(2)


def by_hand(name, a, k):
    m, s, lo, hi = stats(a)
    r = (a.max() - a.min()) / 2
    square = windows(a * a, SIZE).mean(2)
    if name == "threshold_niblack":
        return m - k * s
    if name == "threshold_sauvola":
        return m * (1 + k * (s / r - 1))
    if name == "niblack":
        return m + k * s
    if name == "sauvola":
        return m * (1 - k * (1 - s / r))
    if name == "wolf":
        return (1 - k) * m + k * a.min() + k * (s / (s.max() * (m - a.min())))
    if name == "singh":
        return k * (m + (hi - lo) * (1 - a))
    if name == "trsingh":
        return m * (1 + k * ((a - m) / (1 - (a - m)) - 1))
    if name == "wan":
        return (hi + m) / 2 * (1 - k * (1 - s / r))
    if name == "nick":
        return m + k * np.sqrt((square * N - m * m) / N)
    if name == "nick_v2":
        return m + k * np.sqrt(square)
    if name == "nick_v3":
        return m + k * np.sqrt(m * m + np.sqrt(s))
    if name == "laab":
        delta = (a - m) * (1 - m)
        v = k * ((1 + delta) / (1 - delta))
        e = np.abs(1 - 2 * v)
        return 1 - (e - (1 - 2 * v)) / (2 * e)
    if name == "contrast":
        return np.where((a - lo) * k <= (hi - a) * (2 - k), a.max(), 0)
    if name == "bataineh":
        adaptive = (s - s.min()) / (s.max() - s.min()) * a.max()
        return m - m * m * s / ((a.mean() + s) * (adaptive + s))
    if name == "rais":
        here, whole = m * s, a.mean() * a.std()
        return m + -0.3 * (whole - here) / np.maximum(whole, here) * s
    if name == "phansalkar":
        return m * (1 + 2 * np.exp(-10 * m) + k * (s / s.max() - 1))
    raise KeyError(name)


def frame(spark, a):
    return spark.createDataFrame([(y, x, float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], "y int, x int, v double")


def image(df, column="t"):
    out = np.full(IMAGE.shape, np.nan)
    for r in df.collect():
        out[r.y, r.x] = r[column]
    return out


@pytest.mark.parametrize("name", threshold.LOCAL)
def test_local_thresholds(spark, name):
    df = frame(spark, IMAGE)
    np.testing.assert_allclose(image(threshold.local_threshold(df, "yx", IMAGE.shape, name, size=SIZE, k=0.45)), by_hand(name, IMAGE, 0.45), rtol=1e-9, atol=1e-12)
    k = {"niblack": -0.2, "wan": 0.33, "contrast": 1.0}.get(name, 0.6)
    np.testing.assert_allclose(image(threshold.local_threshold(df, "yx", IMAGE.shape, name, size=SIZE)), by_hand(name, IMAGE, k), rtol=1e-9, atol=1e-12)


def feng(a, small, big, alpha, k1, k2):
    m, s, lo, _ = stats(a, small)
    ratio = s / stats(a, big)[1]
    return (1 - alpha) * m + k1 * ratio**2 * ratio * (m - lo) + k2 * ratio**2 * lo


def test_feng_and_hybrids(spark):
    df = frame(spark, IMAGE)
    np.testing.assert_allclose(image(threshold.feng(df, "yx", IMAGE.shape)), feng(IMAGE, 5, 7, 0.18, 0.66, 0.15), rtol=1e-9)
    _, _, lo, hi = stats(IMAGE, 3)
    want = IMAGE > np.where(hi - lo < 0.7, 0.5, feng(IMAGE, 3, 5, 0.12, 0.25, 0.04))
    np.testing.assert_array_equal(image(threshold.hybrid_bernsen(df, "yx", IMAGE.shape, "feng", 0.5, min_contrast=0.7), "v"), want)
    m, s, lo, hi = stats(IMAGE)
    want = IMAGE > np.where(hi - lo < 0.7, 0.5, m * (1 + 10 * np.exp(-30 * m) + 0.05 * (s / s.max() - 1)))
    np.testing.assert_array_equal(image(threshold.hybrid_bernsen(df, "yx", IMAGE.shape, "phansalkar", 0.5, size=3, min_contrast=0.7), "v"), want)
    want = IMAGE > np.where(hi - lo > 0.7, (hi + lo) / 2, 0.5)
    np.testing.assert_array_equal(image(threshold.bernsen(df, "yx", IMAGE.shape, 0.5, 3, 0.7), "v"), want)


def test_zeros_count_as_epsilon(spark):
    a = IMAGE.copy()
    a[2:7, 3:8] = 0
    got = image(threshold.local_threshold(frame(spark, a), "yx", a.shape, "rais", size=SIZE))
    u = np.where(a == 0, EPS, a)
    np.testing.assert_allclose(got, by_hand("rais", u, 0), rtol=1e-6, atol=1e-12)


@pytest.mark.parametrize("most, least", [(1, 1), (1, 3), (2, 0.5)])
def test_weighted_midpoint(spark, most, least):
    _, _, lo, hi = stats(IMAGE)
    got = image(local_stats.weighted_midpoint(frame(spark, IMAGE), "yx", IMAGE.shape, (3, 3), most, least), "v")
    np.testing.assert_allclose(got, (hi * most + lo * least) / (most + least))
    if most == least:
        np.testing.assert_allclose(image(local_stats.weighted_midpoint(frame(spark, IMAGE), "yx", IMAGE.shape, (3, 3)), "v"), (hi + lo) / 2)


def brute_multiotsu(n, c, classes):
    keep = np.flatnonzero(n)
    n, c = n[keep].astype(float), c[keep]
    best, found = -1.0, ()
    for cut in itertools.combinations(range(1, len(n)), classes - 1):
        edges = [0, *cut, len(n)]
        value = sum((n[a:b] * c[a:b]).sum() ** 2 / n[a:b].sum() for a, b in zip(edges, edges[1:]))
        if value > best + 1e-9:
            best, found = value, cut
    return [float(c[k - 1]) for k in found]


HISTOGRAMS = [np.array([5, 20, 40, 20, 5, 1, 4, 15, 30, 15, 3, 2]), np.array([0, 1, 3, 90, 40, 20, 11, 7, 4, 2, 1, 0, 1]), np.array([1, 0, 2, 4, 3, 9, 14, 60, 80, 20, 2])]


@pytest.mark.parametrize("n", HISTOGRAMS)
def test_global_thresholds_by_definition(n):
    c = np.arange(len(n)) * 2.0 + 1

    # Otsu: every cut, by the variance between the two classes.
    def between(k):
        a, b = n[: k + 1], n[k + 1 :]
        return a.sum() * b.sum() * ((a * c[: k + 1]).sum() / a.sum() - (b * c[k + 1 :]).sum() / b.sum()) ** 2 if a.sum() and b.sum() else -1

    assert threshold.otsu(n, c) == c[int(np.argmax([between(k) for k in range(len(n) - 1)]))]
    # Isodata: the first centre whose two means' middle lies in the same bin.
    for k in range(len(n) - 1):
        a, b = n[: k + 1], n[k + 1 :]
        if a.sum() and b.sum():
            middle = ((a * c[: k + 1]).sum() / a.sum() + (b * c[k + 1 :]).sum() / b.sum()) / 2
            if c[k] <= middle < c[k] + 2:
                assert threshold.isodata(n, c) == c[k]
                break
    # Yen: the largest entropic correlation.
    p = n / n.sum()
    crit = []
    for k in range(len(n) - 1):
        g1, g2, w = (p[: k + 1] ** 2).sum(), (p[k + 1 :] ** 2).sum(), p[: k + 1].sum()
        crit.append(-np.log(g1 * g2) + 2 * np.log(w * (1 - w)) if g1 * g2 > 0 and 0 < w < 1 else -np.inf)
    assert threshold.yen(n, c) == c[int(np.argmax(crit))]
    # Triangle: the point of the longer tail farthest from the line from its end to the peak.
    first, last, peak = np.flatnonzero(n)[0], np.flatnonzero(n)[-1], int(np.argmax(n))
    end = last if peak - first < last - peak else first
    tail = range(peak + 1, last + 1) if end == last else range(first, peak)
    far = {k: (n[peak] * abs(k - end) - abs(peak - end) * n[k]) / np.hypot(peak - end, n[peak]) for k in tail}
    assert threshold.triangle(n, c) == c[max(far, key=lambda k: (round(far[k], 9), -abs(k - end)))]
    for classes in (2, 3, 4):
        assert threshold.multiotsu(n, c, classes) == brute_multiotsu(n, c, classes)


def test_minimum_between_two_peaks():
    n = HISTOGRAMS[0]
    h = n.astype(float)
    while True:
        peaks = [k for k in range(1, len(h) - 1) if h[k] > h[k - 1] and h[k] >= h[k + 1]]
        if len(peaks) == 2:
            break
        h = np.convolve(np.pad(h, 1, "edge"), np.ones(3) / 3, "valid")
    low = peaks[0] + int(np.argmin(h[peaks[0] : peaks[1] + 1]))
    assert threshold.minimum(n, np.arange(12.0)) == low


def test_nextafter(spark):
    a, b = np.array([[1.0, 0.0, -2.5, np.inf]]), np.array([[2.0, -1.0, -2.5, 0.0]])
    one, two = (Pyramid.from_arrays(spark, {"0": x}, "yx") for x in (a, b))
    got = {(r.y, r.x): r.v for r in one.ufunc("nextafter", two).layer().collect()}
    want = np.nextafter(a, b)
    assert all(got[(0, k)] == want[0, k] for k in range(4))
