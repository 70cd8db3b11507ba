"""Array operators against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.api import Aggregative, BasicOperations, Converter, Filters, Settings, Threshold
from lamella.meta import ImageLabelMeta, Layer, Meta, planned_shapes
from lamella.operators import filters, labels, neighbourhood, reduce, threshold
from lamella.pyramid import Pyramid, PyramidCollection
from lamella.sources import zarr

RNG = np.random.default_rng(1)
A = RNG.integers(-50, 50, (7, 9)).astype(np.int64)
B = RNG.integers(1, 9, (7, 9)).astype(np.int64)
PAD = {"reflect": "symmetric", "nearest": "edge", "mirror": "reflect", "wrap": "wrap", "constant": "constant"}


def pyr(spark, a, axes="yx"):
    return Pyramid.from_arrays(spark, {"0": a}, axes)


def array(df, axes, shape, dtype=float):
    pdf = df.toPandas()
    out = np.full(shape, -99999, dtype)
    out[tuple(pdf[a].to_numpy() for a in axes)] = pdf["v"].to_numpy()
    assert len(pdf) == out.size
    return out


@pytest.mark.parametrize("name,f", [("add", np.add), ("floor_divide", np.floor_divide), ("mod", np.mod), ("fmod", np.fmod), ("left_shift", np.left_shift), ("right_shift", np.right_shift), ("bitwise_xor", np.bitwise_xor), ("greater", np.greater), ("hypot", np.hypot)])
def test_binary(spark, name, f):
    got = pyr(spark, A).ufunc(name, pyr(spark, B)).layer()
    np.testing.assert_array_equal(array(got, "yx", A.shape, np.int64), f(A, B).astype(np.int64))


def test_division_by_zero_and_logs(spark):
    x = np.array([[0.0, -1.0, 2.0, np.nan]])
    with np.errstate(all="ignore"):
        for name in ("log", "sqrt", "reciprocal", "log1p", "arccosh"):
            np.testing.assert_allclose(array(pyr(spark, x).ufunc(name).layer(), "yx", x.shape), getattr(np, name)(x))
        np.testing.assert_allclose(array(pyr(spark, x).ufunc("divide", 0.0).layer(), "yx", x.shape), x / 0.0)


def test_casts_wrap(spark):
    x = np.array([[300, -1, 70000, 5]])
    for dtype in ("uint8", "int8", "int16", "uint16", "uint32", "bool"):
        np.testing.assert_array_equal(array(pyr(spark, x).astype(dtype).layer(), "yx", x.shape, np.int64), x.astype(dtype).astype(np.int64))


def test_reductions_keep_axes(spark):
    for name in ("sum", "min", "max", "ptp"):
        got = array(pyr(spark, A).reduce(name, "x").layer(), "yx", (7, 1), np.int64)
        np.testing.assert_array_equal(got, getattr(np, name)(A, axis=1, keepdims=True))


def test_two_phase_reduction_spreads_its_groups_and_keeps_nan(spark):
    a = np.random.default_rng(3).normal(size=(400, 3, 5))
    a[7, :, 2] = np.nan
    two_phase = lambda axis: pyr(spark, a, "zyx").reduce("reduction", axis, chunk=lambda s: s.sum(skipna=False), aggregate=lambda s: s.sum(skipna=False))
    for axis, k in (("x", 2), ("yx", (1, 2)), ("z", 0)):
        want = a.sum(k, keepdims=True)
        np.testing.assert_allclose(array(two_phase(axis).layer(), "zyx", want.shape), want)
    assert np.isnan(two_phase("zyx").layer().first()["v"])
    # Every group takes a call of Python, so few bytes in many groups mustn't end in one task.
    assert two_phase("x").layer().select(F.spark_partition_id()).distinct().count() > 1
    empty = reduce.reduction(spark.createDataFrame([], "y int, x int, v double"), "yx", max, max, "yx")
    assert empty.count() == 0


def convex_area(at):
    """Pixels that lie beyond no line through two of the points that has none of them beyond it; coordinates are doubled."""
    points = np.unique(np.concatenate([2 * at + step for step in ((0, 1), (0, -1), (1, 0), (-1, 0))]), axis=0)
    d = points[None] - points[:, None]
    side = lambda q: d[..., 0] * (q[1] - points[:, None, 1]) - d[..., 1] * (q[0] - points[:, None, 0])
    edges = np.minimum.reduce([side(q) for q in points]) >= 0
    box = [range(lo, hi + 1) for lo, hi in zip(at.min(0), at.max(0))]
    return sum((side((2 * y, 2 * x))[edges] >= 0).all() for y in box[0] for x in box[1])


def test_convex_areas_of_many_labels_are_spread(spark, monkeypatch):
    v = np.zeros((24, 30), np.int64)
    v[0, :5] = v[3:6, 20] = v[5:14, 3] = v[13, 3:16] = v[10:13, 16] = 1
    v[range(15, 23), range(10, 26, 2)] = v[range(15, 23), range(11, 27, 2)] = 1
    v += 2 * (np.random.default_rng(3).random(v.shape) > 0.95) * (v == 0)
    df = pyr(spark, v).layer()
    names = array(labels.label(df, "yx", v.shape), "yx", v.shape, np.int64)
    got = {r["label"]: r["area_convex"] for r in labels.properties(labels.label(df, "yx", v.shape), df, "yx", ("area_convex",)).collect()}
    assert set(got) == set(names[names > 0])
    assert got == {n: convex_area(np.argwhere(names == n)) for n in got}
    # A label in several pieces, as tables of labels may have it: their common hull.
    apart = spark.createDataFrame([(0, 0, 5), (4, 8, 5), (7, 2, 6)], "y int, x int, v long")
    want = [(5, 2, convex_area(np.array([(0, 0), (4, 8)]))), (6, 1, 1)]
    assert sorted(map(tuple, labels.properties(apart, apart, "yx", ("area", "area_convex")).collect())) == want

    def tasks(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        for b in batches:
            yield pa.RecordBatch.from_arrays([b["label"], pa.array([TaskContext.get().partitionId()] * len(b), pa.int64())], ["label", "area_convex"])

    monkeypatch.setattr(labels, "_hulls", tasks)
    assert labels.properties(labels.label(df, "yx", v.shape), df, "yx", ("area_convex",)).select("area_convex").distinct().count() > 1


@pytest.mark.parametrize("mode", list(PAD))
def test_correlation_in_every_mode(spark, mode):
    w = RNG.normal(size=(3, 4))
    got = array(filters.correlate(pyr(spark, A).layer(), "yx", A.shape, w, mode, 3.0), "yx", A.shape)
    kw = {"constant_values": 3.0} if mode == "constant" else {}
    p = np.pad(A.astype(float), ((1, 1), (2, 1)), PAD[mode], **kw)
    want = np.einsum("yxij,ij->yx", np.lib.stride_tricks.sliding_window_view(p, w.shape), w)
    np.testing.assert_allclose(got, want)


def test_blocks_don_t_change_results(spark):
    df = pyr(spark, A).layer()
    want = array(filters.median_filter(df, "yx", A.shape, 3), "yx", A.shape)
    kernel = lambda a: np.pad(np.median(np.lib.stride_tricks.sliding_window_view(a, (3, 3)), axis=(2, 3)), 1)
    for block in ((2, 3), (7, 9), (4, 4)):
        np.testing.assert_array_equal(array(neighbourhood.blocks(df.withColumn("v", df.v.cast("double")), "yx", A.shape, kernel, (1, 1), block), "yx", A.shape), want)
    large = filters.rank_filter(df, "yx", A.shape, lambda n: n // 2, 9, block=4)
    p = np.pad(A, 4, "symmetric")
    np.testing.assert_array_equal(array(large, "yx", A.shape), np.median(np.lib.stride_tricks.sliding_window_view(p, (9, 9)), axis=(2, 3)))


def test_global_thresholds():
    n, c = np.array([5, 20, 40, 20, 5, 1, 4, 15, 30, 15, 3, 2]), np.arange(12.0)
    assert 3 <= threshold.otsu(n, c) <= 6 and 3 <= threshold.minimum(n, c) <= 6


def test_labels(spark):
    m = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 0, 1]])
    p = pyr(spark, m).label(dense=True)
    np.testing.assert_array_equal(array(p.layer(), "yx", m.shape, np.int64), [[1, 0, 0, 2], [0, 1, 0, 2], [0, 0, 0, 0], [3, 3, 0, 4]])
    np.testing.assert_array_equal(array(p.label(dense=True).layer(), "yx", m.shape, np.int64), array(p.layer(), "yx", m.shape, np.int64))
    props = {r.label: r.area for r in labels.properties(p.layer(), pyr(spark, m).layer(), "yx", ("area",)).collect()}
    assert props == {1: 2, 2: 2, 3: 2, 4: 1}


def test_rescale_crop_and_concatenate(spark):
    p = pyr(spark, A).rescale(3, 2)
    assert [x.shape for x in p.meta.layers.values()] == [(7, 9), (4, 5), (2, 3)]
    padded = np.pad(A, ((0, 1), (0, 1)))
    want = np.trunc(padded.reshape(4, 2, 5, 2).sum((1, 3)) / 4)
    np.testing.assert_array_equal(array(p.layer("1"), "yx", (4, 5), np.int64), want)
    parts = [pyr(spark, A).subset({"y": b}) for b in ((0, 3), (3, 7))]
    np.testing.assert_array_equal(array(PyramidCollection(parts).concatenate("y").layer(), "yx", A.shape, np.int64), A)
    with pytest.raises(ValueError):
        PyramidCollection([parts[0], pyr(spark, A.T)]).concatenate("y")


@pytest.mark.parametrize("codec,sep", [("zlib", "."), ("zstd", "/"), (None, "."), ("blosc", "/")])
def test_zarr_round_trip(spark, tmp_path, codec, sep):
    a = RNG.integers(0, 200, (2, 7, 9)).astype(np.uint8)
    p = pyr(spark, a, "zyx").rescale(2, 2)
    zarr.write_pyramid(p, str(tmp_path / "p"), codec=codec, chunks=None, separator=sep)
    back = zarr.read_pyramid(spark, str(tmp_path / "p"))
    assert back.meta.to_json() == p.meta.to_json() and back.meta.layers["0"].dtype == "uint8"
    np.testing.assert_array_equal(array(back.layer(), "zyx", a.shape, np.int64), a)
    zarr.write_array(p.layer(), str(tmp_path / "q"), "zyx", a.shape, "uint8", (1, 3, 4), codec, sep)
    got = zarr.read_array(spark, str(tmp_path / "q"), crop={"y": (2, 5), "x": (3, 9)}).toPandas()
    assert len(got) == 2 * 3 * 6 and (a[got.z, got.y, got.x] == got.v).all()
    with pytest.raises(FileExistsError):
        zarr.write_pyramid(p, str(tmp_path / "p"))


def test_overwrite_leaves_nothing_of_the_old_store(spark, tmp_path):
    path = str(tmp_path / "p")
    zarr.write_pyramid(pyr(spark, np.full((4, 4), 7)).rescale(2, 2), path, chunks=(2, 2), separator="/")
    half = Pyramid(pyr(spark, np.ones((4, 4), np.int64)).meta, {"0": pyr(spark, np.ones((4, 4), np.int64)).layer().where("y < 2")})
    zarr.write_pyramid(half, path, overwrite=True, chunks=(2, 2))
    np.testing.assert_array_equal(array(zarr.read_array(spark, path + "/0"), "yx", (4, 4), np.int64), [[1] * 4] * 2 + [[0] * 4] * 2)
    back = zarr.read_pyramid(spark, path)
    assert back.meta.paths == ["0"] and sorted(x.name for x in tmp_path.iterdir()) == ["p"] and not (tmp_path / "p" / "1").exists()
    zarr.write_pyramid(back.ufunc("add", 1), path, overwrite=True, chunks=(2, 2))  # reads what it overwrites
    np.testing.assert_array_equal(array(zarr.read_array(spark, path + "/0"), "yx", (4, 4), np.int64), [[2] * 4] * 2 + [[1] * 4] * 2)
    with pytest.raises(ValueError):
        zarr.write_pyramid(half, "bucket://somewhere/p")


def test_blosc_frames():
    import struct
    import zlib

    from lamella.sources import blosc

    data = np.arange(5000, dtype="<i4").tobytes() + b"xyz"
    for name in ("lz4", "zlib", "zstd", "snappy"):
        for item in (1, 2, 4, 8):
            frame = blosc.encode(data, item, name)
            assert blosc.decode(frame) == data and struct.unpack("<I", frame[12:16])[0] == len(frame)
    noise = RNG.bytes(999)
    assert blosc.decode(blosc.encode(noise, 4)) == noise and blosc.decode(blosc.encode(b"", 4)) == b""
    # A frame as other encoders make them: two blocks, the first split into a stream per byte, the second whole, one stream stored plainly.
    a, item, most = np.arange(300, dtype="<u4") * 77, 4, 1024
    raw, blocks = a.tobytes(), []
    for at in (0, most):
        part = np.frombuffer(raw[at : at + most], np.uint8).reshape(-1, item).T
        streams = [s.tobytes() for s in part] if at == 0 else [part.tobytes()]
        packed = [zlib.compress(s) if k != 1 else s for k, s in enumerate(streams)]
        blocks.append(b"".join(struct.pack("<i", len(p)) + p for p in packed))
    body = struct.pack("<II", 24, 24 + len(blocks[0])) + b"".join(blocks)
    assert blosc.decode(struct.pack("<BBBBIII", 2, 1, 1 | 3 << 5, item, len(raw), most, 16 + len(body)) + body) == raw
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, 1184).reshape(296, 32 // 8), axis=1, bitorder="little").T
    mixed = np.packbits(bits, axis=1, bitorder="little").tobytes() + raw[1184:]
    body = struct.pack("<Ii", 20, len(zlib.compress(mixed))) + zlib.compress(mixed)
    assert blosc.decode(struct.pack("<BBBBIII", 2, 1, 4 | 16 | 3 << 5, item, len(raw), len(raw), 16 + len(body)) + body) == raw
    with pytest.raises(ValueError):
        blosc.decode(struct.pack("<BBBBIII", 2, 1, 16, 1, 100, 100, 40) + struct.pack("<Ii", 20, 5) + b"abcde")


def test_facades(spark, tmp_path):
    out = str(tmp_path / "o")
    s = Settings(input_subset_indices={"x": (1, 8)}, overwrite=True, rescale_output=True, n_scales=2)
    BasicOperations(spark, s).add(pyr(spark, A), 3, out=out)
    back = zarr.read_pyramid(spark, out)
    np.testing.assert_array_equal(array(back.layer(), "yx", (7, 7), np.int64), A[:, 1:8] + 3)
    assert back.meta.paths == ["0", "1"]
    mask = Threshold(spark).threshold_otsu(out).layer()
    assert {r.v for r in mask.distinct().collect()} == {0, 1}
    assert Filters(spark).maximum_filter(pyr(spark, A), 3).layer().count() == A.size
    assert Aggregative(spark).concatenate([out, out], "y").meta.layers["0"].shape == (14, 7)
    assert Converter().to_omezarr("a.tif", "b.zarr", resolutions=3) == "bioformats2raw --resolutions=3 a.tif b.zarr"
    with pytest.raises(TypeError):
        BasicOperations(spark).set(nonsense=1)


def test_metadata():
    m = Meta("zyx", {str(k): Layer((4, 8 // 2**k, 8 // 2**k), (1.0, 0.5 * 2**k, 0.5 * 2**k)) for k in range(3)} | {"10": Layer((4, 1, 1), (1, 4, 4))})
    assert m.paths == ["0", "1", "2", "10"] and Meta.from_json(m.to_json(), m.layers).to_json() == m.to_json()
    assert m.update_scales({"x": 2.0}).layers["1"].scale == (1.0, 1.0, 4.0)
    assert m.update_units({"x": "nm"}).units == ("Slice", "Pixel", "nm")
    assert m.drop_axis("z").axes == "yx" and planned_shapes((3, 21), (1, 2), 2) == [(3, 21), (3, 10)]
    for bad in (lambda: Meta("yy", m.layers), lambda: Meta("yx", {}), lambda: Meta("yx", m.layers), lambda: Meta.from_json({}, {}), lambda: ImageLabelMeta().to_json()):
        with pytest.raises(ValueError):
            bad()
    one = ImageLabelMeta()
    one.add_color(2, (1, 2, 3, 4))
    one.add_property(2, area=5)
    assert ImageLabelMeta.from_json(one.to_json()).properties == {2: {"area": 5}}
