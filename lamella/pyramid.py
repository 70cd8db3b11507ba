"""Pyramids: lazy layers of dense voxels with metadata, and what can be done with them.

A layer is a DataFrame with one int column per axis and ``v``. All methods return new pyramids and run nothing; Catalyst plans the
whole chain when an action comes. Values are cast to the output type before and after each operator, as arrays stored in that type are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce as fold

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ufuncs
from .functions.dtypes import cast, is_float
from .meta import Layer, Meta, default_chunks, planned_shapes, shrunk_shape
from .operators import combine, filters, grid, labels, multiscale, reduce, scan, threshold


class Pyramid:
    def __init__(self, meta: Meta, layers: dict[str, DataFrame]):
        self.meta, self.layers = meta, layers
        self.labels: dict[str, Pyramid] = {}

    # -- making ------------------------------------------------------------------------------------------------

    @staticmethod
    def from_frame(df: DataFrame, axes: str, shape: tuple[int, ...], dtype: str = "int64", scale: tuple[float, ...] | None = None) -> Pyramid:
        layer = Layer(tuple(shape), tuple(scale or (1.0,) * len(axes)), None, dtype, default_chunks(shape))
        return Pyramid(Meta(axes, {"0": layer}), {"0": df.select(*axes, "v")})

    @staticmethod
    def from_arrays(spark: SparkSession, arrays: dict[str, np.ndarray], axes: str, scale: tuple[float, ...] | None = None) -> Pyramid:
        """From small arrays on the driver; scales of lower layers follow from the shapes."""
        layers, frames = {}, {}
        ref = next(iter(arrays.values()))
        for path, a in arrays.items():
            s = tuple(x * n / m for x, n, m in zip(scale or (1.0,) * a.ndim, ref.shape, a.shape))
            layers[path] = Layer(a.shape, s, None, str(a.dtype), default_chunks(a.shape))
            import pandas as pd

            index = np.indices(a.shape).reshape(a.ndim, -1)
            values = a.ravel() if a.dtype != np.float16 else a.ravel().astype(np.float32)
            kind = {"u": np.int64}.get(a.dtype.kind)
            pdf = pd.DataFrame({x: index[k].astype(np.int32) for k, x in enumerate(axes)} | {"v": values.astype(kind) if kind else values})
            frames[path] = spark.createDataFrame(pdf)
        return Pyramid(Meta(axes, layers), frames)

    @staticmethod
    def create(spark: SparkSession, axes: str, shape: tuple[int, ...], value: Column | float = 0, layers: int = 1, factor: tuple[float, ...] | None = None, dtype: str = "int64") -> Pyramid:
        """Layers made independently of each other, each of the planned shape and filled with ``value``."""
        factor = factor or tuple(2.0 if a in "yx" else 1.0 for a in axes)
        column = value if isinstance(value, Column) else F.lit(value)
        meta, frames = {}, {}
        for k, s in enumerate(planned_shapes(shape, factor, layers)):
            meta[str(k)] = Layer(s, tuple(n / m for n, m in zip(shape, s)), None, dtype, default_chunks(s))
            frames[str(k)] = grid.full(spark, axes, s, cast(column.cast("double"), "float64", dtype))
        return Pyramid(Meta(axes, meta), frames)

    @staticmethod
    def zeros(spark: SparkSession, axes: str, shape: tuple[int, ...], **kw) -> Pyramid:
        return Pyramid.create(spark, axes, shape, 0, **kw)

    @staticmethod
    def ones(spark: SparkSession, axes: str, shape: tuple[int, ...], **kw) -> Pyramid:
        return Pyramid.create(spark, axes, shape, 1, **kw)

    @staticmethod
    def rand(spark: SparkSession, axes: str, shape: tuple[int, ...], seed: int = 0, dtype: str = "float64", **kw) -> Pyramid:
        return Pyramid.create(spark, axes, shape, F.rand(seed), dtype=dtype, **kw)

    # -- layers ------------------------------------------------------------------------------------------------

    @property
    def axes(self) -> str:
        return self.meta.axes

    def layer(self, path: str | int | None = None) -> DataFrame:
        return self.layers[self.meta.reference if path is None else str(path)]

    __getitem__ = layer

    def frame(self) -> DataFrame:
        """All layers in one table with a ``layer`` column."""
        return fold(DataFrame.unionByName, [df.select(F.lit(p).alias("layer"), *self.axes, "v") for p, df in self.layers.items()])

    def select_layers(self, which: str | int | list[str] = "all") -> Pyramid:
        paths = self.meta.paths if which == "all" else self.meta.paths[:which] if isinstance(which, int) else [str(p) for p in which]
        if isinstance(which, str) and which != "all":
            raise ValueError("layers are 'all', a number of first layers, or a list")
        return Pyramid(replace(self.meta, layers={p: self.meta.layers[p] for p in paths}), {p: self.layers[p] for p in paths})

    shrink = select_layers

    def drop_layer(self, path: str) -> Pyramid:
        return self.select_layers([p for p in self.meta.paths if p != path])

    def with_meta(self, meta: Meta) -> Pyramid:
        return Pyramid(meta, self.layers)

    def _map(self, f: Callable[[str, DataFrame, Layer], DataFrame], shape: Callable[[Layer], tuple[int, ...]] | None = None, dtype: str | None = None) -> Pyramid:
        meta, frames = {}, {}
        for p, df in self.layers.items():
            one = self.meta.layers[p]
            frames[p] = f(p, df, one)
            s = shape(one) if shape else one.shape
            meta[p] = replace(one, shape=s, dtype=dtype or one.dtype, chunks=default_chunks(s))
        return Pyramid(replace(self.meta, layers=meta), frames)

    # -- cropping, casting -------------------------------------------------------------------------------------

    def subset(self, bounds: dict[str, tuple[int, int]]) -> Pyramid:
        """Crop in coordinates of the full resolution; bounds of other layers shrink with their shape, truncated."""
        ref = self.meta.layers[self.meta.reference].shape

        def of(layer: Layer) -> dict[str, tuple[int, int]]:
            k = {a: self.meta.index(a) for a in bounds}
            return {a: (int(lo * layer.shape[k[a]] / ref[k[a]]), int(hi * layer.shape[k[a]] / ref[k[a]])) for a, (lo, hi) in bounds.items()}

        return self._map(lambda p, df, layer: grid.crop(df, of(layer)), lambda layer: tuple((lambda b: b[1] - b[0])(of(layer)[a]) if a in bounds else n for a, n in zip(self.axes, layer.shape)))

    def astype(self, dtype: str) -> Pyramid:
        return self._map(lambda p, df, layer: df.withColumn("v", cast(F.col("v"), layer.dtype, dtype)), dtype=dtype)

    # -- element-wise ------------------------------------------------------------------------------------------

    def ufunc(self, name: str, *others: Pyramid | float, output_dtype: str | None = None) -> Pyramid:
        """An element-wise operator with pyramids of the same shapes or with scalars."""
        for o in others:
            if isinstance(o, Pyramid) and [x.shape for x in o.meta.layers.values()] != [x.shape for x in self.meta.layers.values()]:
                raise ValueError("pyramids must have the same layers and shapes")
        u = ufuncs.UFUNCS[name]

        def run(p: str, df: DataFrame, layer: Layer) -> DataFrame:
            out = output_dtype or layer.dtype
            real = is_float(out)
            df = df.select(*self.axes, cast(F.col("v"), layer.dtype, out).alias("v"))
            operands = [F.col("v")]
            for k, o in enumerate(others):
                if isinstance(o, Pyramid):
                    other = o.layers[p].select(*self.axes, cast(F.col("v"), o.meta.layers[p].dtype, out).alias(f"v{k}"))
                    df = df.join(other, list(self.axes))
                    operands.append(F.col(f"v{k}"))
                else:
                    operands.append(F.lit(o))
            value = ufuncs.apply(name, *operands, real=real)
            if u.result == "bool":
                value = cast(value.cast("int").cast("bigint"), "int64", out)
            elif u.result == "real" or (real and name in ufuncs.REAL_FORMS):
                value = cast(value.cast("double"), "float64", out)
            elif not real:
                value = cast(value.cast("bigint"), "int64", out)
            else:
                value = cast(value.cast("double"), "float64", out)
            return df.select(*self.axes, value.alias("v"))

        return self._map(run, dtype=output_dtype)

    def __add__(self, o): return self.ufunc("add", o)  # noqa: E704
    def __sub__(self, o): return self.ufunc("subtract", o)  # noqa: E704
    def __mul__(self, o): return self.ufunc("multiply", o)  # noqa: E704
    def __truediv__(self, o): return self.ufunc("divide", o)  # noqa: E704

    __radd__, __rmul__ = __add__, __mul__

    def __rsub__(self, o): return self.ufunc("negative").ufunc("add", o)  # noqa: E704

    def __rtruediv__(self, o: float) -> Pyramid:
        def run(p: str, df: DataFrame, layer: Layer) -> DataFrame:
            return df.select(*self.axes, cast(ufuncs.quotient(F.lit(float(o)), F.col("v").cast("double")), "float64", layer.dtype).alias("v"))

        return self._map(run)

    # -- reductions, scans -------------------------------------------------------------------------------------

    def reduce(self, name: str, axis: str, output_dtype: str | None = None, **kw) -> Pyramid:
        def run(p: str, df: DataFrame, layer: Layer) -> DataFrame:
            if name in ("nanargmax", "nanargmin"):
                out = reduce.arg_reduce(df, self.axes, name, axis)
            elif name == "moment":
                out = reduce.moment(df, self.axes, kw["k"], axis)
            elif name == "reduction":
                out = reduce.reduction(df, self.axes, kw["chunk"], kw["aggregate"], axis)
            else:
                out = reduce.reduce(df, self.axes, name, axis)
            source = {"boolean": "bool", "bigint": "int64"}.get(out.schema["v"].dataType.simpleString(), "float64")
            return out.withColumn("v", cast(F.col("v") if source != "float64" else F.col("v").cast("double"), source, output_dtype or layer.dtype))

        return self._map(run, lambda layer: tuple(1 if a in axis else n for a, n in zip(self.axes, layer.shape)), output_dtype)

    def total(self, name: str, path: str | None = None) -> float:
        """One value over a layer, the full resolution by default."""
        return reduce.total(self.layer(path), name).first()[0]

    def sum(self, path: str | None = None): return self.total("sum", path)  # noqa: E704
    def min(self, path: str | None = None): return self.total("min", path)  # noqa: E704
    def max(self, path: str | None = None): return self.total("max", path)  # noqa: E704
    def mean(self, path: str | None = None): return self.total("mean", path)  # noqa: E704
    def median(self, path: str | None = None): return self.total("median", path)  # noqa: E704

    def topk(self, k: int, axis: str) -> Pyramid:
        return self._map(lambda p, df, layer: reduce.topk(df, self.axes, k, axis), lambda layer: tuple(min(abs(k), n) if a == axis else n for a, n in zip(self.axes, layer.shape)))

    def scan(self, name: str, axis: str, block: int | None = None, output_dtype: str | None = None) -> Pyramid:
        def run(p: str, df: DataFrame, layer: Layer) -> DataFrame:
            out = scan.scan(df, self.axes, name, axis, block)
            integral = out.schema["v"].dataType.simpleString() == "bigint"
            return out.withColumn("v", cast(F.col("v") if integral else F.col("v").cast("double"), "int64" if integral else "float64", output_dtype or layer.dtype))

        return self._map(run, dtype=output_dtype)

    def gradient(self, axis: str, output_dtype: str | None = None) -> Pyramid:
        return self._map(lambda p, df, layer: scan.gradient(df, self.axes, axis).withColumn("v", cast(F.col("v"), "float64", output_dtype or layer.dtype)), dtype=output_dtype)

    def delete(self, obj: list[int], axis: str) -> Pyramid:
        gone = len(set(obj))
        return self._map(lambda p, df, layer: grid.delete(df, axis, obj), lambda layer: tuple(n - gone if a == axis else n for a, n in zip(self.axes, layer.shape)))

    def pad(self, widths: dict[str, tuple[int, int]], fill: float = 0) -> Pyramid:
        return self._map(lambda p, df, layer: grid.pad(df, self.axes, layer.shape, widths, fill), lambda layer: tuple(n + sum(widths.get(a, (0, 0))) for a, n in zip(self.axes, layer.shape)))

    # -- filters, thresholds, labels ---------------------------------------------------------------------------

    def filter(self, name: str, *args, output_dtype: str | None = None, **kw) -> Pyramid:
        def run(p: str, df: DataFrame, layer: Layer) -> DataFrame:
            out = output_dtype or layer.dtype
            if name in ("uniform_filter", "gaussian_filter"):
                kw["integral"] = not is_float(out)
            df = df.withColumn("v", cast(F.col("v"), layer.dtype, out))
            return getattr(filters, name)(df, self.axes, layer.shape, *args, **kw).select(*self.axes, cast(F.col("v").cast("double"), "float64", out).alias("v"))

        return self._map(run, dtype=output_dtype)

    def threshold(self, method: str, **kw) -> Pyramid:
        """manual, otsu, isodata, yen, multiotsu, minimum, triangle, or a local method; layer by layer."""

        def run(p: str, df: DataFrame, layer: Layer) -> DataFrame:
            if method == "manual":
                return threshold.above(df, self.axes, kw.get("threshold", 0))
            if method in threshold.GLOBAL or method == "multiotsu":
                return threshold.above(df, self.axes, threshold.global_threshold(df, method, **kw))
            if method.endswith("_bernsen"):
                k = dict(kw)
                t = k.pop("threshold", None)
                t = threshold.global_threshold(df, k.pop("global_method", "otsu")) if t is None else t
                return threshold.hybrid_bernsen(df, self.axes, layer.shape, method.removesuffix("_bernsen"), t, **k)
            return threshold.local_mask(df, self.axes, layer.shape, method, **kw)

        return self._map(run, dtype="int64")

    def label(self, dense: bool = False) -> Pyramid:
        """Components of the full resolution; lower layers follow by foreground-preserving downscaling to their shapes."""
        ref = self.meta.reference
        layer = self.meta.layers[ref]
        out = Pyramid(replace(self.meta, layers={ref: replace(layer, dtype="int64")}), {ref: labels.label(self.layers[ref], self.axes, layer.shape, dense)})
        if len(self.layers) == 1:
            return out
        second = self.meta.layers[self.meta.paths[1]].shape
        factor = tuple(int(n / m + 0.5) for n, m in zip(layer.shape, second))
        return out.rescale(len(self.layers), factor, "softmax")

    # -- layers from layers ------------------------------------------------------------------------------------

    def rescale(self, n_layers: int, factor: int | tuple[float, ...] | dict[str, float] = 2, kernel: str | Callable = "mean") -> Pyramid:
        """Rebuild all layers but the reference, each from the one above; values are stored in the layer's type at each level."""
        ref = self.meta.reference
        if isinstance(factor, dict):
            factor = tuple(factor.get(a, 1) for a in self.axes)
        if isinstance(factor, (int, float)):
            factor = tuple(factor if a in "yx" else 1 for a in self.axes)
        whole = tuple(int(f + 0.5) for f in factor)
        top = self.meta.layers[ref]
        df, layer = self.layers[ref], top
        frames, meta = {"0": df}, {"0": layer}
        for k in range(1, n_layers):
            shape = shrunk_shape(layer.shape, whole)
            df = multiscale.downscale(df, self.axes, whole, kernel).withColumn("v", cast(F.col("v").cast("double"), "float64", top.dtype))
            layer = replace(layer, shape=shape, scale=tuple(s * n / m for s, n, m in zip(top.scale, top.shape, shape)), chunks=default_chunks(shape))
            frames[str(k)], meta[str(k)] = df, layer
        return Pyramid(replace(self.meta, layers=meta), frames)

    def apply(self, f: Callable[[DataFrame, str, tuple[int, ...]], DataFrame], output_dtype: str | None = None) -> Pyramid:
        """A function of (layer, axes, shape) over all layers."""
        return self._map(lambda p, df, layer: f(df, self.axes, layer.shape), dtype=output_dtype)

    def compute_properties(self, label_name: str, path: str | None = None, features: tuple[str, ...] = ("area", "intensity_mean", "intensity_max")) -> DataFrame:
        return labels.properties(self.labels[label_name].layer(path), self.layer(path), self.axes, features)


class PyramidCollection:
    """Pyramids with their common layers."""

    def __init__(self, pyramids: list[Pyramid]):
        if not pyramids:
            raise ValueError("a collection needs a pyramid")
        common = [p for p in pyramids[0].meta.paths if all(p in q.meta.paths for q in pyramids)]
        self.pyramids = [p.select_layers(common) for p in pyramids]

    def add(self, pyramid: Pyramid) -> PyramidCollection:
        return PyramidCollection([*self.pyramids, pyramid])

    def drop(self, k: int) -> PyramidCollection:
        return PyramidCollection([p for i, p in enumerate(self.pyramids) if i != k])

    def uniform(self, what: str) -> bool:
        """Whether axes, units, scales, shapes, chunks, compressors, dtypes or separators are the same in all."""
        of = {"axes": lambda m: m.axes, "units": lambda m: m.units}
        attribute = {"scales": "scale", "shapes": "shape", "chunks": "chunks", "compressors": "compressor", "dtypes": "dtype", "separators": "separator"}
        value = of.get(what) or (lambda m: tuple(getattr(x, attribute[what]) for x in m.layers.values()))
        return len({value(p.meta) for p in self.pyramids}) == 1

    def extensible_along(self, axis: str) -> bool:
        cut = lambda m: tuple(tuple(n for a, n in zip(m.axes, x.shape) if a != axis) for x in m.layers.values())
        return self.uniform("axes") and len({cut(p.meta) for p in self.pyramids}) == 1

    def concatenate(self, axis: str = "z") -> Pyramid:
        first = self.pyramids[0]
        frames, meta = {}, {}
        for path in first.meta.paths:
            dtype = first.meta.layers[path].dtype
            parts = [(p.layers[path].withColumn("v", cast(F.col("v"), p.meta.layers[path].dtype, dtype)), p.meta.layers[path].shape) for p in self.pyramids]
            frames[path], shape = combine.concatenate(parts, first.axes, axis)
            meta[path] = replace(first.meta.layers[path], shape=shape, chunks=default_chunks(shape))
        return Pyramid(replace(first.meta, layers=meta), frames)

    def frame(self) -> DataFrame:
        """All pyramids in one table with the columns ``img`` and ``layer``."""
        return fold(DataFrame.unionByName, [p.frame().withColumn("img", F.lit(k)) for k, p in enumerate(self.pyramids)])
