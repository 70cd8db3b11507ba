"""Facades by family: each method takes pyramids or paths and returns a pyramid, written to ``out`` where that is given."""

from __future__ import annotations

import os
import shlex
import subprocess
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from glob import glob
from typing import Any

from pyspark.sql import SparkSession

from .functions.ufuncs import UFUNCS
from .meta import Meta
from .operators.reduce import REDUCTIONS
from .operators.scan import SCANS
from .pyramid import Pyramid, PyramidCollection
from .sources import zarr


@dataclass
class Settings:
    """What every operator takes: cropping, layers, type and storage of the result, and rebuilding of lower layers."""

    input_subset_indices: dict[str, tuple[int, int]] | None = None
    select_layers: str | int | list[str] = "all"
    rescale_output: bool = False
    n_scales: int | None = None
    scale_factor: int | tuple[float, ...] | None = None
    output_dtype: str | None = None
    output_chunks: tuple[int, ...] | None = None
    output_compressor: str | None = "zlib"
    output_dimension_separator: str = "."
    output_store: str | None = None
    overwrite: bool = False


@dataclass
class Facade:
    spark: SparkSession
    settings: Settings = field(default_factory=Settings)

    def set(self, **values: Any) -> Facade:
        """A facade with other settings; unknown names raise TypeError."""
        return type(self)(self.spark, replace(self.settings, **values))

    def read(self, x: Pyramid | str | float) -> Any:
        return zarr.read_pyramid(self.spark, x) if isinstance(x, str) else x

    def run(self, x: Pyramid | str, f: Callable[[Pyramid], Pyramid], out: str | None = None) -> Pyramid:
        s = self.settings
        p = self.read(x)
        if s.rescale_output:
            layers = s.n_scales or len(p.layers)
            p = p.select_layers([p.meta.reference])
        elif s.n_scales is not None or s.scale_factor is not None:
            raise ValueError("n_scales and scale_factor need rescale_output")
        p = p.select_layers(s.select_layers)
        if s.input_subset_indices:
            p = p.subset(s.input_subset_indices)
        p = f(p)
        if s.rescale_output:
            p = p.rescale(layers, s.scale_factor or 2)
        store = out or s.output_store
        if store:
            zarr.write_pyramid(p, store, s.overwrite, s.output_compressor, s.output_chunks, s.output_dimension_separator)
        return p


class BasicOperations(Facade):
    """Element-wise operators, reductions and scans by name, for example ``ops.add(a, b)`` or ``ops.sum(a, axis="x")``."""

    def __getattr__(self, name: str) -> Callable[..., Pyramid]:
        if name in UFUNCS and UFUNCS[name].arity >= 1:
            return lambda x, *others, out=None: self.run(x, lambda p: p.ufunc(name, *map(self.read, others), output_dtype=self.settings.output_dtype), out)
        if name in REDUCTIONS or name in ("nanargmax", "nanargmin", "moment", "reduction"):
            return lambda x, axis, out=None, **kw: self.run(x, lambda p: p.reduce(name, axis, self.settings.output_dtype, **kw), out)
        if name in SCANS:
            return lambda x, axis, out=None, **kw: self.run(x, lambda p: p.scan(name, axis, output_dtype=self.settings.output_dtype, **kw), out)
        raise AttributeError(name)

    def topk(self, x, k: int, axis: str, out: str | None = None):
        return self.run(x, lambda p: p.topk(k, axis), out)

    def gradient(self, x, axis: str, out: str | None = None):
        return self.run(x, lambda p: p.gradient(axis, self.settings.output_dtype), out)

    def delete(self, x, obj: list[int], axis: str, out: str | None = None):
        return self.run(x, lambda p: p.delete(obj, axis), out)

    def pad(self, x, widths: dict[str, tuple[int, int]], fill: float = 0, out: str | None = None):
        return self.run(x, lambda p: p.pad(widths, fill), out)

    def zeros(self, axes: str, shape: tuple[int, ...], **kw):
        return Pyramid.zeros(self.spark, axes, shape, **kw)

    def ones(self, axes: str, shape: tuple[int, ...], **kw):
        return Pyramid.ones(self.spark, axes, shape, **kw)

    def rand(self, axes: str, shape: tuple[int, ...], **kw):
        return Pyramid.rand(self.spark, axes, shape, **kw)

    def create(self, axes: str, shape: tuple[int, ...], value: float = 0, **kw):
        return Pyramid.create(self.spark, axes, shape, value, **kw)


FILTERS = ("convolve", "correlate", "uniform_filter", "minimum_filter", "maximum_filter", "mean_filter", "median_filter", "percentile_filter", "gaussian_filter", "gaussian_laplace", "laplace", "prewitt", "sobel", "generic_gradient_magnitude", "gaussian_gradient_magnitude", "gaussian_sobel_magnitude", "gaussian_prewitt_magnitude")


class Filters(Facade):
    def __getattr__(self, name: str) -> Callable[..., Pyramid]:
        if name in FILTERS:
            return lambda x, *args, out=None, **kw: self.run(x, lambda p: p.filter(name, *args, output_dtype=self.settings.output_dtype, **kw), out)
        raise AttributeError(name)


class Threshold(Facade):
    """threshold_manual, _otsu, _isodata, _yen, _multiotsu, _minimum, _triangle, _niblack, _sauvola; niblack_bernsen and sauvola_bernsen."""

    def __getattr__(self, name: str) -> Callable[..., Pyramid]:
        method = {"threshold_niblack": "threshold_niblack", "threshold_sauvola": "threshold_sauvola"}.get(name, name.removeprefix("threshold_"))
        if name.startswith("_"):
            raise AttributeError(name)
        return lambda x, out=None, **kw: self.run(x, lambda p: p.threshold(method, **kw), out)


class Label(Facade):
    def label(self, x, out: str | None = None, dense: bool = False):
        return self.run(x, lambda p: p.label(dense), out)

    def extract_label(self, x, label_idx: int, out: str | None = None):
        from .operators.labels import extract

        return self.run(x, lambda p: p.apply(lambda df, axes, shape: extract(df, axes, label_idx)), out)


class Aggregative(Facade):
    def concatenate(self, inputs: list[Pyramid | str] | str, axis: str = "z", out: str | None = None):
        """Pyramids, their paths, or a directory of them in the order of their names."""
        if isinstance(inputs, str):
            inputs = list(zarr.collection_paths(inputs))
        return self.run(PyramidCollection([self.read(x) for x in inputs]).concatenate(axis), lambda p: p, out)


class MetadataUpdater(Facade):
    def update_scales(self, x, scale: dict[str, float], out: str | None = None):
        return self.run(x, lambda p: p.with_meta(p.meta.update_scales(scale)), out)

    def update_units(self, x, units: dict[str, str] | list[str], out: str | None = None):
        return self.run(x, lambda p: p.with_meta(p.meta.update_units(units)), out)

    def report(self, x) -> Meta:
        return self.read(x).meta


class Converter:
    """Command lines of the external converters to OME-TIFF (bfconvert) and OME-Zarr (bioformats2raw), returned or run."""

    def __init__(self, execute: bool = False):
        self.execute = execute

    def _finish(self, command: list[str]) -> str:
        if self.execute:
            subprocess.run(command, check=True)
        return shlex.join(command)

    def to_ometiff(self, source: str, target: str, **options: Any) -> str:
        flags = [str(y) for k, v in options.items() for y in ([f"-{k.replace('_', '-')}"] if v is True else [f"-{k.replace('_', '-')}", v]) if v not in (None, False)]
        return self._finish(["bfconvert", *flags, source, target])

    def to_omezarr(self, source: str, target: str, **options: Any) -> str:
        flags = [f"--{k}" if v is True else f"--{k}={v}" for k, v in options.items() if v not in (None, False)]
        return self._finish(["bioformats2raw", *flags, source, target])

    def batch(self, spark: SparkSession, pattern: str, directory: str, kind: str = "omezarr", **options: Any) -> list[str]:
        """One command for every file that ``pattern`` matches; run by Spark tasks where the converter executes."""
        suffix = {"omezarr": ".zarr", "ometiff": ".ome.tiff"}[kind]
        plain = Converter(False)
        commands = [getattr(plain, f"to_{kind}")(f, os.path.join(directory, os.path.basename(f).split(".")[0] + suffix), **options) for f in sorted(glob(pattern))]
        if self.execute and commands:
            spark.createDataFrame([(c,) for c in commands], "c string").repartition(len(commands)).foreach(lambda r: subprocess.run(shlex.split(r.c), check=True))
        return commands
