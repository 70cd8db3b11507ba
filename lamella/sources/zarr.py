"""Chunked arrays on disk (zarr version 2): a Spark data source for reading and a writer of one file per chunk.

Reading: ``spark.dataSource.register(ZarrSource)``, then ``spark.read.format("zarr").option("path", p).load()`` gives the axes' columns and v. Every
chunk is a partition; ``option("crop", "y:0:100,x:5:9")`` leaves out chunks beyond the bounds before any is opened. Chunks that don't
exist hold the fill value. Codecs: none, blosc (lz4, zlib, zstd and snappy frames), zlib, gzip, bz2, lzma, zstd.

Writing: voxels are grouped by chunk, so a task holds one chunk; each file is written aside and renamed, so a task that runs again leaves the
same bytes. Metadata is written last. Overwriting a pyramid writes a whole new store beside the old one and swaps the two, so nothing of the old
store is left, and a plan may read the store that it overwrites. Paths are folders that every executor sees under one name; other file systems'
addresses raise ValueError.
"""

from __future__ import annotations

import bz2
import gzip
import itertools
import json
import lzma
import math
import os
import shutil
import uuid
import zlib
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.dtypes import DTYPES, spark_type
from ..meta import ORDER, ImageLabelMeta, Layer, Meta, default_chunks
from ..pyramid import Pyramid
from . import blosc

CODECS = ("blosc", "zlib", "gzip", "bz2", "lzma", "zstd", None)


def local(path: str) -> str:
    path = path.removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise ValueError(f"not a folder of a mounted file system: {path}")
    return path


def decode(data: bytes, codec: str | None) -> bytes:
    if codec is None:
        return data
    if codec == "blosc":
        return blosc.decode(data)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    f = {"zlib": zlib.decompress, "gzip": gzip.decompress, "bz2": bz2.decompress, "lzma": lzma.decompress}.get(codec)
    if f is None:
        raise ValueError(f"codec {codec!r} isn't one of {CODECS}")
    return f(data)


def encode(data: bytes, codec: str | None, item: int = 1) -> bytes:
    if codec is None:
        return data
    if codec == "blosc":
        return blosc.encode(data, item)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=3).compress(data)
    f = {"zlib": zlib.compress, "gzip": lambda b: gzip.compress(b, mtime=0), "bz2": bz2.compress, "lzma": lzma.compress}.get(codec)
    if f is None:
        raise ValueError(f"codec {codec!r} isn't one of {CODECS}")
    return f(data)


def array_meta(path: str) -> dict[str, Any]:
    with open(os.path.join(local(path), ".zarray")) as f:
        return json.load(f)


def numpy_dtype(meta: dict[str, Any]) -> np.dtype:
    return np.dtype(meta["dtype"])


def read_chunk(path: str, meta: dict[str, Any], at: Sequence[int]) -> np.ndarray | None:
    """A whole chunk, or None where no file exists."""
    sep = meta.get("dimension_separator", ".")
    name = os.path.join(local(path), sep.join(map(str, at)) if at else "0")
    if not os.path.exists(name):
        return None
    with open(name, "rb") as f:
        data = decode(f.read(), (meta["compressor"] or {}).get("id"))
    return np.frombuffer(data, numpy_dtype(meta)).reshape(meta["chunks"], order=meta.get("order", "C"))


class ChunkPartition(InputPartition):
    def __init__(self, at: tuple[int, ...]):
        super().__init__(at)
        self.at = at


class ZarrReader(DataSourceReader):
    def __init__(self, path: str, axes: str, crop: dict[str, tuple[int, int]]):
        self.path, self.axes, self.crop, self.meta = path, axes, crop, array_meta(path)

    def _range(self, k: int) -> tuple[int, int]:
        n = self.meta["shape"][k]
        lo, hi = self.crop.get(self.axes[k], (0, n))
        return max(lo, 0), min(hi, n)

    def partitions(self) -> list[ChunkPartition]:
        grids = []
        for k, c in enumerate(self.meta["chunks"]):
            lo, hi = self._range(k)
            grids.append(range(lo // c, -(-hi // c)) if hi > lo else range(0))
        return [ChunkPartition(at) for at in itertools.product(*grids)]

    def read(self, partition: ChunkPartition) -> Iterator[pa.RecordBatch]:
        meta = self.meta
        shape, chunks = meta["shape"], meta["chunks"]
        origin = [i * c for i, c in zip(partition.at, chunks)]
        inner = []
        for k, o in enumerate(origin):
            lo, hi = self._range(k)
            inner.append(slice(max(lo - o, 0), min(hi - o, chunks[k], shape[k] - o)))
        block = read_chunk(self.path, meta, partition.at)
        if block is None:
            block = np.full(chunks, meta.get("fill_value") or 0, numpy_dtype(meta))
        block = block[tuple(inner)]
        index = np.indices(block.shape).reshape(block.ndim, -1)
        name = np.dtype(meta["dtype"]).name
        width = {"uint8": np.int16, "uint16": np.int32, "uint32": np.int64, "float16": np.float32}.get(name, block.dtype.newbyteorder("="))
        columns = [pa.array((index[k] + inner[k].start + origin[k]).astype(np.int32)) for k in range(block.ndim)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(block.ravel().astype(width))], names=[*self.axes, "v"])


class ZarrSource(DataSource):
    """Options: path, axes (the last letters of tczyx by default), crop."""

    @classmethod
    def name(cls) -> str:
        return "zarr"

    def _axes(self) -> str:
        return self.options.get("axes") or ORDER[-len(array_meta(self.options["path"])["shape"]) :]

    def schema(self) -> str:
        dtype = numpy_dtype(array_meta(self.options["path"])).name
        if dtype not in DTYPES or dtype == "uint64":
            raise ValueError(f"no column type for {dtype}")
        return ", ".join([f"{a} int" for a in self._axes()] + [f"v {spark_type(dtype)}"])

    def reader(self, schema: Any) -> DataSourceReader:
        crop = {}
        for part in filter(None, (self.options.get("crop") or "").split(",")):
            a, lo, hi = part.split(":")
            crop[a] = (int(lo), int(hi))
        return ZarrReader(self.options["path"], self._axes(), crop)


def read_array(spark: SparkSession, path: str, axes: str | None = None, crop: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """The voxels of one array, in coordinates of the whole array."""
    spark.dataSource.register(ZarrSource)
    reader = spark.read.format("zarr").option("path", path)
    if axes:
        reader = reader.option("axes", axes)
    if crop:
        reader = reader.option("crop", ",".join(f"{a}:{lo}:{hi}" for a, (lo, hi) in crop.items()))
    return reader.load()


def compressor(codec: str | None) -> dict[str, Any] | None:
    if codec == "blosc":
        return {"id": "blosc", "cname": "lz4", "clevel": 5, "shuffle": 1, "blocksize": 0}
    return {"id": codec} if codec else None


def write_array(df: DataFrame, path: str, axes: str, shape: tuple[int, ...], dtype: str, chunks: tuple[int, ...] | None = None, codec: str | None = "zlib", separator: str = ".", fill: float = 0) -> int:
    """Write dense or sparse voxels; returns the number of chunk files. Chunks without rows aren't written."""
    chunks = tuple(chunks or default_chunks(shape))
    root = local(path)
    os.makedirs(root, exist_ok=True)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        at = [int(pdf[f"__{a}"].iloc[0]) for a in axes]
        block = np.full(chunks, fill, dtype)
        block[tuple(pdf[a].to_numpy() - i * c for a, i, c in zip(axes, at, chunks))] = pdf["v"].to_numpy()
        name = os.path.join(root, separator.join(map(str, at)))
        os.makedirs(os.path.dirname(name), exist_ok=True)
        aside = f"{name}.{uuid.uuid4().hex}"
        with open(aside, "wb") as f:
            f.write(encode(block.tobytes(), codec, block.itemsize))
        os.replace(aside, name)
        return pd.DataFrame({"file": [name]})

    keyed = df.select(*axes, "v", *(F.floor(F.col(a) / c).cast("int").alias(f"__{a}") for a, c in zip(axes, chunks)))
    files = keyed.groupBy(*(f"__{a}" for a in axes)).applyInPandas(one, "file string").count()
    meta = {"zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": np.dtype(dtype).str, "compressor": compressor(codec), "fill_value": fill, "order": "C", "filters": None, "dimension_separator": separator}
    with open(os.path.join(root, ".zarray"), "w") as f:
        json.dump(meta, f)
    return files


def path_has_pyramid(path: str) -> bool:
    return os.path.exists(os.path.join(local(path), ".zgroup"))


def _attributes(path: str) -> dict[str, Any]:
    name = os.path.join(local(path), ".zattrs")
    if not os.path.exists(name):
        return {}
    with open(name) as f:
        return json.load(f)


def read_pyramid(spark: SparkSession, path: str, paths: list[str] | None = None) -> Pyramid:
    """A pyramid with the layers that its metadata names, or those in ``paths``; attached labels come along."""
    document = _attributes(path)
    arrays = {}
    for d in document.get("multiscales", [{}])[0].get("datasets", []):
        if paths and d["path"] not in paths:
            continue
        m = array_meta(os.path.join(local(path), d["path"]))
        n = len(m["shape"])
        arrays[d["path"]] = Layer(tuple(m["shape"]), (1.0,) * n, None, numpy_dtype(m).name, tuple(m["chunks"]), (m["compressor"] or {}).get("id"), m.get("dimension_separator", "."))
    meta = Meta.from_json(document, arrays)
    out = Pyramid(meta, {p: read_array(spark, os.path.join(local(path), p), meta.axes) for p in meta.paths})
    below = os.path.join(local(path), "labels")
    for name in _attributes(below).get("labels", []):
        out.labels[name] = read_pyramid(spark, os.path.join(below, name))
    return out


def read_label_meta(path: str) -> ImageLabelMeta:
    return ImageLabelMeta.from_json(_attributes(path))


def write_pyramid(pyramid: Pyramid, path: str, overwrite: bool = False, codec: str | None = "zlib", chunks: tuple[int, ...] | None = None, separator: str = ".", label_meta: ImageLabelMeta | None = None) -> None:
    root = local(path)
    if path_has_pyramid(path):
        if not overwrite:
            raise FileExistsError(path)
        root = root.rstrip("/")
        fresh, old = f"{root}.{uuid.uuid4().hex}", f"{root}.{uuid.uuid4().hex}"
        write_pyramid(pyramid, fresh, False, codec, chunks, separator, label_meta)
        os.rename(root, old)
        os.rename(fresh, root)
        shutil.rmtree(old)
        return
    os.makedirs(root, exist_ok=True)
    for p, df in pyramid.layers.items():
        layer = pyramid.meta.layers[p]
        write_array(df, os.path.join(root, p), pyramid.axes, layer.shape, layer.dtype, chunks or layer.chunks or None, codec, separator)
    document = pyramid.meta.to_json() | (label_meta.to_json() if label_meta else {})
    for name, content in ((".zattrs", document), (".zgroup", {"zarr_format": 2})):
        with open(os.path.join(root, name), "w") as f:
            json.dump(content, f)
    if pyramid.labels:
        below = os.path.join(root, "labels")
        for name, one in pyramid.labels.items():
            write_pyramid(one, os.path.join(below, name), overwrite, codec, chunks, separator)
        with open(os.path.join(below, ".zattrs"), "w") as f:
            json.dump({"labels": list(pyramid.labels)}, f)


def collection_paths(directory: str) -> list[str]:
    """Groups below ``directory`` that hold a pyramid, in order of their paths."""
    found = []
    for at, below, files in os.walk(local(directory)):
        if ".zattrs" in files and "multiscales" in _attributes(at):
            found.append(at)
            below.clear()
        below.sort()
    return found


def chunk_count(shape: tuple[int, ...], chunks: tuple[int, ...]) -> int:
    return math.prod(-(-n // c) for n, c in zip(shape, chunks))
