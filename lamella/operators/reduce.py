"""Reductions along axes as group-bys. Reduced axes stay, with the one coordinate 0."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ufuncs import isnan


def _nan() -> Column:
    return F.lit(float("nan"))


def _poisoned(value: Column, v: Column) -> Column:
    """``value``, or NaN if any element is NaN: Spark would order NaN last instead."""
    return F.when(F.max(isnan(v)), _nan()).otherwise(value)


def _real(v: Column) -> Column:
    return F.when(~isnan(v), v)


def _first(axis: str, v: Column, largest: bool) -> Column:
    """The coordinate of the extreme, the smallest of equal ones; NaN never wins."""
    x = F.struct((-v if largest else v).alias("k"), F.col(axis).alias("i"))
    return F.min(F.when(~isnan(v), x))["i"].cast("bigint")


REDUCTIONS: dict[str, Callable[[Column], Column]] = {
    "max": F.max,
    "min": lambda v: _poisoned(F.min(v).cast("double"), v),
    "sum": F.sum,
    "mean": lambda v: F.avg(v),
    "average": lambda v: F.avg(v),
    "median": lambda v: _poisoned(F.median(v), v),
    "prod": lambda v: F.product(v),
    "ptp": lambda v: _poisoned((F.max(v) - F.min(v)).cast("double"), v),
    "std": lambda v: F.stddev_pop(v),
    "var": lambda v: F.var_pop(v),
    "all": lambda v: F.bool_and(v != 0),
    "any": lambda v: F.bool_or(v != 0),
    "nanmax": lambda v: F.coalesce(F.max(_real(v)).cast("double"), _nan()),
    "nanmin": lambda v: F.coalesce(F.min(_real(v)).cast("double"), _nan()),
    "nanmean": lambda v: F.coalesce(F.avg(_real(v)), _nan()),
    "nanmedian": lambda v: F.coalesce(F.median(_real(v)), _nan()),
    "nanprod": lambda v: F.coalesce(F.product(_real(v)), F.lit(1.0)),
    "nanstd": lambda v: F.coalesce(F.stddev_pop(_real(v)), _nan()),
    "nansum": lambda v: F.coalesce(F.sum(_real(v)).cast("double"), F.lit(0.0)),
    "nanvar": lambda v: F.coalesce(F.var_pop(_real(v)), _nan()),
}
#: Those whose result on integers is an integer.
INTEGRAL = {"max", "min", "sum", "ptp", "nanmax", "nanmin", "nansum", "prod", "nanprod"}


def _keep(df: DataFrame, axes: str, reduced: str) -> DataFrame:
    return df.withColumns({a: F.lit(0) for a in reduced}).select(*axes, "v")


def reduce(df: DataFrame, axes: str, name: str, axis: str) -> DataFrame:
    """Reduce over the letters of ``axis``; partial aggregation precedes the shuffle."""
    rest = [a for a in axes if a not in axis]
    return _keep(df.groupBy(*rest).agg(REDUCTIONS[name](F.col("v")).alias("v")), axes, axis)


def arg_reduce(df: DataFrame, axes: str, name: str, axis: str) -> DataFrame:
    """nanargmax or nanargmin along one axis, as coordinates of the whole axis."""
    rest = [a for a in axes if a != axis]
    return _keep(df.groupBy(*rest).agg(_first(axis, F.col("v"), name == "nanargmax").alias("v")), axes, axis)


def moment(df: DataFrame, axes: str, k: int, axis: str) -> DataFrame:
    """The k-th central moment, in two group-bys so that no group is held as a whole."""
    rest = [a for a in axes if a not in axis]
    mean = df.groupBy(*rest).agg(F.avg("v").alias("m"))
    joined = df.join(mean, rest) if rest else df.crossJoin(F.broadcast(mean))  # one row
    return _keep(joined.groupBy(*rest).agg(F.avg(F.pow(F.col("v") - F.col("m"), F.lit(float(k)))).alias("v")), axes, axis)


def topk(df: DataFrame, axes: str, k: int, axis: str) -> DataFrame:
    """The k largest elements along an axis in falling order; for a negative k the smallest in rising order."""
    rest = [a for a in axes if a != axis]
    by = F.desc("v") if k > 0 else F.asc("v")
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(*rest).orderBy(by, axis)))
    return ranked.where(F.col("__r") <= abs(k)).withColumn(axis, (F.col("__r") - 1).cast("int")).select(*axes, "v")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with equal keys in one of a fixed number of tasks: adaptive plans join few bytes to one task, however much Python each group takes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def reduction(df: DataFrame, axes: str, chunk: Callable[[pd.Series], float], aggregate: Callable[[pd.Series], float], axis: str) -> DataFrame:
    """A user reduction in two phases: ``chunk`` within batches before the shuffle, ``aggregate`` over the batches' values."""
    rest = [a for a in axes if a not in axis]
    schema = ", ".join([f"{a} int" for a in rest] + ["v double"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pdf = batch.to_pandas()
            if len(pdf):
                one = pdf.groupby(rest, sort=False)["v"].agg(lambda s: float(chunk(s))).reset_index() if rest else pd.DataFrame({"v": [float(chunk(pdf["v"]))]})
                yield _batch({a: one[a].to_numpy() for a in rest}, one["v"].to_numpy(float))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, values = batch["v"].offsets.to_numpy(), batch["v"].values.to_numpy(zero_copy_only=False)
            out = [float(aggregate(pd.Series(values[i:j], name="v"))) for i, j in itertools.pairwise(ends.tolist())]
            yield _batch({a: batch[a].to_numpy() for a in rest}, np.array(out, float))

    parts = df.select(*axes, "v").mapInArrow(partial, schema)
    if rest:
        parts = spread(parts, *rest)
    # An empty table has no group, even if all axes are reduced.
    lists = parts.groupBy(*rest).agg(F.collect_list("v").alias("v")).where(F.size("v") > 0)
    return _keep(lists.mapInArrow(whole, schema), axes, axis)


def _batch(keys: dict[str, np.ndarray], v: np.ndarray) -> pa.RecordBatch:
    """Coordinates and doubles as Arrow, in which NaN stays apart from null."""
    return pa.RecordBatch.from_pydict({a: pa.array(k, pa.int32()) for a, k in keys.items()} | {"v": pa.array(v, pa.float64())})


def total(df: DataFrame, name: str) -> DataFrame:
    """One value over all elements."""
    return df.agg(REDUCTIONS[name](F.col("v")).alias("v"))
