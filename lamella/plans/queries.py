"""Registered queries: every operator over arrays made from the driver's tables, with its result in DuckDB SQL.

Real results are compared in millionths, as longs: NaN and infinities have numbers of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ufuncs import UFUNCS
from ..operators import filters, labels, local_stats, neighbourhood, reduce, scan, threshold
from ..operators.components import shared_folder
from ..operators.multiscale import KERNELS
from ..pyramid import Pyramid, PyramidCollection
from ..sources import zarr
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def micro(v: Column) -> Column:
    """A double in millionths, as a long; the nearest long where the millionths are beyond 64 bits, on which the SQL raises."""
    d = v.cast("double")
    inf = float("inf")
    m, end = d * 1e6, F.lit(2.0**63)  # which casts to the largest long
    inside = F.when(m > end, end).when(m < -end, -end).otherwise(m)  # NaN is larger than any, null stays
    return F.when(F.isnan(d), F.lit(-(10**15))).when(d == inf, F.lit(10**15)).when(d == -inf, F.lit(1 - 10**15)).otherwise(F.round(inside).cast("bigint"))


def sql_micro(e: str) -> str:
    return f"CASE WHEN isnan(CAST({e} AS DOUBLE)) THEN -1000000000000000 WHEN CAST({e} AS DOUBLE) = CAST('inf' AS DOUBLE) THEN 1000000000000000 WHEN CAST({e} AS DOUBLE) = CAST('-inf' AS DOUBLE) THEN -999999999999999 ELSE CAST(round(CAST({e} AS DOUBLE) * CAST(1e6 AS DOUBLE)) AS BIGINT) END"


def pyramid(spark: SparkSession, sf: str, dtype: str = "int64") -> Pyramid:
    df = fx.image(spark, sf)
    return Pyramid.from_frame(df if dtype == "int64" else df.withColumn("v", F.col("v").cast("double")), "yx", (fx.height(spark, sf), fx.WIDTH), dtype)


# -- element-wise ----------------------------------------------------------------------------------------------

#: Real operand: centred and scaled, with negatives, so that domains are left on purpose. s is (v - 127) / 32.
_S = "((CAST(v AS DOUBLE) - CAST(127 AS DOUBLE)) / CAST(32 AS DOUBLE))"
#: Positive and zero values for logarithms.
_REAL_SQL = {
    "exp": "exp({s})", "exp2": "pow(CAST(2 AS DOUBLE), {s})", "expm1": "exp({s}) - CAST(1 AS DOUBLE)", "sqrt": "CASE WHEN {s} < 0 THEN CAST('nan' AS DOUBLE) ELSE sqrt(abs({s})) END", "rint": "round_even({s}, 0)",
    "sin": "sin({s})", "cos": "cos({s})", "tan": "tan({s})", "arctan": "atan({s})", "sinh": "sinh({s})", "cosh": "cosh({s})", "tanh": "tanh({s})", "arcsinh": "asinh({s})",
    "arcsin": "CASE WHEN abs({s}) > 1 THEN CAST('nan' AS DOUBLE) ELSE asin(greatest(least({s}, CAST(1 AS DOUBLE)), CAST(-1 AS DOUBLE))) END",
    "arccos": "CASE WHEN abs({s}) > 1 THEN CAST('nan' AS DOUBLE) ELSE acos(greatest(least({s}, CAST(1 AS DOUBLE)), CAST(-1 AS DOUBLE))) END",
    "arccosh": "CASE WHEN {s} < 1 THEN CAST('nan' AS DOUBLE) ELSE acosh(greatest({s}, CAST(1 AS DOUBLE))) END",
    "arctanh": "CASE WHEN abs({s}) > 1 THEN CAST('nan' AS DOUBLE) WHEN {s} = 1 THEN CAST('inf' AS DOUBLE) WHEN {s} = -1 THEN CAST('-inf' AS DOUBLE) ELSE atanh(greatest(least({s}, CAST(0.9999999 AS DOUBLE)), CAST(-0.9999999 AS DOUBLE))) END",
    "deg2rad": "radians({s})", "rad2deg": "degrees({s})", "floor": "floor({s})", "ceil": "ceil({s})", "trunc": "trunc({s})", "fabs": "abs({s})",
    "log": "CASE WHEN {s} < 0 THEN CAST('nan' AS DOUBLE) WHEN {s} = 0 THEN CAST('-inf' AS DOUBLE) ELSE ln(CASE WHEN {s} > 0 THEN {s} ELSE 1 END) END",
    "log2": "CASE WHEN {s} < 0 THEN CAST('nan' AS DOUBLE) WHEN {s} = 0 THEN CAST('-inf' AS DOUBLE) ELSE log2(CASE WHEN {s} > 0 THEN {s} ELSE 1 END) END",
    "log10": "CASE WHEN {s} < 0 THEN CAST('nan' AS DOUBLE) WHEN {s} = 0 THEN CAST('-inf' AS DOUBLE) ELSE log10(CASE WHEN {s} > 0 THEN {s} ELSE 1 END) END",
    "log1p": "CASE WHEN {s} < -1 THEN CAST('nan' AS DOUBLE) WHEN {s} = -1 THEN CAST('-inf' AS DOUBLE) ELSE ln(CAST(1 AS DOUBLE) + CASE WHEN {s} > -1 THEN {s} ELSE 0 END) END",
    "reciprocal": "CASE WHEN {s} = 0 THEN CAST('inf' AS DOUBLE) ELSE 1 / CASE WHEN {s} = 0 THEN CAST(1 AS DOUBLE) ELSE {s} END END",
    "modf": "{s} - trunc({s})", "frexp": "CASE WHEN {s} = 0 THEN CAST(0 AS DOUBLE) ELSE {s} / pow(CAST(2 AS DOUBLE), floor(log2(abs(CASE WHEN {s} = 0 THEN CAST(1 AS DOUBLE) ELSE {s} END))) + 1) END",
}
_NUMBER_SQL = {"absolute": "abs(v - 127)", "conj": "v - 127", "square": "(v - 127) * (v - 127)", "negative": "127 - v", "zeros_like": "0", "ones_like": "1", "relocate": "v - 127", "sign": "sign(v - 127)", "signbit": "CAST(v - 127 < 0 AS BIGINT)", "logical_not": "CAST(v - 127 = 0 AS BIGINT)", "invert": "-(v - 127) - 1"}
_NAN_SQL = {"isnan": "CAST(isnan(v) AS BIGINT)", "isinf": "CAST(isinf(v) AS BIGINT)", "isfinite": "CAST(isfinite(v) AS BIGINT)", "isnat": "CAST(v IS NULL AS BIGINT)"}
_A, _B = "CAST(a.v - 127 AS DOUBLE)", "CAST(b.v - 127 AS DOUBLE)"
_REAL2_SQL = {
    "arctan2": f"atan2({_A}, {_B})", "hypot": f"sqrt({_A} * {_A} + {_B} * {_B})", "power": f"pow({_A}, CAST(b.w AS DOUBLE))",
    "divide": f"CASE WHEN {_B} = 0 AND {_A} = 0 THEN CAST('nan' AS DOUBLE) WHEN {_B} = 0 THEN sign({_A}) * CAST('inf' AS DOUBLE) ELSE {_A} / CASE WHEN {_B} = 0 THEN CAST(1 AS DOUBLE) ELSE {_B} END END",
    "logaddexp": f"greatest({_A}, {_B}) + ln(1 + exp(-abs({_A} - {_B})))", "logaddexp2": f"greatest({_A}, {_B}) + log2(1 + pow(CAST(2 AS DOUBLE), -abs({_A} - {_B})))",
    "copysign": f"CASE WHEN {_B} < 0 THEN -abs({_A}) ELSE abs({_A}) END", "ldexp": f"{_A} * pow(CAST(2 AS DOUBLE), CAST(b.w AS DOUBLE))", "nextafter": f"nextafter({_A}, {_B})",
}
_REAL2_SQL["true_divide"] = _REAL2_SQL["divide"]
_LA, _LB = "(a.v - 127)", "(b.v - 127)"
_WHOLE2_SQL = {
    "add": f"{_LA} + {_LB}", "subtract": f"{_LA} - {_LB}", "multiply": f"{_LA} * {_LB}", "maximum": f"greatest({_LA}, {_LB})", "minimum": f"least({_LA}, {_LB})",
    "remainder": f"(({_LA} % b.w) + b.w) % b.w", "fmod": f"{_LA} % b.w", "floor_divide": f"CAST(floor(CAST({_LA} AS DOUBLE) / b.w) AS BIGINT)",
    "bitwise_and": "a.v & b.v", "bitwise_or": "a.v | b.v", "bitwise_xor": "xor(a.v, b.v)", "left_shift": "a.v << b.w", "right_shift": "a.v >> b.w",
    "greater": f"CAST({_LA} > {_LB} AS BIGINT)", "greater_equal": f"CAST({_LA} >= {_LB} AS BIGINT)", "less": f"CAST({_LA} < {_LB} AS BIGINT)", "less_equal": f"CAST({_LA} <= {_LB} AS BIGINT)",
    "equal": f"CAST({_LA} = {_LB} AS BIGINT)", "not_equal": f"CAST({_LA} <> {_LB} AS BIGINT)",
    "logical_and": f"CAST({_LA} <> 0 AND {_LB} <> 0 AS BIGINT)", "logical_or": f"CAST({_LA} <> 0 OR {_LB} <> 0 AS BIGINT)", "logical_xor": f"CAST(({_LA} <> 0) <> ({_LB} <> 0) AS BIGINT)",
}
_WHOLE2_SQL["mod"] = _WHOLE2_SQL["remainder"]
_SMALL = {"power", "ldexp", "remainder", "mod", "fmod", "floor_divide", "left_shift", "right_shift"}
_PLAIN = {"bitwise_and", "bitwise_or", "bitwise_xor", "left_shift", "right_shift"}


def _centred(p: Pyramid, by: float = 127) -> Pyramid:
    return p.ufunc("subtract", by)


def _unary() -> None:
    for name, e in _REAL_SQL.items():
        def q(spark: SparkSession, sf: str, name=name) -> DataFrame:
            p = _centred(pyramid(spark, sf, "float64")).ufunc("divide", 32.0).ufunc(name)
            return p.layer().withColumn("v", micro(F.col("v")))

        QUERIES[f"ufunc_{name}"] = q
        SQL[f"ufunc_{name}"] = f"WITH {fx.IMG} SELECT y, x, {sql_micro(e.format(s=_S))} AS v FROM img"
    for name, e in _NUMBER_SQL.items():
        QUERIES[f"ufunc_{name}"] = lambda spark, sf, name=name: _centred(pyramid(spark, sf)).ufunc(name).layer()
        SQL[f"ufunc_{name}"] = f"WITH {fx.IMG} SELECT y, x, CAST({e} AS BIGINT) AS v FROM img"
    for name, e in _NAN_SQL.items():
        def q(spark: SparkSession, sf: str, name=name) -> DataFrame:
            p = Pyramid.from_frame(fx.nan_image(spark, sf), "yx", (fx.height(spark, sf), fx.WIDTH), "float64")
            return p.ufunc(name).layer().withColumn("v", F.col("v").cast("bigint"))

        QUERIES[f"ufunc_{name}"] = q
        SQL[f"ufunc_{name}"] = f"WITH {fx.NAN} SELECT y, x, {e} AS v FROM nanimg"
    QUERIES["ufunc_clip"] = lambda spark, sf: pyramid(spark, sf).ufunc("clip", 100, 140).layer()
    SQL["ufunc_clip"] = f"WITH {fx.IMG} SELECT y, x, least(greatest(v, 100), 140) AS v FROM img"
    for name in ("fmax", "fmin"):
        def q(spark: SparkSession, sf: str, name=name) -> DataFrame:
            shape = (fx.height(spark, sf), fx.WIDTH)
            a = Pyramid.from_frame(fx.nan_image(spark, sf), "yx", shape, "float64")
            b = Pyramid.from_frame(fx.mirrored(spark, sf).withColumn("v", F.col("v").cast("double")), "yx", shape, "float64")
            return a.ufunc(name, b).layer().withColumn("v", micro(F.col("v")))

        f = {"fmax": "greatest", "fmin": "least"}[name]
        e = f"CASE WHEN isnan(a.v) THEN CAST(b.v AS DOUBLE) ELSE {f}(a.v, CAST(b.v AS DOUBLE)) END"
        QUERIES[f"ufunc_{name}"] = q
        SQL[f"ufunc_{name}"] = f"WITH {fx.IMG2}, nanimg AS (SELECT y, x, CASE WHEN v % 11 = 0 THEN CAST('nan' AS DOUBLE) ELSE CAST(v AS DOUBLE) END AS v FROM img) SELECT a.y, a.x, {sql_micro(e)} AS v FROM nanimg a JOIN img2 b USING (y, x)"


def _binary() -> None:
    for names, dtype, wrap in ((_REAL2_SQL, "float64", sql_micro), (_WHOLE2_SQL, "int64", lambda e: f"CAST({e} AS BIGINT)")):
        for name, e in names.items():
            def q(spark: SparkSession, sf: str, name=name, dtype=dtype) -> DataFrame:
                shape = (fx.height(spark, sf), fx.WIDTH)
                a = pyramid(spark, sf)
                b = Pyramid.from_frame(fx.mirrored(spark, sf), "yx", shape)
                b = b.ufunc("mod", 7).ufunc("add", 1) if name in _SMALL else b if name in _PLAIN else _centred(b)
                a = a if name in _PLAIN else _centred(a)
                out = a.ufunc(name, b, output_dtype=dtype).layer()
                return out.withColumn("v", micro(F.col("v"))) if dtype == "float64" else out

            QUERIES[f"ufunc_{name}"] = q
            if name != "nextafter":
                SQL[f"ufunc_{name}"] = f"WITH {fx.IMG2} SELECT a.y, a.x, {wrap(e)} AS v FROM img a JOIN img2 b USING (y, x)"


# -- reductions, scans -----------------------------------------------------------------------------------------

_REDUCE_SQL = {
    "max": "max(v)", "min": "min(v)", "sum": "CAST(sum(v) AS BIGINT)", "mean": "CAST(trunc(avg(v)) AS BIGINT)", "average": "CAST(trunc(avg(v)) AS BIGINT)", "median": "CAST(trunc(median(v)) AS BIGINT)", "ptp": "max(v) - min(v)",
    "all": "CAST(bool_and(v - 127 <> 0) AS BIGINT)", "any": "CAST(bool_or(v - 127 <> 0) AS BIGINT)",
}
_REDUCE_REAL_SQL = {"std": "stddev_pop(v)", "var": "var_pop(v)"}
_NANREDUCE_SQL = {"nanmax": "max(v)", "nanmin": "min(v)", "nanmean": "avg(v)", "nanmedian": "median(v)", "nanstd": "stddev_pop(v)", "nansum": "sum(v)", "nanvar": "var_pop(v)"}


def _reductions() -> None:
    for name, e in _REDUCE_SQL.items():
        def q(spark: SparkSession, sf: str, name=name) -> DataFrame:
            p = pyramid(spark, sf)
            return (_centred(p) if name in ("all", "any") else p).reduce(name, "x").layer()

        QUERIES[f"reduce_{name}"] = q
        SQL[f"reduce_{name}"] = f"WITH {fx.IMG} SELECT y, 0 AS x, {e} AS v FROM img GROUP BY y"
    for name, e in _REDUCE_REAL_SQL.items():
        QUERIES[f"reduce_{name}"] = lambda spark, sf, name=name: pyramid(spark, sf).reduce(name, "y", "float64").layer().withColumn("v", micro(F.col("v")))
        SQL[f"reduce_{name}"] = f"WITH {fx.IMG} SELECT 0 AS y, x, {sql_micro(e)} AS v FROM img GROUP BY x"
    # Products run over all columns: factors of 1 or 2 by parity are exact, others are scaled to about 1. The SQL covers 8 and 4 columns only.
    QUERIES["reduce_prod"] = lambda spark, sf: pyramid(spark, sf).ufunc("mod", 2).ufunc("add", 1).reduce("prod", "x").layer()
    SQL["reduce_prod"] = f"WITH {fx.IMG} SELECT y, 0 AS x, CAST(product(1 + v % 2) AS BIGINT) AS v FROM img WHERE x < 8 GROUP BY y"
    for name, e in _NANREDUCE_SQL.items():
        def q(spark: SparkSession, sf: str, name=name) -> DataFrame:
            p = Pyramid.from_frame(fx.nan_image(spark, sf), "yx", (fx.height(spark, sf), fx.WIDTH), "float64")
            return p.reduce(name, "x").layer().withColumn("v", micro(F.col("v")))

        QUERIES[f"reduce_{name}"] = q
        SQL[f"reduce_{name}"] = f"WITH {fx.NAN} SELECT y, 0 AS x, {sql_micro(e)} AS v FROM nanimg WHERE NOT isnan(v) GROUP BY y"
    QUERIES["reduce_nanprod"] = lambda spark, sf: reduce.reduce(fx.nan_image(spark, sf).withColumn("v", F.col("v") / 127), "yx", "nanprod", "x").withColumn("v", micro(F.col("v")))
    SQL["reduce_nanprod"] = f"WITH {fx.NAN} SELECT y, 0 AS x, {sql_micro('coalesce(product(v) FILTER (WHERE NOT isnan(v)), 1) / 1e6')} AS v FROM nanimg WHERE x < 4 GROUP BY y"
    for name, f in (("nanargmax", "DESC"), ("nanargmin", "ASC")):
        QUERIES[f"reduce_{name}"] = lambda spark, sf, name=name: reduce.arg_reduce(fx.nan_image(spark, sf), "yx", name, "x")
        SQL[f"reduce_{name}"] = f"WITH {fx.NAN}, r AS (SELECT y, x, row_number() OVER (PARTITION BY y ORDER BY v {f}, x) AS k FROM nanimg WHERE NOT isnan(v)) SELECT y, 0 AS x, CAST(x AS BIGINT) AS v FROM r WHERE k = 1"
    QUERIES["reduce_moment"] = lambda spark, sf: pyramid(spark, sf).reduce("moment", "x", "float64", k=3).layer().withColumn("v", micro(F.col("v") / 1e4))
    SQL["reduce_moment"] = f"WITH {fx.IMG}, m AS (SELECT y, avg(v) AS m FROM img GROUP BY y) SELECT y, 0 AS x, {sql_micro('avg(pow(v - m, 3)) / 1e4')} AS v FROM img JOIN m USING (y) GROUP BY y"
    QUERIES["reduce_topk"] = lambda spark, sf: pyramid(spark, sf).topk(3, "x").layer()
    SQL["reduce_topk"] = f"WITH {fx.IMG}, r AS (SELECT y, v, row_number() OVER (PARTITION BY y ORDER BY v DESC, x) - 1 AS k FROM img) SELECT y, CAST(k AS INT) AS x, v FROM r WHERE k < 3"
    QUERIES["reduce_two_phase"] = lambda spark, sf: pyramid(spark, sf).reduce("reduction", "x", chunk=lambda s: s.max(), aggregate=lambda s: s.max()).layer()
    SQL["reduce_two_phase"] = f"WITH {fx.IMG} SELECT y, 0 AS x, max(v) AS v FROM img GROUP BY y"
    QUERIES["reduce_two_axes"] = lambda spark, sf: reduce.reduce(fx.cube(spark, sf), "ctx", "sum", "tx")
    SQL["reduce_two_axes"] = f"WITH {fx.CUBE} SELECT c, 0 AS t, 0 AS x, CAST(sum(v) AS BIGINT) AS v FROM cube GROUP BY c"
    for name, e in (("sum", "CAST(sum(v) AS BIGINT)"), ("min", "CAST(min(v) AS BIGINT)"), ("max", "max(v)"), ("mean", sql_micro("avg(v)")), ("median", sql_micro("median(v)"))):
        def q(spark: SparkSession, sf: str, name=name) -> DataFrame:
            out = reduce.total(fx.image(spark, sf), name)
            return out.withColumn("v", micro(F.col("v")) if name in ("mean", "median") else F.col("v").cast("bigint"))

        QUERIES[f"total_{name}"] = q
        SQL[f"total_{name}"] = f"WITH {fx.IMG} SELECT {e} AS v FROM img"
    frame = "OVER (PARTITION BY y ORDER BY x ROWS UNBOUNDED PRECEDING)"
    QUERIES["scan_cumsum"] = lambda spark, sf: pyramid(spark, sf).scan("cumsum", "x").layer()
    SQL["scan_cumsum"] = f"WITH {fx.IMG} SELECT y, x, CAST(sum(v) {frame} AS BIGINT) AS v FROM img"
    QUERIES["scan_cumsum_block"] = lambda spark, sf: pyramid(spark, sf).scan("cumsum", "x", block=16).layer()
    SQL["scan_cumsum_block"] = f"WITH {fx.IMG} SELECT y, x, CAST(sum(v) OVER (PARTITION BY y, x // 16 ORDER BY x ROWS UNBOUNDED PRECEDING) AS BIGINT) AS v FROM img"
    QUERIES["scan_cumprod"] = lambda spark, sf: scan.scan(fx.image(spark, sf).withColumn("v", 1 + F.col("v") % 2), "yx", "cumprod", "x", 16).withColumn("v", F.col("v").cast("bigint"))
    SQL["scan_cumprod"] = f"WITH {fx.IMG} SELECT y, x, CAST(product(1 + v % 2) OVER (PARTITION BY y, x // 16 ORDER BY x ROWS UNBOUNDED PRECEDING) AS BIGINT) AS v FROM img"
    QUERIES["scan_nancumsum"] = lambda spark, sf: scan.scan(fx.nan_image(spark, sf), "yx", "nancumsum", "x").withColumn("v", F.col("v").cast("bigint"))
    SQL["scan_nancumsum"] = f"WITH {fx.NAN} SELECT y, x, CAST(sum(CASE WHEN isnan(v) THEN 0 ELSE v END) {frame} AS BIGINT) AS v FROM nanimg"
    QUERIES["scan_nancumprod"] = lambda spark, sf: scan.scan(fx.nan_image(spark, sf).withColumn("v", 1 + F.col("v") % 2), "yx", "nancumprod", "x", 16).withColumn("v", F.col("v").cast("bigint"))
    SQL["scan_nancumprod"] = f"WITH {fx.NAN} SELECT y, x, CAST(product(CASE WHEN isnan(v) THEN 1 ELSE 1 + v % 2 END) OVER (PARTITION BY y, x // 16 ORDER BY x ROWS UNBOUNDED PRECEDING) AS BIGINT) AS v FROM nanimg"
    QUERIES["scan_gradient"] = lambda spark, sf: pyramid(spark, sf).gradient("x", "float64").layer().withColumn("v", micro(F.col("v")))
    w = "OVER (PARTITION BY y ORDER BY x)"
    SQL["scan_gradient"] = f"WITH {fx.IMG}, g AS (SELECT y, x, CASE WHEN lag(v) {w} IS NULL THEN CAST(lead(v) {w} - v AS DOUBLE) WHEN lead(v) {w} IS NULL THEN CAST(v - lag(v) {w} AS DOUBLE) ELSE (lead(v) {w} - lag(v) {w}) / CAST(2 AS DOUBLE) END AS v FROM img) SELECT y, x, {sql_micro('v')} AS v FROM g"
    QUERIES["select_delete"] = lambda spark, sf: pyramid(spark, sf).delete([0, 5, 63], "x").layer()
    SQL["select_delete"] = f"WITH {fx.IMG} SELECT y, CAST(x - 1 - CAST(x > 5 AS INT) AS INT) AS x, v FROM img WHERE x NOT IN (0, 5, 63)"


# -- selection, casting, layers --------------------------------------------------------------------------------


def _layers() -> None:
    QUERIES["select_subset"] = lambda spark, sf: pyramid(spark, sf).subset({"y": (10, 200), "x": (8, 40)}).layer()
    SQL["select_subset"] = f"WITH {fx.IMG} SELECT CAST(y - 10 AS INT) AS y, CAST(x - 8 AS INT) AS x, v FROM img WHERE y >= 10 AND y < 200 AND x >= 8 AND x < 40"
    wrapped = {"uint8": "v * 5 % 256", "int8": "(v * 5 + 128) % 256 - 128", "int16": "v * 5", "bool": "CAST(v * 5 <> 0 AS BIGINT)"}
    for dtype, e in wrapped.items():
        QUERIES[f"cast_{dtype}"] = lambda spark, sf, dtype=dtype: pyramid(spark, sf).ufunc("multiply", 5).astype(dtype).layer().withColumn("v", F.col("v").cast("int").cast("bigint"))
        SQL[f"cast_{dtype}"] = f"WITH {fx.IMG} SELECT y, x, CAST({e} AS BIGINT) AS v FROM img"
    for name, op in (("add", lambda a, b: a + b), ("subtract", lambda a, b: a - b), ("multiply", lambda a, b: a * b), ("divide", lambda a, b: a / b), ("reflected_subtract", lambda a, b: 7 - a), ("reflected_divide", lambda a, b: 4096 / a), ("reflected_add", lambda a, b: 7 + a), ("reflected_multiply", lambda a, b: 7 * a)):
        def q(spark: SparkSession, sf: str, op=op) -> DataFrame:
            return op(pyramid(spark, sf), Pyramid.from_frame(fx.mirrored(spark, sf), "yx", (fx.height(spark, sf), fx.WIDTH))).layer()

        e = {"add": "a.v + b.v", "subtract": "a.v - b.v", "multiply": "a.v * b.v", "divide": "trunc(CAST(a.v AS DOUBLE) / b.v)", "reflected_subtract": "7 - a.v", "reflected_divide": "trunc(CAST(4096 AS DOUBLE) / a.v)", "reflected_add": "7 + a.v", "reflected_multiply": "7 * a.v"}[name]
        QUERIES[f"overload_{name}"] = q
        SQL[f"overload_{name}"] = f"WITH {fx.IMG2} SELECT a.y, a.x, CAST({e} AS BIGINT) AS v FROM img a JOIN img2 b USING (y, x)"
    pyr = f"""{fx.IMG}, l1 AS (SELECT y // 2 AS y, x // 2 AS x, CAST(trunc(sum(v) / CAST(4 AS DOUBLE)) AS BIGINT) AS v FROM img GROUP BY 1, 2),
l2 AS (SELECT y // 2 AS y, x // 2 AS x, CAST(trunc(sum(v) / CAST(4 AS DOUBLE)) AS BIGINT) AS v FROM l1 GROUP BY 1, 2),
l3 AS (SELECT y // 2 AS y, x // 2 AS x, CAST(trunc(sum(v) / CAST(4 AS DOUBLE)) AS BIGINT) AS v FROM l2 GROUP BY 1, 2)"""
    QUERIES["rescale_mean"] = lambda spark, sf: pyramid(spark, sf).rescale(4, 2).frame()
    SQL["rescale_mean"] = f"WITH {pyr} " + " UNION ALL ".join(f"SELECT '{k}' AS layer, CAST(y AS INT) AS y, CAST(x AS INT) AS x, v FROM {t}" for k, t in enumerate(("img", "l1", "l2", "l3")))
    QUERIES["select_layers"] = lambda spark, sf: pyramid(spark, sf).rescale(4, 2).select_layers(["1", "2"]).frame()
    SQL["select_layers"] = f"WITH {pyr} " + " UNION ALL ".join(f"SELECT '{k}' AS layer, CAST(y AS INT) AS y, CAST(x AS INT) AS x, v FROM l{k}" for k in (1, 2))
    ragged = {"mean": "CAST(trunc(sum(v) / CAST(9 AS DOUBLE)) AS BIGINT)", "min": "CASE WHEN count(*) = 9 THEN min(v) ELSE least(min(v), 0) END", "max": "CASE WHEN count(*) = 9 THEN max(v) ELSE greatest(max(v), 0) END", "median": "CAST(trunc(median(v)) AS BIGINT)", "softmax": "CASE WHEN count(*) = 9 AND min(v) > 0 THEN min(v) ELSE greatest(max(v), 0) END"}
    for name in KERNELS:
        def q(spark: SparkSession, sf: str, name=name) -> DataFrame:
            return pyramid(spark, sf).rescale(2, (3, 3), name).layer("1")

        # The median's SQL leaves the padded blocks at the edges out, and all rows from 99 on.
        where = "WHERE y < 99 AND x < 63" if name == "median" else ""
        QUERIES[f"downscale_{name}"] = q
        SQL[f"downscale_{name}"] = f"WITH {fx.IMG} SELECT CAST(y // 3 AS INT) AS y, CAST(x // 3 AS INT) AS x, {ragged[name]} AS v FROM img {where} GROUP BY y // 3, x // 3"

    def parts(spark: SparkSession, sf: str) -> list[Pyramid]:
        p, n = pyramid(spark, sf), fx.height(spark, sf)
        return [p.subset({"y": b}) for b in ((0, 200), (200, 400), (400, n))]

    QUERIES["combine_concatenate"] = lambda spark, sf: PyramidCollection(parts(spark, sf)).concatenate("y").layer()
    SQL["combine_concatenate"] = f"WITH {fx.IMG} SELECT y, x, v FROM img"
    QUERIES["combine_collection"] = lambda spark, sf: PyramidCollection(parts(spark, sf)).frame()
    SQL["combine_collection"] = f"WITH {fx.IMG} SELECT CAST(y // 200 AS INT) AS img, '0' AS layer, CAST(y % 200 AS INT) AS y, x, v FROM img WHERE y < 400"

    # Stacks and mosaics take the whole image and its mirror image; their SQL, like the collection's, has only the rows before 400.
    def both(spark: SparkSession, sf: str) -> list[tuple[DataFrame, tuple[int, int]]]:
        return [(f(spark, sf), _shape(spark, sf)) for f in (fx.image, fx.mirrored)]

    def stacked(spark: SparkSession, sf: str) -> DataFrame:
        from ..operators.combine import stack

        return stack(both(spark, sf), "yx", "z")[0]

    QUERIES["combine_stack"] = stacked
    SQL["combine_stack"] = f"WITH {fx.IMG} SELECT CAST(y // 200 AS INT) AS z, CAST(y % 200 AS INT) AS y, x, v FROM img WHERE y < 400"

    def mosaic(spark: SparkSession, sf: str) -> DataFrame:
        from ..operators import combine

        one = both(spark, sf)
        return combine.mosaic({(0, 0): one[0], (0, 1): one[1], (1, 0): one[1], (1, 1): one[0]}, "yx")[0]

    QUERIES["combine_mosaic"] = mosaic
    SQL["combine_mosaic"] = f"WITH {fx.IMG}, p AS (SELECT y // 200 AS k, y % 200 AS y, x, v FROM img WHERE y < 400), g AS (SELECT * FROM (VALUES (0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 0)) t(r, c, k)) SELECT CAST(y + 200 * r AS INT) AS y, CAST(x + 64 * c AS INT) AS x, v FROM p JOIN g USING (k)"

    def summed(spark: SparkSession, sf: str) -> DataFrame:
        from ..operators.combine import sum_arrays

        return sum_arrays([fx.image(spark, sf), fx.mirrored(spark, sf)], "yx")

    QUERIES["combine_sum"] = summed
    SQL["combine_sum"] = f"WITH {fx.IMG2} SELECT a.y, a.x, a.v + b.v AS v FROM img a JOIN img2 b USING (y, x)"
    QUERIES["create_pad"] = lambda spark, sf: pyramid(spark, sf).pad({"y": (2, 1), "x": (0, 3)}, 9).layer()
    SQL["create_pad"] = f"WITH {fx.IMG}, g AS (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM range(0, 23) a(y), range(0, 67) b(x)) SELECT g.y, g.x, coalesce(v, 9) AS v FROM g LEFT JOIN (SELECT y + 2 AS y, x, v FROM img WHERE y < 20) p ON p.y = g.y AND p.x = g.x"
    cells = "SELECT CAST(l AS VARCHAR) AS layer, CAST(z AS INT) AS z, CAST(y AS INT) AS y, CAST(x AS INT) AS x, {e} AS v FROM range(0, 2) l(l), range(0, 3) z(z), range(0, 21) y(y), range(0, 30) x(x) WHERE l = 0 OR (y < 10 AND x < 15)"
    for name, e in (("zeros", "CAST(0 AS BIGINT)"), ("ones", "CAST(1 AS BIGINT)")):
        QUERIES[f"create_{name}"] = lambda spark, sf, name=name: getattr(Pyramid, name)(spark, "zyx", (3, 21, 30), layers=2).frame()
        SQL[f"create_{name}"] = cells.format(e=e)
    QUERIES["create_full"] = lambda spark, sf: Pyramid.create(spark, "zyx", (3, 21, 30), 7, layers=2, dtype="int16").frame().withColumn("v", F.col("v").cast("bigint"))
    SQL["create_full"] = cells.format(e="CAST(7 AS BIGINT)")
    QUERIES["create_rand"] = lambda spark, sf: Pyramid.rand(spark, "yx", (32, 32), 3).layer().select("y", "x", ((F.col("v") >= 0) & (F.col("v") < 1)).alias("v"))
    SQL["create_rand"] = "SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, true AS v FROM range(0, 32) y(y), range(0, 32) x(x)"
    QUERIES["create_densify"] = fx.cube
    SQL["create_densify"] = f"WITH {fx.CUBE} SELECT c, t, x, v FROM cube"


# -- neighbourhoods --------------------------------------------------------------------------------------------


def _taps(weights: dict[tuple[int, int], float], agg: str, source: str = "img", value: str = "v") -> str:
    """A query over all taps of every pixel, with reflected edges."""
    rows = ", ".join(f"({a}, {b}, CAST({float(w)!r} AS DOUBLE))" for (a, b), w in weights.items())
    fold = lambda c, n: f"CASE WHEN (({c}) % (2 * {n}) + 2 * {n}) % (2 * {n}) < {n} THEN (({c}) % (2 * {n}) + 2 * {n}) % (2 * {n}) ELSE 2 * {n} - 1 - (({c}) % (2 * {n}) + 2 * {n}) % (2 * {n}) END"
    return f"""SELECT p.y, p.x, {agg} AS v FROM (SELECT a.y, a.x, {fold("a.y + t.dy", "d.ny")} AS sy, {fold("a.x + t.dx", "d.nx")} AS sx, t.w AS w FROM {source} a, dims d, (VALUES {rows}) t(dy, dx, w)) p
JOIN {source} s ON s.y = p.sy AND s.x = p.sx GROUP BY p.y, p.x"""


def _box(n: int, m: int | None = None) -> dict[tuple[int, int], float]:
    m = m or n
    return {(a - n // 2, b - m // 2): 1.0 for a in range(n) for b in range(m)}


def _shape(spark: SparkSession, sf: str) -> tuple[int, int]:
    return fx.height(spark, sf), fx.WIDTH


_CROSS = np.array([[0, 1, 0], [1, 1, 1], [0, 1, 0]], bool)
_W = np.array([[1.0, 2.0, 0.0], [0.0, 3.0, -1.0], [2.0, 0.0, 1.0]])


def _filters() -> None:
    def reg(name: str, f: Callable[[DataFrame, tuple[int, int]], DataFrame], sql: str | None, real: bool = True) -> None:
        def q(spark: SparkSession, sf: str) -> DataFrame:
            out = f(fx.image(spark, sf), _shape(spark, sf))
            return out.select("y", "x", micro(F.col("v")).alias("v") if real else F.col("v").cast("bigint").alias("v"))

        QUERIES[name] = q
        if sql:
            SQL[name] = sql

    def with_img(body: str) -> str:
        return f"WITH {fx.IMG} {body}"

    def real(body: str) -> str:
        return f"WITH {fx.IMG}, f AS ({body}) SELECT y, x, {sql_micro('v')} AS v FROM f"

    weighted = "sum(s.v * p.w)"
    at = {(i - 1, j - 1): float(_W[i, j]) for i in range(3) for j in range(3) if _W[i, j]}
    reg("filter_correlate", lambda d, s: filters.correlate(d, "yx", s, _W), real(_taps(at, weighted)))
    reg("filter_convolve", lambda d, s: filters.convolve(d, "yx", s, _W), real(_taps({(-a, -b): w for (a, b), w in at.items()}, weighted)))
    reg("filter_minimum", lambda d, s: filters.minimum_filter(d, "yx", s, 3), with_img(_taps(_box(3), "min(s.v)")), False)
    reg("filter_maximum", lambda d, s: filters.maximum_filter(d, "yx", s, 3), with_img(_taps(_box(3), "max(s.v)")), False)
    cross = {o: 1.0 for o in neighbourhood.offsets_of(_CROSS)}
    reg("filter_maximum_footprint", lambda d, s: filters.maximum_filter(d, "yx", s, footprint=_CROSS), with_img(_taps(cross, "max(s.v)")), False)
    reg("filter_mean", lambda d, s: filters.mean_filter(d, "yx", s, 5), real(_taps(_box(5), "avg(CAST(s.v AS DOUBLE))")))
    reg("filter_median", lambda d, s: filters.median_filter(d, "yx", s, 3), with_img(_taps(_box(3), "list_sort(list(s.v))[5]")), False)
    reg("filter_percentile", lambda d, s: filters.percentile_filter(d, "yx", s, 20, 3), with_img(_taps(_box(3), "list_sort(list(s.v))[2]")), False)
    half = lambda axis: f"SELECT y, x, CAST(v // 3 AS BIGINT) AS v FROM ({_taps({((k, 0) if axis == 'y' else (0, k)): 1.0 for k in (-1, 0, 1)}, 'CAST(sum(s.v) AS BIGINT)', 'img' if axis == 'y' else 'h')})"
    reg("filter_uniform", lambda d, s: filters.uniform_filter(d, "yx", s, 3, integral=True), f"WITH {fx.IMG}, h AS ({half('y')}) {half('x')}", False)
    lap = {(0, 0): -4.0, (1, 0): 1.0, (-1, 0): 1.0, (0, 1): 1.0, (0, -1): 1.0}
    reg("filter_laplace", lambda d, s: filters.laplace(d, "yx", s), real(_taps(lap, weighted)))
    smooth = {"prewitt": (1, 1, 1), "sobel": (1, 2, 1)}
    for name, side in smooth.items():
        taps = {(i - 1, j): float(j * side[i]) for i in range(3) for j in (-1, 1)}
        f = getattr(filters, name)
        reg(f"filter_{name}", lambda d, s, f=f: f(d, "yx", s, "x"), real(_taps(taps, weighted)))
        other = {(b, a): w for (a, b), w in taps.items()}
        reg(f"filter_generic_gradient_magnitude_{name}", lambda d, s, f=f: filters.generic_gradient_magnitude(d, "yx", s, f),
            f"WITH {fx.IMG}, a AS ({_taps(taps, weighted)}), b AS ({_taps(other, weighted)}) SELECT a.y, a.x, {sql_micro('sqrt(a.v * a.v + b.v * b.v)')} AS v FROM a JOIN b USING (y, x)")

    def separable(wy: list[float], wx: list[float]) -> str:
        ry, rx = len(wy) // 2, len(wx) // 2
        a = _taps({(i - ry, 0): w for i, w in enumerate(wy)}, weighted)
        b = _taps({(0, j - rx): w for j, w in enumerate(wx)}, weighted, "h")
        return f"h AS ({a}), f AS ({b})"

    g0, g1, g2 = (filters.gaussian_weights(1.0, o) for o in (0, 1, 2))
    reg("filter_gaussian", lambda d, s: filters.gaussian_filter(d, "yx", s, 1.0), f"WITH {fx.IMG}, {separable(g0, g0)} SELECT y, x, {sql_micro('v')} AS v FROM f")

    def two(a: list[float], b: list[float], value: str) -> str:
        one, other = separable(a, b), separable(b, a).replace("h AS", "h2 AS").replace("f AS", "f2 AS").replace("FROM h ", "FROM h2 ").replace("JOIN h ", "JOIN h2 ")
        return f"WITH {fx.IMG}, {one}, {other} SELECT f.y, f.x, {sql_micro(value)} AS v FROM f JOIN f2 USING (y, x)"

    reg("filter_gaussian_laplace", lambda d, s: filters.gaussian_laplace(d, "yx", s, 1.0), two(g2, g0, "f.v + f2.v"))
    reg("filter_gaussian_gradient_magnitude", lambda d, s: filters.gaussian_gradient_magnitude(d, "yx", s, 1.0), two(g1, g0, "sqrt(f.v * f.v + f2.v * f2.v)"))
    for name, side in smooth.items():
        taps = {(i - 1, j): float(j * side[i]) for i in range(3) for j in (-1, 1)}
        other = {(b, a): w for (a, b), w in taps.items()}
        f = getattr(filters, f"gaussian_{name}_magnitude")
        reg(f"filter_gaussian_{name}_magnitude", lambda d, s, f=f: f(d, "yx", s, 1.0),
            f"WITH {fx.IMG}, {separable(g0, g0)}, a AS ({_taps(taps, weighted, 'f')}), b AS ({_taps(other, weighted, 'f')}) SELECT a.y, a.x, {sql_micro('sqrt(a.v * a.v + b.v * b.v)')} AS v FROM a JOIN b USING (y, x)")

    # Local statistics over 5 x 5 boxes; the image has no zeros.
    stats = f"m AS ({_taps(_box(5), 'avg(CAST(s.v AS DOUBLE))')}), dev AS (SELECT img.y, img.x, pow(img.v - m.v, 2) AS v FROM img JOIN m USING (y, x)), va AS ({_taps(_box(5), 'avg(s.v)', 'dev')}), lo AS ({_taps(_box(5), 'min(s.v)')}), hi AS ({_taps(_box(5), 'max(s.v)')}), sq AS ({_taps(_box(5), 'avg(CAST(s.v AS DOUBLE) * s.v)')}), st AS (SELECT img.y, img.x, img.v AS v, m.v AS m, va.v AS va, sqrt(va.v) AS s, lo.v AS lo, hi.v AS hi, sq.v AS sq FROM img JOIN m USING (y, x) JOIN va USING (y, x) JOIN lo USING (y, x) JOIN hi USING (y, x) JOIN sq USING (y, x))"
    simple = {"sum": "m * 25", "mean": "m", "variance": "va", "std": "s", "contrast": "hi - lo", "midpoint": "(hi + lo) / CAST(2 AS DOUBLE)", "minimum": "lo", "maximum": "hi"}
    for name, e in simple.items():
        reg(f"local_{name}", lambda d, s, name=name: local_stats.statistic(d, "yx", s, (5, 5), name), f"WITH {fx.IMG}, {stats} SELECT y, x, {sql_micro(e)} AS v FROM st")
    reg("local_weighted_midpoint", lambda d, s: local_stats.weighted_midpoint(d, "yx", s, (5, 5), 1, 2), f"WITH {fx.IMG}, {stats} SELECT y, x, {sql_micro('(hi * 1 + lo * 2) / CAST(3 AS DOUBLE)')} AS v FROM st")
    reg("local_interquartile", lambda d, s: local_stats.interquartile(d, "yx", s, (3, 3)), f"WITH {fx.IMG}, f AS ({_taps(_box(3), 'list_sort(list(s.v))[7] - list_sort(list(s.v))[3]')}) SELECT y, x, {sql_micro('v')} AS v FROM f")
    for name, k in (("skewness", 1), ("pearson_skewness", 3)):
        reg(f"local_{name}", lambda d, s, k=k: local_stats.skewness(d, "yx", s, (5, 5), k == 3),
            f"WITH {fx.IMG}, {stats}, md AS ({_taps(_box(5), 'list_sort(list(s.v))[13]')}) SELECT st.y, st.x, {sql_micro(f'CASE WHEN s > 0 THEN (m - md.v) / s ELSE 0 END * {k}')} AS v FROM st JOIN md USING (y, x)")

    # Local thresholds; masks compare strictly, so the oracle repeats the formulas.
    glob = "g AS (SELECT max(s) AS smax, min(s) AS smin, min(v) AS vmin, max(v) AS vmax, avg(v) AS mu, stddev_pop(v) AS sd, (max(v) - min(v)) / CAST(2 AS DOUBLE) AS r FROM st)"
    k = "CAST(0.3 AS DOUBLE)"
    local = {
        "threshold_niblack": f"m - {k} * s", "threshold_sauvola": f"m * (1 + {k} * (s / r - 1))", "niblack": f"m + {k} * s", "sauvola": f"m * (1 - {k} * (1 - s / r))",
        "wolf": f"(1 - {k}) * m + {k} * (s / CASE WHEN smax * (m - vmin) = 0 THEN 1e-300 ELSE smax * (m - vmin) END) + {k} * vmin", "singh": f"{k} * (m + (hi - lo) * (1 - v))",
        "trsingh": f"m * (1 + {k} * ((v - m) / CASE WHEN 1 - (v - m) = 0 THEN 1e-300 ELSE 1 - (v - m) END - 1))", "wan": f"(hi + m) / 2 * (1 - {k} * (1 - s / r))",
        "nick": f"m + {k} * sqrt(greatest((sq * 25 - m * m) / 25, 0))", "nick_v2": f"m + {k} * sqrt(greatest(m * m + sq - m * m, 0))", "nick_v3": f"m + {k} * sqrt(m * m + sqrt(s))",
        "contrast": f"CASE WHEN (v - lo) * {k} <= (hi - v) * (2 - {k}) THEN vmax ELSE 0 END",
        "bataineh": "m - m * m * s / ((mu + s) * ((s - smin) / CASE WHEN smax - smin = 0 THEN 1e-300 ELSE smax - smin END * vmax + s))",
        "rais": "m - CAST(0.3 AS DOUBLE) * ((mu * sd - m * s) / greatest(mu * sd, m * s)) * s", "phansalkar": f"m * (1 + 2 * exp(-10 * m) + {k} * (s / smax - 1))",
    }
    for name, e in local.items():
        reg(f"threshold_local_{name.removeprefix('threshold_') if not name.startswith('threshold_') else 'public_' + name.removeprefix('threshold_')}",
            lambda d, s, name=name: threshold.local_threshold(d, "yx", s, name, size=5, k=0.3).select("y", "x", (F.col("v") > F.col("t") + 1e-7).cast("bigint").alias("v")),
            f"WITH {fx.IMG}, {stats}, {glob} SELECT y, x, CAST(v > ({e}) + CAST(1e-7 AS DOUBLE) AS BIGINT) AS v FROM st, g", False)
    for name in ("niblack", "sauvola", "phansalkar"):
        reg(f"threshold_{name}_bernsen", lambda d, s, name=name: threshold.hybrid_bernsen(d, "yx", s, name, 127.3, size=5, k=0.3, min_contrast=40),
            f"WITH {fx.IMG}, {stats}, {glob} SELECT y, x, CAST(v > CASE WHEN hi - lo < 40 THEN CAST(127.3 AS DOUBLE) ELSE {local[name]} END AS BIGINT) AS v FROM st, g", False)
    reg("threshold_bernsen", lambda d, s: threshold.bernsen(d, "yx", s, 127.3, 5, 40), f"WITH {fx.IMG}, {stats} SELECT y, x, CAST(v > CASE WHEN hi - lo > 40 THEN (hi + lo) / CAST(2 AS DOUBLE) ELSE CAST(127.3 AS DOUBLE) END AS BIGINT) AS v FROM st", False)
    # LAAB's formula is for values from 0 to 1.
    reg("threshold_local_laab", lambda d, s: threshold.local_threshold(d.withColumn("v", F.col("v") / 255.0), "yx", s, "laab", size=5, k=0.5).select("y", "x", F.col("t").cast("bigint").alias("v")),
        f"WITH {fx.IMG}, unit AS (SELECT y, x, v / CAST(255 AS DOUBLE) AS v FROM img), {stats.replace('img', 'unit')}, h AS (SELECT y, x, CAST(0.5 AS DOUBLE) * ((1 + (v - m) * (1 - m)) / (1 - (v - m) * (1 - m))) AS h FROM st) SELECT y, x, CAST(1 - (abs(1 - 2 * h) - (1 - 2 * h)) / (2 * CASE WHEN 1 - 2 * h = 0 THEN 1e-300 ELSE abs(1 - 2 * h) END) AS BIGINT) AS v FROM h", False)
    for name, small, big, (alpha, k1, k2) in (("feng", 5, 7, (0.18, 0.66, 0.15)), ("feng_bernsen", 3, 5, (0.12, 0.25, 0.04))):
        boxes = "".join(
            f", m{n} AS ({_taps(_box(n), 'avg(CAST(s.v AS DOUBLE))')}), d{n} AS (SELECT img.y, img.x, pow(img.v - m{n}.v, 2) AS v FROM img JOIN m{n} USING (y, x)), s{n} AS (SELECT y, x, sqrt(v) AS v FROM ({_taps(_box(n), 'avg(s.v)', f'd{n}')}))"
            for n in (small, big)
        )
        boxes += f", lo AS ({_taps(_box(small), 'min(s.v)')}), hi AS ({_taps(_box(small), 'max(s.v)')})"
        ratio = "(a.v / CASE WHEN b.v = 0 THEN 1e-300 ELSE b.v END)"
        t = f"CAST({1 - alpha} AS DOUBLE) * m.v + CAST({k1} AS DOUBLE) * pow({ratio}, 3) * (m.v - lo.v) + CAST({k2} AS DOUBLE) * pow({ratio}, 2) * lo.v"
        if name == "feng":
            run = lambda d, s: threshold.feng(d, "yx", s).select("y", "x", (F.col("v") > F.col("t") + 1e-7).cast("bigint").alias("v"))
        else:
            run = lambda d, s: threshold.hybrid_bernsen(d, "yx", s, "feng", 127.3, min_contrast=40).select("y", "x", "v")
            t = f"CASE WHEN hi.v - lo.v < 40 THEN CAST(127.3 AS DOUBLE) ELSE {t} END"
        reg(f"threshold_{name}", run, f"WITH {fx.IMG}{boxes} SELECT img.y, img.x, CAST(img.v > {t} + CAST({1e-7 if name == 'feng' else 0} AS DOUBLE) AS BIGINT) AS v FROM img JOIN m{small} m USING (y, x) JOIN s{small} a USING (y, x) JOIN s{big} b USING (y, x) JOIN lo USING (y, x) JOIN hi USING (y, x)", False)


def _thresholds() -> None:
    d = "CAST({} AS DOUBLE)"
    otsu = f"""mm AS (SELECT min(v) AS mn, max(v) AS mx FROM img),
h AS (SELECT least(floor((v - mn) * {d.format(256)} / (mx - mn)), 255) AS b, count(*) AS n FROM img, mm GROUP BY 1),
k AS (SELECT b, n, mn + (b + {d.format(0.5)}) * (mx - mn) / {d.format(256)} AS c FROM h, mm),
w AS (SELECT c, CAST(sum(n) OVER (ORDER BY b) AS DOUBLE) AS w1, CAST(sum(n * c) OVER (ORDER BY b) AS DOUBLE) AS s1, CAST(sum(n) OVER () AS DOUBLE) AS w, CAST(sum(n * c) OVER () AS DOUBLE) AS s FROM k),
o AS (SELECT c, w1 * (w - w1) * pow(s1 / w1 - (s - s1) / (w - w1), 2) AS q FROM w WHERE w1 < w),
t AS (SELECT c AS t FROM o ORDER BY q DESC, c LIMIT 1)"""
    QUERIES["threshold_otsu"] = lambda spark, sf: pyramid(spark, sf).threshold("otsu").layer()
    SQL["threshold_otsu"] = f"WITH {fx.IMG}, {otsu} SELECT y, x, CAST(v > t AS BIGINT) AS v FROM img, t"
    QUERIES["threshold_manual"] = lambda spark, sf: pyramid(spark, sf).threshold("manual", threshold=140).layer()
    SQL["threshold_manual"] = f"WITH {fx.IMG} SELECT y, x, CAST(v > 140 AS BIGINT) AS v FROM img"
    for name in ("isodata", "yen", "minimum", "multiotsu", "triangle"):
        QUERIES[f"threshold_{name}"] = lambda spark, sf, name=name: pyramid(spark, sf).threshold(name).layer()
    # All 256 bins, empty ones too; b counts from 0.
    bins = f"""mm AS (SELECT min(v) AS mn, max(v) AS mx FROM img),
filled AS (SELECT CAST(least(floor((v - mn) * {d.format(256)} / (mx - mn)), 255) AS INT) AS b, count(*) AS n FROM img, mm GROUP BY 1),
k AS (SELECT CAST(r.b AS INT) AS b, CAST(coalesce(n, 0) AS DOUBLE) AS n, mn + (r.b + {d.format(0.5)}) * (mx - mn) / {d.format(256)} AS c FROM range(0, 256) r(b) LEFT JOIN filled USING (b) CROSS JOIN mm)"""
    mask = "SELECT y, x, CAST(v > t AS BIGINT) AS v FROM img, t"
    SQL["threshold_isodata"] = f"""WITH {fx.IMG}, {bins},
w AS (SELECT b, c, sum(n) OVER (ORDER BY b) AS w1, sum(n * c) OVER (ORDER BY b) AS s1, sum(n) OVER () AS w, sum(n * c) OVER () AS s FROM k),
g AS (SELECT b, c, (s1 / w1 + (s - s1) / (w - w1)) / 2 - c AS gap FROM w WHERE w1 > 0 AND w > w1),
t AS (SELECT c AS t FROM g, mm WHERE gap >= 0 AND gap < (mx - mn) / {d.format(256)} ORDER BY b LIMIT 1) {mask}"""
    SQL["threshold_yen"] = f"""WITH {fx.IMG}, {bins},
p AS (SELECT b, c, n / sum(n) OVER () AS p FROM k),
w AS (SELECT b, c, sum(p) OVER (ORDER BY b) AS p1, sum(p * p) OVER (ORDER BY b) AS q1, sum(p * p) OVER (ORDER BY b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q2 FROM p),
t AS (SELECT c AS t FROM w WHERE b < 255 AND q1 * q2 > 0 AND p1 < 1 ORDER BY 2 * ln(p1 * (1 - p1)) - ln(q1 * q2) DESC, b LIMIT 1) {mask}"""
    SQL["threshold_triangle"] = f"""WITH {fx.IMG}, {bins},
e AS (SELECT min(b) AS first, max(b) AS last, arg_max(b, n) AS peak, max(n) AS high FROM (SELECT * FROM k WHERE n > 0 ORDER BY b)),
f AS (SELECT *, peak - first < last - peak AS flip FROM e),
q AS (SELECT b, c, n, CASE WHEN flip THEN last - b ELSE b - first END AS i, CASE WHEN flip THEN last - peak ELSE peak - first END AS width, high FROM k, f WHERE CASE WHEN flip THEN b > peak AND b <= last ELSE b >= first AND b < peak END),
t AS (SELECT c AS t FROM q ORDER BY high * i - width * n DESC, i LIMIT 1) {mask}"""
    SQL["threshold_multiotsu"] = f"""WITH {fx.IMG}, {bins},
w AS (SELECT b, c, sum(n) OVER (ORDER BY b) AS w, sum(n * c) OVER (ORDER BY b) AS s, sum(n) OVER () AS wn, sum(n * c) OVER () AS sn, n FROM k),
o AS (SELECT * FROM w WHERE n > 0),
v AS (SELECT i.b AS i, j.b AS j, i.c AS t, i.s * i.s / i.w + pow(j.s - i.s, 2) / (j.w - i.w) + pow(j.sn - j.s, 2) / (j.wn - j.w) AS gain FROM o i JOIN o j ON i.b < j.b WHERE j.w < j.wn),
t AS (SELECT t FROM v ORDER BY gain DESC, i, j LIMIT 1) {mask}"""
    QUERIES["threshold_histogram"] = lambda spark, sf: fx.image(spark, sf).crossJoin(F.broadcast(fx.image(spark, sf).agg(F.min("v").alias("mn"), F.max("v").alias("mx")))).groupBy(F.least(F.floor((F.col("v") - F.col("mn")) * F.lit(256.0) / (F.col("mx") - F.col("mn"))), F.lit(255)).cast("bigint").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    SQL["threshold_histogram"] = f"WITH {fx.IMG}, mm AS (SELECT min(v) AS mn, max(v) AS mx FROM img) SELECT CAST(least(floor((v - mn) * {d.format(256)} / (mx - mn)), 255) AS BIGINT) AS b, count(*) AS n FROM img, mm GROUP BY 1"


def _stores() -> None:
    """Chunked stores in the shared folder, written and read again."""

    def stored(spark: SparkSession, sf: str, **kw) -> str:
        path = f"{shared_folder(spark)}/zarr-{uuid.uuid4().hex}"
        zarr.write_pyramid(pyramid(spark, sf), path, chunks=(64, 64), **kw)
        return path

    def overwritten(spark: SparkSession, sf: str) -> DataFrame:
        path = stored(spark, sf, codec="zlib")
        zarr.write_pyramid(zarr.read_pyramid(spark, path).ufunc("add", 1), path, overwrite=True, codec="zstd", chunks=(100, 16), separator="/")
        return zarr.read_pyramid(spark, path).layer()

    plain = f"WITH {fx.IMG} SELECT y, x, v FROM img"
    QUERIES["zarr_round_trip"], SQL["zarr_round_trip"] = lambda spark, sf: zarr.read_pyramid(spark, stored(spark, sf, codec="blosc")).layer(), plain
    QUERIES["zarr_crop"] = lambda spark, sf: zarr.read_array(spark, stored(spark, sf, codec="zlib") + "/0", crop={"y": (30, 300), "x": (5, 60)})
    SQL["zarr_crop"] = f"{plain} WHERE y >= 30 AND y < 300 AND x >= 5 AND x < 60"
    QUERIES["zarr_overwrite"], SQL["zarr_overwrite"] = overwritten, f"WITH {fx.IMG} SELECT y, x, v + 1 AS v FROM img"


# -- labels ----------------------------------------------------------------------------------------------------


def _labels() -> None:
    # The queries label the whole image; the recursive SQL stops at these rows, so the two agree on tables of no more.
    rows = 32

    def labelled(spark: SparkSession, sf: str, dense: bool = False) -> DataFrame:
        return labels.label(threshold.above(fx.image(spark, sf), "yx", 140), "yx", _shape(spark, sf), dense)

    comp = f"""{fx.IMG}, fg AS (SELECT y, x, CAST(y AS BIGINT) * 64 + x AS id FROM img WHERE y < {rows} AND v > 140),
e AS (SELECT a.id AS a, b.id AS b FROM fg a JOIN fg b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
reach(a, b) AS (SELECT id, id FROM fg UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
l AS (SELECT a AS id, min(b) + 1 AS v FROM reach GROUP BY a),
lab AS (SELECT img.y, img.x, coalesce(l.v, 0) AS v, img.v AS i FROM img LEFT JOIN l ON l.id = CAST(img.y AS BIGINT) * 64 + img.x WHERE img.y < {rows})"""
    QUERIES["label_components"] = labelled
    SQL["label_components"] = f"WITH RECURSIVE {comp} SELECT y, x, v FROM lab"
    QUERIES["label_dense"] = lambda spark, sf: labelled(spark, sf, True)
    SQL["label_dense"] = f"WITH RECURSIVE {comp} SELECT y, x, CASE WHEN v = 0 THEN 0 ELSE dense_rank() OVER (ORDER BY v) - 1 END AS v FROM lab"
    QUERIES["label_extract"] = lambda spark, sf: labels.extract(labelled(spark, sf, True), "yx", 3)
    SQL["label_extract"] = f"WITH RECURSIVE {comp}, n AS (SELECT y, x, dense_rank() OVER (ORDER BY v) - 1 AS v FROM lab) SELECT y, x, CAST(v = 3 AS BIGINT) AS v FROM n"
    QUERIES["label_properties"] = lambda spark, sf: labels.properties(labelled(spark, sf), fx.image(spark, sf), "yx", ("area", "intensity_max", "intensity_mean")).withColumn("intensity_mean", micro(F.col("intensity_mean")))
    SQL["label_properties"] = f"WITH RECURSIVE {comp} SELECT v AS label, count(*) AS area, max(i) AS intensity_max, {sql_micro('avg(i)')} AS intensity_mean FROM lab WHERE v > 0 GROUP BY v"
    QUERIES["label_convex"] = lambda spark, sf: labels.properties(labelled(spark, sf), fx.image(spark, sf), "yx", ("area", "area_convex", "solidity")).withColumn("solidity", micro(F.col("solidity")))
    QUERIES["label_boxes"] = lambda spark, sf: labels.boxes(labelled(spark, sf), "yx")
    SQL["label_boxes"] = f"WITH RECURSIVE {comp} SELECT v AS label, min(y) AS y_min, max(y) AS y_max, min(x) AS x_min, max(x) AS x_max FROM lab WHERE v > 0 GROUP BY v"
    QUERIES["label_colors"] = lambda spark, sf: labels.display_colors(labelled(spark, sf))
    SQL["label_colors"] = f"WITH RECURSIVE {comp}, n AS (SELECT v AS label, count(*) AS n FROM lab GROUP BY v), r AS (SELECT label, row_number() OVER (ORDER BY n, label) AS r, count(*) OVER () AS k FROM n) SELECT label, CAST(floor(CASE WHEN r = k THEN 0 ELSE r END * 255 / CAST(greatest(k - 1, 1) AS DOUBLE)) AS INT) AS position FROM r"

    def upserted(spark: SparkSession, sf: str) -> DataFrame:
        p = labels.properties(labelled(spark, sf), fx.image(spark, sf), "yx", ("area",))
        return labels.upsert(p, p.where("area > 2").select("label", (F.col("area") * 10).alias("area")))

    QUERIES["label_upsert"] = upserted
    SQL["label_upsert"] = f"WITH RECURSIVE {comp} SELECT v AS label, CASE WHEN count(*) > 2 THEN count(*) * 10 ELSE count(*) END AS area FROM lab WHERE v > 0 GROUP BY v"


for make in (_unary, _binary, _reductions, _layers, _filters, _thresholds, _stores, _labels):
    make()
