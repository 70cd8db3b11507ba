"""Element types of arrays on Spark's types, with the casts that array libraries make: truncation and wrap-around.

Casts never raise under ANSI mode: reals are truncated toward zero, integers wrap modulo 2**bits, and reals that
no integer stands for (NaN, infinities, beyond 64 bits) become 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: name -> (Spark type, bits, signed); floats have 0 bits.
DTYPES: dict[str, tuple[str, int, bool]] = {
    "bool": ("boolean", 1, False),
    "int8": ("tinyint", 8, True),
    "int16": ("smallint", 16, True),
    "int32": ("int", 32, True),
    "int64": ("bigint", 64, True),
    "uint8": ("smallint", 8, False),
    "uint16": ("int", 16, False),
    "uint32": ("bigint", 32, False),
    "uint64": ("decimal(20,0)", 64, False),
    "float16": ("float", 0, True),
    "float32": ("float", 0, True),
    "float64": ("double", 0, True),
}


def spark_type(dtype: str) -> str:
    return DTYPES[dtype][0]


def is_float(dtype: str) -> bool:
    return DTYPES[dtype][1] == 0


def truncated(v: Column) -> Column:
    """A double without its fraction."""
    return F.when(v < 0, -F.floor(-v).cast("double")).otherwise(F.floor(v).cast("double"))


def to_long(v: Column) -> Column:
    """A real as a long, truncated; 0 where no long stands for it."""
    d = v.cast("double")
    inside = ~F.isnan(d) & (d > -9.2233720368547e18) & (d < 9.2233720368547e18)
    return F.when(inside, F.when(inside, d).otherwise(F.lit(0.0)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def wrap(v: Column, dtype: str) -> Column:
    """A long in the range of ``dtype``, modulo 2**bits."""
    name, bits, signed = DTYPES[dtype]
    if dtype == "bool":
        return v != 0
    if bits == 64 or bits == 0:
        return v.cast(name)
    if signed:
        return F.shiftright(F.shiftleft(v, 64 - bits), 64 - bits).cast(name)
    return v.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")).cast(name)


def cast(v: Column, source: str, target: str) -> Column:
    """``v`` of element type ``source`` as ``target``."""
    if source == target:
        return v
    if is_float(target):
        return v.cast("double" if target == "float64" else "float") if source != "bool" else v.cast("int").cast(spark_type(target))
    if is_float(source):
        return F.isnan(v) | (v != 0) if target == "bool" else wrap(to_long(v), target)
    return wrap(v.cast("int").cast("bigint") if source == "bool" else v.cast("bigint"), target)
