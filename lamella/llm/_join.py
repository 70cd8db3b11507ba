"""Equi-joins that keep hot keys out of the shuffle, rows under keys of their own, and scores of rows by their texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._memory import tidy
from ._scratch import Scratch

HOT_SHARE = 1024


def left_join_by_weight(rows: DataFrame, classes: DataFrame, keys: list[str], weight: str, total: int, place: Callable[[DataFrame], DataFrame] = lambda side: side) -> DataFrame:
    """``rows`` left-joined with ``classes``, of which there is at most one per key.

    ``weight`` counts the rows of a class. Classes with more than one row in 1024 of all ``total`` rows are
    at most 1024 by counting, whatever the data; they are broadcast, and their rows never meet in a shuffle.
    All others go through an ordinary join, where no key has more than that share; ``place`` partitions both sides of it.
    """
    bar = max(1, total // HOT_SHARE)
    hot = F.broadcast(classes.where(F.col(weight) > bar))
    cold = classes.where(F.col(weight) <= bar)
    return rows.join(hot, keys).unionByName(place(rows.join(hot.select(*keys), keys, "left_anti")).join(place(cold), keys, "left"))


def keyed(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` with a number of its own for every row, written so that it stays the same, and that column's name."""
    row = "row"
    while row in (c.lower() for c in docs.columns):
        row += "_"
    return Scratch(docs.sparkSession, name).write(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def by_text(judge: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, np.ndarray]]], text: Column) -> Column:
    """``judge``'s score of every row's text, found as the row passes: no other column goes to Python, and no row is copied or joined."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for _, score in judge(pa.RecordBatch.from_arrays([t], names=["t"]) for t in texts):
            yield pa.array(score, pa.float64())

    return F.arrow_udf(tidy(run), "double")(text.cast("string"))


def keep_rows(docs: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` whose key isn't in ``dropped`` (one column)."""
    return docs.join(dropped.toDF(key), key, "left_anti").select(*docs.columns)
