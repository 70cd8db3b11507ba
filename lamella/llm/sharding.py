"""Sharding by a minimax contiguous partition of ordered atomic groups.

Rows with equal texts form a group that is never cut. Groups are ordered by the hash of their text. The smallest capacity for
which a greedy walk needs no more than the given shards is found by binary search, and the walk's cuts are used.

The walk never sees all groups. It runs on a histogram of the hashes' leading bits, at most 2**16 items; only where a cut
can still fall (between the walk with indivisible items at the least capacity and the continuous position at the
largest) items are split by eight more bits, until no such item holds more than one group. The cuts are then those that a walk
over all groups makes. Slots come from a range-partitioned sort: each partition numbers its rows, and offsets
come from one count per shard and partition.

Defined results: null texts are of size ``overhead`` and one group with empty texts. Repeated rows take a slot each; null ids come first among
their equals. Fewer groups than shards leave the last shards empty. No rows: no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import Scratch

FIRST_BITS, NEXT_BITS = 16, 8


def walk(prefix: np.ndarray, capacity: int, shards: int) -> np.ndarray | None:
    """Greedy cuts (item numbers where shards 1, 2, ... begin), or None if ``shards`` don't suffice. prefix[0] is 0."""
    cuts, at, n = [], 0, len(prefix) - 1
    while at < n:
        to = int(np.searchsorted(prefix, prefix[at] + capacity, "right")) - 1
        if to == at or len(cuts) == shards:
            return None
        cuts.append(at)
        at = to
    return np.array(cuts[1:], np.int64)


def least_capacity(sizes: np.ndarray, shards: int) -> int:
    """The smallest capacity for which the greedy walk over ``sizes`` needs at most ``shards``."""
    if not len(sizes):
        return 0
    prefix = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    low, high = max(int(sizes.max()), -(-int(prefix[-1]) // shards)), int(prefix[-1])
    while low < high:
        mid = (low + high) // 2
        if walk(prefix, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def _items(rows: DataFrame, bits: int) -> tuple[np.ndarray, ...]:
    """(size, least hash, largest hash) by leading bits, in hash order."""
    got = rows.groupBy(F.shiftright("h", 64 - bits).alias("b")).agg(F.sum("size").alias("s"), F.min("h").alias("lo"), F.max("h").alias("hi")).toArrow()
    order = np.argsort(got["lo"].to_numpy())
    return tuple(got[c].to_numpy()[order] for c in ("s", "lo", "hi"))


def find_cuts(rows: DataFrame, shards: int) -> list[int]:
    """The hashes at which shards 1, 2, ... begin; ``rows`` has h and size."""
    bits = FIRST_BITS
    size, lo, hi = _items(rows, bits)
    while len(size):
        prefix = np.concatenate([[0], np.cumsum(size)])
        most = least_capacity(size, shards)
        single = lo == hi
        least = max(-(-int(prefix[-1]) // shards), int(size[single].max()) if single.any() else 0)
        if single.all() or bits >= 64:
            break
        coarse = _coarse(prefix, least, shards)
        opened = np.zeros(len(size), bool)
        for k, low in enumerate(coarse, 1):
            to = int(np.searchsorted(prefix, min(int(prefix[-1]), k * most), "left"))
            opened[low : to + 1] = True
        if not (opened & ~single).any():
            break
        bits = min(64, bits + NEXT_BITS)
        # Neighbouring items make one range, single groups included: there are at most as many ranges as cuts.
        first = np.flatnonzero(opened & ~np.concatenate([[False], opened[:-1]]))
        last = np.flatnonzero(opened & ~np.concatenate([opened[1:], [False]]))
        inside: Column = F.lit(False)
        for a, b in zip(first, last):
            inside = inside | F.col("h").between(int(lo[a]), int(hi[b]))
        parts = _items(rows.where(inside), bits)
        keep = ~opened
        for a, b in zip(first, last):
            keep[a : b + 1] = False
        size, lo, hi = (np.concatenate([x[keep], y]) for x, y in zip((size, lo, hi), parts))
        order = np.argsort(lo)
        size, lo, hi = size[order], lo[order], hi[order]
    if not len(size):
        return []
    prefix = np.concatenate([[0], np.cumsum(size)])
    return [int(lo[c]) for c in walk(prefix, least_capacity(size, shards), shards)]


def _coarse(prefix: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Where a walk at ``capacity`` over indivisible items cuts at the earliest; an item that is larger is stepped over."""
    out, at, n = [], 0, len(prefix) - 1
    while len(out) < shards - 1 and at < n:
        to = int(np.searchsorted(prefix, prefix[at] + capacity, "right")) - 1
        out.append(to)
        at = max(to, at)
        if to == n:
            break
        if out[-1] == (out[-2] if len(out) > 1 else 0):
            # The item is larger than the capacity, so it will be split; no later cut is certain to lie beyond it.
            out += [to] * (shards - 1 - len(out))
            break
    return out


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row; the largest shard is as small as groups in this order allow."""
    scratch = Scratch(docs.sparkSession, "shards")
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(data) + overhead).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.xxhash64(data).alias("h"))
    rows = scratch.write(rows, "rows")
    number: Column = F.lit(0)
    for cut in find_cuts(rows.select("h", "size"), shards):
        number = number + (F.col("h") >= cut).cast("int")
    placed = rows.withColumn("shard", number).repartitionByRange("h", "doc_id").sortWithinPartitions("h", "doc_id").withColumn("at", F.monotonically_increasing_id())
    placed = scratch.write(placed, "placed")
    runs = placed.groupBy("shard", F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # One row per shard and partition that meet: partitions + shards at most.
    runs = F.broadcast(runs.select("shard", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift")))
    out = placed.withColumn("part", F.shiftright("at", 33)).join(runs, ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("shift")).alias("slot"))
