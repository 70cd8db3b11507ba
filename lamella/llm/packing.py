"""Packing documents into windows of a fixed number of tokens by online sum-of-squares placement.

A level array counts the partially filled windows at every fill level. A document of s tokens goes into the
level h for which the sum of the squared counts after the move to h + s is smallest; opening a new window is the
choice h = 0; of equal choices the fullest window wins. A document is cut only where it must be: into whole windows
where it is longer than one, and at a flush, where the emptiest windows' pieces fill the gaps of the fullest, so one
partial window at most is left for every ``epoch`` tokens of a partition.

A task holds the ids of one epoch and of one document at a time. Windows are numbered by partition, so no
shuffle is needed and a task that runs again gives the same windows.

Defined results: a null or empty text is the end token alone; null ids pass through; repeated rows are packed
each on its own; no rows: no pieces. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._memory import tidy
from ._vocab import WordEncoder, vocabulary_path
from ._words import slabs

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tokens binary"


class SumOfSquares:
    """Windows of ``capacity`` tokens; ``place`` gives each item a window, and ``flush`` closes all."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.levels = np.zeros(capacity + 1, np.int64)  # partially filled windows by fill level
        self.at: list[list[int]] = [[] for _ in range(capacity)]
        self.windows: list[list[tuple[int, int, int]]] = []

    def place(self, item: int, start: int, size: int) -> None:
        """Add tokens [start, start + size) of ``item``; size is 1 to the capacity."""
        c, n = self.capacity, self.levels
        piece = (item, start, size)
        if size == c:
            self.windows.append([piece])
            return
        level, best = 0, 2 * n[size] + 1
        some = np.flatnonzero(n[1 : c - size + 1]) + 1
        if len(some):
            to = some + size
            change = 2 - 2 * n[some] + 2 * n[to]
            if to[-1] == c:
                change[-1] = 1 - 2 * n[some[-1]]
            k = len(some) - 1 - int(np.argmin(change[::-1]))
            if change[k] <= best:
                level = int(some[k])
        if level:
            w = self.at[level].pop()
            n[level] -= 1
            self.windows[w].append(piece)
        else:
            w = len(self.windows)
            self.windows.append([piece])
        if level + size < c:
            n[level + size] += 1
            self.at[level + size].append(w)

    def flush(self) -> list[list[tuple[int, int, int]]]:
        """All windows, with at most one that isn't full; pieces are cut to fill gaps."""
        c = self.capacity
        partial = [(level, w) for level in range(c - 1, 0, -1) for w in self.at[level]]
        i, j = 0, len(partial) - 1
        fill = [level for level, _ in partial]
        while i < j:
            gap = c - fill[i]
            if not gap:
                i += 1
                continue
            giver = self.windows[partial[j][1]]
            item, start, size = giver.pop()
            moved = min(gap, size)
            self.windows[partial[i][1]].append((item, start + size - moved, moved))
            if moved < size:
                giver.append((item, start, size - moved))
            fill[i] += moved
            fill[j] -= moved
            if not giver:
                j -= 1
        out = [w for w in self.windows if w]
        self.__init__(c)
        return out


def _run(path: str, capacity: int, end: int, epoch: int):
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path)
        packer = SumOfSquares(capacity)
        number = TaskContext.get().partitionId() << 33
        held: list[tuple[int | None, bytes]] = []
        tokens = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number, held, tokens
            rows: list[tuple] = []
            for window in packer.flush():
                offset = 0
                for k, start, size in window:
                    doc, ids = held[k]
                    rows.append((doc, start, size, len(ids) // 4, number, offset, ids[4 * start : 4 * (start + size)]))
                    offset += size
                number += 1
                if len(rows) >= 2000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)
            held, tokens = [], 0

        for rows, data, offs in slabs(batches, "t"):
            texts = [data[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:])]
            for doc, ids in zip(rows.column(0).to_pylist(), encoder.encode(texts)):
                ids += last
                n = len(ids) // 4
                held.append((doc, ids))
                for start in range(0, n, capacity):
                    packer.place(len(held) - 1, start, min(capacity, n - start))
                tokens += n
                if tokens >= epoch:
                    yield from close()
        yield from close()

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.binary()]
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "tokens"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = 4096, end: int = 2, epoch: int = 4 << 20) -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned 32-bit numbers in ``tokens``.

    ``tokenizer`` is the path of a file whose pieces never cross white space; the public word-level file by default.
    """
    path = tokenizer or vocabulary_path("word_bpe_49k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(tidy(_run(path, capacity, end, epoch)), SCHEMA)
