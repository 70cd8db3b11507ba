"""Vectorised words of UTF-8 text, straight from Arrow buffers.

Words are runs of bytes other than 0x20 and 0x09-0x0D. No Python string is made for them: a slab of texts is
one byte array, word borders come from a byte table, and the 64-bit fingerprint of every word comes from one
cumulative sum of a polynomial over the slab, then a mixing step. A-Z count as a-z where asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.default_rng(20240611)
_TABLE = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | U64(1)
_LOWER_TABLE = _TABLE.copy()
_LOWER_TABLE[65:91] = _TABLE[97:123]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = U64(0x9E3779B97F4A7C13)  # 3 modulo 8: differences of its powers keep few factors of two
_P_INV = U64(pow(int(_P), -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]
SLAB_BYTES = 2 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective mixing step on 64-bit words."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def _power_arrays(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLAB_BYTES)
        for k, base in enumerate((_P, _P_INV)):
            a = np.full(size, base, U64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0][:n], _powers[1][:n]


def forget_powers() -> None:
    """Drop the arrays of powers, which are made again when asked for."""
    _powers[:] = [np.ones(1, U64), np.ones(1, U64)]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        width = np.int32
    else:
        width = np.int64
    buffers = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(buffers[1], width)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slabs(batches: Iterator[pa.RecordBatch], text: str, most: int = SLAB_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into runs of rows of about ``most`` bytes of text (one row at least): (rows, bytes, offsets)."""
    for batch in batches:
        n, at = batch.num_rows, 0
        if not n:
            continue
        data, offs = text_bytes(batch.column(batch.schema.get_field_index(text)))
        while at < n:
            to = int(np.searchsorted(offs, offs[at] + most, "right")) - 1
            to = min(n, max(to, at + 1))
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; no word crosses from one text into the next."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~SPACE[data]
    border = np.zeros(n + 1, bool)
    border[offs] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | border[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | border[1:-1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit fingerprints of byte spans that are not empty."""
    if not len(start):
        return np.zeros(0, U64)
    power, inverse = _power_arrays(len(data))
    total = (_LOWER_TABLE if lower else _TABLE)[data]
    total *= power
    np.cumsum(total, out=total)
    h = total[end - 1]
    inner = start > 0
    h[inner] -= total[start[inner] - 1]
    h *= inverse[start]
    h ^= (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix(h)


def shingle_keys(words: np.ndarray, row: np.ndarray, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, row) of every run of ``width`` words, and of the whole text where it has fewer words."""
    n = np.bincount(row, minlength=rows)
    m = len(words)
    mult = [U64(pow(0xD1342543DE82EF95, k + 1, 2**64)) for k in range(width)]
    if m >= width:
        h = words[: m - width + 1] * mult[0]
        for k in range(1, width):
            h = h + words[k : m - width + 1 + k] * mult[k]
        at = np.flatnonzero(row[: m - width + 1] == row[width - 1 :])
        keys, where = mix(h[at] ^ U64(width)), row[at]
    else:
        keys, where = np.zeros(0, U64), np.zeros(0, np.int64)
    few = np.flatnonzero((n > 0) & (n < width))
    if len(few):
        first = np.searchsorted(row, few)
        extra = []
        for r, f in zip(few, first):
            h = U64(0)
            for k in range(n[r]):
                h = U64((int(h) + int(words[f + k]) * int(mult[k])) % 2**64)
            extra.append(int(h) ^ (int(n[r]) + 7919))
        keys = np.concatenate([keys, mix(np.array(extra, U64))])
        where = np.concatenate([where, few])
        order = np.argsort(where, kind="stable")
        keys, where = keys[order], where[order]
    return keys, where
