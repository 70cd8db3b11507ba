"""Blosc frames (format 1) over the block codecs that pyarrow brings: lz4, lz4hc, zlib, zstd and snappy, with byte or bit shuffle.

A frame is 16 bytes of header (versions, flags, item size, and the sizes of data, blocks and frame), the blocks' offsets, and blocks of
one stream or of one stream per byte of the item. Streams that didn't shrink are stored as they are. Frames are written with one block of one stream.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa

NAMES = {1: "lz4", 3: "zlib", 4: "zstd", 2: "snappy"}
SHUFFLE, PLAIN, BITS, WHOLE = 1, 2, 4, 16
LEAST_STREAM = 128  # bytes below which no encoder splits a block


def _codec(name: str) -> pa.Codec:
    return pa.Codec({"lz4": "lz4_raw"}.get(name, name))


def _unpack(data: bytes, size: int, kind: int) -> bytes:
    if kind not in NAMES:
        raise ValueError("blosc frames of the blosclz codec can't be read")
    if NAMES[kind] == "zlib":
        return zlib.decompress(data)
    return _codec(NAMES[kind]).decompress(data, size, asbytes=True)


def _unshuffle(block: bytes, item: int, flags: int) -> bytes:
    n = len(block) // item
    if flags & SHUFFLE and item > 1:
        body = np.frombuffer(block, np.uint8, n * item).reshape(item, n).T.tobytes()
        return body + block[n * item :]
    if flags & BITS:
        n -= n % 8
        bits = np.unpackbits(np.frombuffer(block, np.uint8, n * item).reshape(item * 8, n // 8), axis=1, bitorder="little")
        return np.packbits(bits.T.reshape(n, item * 8), axis=1, bitorder="little").tobytes() + block[n * item :]
    return block


def decode(frame: bytes) -> bytes:
    _, _, flags, item, size, most, _ = struct.unpack("<BBBBIII", frame[:16])
    if flags & PLAIN:
        return frame[16 : 16 + size]
    blocks = -(-size // most) if size else 0
    out = []
    for k, at in enumerate(struct.unpack(f"<{blocks}I", frame[16 : 16 + 4 * blocks])):
        length = min(most, size - k * most)
        split = not flags & WHOLE and item <= 16 and length == most and length % item == 0 and length // item >= LEAST_STREAM
        streams = item if split else 1
        parts = []
        for _ in range(streams):
            (n,) = struct.unpack("<i", frame[at : at + 4])
            raw = frame[at + 4 : at + 4 + n]
            parts.append(raw if n == length // streams else _unpack(raw, length // streams, flags >> 5))
            at += 4 + n
        out.append(_unshuffle(b"".join(parts), item, flags))
    return b"".join(out)


def encode(data: bytes, item: int, name: str = "lz4", shuffle: bool = True) -> bytes:
    kind = {v: k for k, v in NAMES.items()}[name]
    flags = WHOLE | kind << 5 | (SHUFFLE if shuffle and item > 1 else 0)
    n = len(data) // item
    body = np.frombuffer(data, np.uint8, n * item).reshape(n, item).T.tobytes() + data[n * item :] if flags & SHUFFLE else data
    packed = zlib.compress(body, 5) if name == "zlib" else _codec(name).compress(body, asbytes=True)
    if not data or len(packed) + 24 >= len(data) + 16:
        return struct.pack("<BBBBIII", 2, 1, flags & ~SHUFFLE | PLAIN, item, len(data), max(len(data), 1), len(data) + 16) + data
    return struct.pack("<BBBBIII", 2, 1, flags, item, len(data), len(data), len(packed) + 24) + struct.pack("<Ii", 20, len(packed)) + packed
