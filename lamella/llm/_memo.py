"""Scores of words, remembered by fingerprint in sorted arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ._words import U64, span_hash, word_spans


class WordMemo:
    """Rows of ``width`` doubles by word. ``make(data, start, end)`` computes rows for spans not seen before.

    At most ``most`` words are remembered; further ones are computed again where they occur.
    """

    def __init__(self, width: int, make: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], most: int = 400_000):
        self.keys, self.rows, self.make, self.most = np.zeros(0, U64), np.zeros((0, width)), make, most

    def slab(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of the slab's different words, which of them each word is, which text each word is in)."""
        start, end, text = word_spans(data, offs)
        keys, first, which = np.unique(span_hash(data, start, end), return_index=True, return_inverse=True)
        out = np.empty((len(keys), self.rows.shape[1]))
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        out[known] = self.rows[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = self.make(data, start[first[new]], end[first[new]])
            if len(self.keys) + len(new) <= self.most:
                keys_all = np.concatenate([self.keys, keys[new]])
                order = np.argsort(keys_all, kind="stable")
                self.keys, self.rows = keys_all[order], np.concatenate([self.rows, out[new]])[order]
        return out, which, text


def padded(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: bytes, after: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Spans copied one after another, each between ``before`` and ``after``: (bytes, offsets)."""
    n = end - start
    a, b = len(before), len(after)
    offs = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n + a + b, out=offs[1:])
    out = np.empty(offs[-1], np.uint8)
    for k in range(a):
        out[offs[:-1] + k] = before[k]
    for k in range(b):
        out[offs[1:] - b + k] = after[k]
    shift = np.repeat(offs[:-1] + a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else np.zeros(0, np.int64)
    inner = np.arange(int(n.sum())) + shift
    src = np.arange(int(n.sum())) + np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else np.zeros(0, np.int64)
    out[inner] = data[src]
    return out, offs
