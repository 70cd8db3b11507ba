"""Byte-pair merging of many words at once, in numpy.

Words of similar length form a matrix of symbols. In every round each word merges its best adjacent pair (the
lowest rank, then the leftmost), exactly as one agenda per word would. A keyed hash can drop candidate merges;
a candidate is named by its word's key and its three borders, so the outcome doesn't depend on the order of work.
"""

from __future__ import annotations

import heapq

import numpy as np

from ._words import U64, mix

NONE = np.int32(2**31 - 1)
LONG = 96  # longer words go through a heap, one by one


class Merges:
    """A table of (left id, right id) -> (rank, merged id)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        order = np.lexsort((rank, key))
        key, rank, merged = key[order], rank[order], merged[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        self.key, self.rank, self.merged = key[first], rank[first].astype(np.int32), merged[first].astype(np.int32)
        size = 1 << (4 * len(self.key)).bit_length()
        self.mask, self.slot = size - 1, np.full(size, -1, np.int32)
        at = self._hash(self.key)
        left_over = np.arange(len(self.key))
        while len(left_over):  # open addressing, all keys at once
            free = self.slot[at] < 0
            self.slot[at[free]] = left_over[free]
            lost = self.slot[at] != left_over
            left_over, at = left_over[lost], (at[lost] + 1) & self.mask
        self.table = {int(k): (int(r), int(m)) for k, r, m in zip(self.key, self.rank, self.merged)}

    def _hash(self, key: np.ndarray) -> np.ndarray:
        h = key.astype(U64) * U64(0x9E3779B97F4A7C15)
        return (h >> U64(32)).astype(np.int64) & self.mask

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of pairs; rank is NONE where there is no merge."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        shape, key = key.shape, key.ravel()
        at = self._hash(key)
        found = self.slot[at]
        todo = np.flatnonzero((found >= 0) & (self.key[found] != key))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found[todo] = self.slot[at[todo]]
            todo = todo[(found[todo] >= 0) & (self.key[found[todo]] != key[todo])]
        hit = (found >= 0) & (left.ravel() >= 0) & (right.ravel() >= 0)
        return np.where(hit, self.rank[found], NONE).reshape(shape), np.where(hit, self.merged[found], -1).reshape(shape)


def _dropped(key: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, bar: int) -> np.ndarray:
    h = key + a.astype(U64) * U64(0x9E3779B97F4A7C15) + b.astype(U64) * U64(0xC2B2AE3D27D4EB4F) + c.astype(U64) * U64(0x165667B19E3779F9)
    return mix(h) < U64(bar)


def merge_all(flat: np.ndarray, offs: np.ndarray, merges: Merges, keys: np.ndarray | None = None, drop: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Merge words of symbol ids, laid one after another: (ids, offsets).

    Id -1 never merges. ``keys``: a 64-bit key per word; with them a candidate merge is dropped with chance ``drop``.
    """
    lengths = np.diff(offs)
    out, size = flat.astype(np.int32), lengths.copy()
    bar = min(int(drop * 2.0**64), 2**64 - 1) if keys is not None else 0
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    at = int(np.searchsorted(ordered, 1, "right"))
    while at < len(order) and ordered[at] <= LONG:
        to = int(np.searchsorted(ordered, ordered[at] + max(1, ordered[at] // 4), "right"))
        to = min(to, at + 20_000)
        _group(order[at:to], flat, offs, merges, keys, bar, out, size)
        at = to
    for k in order[at:]:
        ids = _one(flat[offs[k] : offs[k + 1]], merges, None if keys is None else int(keys[k]), bar)
        out[offs[k] : offs[k] + len(ids)] = ids
        size[k] = len(ids)
    inside = np.arange(len(flat)) - np.repeat(offs[:-1], lengths)
    return out[inside < np.repeat(size, lengths)], np.concatenate([[0], np.cumsum(size)])


def _group(which: np.ndarray, flat: np.ndarray, offs: np.ndarray, merges: Merges, keys: np.ndarray | None, bar: int, out: np.ndarray, sizes: np.ndarray) -> None:
    total = (offs[which + 1] - offs[which]).astype(np.int32)
    width, n = int(total.max()), len(which)
    size = total.copy()
    inside = np.arange(width) < size[:, None]
    sym = np.full((n, width), -1, np.int32)
    sym[inside] = flat[(offs[which][:, None] + np.arange(width))[inside]]
    key = keys[which] if keys is not None else None
    pos = np.where(inside, np.arange(width, dtype=np.int32), total[:, None]) if bar else None
    rank, made = merges.look(sym[:, :-1], sym[:, 1:])
    rank[~inside[:, 1:]] = NONE
    if bar:
        end = np.concatenate([pos[:, 2:], total[:, None]], 1)
        rank[_dropped(key[:, None], pos[:, :-1], pos[:, 1:], end, bar)] = NONE
    live = np.arange(n)

    def done(rows: np.ndarray) -> None:
        m = size[rows]
        inner = np.arange(sym.shape[1]) < m[:, None]
        word = which[live[rows]]
        out[(offs[word][:, None] + np.arange(sym.shape[1]))[inner]] = sym[rows][inner]
        sizes[word] = m

    while True:
        m = sym.shape[1]
        if m < 2:
            return done(np.arange(len(live)))
        j = rank.argmin(1)
        go = rank[np.arange(len(live)), j] != NONE
        if not go.all():
            done(np.flatnonzero(~go))
            keep = np.flatnonzero(go)
            if not len(keep):
                return None
            m = int(size[keep].max())
            live, sym, rank, made, size, j = live[keep], sym[keep, :m], rank[keep, : m - 1], made[keep, : m - 1], size[keep], j[keep]
            pos = pos[keep, :m] if bar else None
        r = np.arange(len(live))
        sym[r, j] = made[r, j]
        src = np.arange(m - 1)
        src = src + (src > j[:, None])
        sym = np.take_along_axis(sym, src, 1)
        size -= 1
        if bar:
            pos = np.take_along_axis(pos, src, 1)
        if m < 3:
            continue
        src = np.arange(m - 2)
        src = src + (src >= j[:, None])
        rank, made = np.take_along_axis(rank, src, 1), np.take_along_axis(made, src, 1)
        for left in (j - 1, j):
            ok = np.flatnonzero((left >= 0) & (left + 1 < size))
            at = left[ok]
            new_rank, new_made = merges.look(sym[ok, at], sym[ok, at + 1])
            if bar:
                stop = np.where(at + 2 < size[ok], pos[ok, np.minimum(at + 2, m - 2)], total[live[ok]])
                new_rank = np.where(_dropped(key[live[ok]], pos[ok, at], pos[ok, at + 1], stop, bar), NONE, new_rank)
            rank[ok, at], made[ok, at] = new_rank, new_made


def _one(word: np.ndarray, merges: Merges, key: int | None, bar: int) -> np.ndarray:
    """One long word through a heap agenda."""
    n = len(word)
    sym, nxt, prv, alive = word.tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list = []

    def offer(a: int) -> None:
        b = nxt[a]
        if b >= n or sym[a] < 0 or sym[b] < 0:
            return
        found = merges.table.get((sym[a] << 32) | sym[b])
        if found is None:
            return
        if bar and key is not None and bool(_dropped(np.array([key], U64), *(np.array([x]) for x in (a, b, nxt[b])), bar)[0]):
            return
        heapq.heappush(heap, (found[0], a, b, nxt[b], sym[a], sym[b], found[1]))

    for a in range(n - 1):
        offer(a)
    while heap:
        _, a, b, c, x, y, m = heapq.heappop(heap)
        if not alive[a] or b >= n or not alive[b] or nxt[a] != b or nxt[b] != c or sym[a] != x or sym[b] != y:
            continue
        sym[a], alive[b], nxt[a] = m, False, c
        if c < n:
            prv[c] = a
        if prv[a] >= 0:
            offer(prv[a])
        offer(a)
    return np.array([s for s, a in zip(sym, alive) if a], np.int32)
