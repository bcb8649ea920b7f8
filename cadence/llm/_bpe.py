"""Merge-type vocabularies: an agenda of adjacent symbol pairs, best first and leftmost among equals.

Short strings are merged side by side as rows of a matrix, one merge per row and round; long ones
go through a heap with links to the neighbours. Both take the same merges in the same order.
"""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.int32(2**31 - 1)
#: Rows merged side by side, and symbols of the longest string that is.
ROWS, LONG = 65536, 48


class PairAgenda:
    """Pairs (left symbol, right symbol) with a rank (lower merges first) and the symbol they become."""

    def __init__(self, left, right, rank, merged):
        key = (np.asarray(left, np.int64) << 32) | np.asarray(right, np.int64)
        self.rank, self.merged = np.append(np.asarray(rank, np.int32), NONE), np.append(np.asarray(merged, np.int32), np.int32(-1))
        self.bits = max(10, int(len(key) * 4).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.entry = np.full(1 << self.bits, len(key), np.int32)
        todo = np.arange(len(key), dtype=np.int32)
        at = self._home(key)
        while len(todo):
            free = self.slots[at[todo]] == -1
            self.slots[at[todo[free]]] = key[todo[free]]
            self.entry[at[todo[free]]] = todo[free]
            todo = todo[self.entry[at[todo]] != todo]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        self.one = {int(k): (int(r), int(m)) for k, r, m in zip(key, self.rank, self.merged)}

    def _home(self, key):
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left, right):
        """Index of each pair's entry; the last index where there is none."""
        key = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        at = self._home(key)
        out = np.full(key.shape, len(self.rank) - 1, np.int32)
        held = self.slots[at]
        hit = held == key
        out[hit] = self.entry[at[hit]]
        open_ = np.flatnonzero(~hit & (held != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            held = self.slots[at[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.entry[at[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Strings of symbols, one after another in a flat array -> what is left of each, likewise."""
        lengths = np.asarray(lengths, np.int64)
        starts = np.cumsum(lengths) - lengths
        left = lengths.copy()
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        for low, high in ((0, 1), (1, 4), (4, 8), (8, 12), (12, 20), (20, LONG)):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            for a in range(0, len(rows), ROWS):
                self._side_by_side(symbols, starts, lengths, rows[a : a + ROWS], left, kept)
        for row in np.flatnonzero(lengths > LONG):
            out = np.array(self.heap(symbols[starts[row] : starts[row] + lengths[row]].tolist()), np.int32)
            left[row] = len(out)
            kept.append((np.array([row]), out))
        ends = np.cumsum(left)
        flat = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for rows, out in kept:
            n = left[rows]
            flat[np.repeat((ends - left)[rows] - (np.cumsum(n) - n), n) + np.arange(len(out))] = out
        return flat, left

    def _side_by_side(self, symbols, starts, lengths, rows, left, kept):
        width = int(lengths[rows].max())
        where = starts[rows, None] + np.arange(width)
        inside = np.arange(width) < lengths[rows, None]
        s = np.where(inside, symbols[np.minimum(where, len(symbols) - 1)], -1).astype(np.int32)
        if width > 1:
            rank = np.full((len(rows), width - 1), NONE, np.int32)
            both = inside[:, 1:]
            rank[both] = self.rank[self.find(s[:, :-1][both], s[:, 1:][both])]
        while True:
            if s.shape[1] > 1:
                at = rank.argmin(1)
                go = rank[np.arange(len(rows)), at] != NONE
            else:
                go = np.zeros(len(rows), bool)
            if not go.all():
                done = s[~go]
                full = done >= 0
                left[rows[~go]] = full.sum(1)
                kept.append((rows[~go], done[full]))
                rows, s = rows[go], s[go]
                if not len(rows):
                    return
                rank, at = rank[go], at[go]
            n = np.arange(len(rows))
            s[n, at] = self.merged[self.find(s[n, at], s[n, at + 1])]
            stay = np.ones(s.shape, bool)
            stay[n, at + 1] = False
            s = s[stay].reshape(len(rows), -1)
            stay = np.ones(rank.shape, bool)
            stay[n, at] = False
            rank = rank[stay].reshape(len(rows), -1)
            for side in (at - 1, at):
                ok = np.flatnonzero((side >= 0) & (side < rank.shape[1]))
                a, b = s[ok, side[ok]], s[ok, np.minimum(side[ok] + 1, s.shape[1] - 1)]
                rank[ok, side[ok]] = np.where(b >= 0, self.rank[self.find(a, b)], NONE)

    def heap(self, symbols: list[int]) -> list[int]:
        """One string of any length: a heap of (rank, place) with links, in n log n."""
        s, n = list(symbols), len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(*self.one[k], i, s[i], s[i + 1]) for i in range(n - 1) if (k := s[i] << 32 | s[i + 1]) in self.one]
        agenda = [(r, i, a, b, m) for r, m, i, a, b in agenda]
        heapq.heapify(agenda)
        while agenda:
            _, i, a, b, new = heapq.heappop(agenda)
            j = after[i]
            if s[i] != a or j < 0 or s[j] != b:
                continue
            s[i], s[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (k := s[x] << 32 | s[y]) in self.one:
                    r, m = self.one[k]
                    heapq.heappush(agenda, (r, x, s[x], s[y], m))
        return [x for x in s if x >= 0]
