"""A hash table of 64-bit keys for whole arrays of questions."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """values by key (distinct signed 64-bit integers); get() answers `missing` for other keys.

    Open addressing with places that follow each other; a third of the table is filled at most.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing):
        self.bits, self.missing = max(4, (3 * len(keys)).bit_length()), missing
        size = 1 << self.bits
        self.keys, self.values, self.used = np.zeros(size, np.int64), np.full(size, missing, values.dtype), np.zeros(size, bool)
        waiting, at = np.arange(len(keys)), self._slots(keys)
        while len(waiting):
            free = np.flatnonzero(~self.used[at])
            _, first = np.unique(at[free], return_index=True)
            chosen = free[first]
            slots, rows = at[chosen], waiting[chosen]
            self.used[slots], self.keys[slots], self.values[slots] = True, keys[rows], values[rows]
            waiting, at = np.delete(waiting, chosen), (np.delete(at, chosen) + 1) & (size - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slots(keys)
        out, same = self.values[at], self.keys[at] == keys
        where = np.flatnonzero(~same & self.used[at])
        out[~same] = self.missing
        at = at[where]
        while len(where):
            at = (at + 1) & (len(self.keys) - 1)
            same = self.keys[at] == keys[where]
            there = self.used[at]
            out[where[same & there]] = self.values[at[same & there]]
            on = ~same & there
            where, at = where[on], at[on]
        return out
