"""An open-addressing hash table in numpy: built once, looked up for whole arrays of 64-bit keys."""

from __future__ import annotations

import numpy as np

from .kernels import mix


class HashTable:
    """Distinct uint64 ``keys`` to int64 ``values``; at most a quarter of the slots is taken."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1)))) + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int64)
        keys, values = keys.astype(np.uint64), values.astype(np.int64)
        slot = self._home(keys)
        left = np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self.values[at] < 0
            first = np.zeros(len(left), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = left[free & first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = left[~(free & first)]
            slot[left] = (slot[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray, missing: int) -> np.ndarray:
        """The value of each key, ``missing`` where there is none."""
        slot = self._home(keys)
        value, held = self.values[slot], self.keys[slot]
        out = np.where((held == keys) & (value >= 0), value, missing)
        left = np.flatnonzero((held != keys) & (value >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            value, held = self.values[slot[left]], self.keys[slot[left]]
            hit = (value >= 0) & (held == keys[left])
            out[left[hit]] = value[hit]
            left = left[(value >= 0) & ~hit]
        return out
