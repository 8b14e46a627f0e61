"""A vectorised open-addressing hash table for numpy arrays."""

from __future__ import annotations

import numpy as np


class HashTable:
    """Distinct 64-bit keys to 32-bit values; a quarter of the slots are taken at most."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.zeros(1 << self.bits, dtype=np.int64)
        self.used = np.zeros(1 << self.bits, dtype=bool)
        self.values = np.zeros(1 << self.bits, dtype=np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(~self.used[slot])
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]  # one key for each free slot
            at = slot[put]
            self.keys[at], self.values[at], self.used[at] = keys[put], values[put], True
            left = np.ones(len(keys), dtype=bool)
            left[put] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray, default: int) -> np.ndarray:
        """The value of each key (int64), ``default`` where there is none."""
        shape = keys.shape
        keys = np.ascontiguousarray(keys).ravel()
        slot = self._slot(keys)
        used = self.used[slot]
        same = (self.keys[slot] == keys) & used
        out = np.where(same, self.values[slot], np.int32(default))
        on = np.flatnonzero(used & ~same)
        while len(on):
            slot[on] = (slot[on] + 1) & self.mask
            used = self.used[slot[on]]
            hit = used & (self.keys[slot[on]] == keys[on])
            out[on[hit]] = self.values[slot[on[hit]]]
            on = on[used & ~hit]
        return out.reshape(shape)
