"""An open-addressing table of 64-bit keys whose lookups are whole-array numpy passes."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class Interner:
    """Numbers distinct non-zero keys 0, 1, 2, ... in order of arrival."""

    def __init__(self, bits: int = 16):
        self._reset(bits)
        self.size = 0

    def _reset(self, bits: int) -> None:
        self.bits, self.shift, self.mask = bits, U64(64 - bits), (1 << bits) - 1
        self.keys, self.numbers = np.zeros(1 << bits, U64), np.full(1 << bits, -1, np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 where it is unknown."""
        out = np.full(len(keys), -1, np.int64)
        left, slot, want = None, self._slots(keys), keys
        while len(want):
            there = self.keys[slot]
            hit = there == want
            where = np.flatnonzero(hit)
            out[where if left is None else left[where]] = self.numbers[slot[where]]
            go = np.flatnonzero(~hit & (there != 0))
            left = go if left is None else left[go]
            slot, want = (slot[go] + 1) & self.mask, want[go]
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Numbers given to distinct keys that the table lacks."""
        if (self.size + len(keys)) * 2 > len(self.keys):
            old, numbers = self.keys[self.keys != 0], self.numbers[self.keys != 0]
            bits = self.bits
            while (self.size + len(keys)) * 2 > 1 << bits:
                bits += 1
            self._reset(bits)
            self._place(old, numbers)
        numbers = np.arange(self.size, self.size + len(keys), dtype=np.int64)
        self._place(keys, numbers)
        self.size += len(keys)
        return numbers

    def _place(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            won = self.keys[slot] == keys
            self.numbers[slot[won]] = numbers[won]
            keys, numbers, slot = keys[~won], numbers[~won], (slot[~won] + 1) & self.mask
