"""A table from 64-bit hashes to their numbers, for whole arrays at once."""

from __future__ import annotations

import numpy as np


class HashIndex:
    """The place of each of some distinct hashes. Hashes are sorted and parted by their leading bits, about one to four parts."""

    def __init__(self, hashes: np.ndarray):
        self.place = np.argsort(hashes)
        self.sorted = hashes[self.place]
        bits = max(1, int(len(hashes)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        parts = (self.sorted >> self.shift).astype(np.int64)
        self.start = np.searchsorted(parts, np.arange((1 << bits) + 1))
        self.deepest = int(np.diff(self.start).max(initial=0))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 for others."""
        out = np.full(len(hashes), -1, np.int64)
        part = (hashes >> self.shift).astype(np.int64)
        at, end = self.start[part], self.start[part + 1]
        left = np.flatnonzero(at < end)
        for _ in range(self.deepest):
            if not len(left):
                break
            same = self.sorted[at[left]] == hashes[left]
            out[left[same]] = self.place[at[left[same]]]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out
