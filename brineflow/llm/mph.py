"""A minimal perfect hash over 64-bit keys, built and read with numpy.

Keys fall through levels of bit arrays: on each level a key that is alone on
its position sets the bit and stops there, the others go on. A key's slot is
the number of bits set before its own, so n keys fill the slots 0 .. n-1.
A key that was never stored may get any slot or none: callers keep a
fingerprint, or the key itself, beside each slot.
"""

from __future__ import annotations

import numpy as np

MASK = (1 << 64) - 1
STEP, MUL = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Bits of a level for each key that reaches it.
SPREAD = 2


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    z = (keys + np.uint64(seed * STEP & MASK)) * np.uint64(MUL)
    z ^= z >> np.uint64(32)
    z *= np.uint64(MUL)
    return z ^ (z >> np.uint64(29))


def mix_one(key: int, seed: int) -> int:
    z = (key + seed * STEP) * MUL & MASK
    z ^= z >> 32
    z = z * MUL & MASK
    return z ^ (z >> 29)


class PerfectHash:
    def __init__(self, sizes: list[int], words: np.ndarray, before: np.ndarray):
        """sizes: bits of each level, in whole words; words: their bits in a row; before: set bits before each word."""
        self.sizes, self.words, self.before = sizes, words, before
        self.first = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64) // 64)])[:-1].tolist() if sizes else []
        self._lists: tuple | None = None

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left = np.asarray(keys, np.uint64)
        if len(np.unique(left)) != len(left):
            raise ValueError("keys repeat")
        sizes, parts = [], []
        while len(left):
            size = (len(left) * SPREAD // 64 + 1) * 64
            at = (mix(left, len(sizes) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
        words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        ones = np.bitwise_count(words).astype(np.int64)
        return cls(sizes, words, np.cumsum(ones) - ones)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for one that no level holds."""
        keys = np.asarray(keys, np.uint64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = (mix(keys[open_], level + 1) % np.uint64(size)).astype(np.int64)
            w, bit = self.first[level] + (at >> 6), (at & 63).astype(np.uint64)
            word = self.words[w]
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (self.before[w] + below)[hit]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out

    def slot(self, key: int) -> int:
        """As :meth:`slots`, for one key."""
        if self._lists is None:
            self._lists = self.words.tolist(), self.before.tolist()
        words, before = self._lists
        for level, size in enumerate(self.sizes):
            at = mix_one(key, level + 1) % size
            w, bit = self.first[level] + (at >> 6), at & 63
            if words[w] >> bit & 1:
                return before[w] + (words[w] & ((1 << bit) - 1)).bit_count()
        return -1
