"""A minimal perfect hash over 32-byte digests, built and queried with numpy.

Level l holds a bit array of ``GAMMA`` times the keys that are left. A key whose position in it is no
other key's sets its bit and is done; the others go on to level l + 1. A key's slot is the number of
bits set before its own over all levels, so n keys fill exactly the slots 0..n-1.
"""

from __future__ import annotations

import numpy as np

GAMMA = 2
#: Keys that are left after so many levels are found by binary search; in practice none are.
LEVELS = 48


def _halves(digests: np.ndarray) -> np.ndarray:
    """Four 64-bit words of each 32-byte digest."""
    return np.ascontiguousarray(digests).view("<u8").reshape(len(digests), 4)


def _position(words: np.ndarray, level: int, bits: int) -> np.ndarray:
    h = words[:, level % 4] + np.uint64(2 * level + 1) * words[:, (level // 4 + level + 1) % 4]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))) % np.uint64(bits)


class PerfectHash:
    """``slot_of(digests)`` gives 0..n-1 for the keys it was built from, and any slot or -1 for others."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks, at = [], 0
        for bits in levels:
            self.ranks.append(at + np.concatenate([[0], np.cumsum(bits, dtype=np.int64)]))
            at += int(bits.sum())
        self.placed = at

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        """``digests``: distinct values of dtype S32/V32."""
        left, levels = _halves(digests), []
        while len(left) and len(levels) < LEVELS:
            bits = max(8, GAMMA * len(left))
            at = _position(left, len(levels), bits)
            alone = np.bincount(at.astype(np.int64), minlength=bits) == 1
            levels.append(alone)
            left = left[~alone[at]]
        order = np.lexsort(left.T[::-1])
        return cls(levels, left[order])

    def slot_of(self, digests: np.ndarray) -> np.ndarray:
        words = _halves(digests)
        slots, open_ = np.full(len(words), -1, np.int64), np.arange(len(words))
        for level, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = _position(words[open_], level, len(bits))
            hit = bits[at]
            slots[open_[hit]] = self.ranks[level][at[hit]]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            known = {tuple(k): self.placed + i for i, k in enumerate(self.rest.tolist())}
            slots[open_] = [known.get(tuple(k), -1) for k in words[open_].tolist()]
        return slots

    def packed(self) -> list[np.ndarray]:
        sizes = np.array([len(b) for b in self.levels], np.int64)
        flat = np.packbits(np.concatenate(self.levels)) if self.levels else np.empty(0, np.uint8)
        return [sizes, flat, self.rest.ravel()]

    @classmethod
    def unpacked(cls, sizes: np.ndarray, flat: np.ndarray, rest: np.ndarray) -> PerfectHash:
        bits, ends = np.unpackbits(flat).astype(bool), np.cumsum(sizes)
        return cls([bits[e - n : e] for e, n in zip(ends, sizes, strict=True)], rest.reshape(-1, 4))
