"""Recompression of token sequences: rounds that name runs and pairs alike wherever they stand.

A name is a 64-bit hash of what it stands for, so every task gives equal parts equal names without asking
the others. A round names each pair of neighbours (a, b) with a in the left and b in the right half of the
alphabet; a hash of symbol and round halves the alphabet. Before the pairs of the last round, each maximal run of one
symbol gets a name; in earlier rounds that would widen the stretches that fix a symbol, and equal symbols never pair up.
Whether two symbols pair up depends on them alone, so the parse of a passage depends on its inside, but for a few
symbols at either end. Each symbol carries ``left`` and ``right``: the stretch of tokens that fixes it. Any two
equal stretches of tokens that include this one hold the same symbol at the same place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import mixed

ROUNDS = 4
_FAR = np.int64(1 << 40)


@dataclass
class Symbols:
    name: np.ndarray
    text: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def of(self, rows: np.ndarray) -> Symbols:
        return Symbols(self.name[rows], self.text[rows], self.left[rows], self.right[rows])


def _runs(s: Symbols, level: int) -> Symbols:
    n = len(s.name)
    new = np.concatenate([[True], (s.name[1:] != s.name[:-1]) | (s.text[1:] != s.text[:-1])])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, n))
    left, right = np.minimum.reduceat(s.left, first), np.maximum.reduceat(s.right, first)
    name = s.name[first]
    name = np.where(count > 1, mixed(name + count.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(level)), name)
    text = s.text[first]
    # that a run ends here shows only to who sees the symbols beside it
    before, after = np.maximum(first - 1, 0), np.minimum(first + count, n - 1)
    no_before = np.concatenate([[True], text[1:] != text[:-1]])
    no_after = np.concatenate([text[1:] != text[:-1], [True]])
    left = np.where(no_before, -_FAR, np.minimum(left, s.left[before]))
    left = np.where(no_after, left, np.minimum(left, s.left[after]))
    right = np.where(no_after, _FAR, np.maximum(right, s.right[after]))
    right = np.where(no_before, right, np.maximum(right, s.right[before]))
    return Symbols(name, text, left, right)


def _pairs(s: Symbols, level: int) -> Symbols:
    n = len(s.name)
    is_left = mixed(s.name ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1)) >> np.uint64(63) == 0
    same = s.text[1:] == s.text[:-1]
    opens = np.zeros(n, bool)
    opens[:-1] = is_left[:-1] & ~is_left[1:] & same
    closes = np.zeros(n, bool)
    closes[1:] = opens[:-1]
    left, right, name = s.left.copy(), s.right.copy(), s.name.copy()
    i = np.flatnonzero(opens)
    left[i] = np.minimum(s.left[i], s.left[i + 1])
    right[i] = np.maximum(s.right[i], s.right[i + 1])
    name[i] = mixed(s.name[i] * np.uint64(0x9FB21C651E98DF25) + s.name[i + 1] + np.uint64(level))
    # an unpaired symbol shows as such only beside the neighbour that it could have paired with
    has_after, has_before = np.append(same, False), np.concatenate([[False], same])
    lone = ~opens & ~closes
    j = np.flatnonzero(lone & is_left & has_after)
    left[j], right[j] = np.minimum(s.left[j], s.left[j + 1]), np.maximum(s.right[j], s.right[j + 1])
    right[lone & is_left & ~has_after] = _FAR
    j = np.flatnonzero(lone & ~is_left & has_before)
    left[j], right[j] = np.minimum(s.left[j], s.left[j - 1]), np.maximum(s.right[j], s.right[j - 1])
    left[lone & ~is_left & ~has_before] = -_FAR
    return Symbols(name, s.text, left, right).of(~closes)


def anchors(tokens: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of ``width`` tokens the highest symbol that they fix, of several the one with the least name.

    ``text`` numbers the texts that the tokens are of, in order. Returns names, and ordinals that grow by one
    with each further symbol in use; starts whose stretch leaves its text have undefined values. Equal
    stretches have equal names.
    """
    n = len(tokens)
    at = np.arange(n, dtype=np.int64)
    level_of, name_of, left_of = np.zeros(n, np.int64), tokens.copy(), at.copy()
    s = Symbols(tokens, text, at, at + 1)
    for level in range(1, ROUNDS + 1):
        if not n:
            break
        s = _pairs(_runs(s, level) if level == ROUNDS else s, level)
        fits = np.flatnonzero(s.right - s.left <= width)
        if not len(fits):
            break
        f = s.of(fits)
        begin = np.maximum(f.right - width, 0)
        times = f.left - begin + 1
        order = np.argsort(f.name, kind="stable")[::-1]
        rows, times = np.repeat(order, times[order]), times[order]
        place = begin[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
        # of several writes to a place the last one, the symbol with the least name, stays
        level_of[place], name_of[place], left_of[place] = level, f.name[rows], f.left[rows]
    name = mixed(name_of + level_of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if not n:
        return name, at
    new = np.concatenate([[True], (name[1:] != name[:-1]) | (left_of[1:] != left_of[:-1]) | (text[1:] != text[:-1])])
    return name, np.cumsum(new) - 1
