"""Vectorised hashes over whole slices of text.

``Rolling`` gives the hash of any byte range in constant time from prefix sums
of ``byte * base**position`` modulo 2**64: the range sum is divided by
``base**start`` (the base is odd, so it has an inverse).
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15
#: The bytes that separate words.
SPACES = bytes([32, *range(9, 14)])


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (finalising steps of a multiplicative hash)."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def powers(n: int, base: int = BASE, known: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """base**i and base**-i modulo 2**64 for i up to n; kept for the life of the task."""
    if base not in known or len(known[base][0]) <= n:
        size = max(n + 1, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        known[base] = tuple(np.cumprod(np.concatenate([[U(1)], np.full(size, U(b), U)]), dtype=U) for b in (base, inverse))
    return known[base]


class Rolling:
    """Hashes of ranges of a sequence of bytes or of 64-bit values."""

    def __init__(self, values: np.ndarray, base: int = BASE):
        n = len(values)
        self.power, self.inverse = powers(n, base)
        self.sums = np.zeros(n + 1, U)
        np.cumsum((values.astype(U) + U(1)) * self.power[:n], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def windows(self, size: int) -> np.ndarray:
        """Hash of every window of ``size`` values."""
        n = max(len(self.sums) - size, 0)
        return mix((self.sums[size:size + n] - self.sums[:n]) * self.inverse[:n])


def word_table(keep: bytes | None = None) -> np.ndarray:
    """Which bytes belong to words: all but spaces, or those given."""
    t = np.zeros(256, bool) if keep is not None else np.ones(256, bool)
    t[list(keep if keep is not None else SPACES)] = keep is not None
    return t


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def runs(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of a mask; a run ends with its row (rows begin at ``at[:-1]``)."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = at[:-1][at[:-1] < len(mask)]
    start = mask.copy()
    start[1:] &= ~mask[:-1]
    start[first] = mask[first]
    last = at[1:][at[1:] > 0] - 1
    end = mask.copy()
    end[:-1] &= ~mask[1:]
    end[last] = mask[last]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def winnow(h: np.ndarray, at: np.ndarray, gram: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Local minima: for every window of ``size`` units of a row, its gram with the smallest hash (the last such).

    ``h``: hash of every gram of ``gram`` units; ``at``: bounds of the rows in
    units.  Returns the chosen grams, each once, with the first and the last window
    start that chose it.  Equal windows choose the same place, wherever they are.
    """
    width = size - gram + 1
    n = len(h) - width + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3
    low = U(2**31 - 1)
    least = (h & ~low) | (low - np.arange(len(h), dtype=U))
    reach = 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[:n], least[width - reach:width - reach + n])
    # window starts of the rows that hold a window
    long = np.diff(at) >= size
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, at[:-1][long], 1)
    np.add.at(steps, at[1:][long] - size + 1, -1)
    start = np.flatnonzero(np.cumsum(steps)[:n] > 0)
    chosen = (low - (least[start] & low)).astype(np.int64)
    if not len(chosen):
        return (np.zeros(0, np.int64),) * 3
    new = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.concatenate([new[1:], [len(chosen)]]) - 1
    return chosen[new], start[new], start[last]


def word_hashes(data: np.ndarray, at: np.ndarray, words: np.ndarray, base: int = BASE) -> tuple[np.ndarray, ...]:
    """Words of a slice: their starts, ends, hashes, and the bounds of each row in them."""
    start, end = runs(words[data], at)
    return start, end, Rolling(data, base).ranges(start, end), np.searchsorted(start, at)
