"""Vectorised byte kernels: substring hashes by prefix sums, words, lines, word windows."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: An odd multiplier has an inverse modulo 2**64, so any substring's hash is a difference of prefix sums times an inverse power. Long strings
#: over two letters can be made to collide, so users confirm equal hashes on bytes where equality counts.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        steps = np.full(size, U(base))
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a hash depend on all bits of its input."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(29))
    h = h * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


class Hashes:
    """Hashes of substrings [start, end) of a byte array (or an array of 64-bit values)."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, U)
        np.cumsum((values.astype(U) + U(1)) * _power(BASE, n), out=self.sums[1:])
        self.back = _power(INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(U))


def equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Whether data[a : a + size] is data[b : b + size], for each a, b and size: hashes that are equal are confirmed by this."""
    out = np.ones(len(size), bool)
    long = np.flatnonzero(size > block)
    for k in long:
        out[k] = np.array_equal(data[a[k] : a[k] + size[k]], data[b[k] : b[k] + size[k]])
    short = np.flatnonzero(size <= block)
    total = np.cumsum(size[short])
    lo = 0
    while lo < len(short):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + block, side="right")))
        own = short[lo:hi]
        n = size[own]
        row = np.repeat(np.arange(len(own)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        out[own[row[data[a[own][row] + nth] != data[b[own][row] + nth]]]] = False
        lo = hi
    return out


def blank(data: np.ndarray) -> np.ndarray:
    """Which bytes part words: space and 9 to 13."""
    return (data == 32) | ((data - np.uint8(9)) < 5)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that do not cross rows, and the first run of each row (and their number)."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    start[edge] = inside[edge]
    end[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(~blank(data), offsets)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return data + ((data - np.uint8(65)) < 26).astype(np.uint8) * np.uint8(32)


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each n consecutive values that stay in one row, and the first of each row. first: of each row's values, and their number."""
    if n == 1:
        return h, first
    size = np.maximum(np.diff(first) - n + 1, 0)
    row = np.repeat(np.arange(len(size)), size)
    at = np.concatenate([[0], np.cumsum(size)])
    start = np.arange(at[-1]) - at[row] + first[row]
    out = np.full(len(start), U(n))
    for k in range(n):
        out = mix(out * U(0x2545F4914F6CDD1D) + h[start + k])
    return out, at


def starts(size: int, of: np.ndarray) -> np.ndarray:
    """For each of `size` sorted row numbers, where each row begins."""
    return np.searchsorted(of, np.arange(size + 1))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums by row, 0 for empty rows."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]
