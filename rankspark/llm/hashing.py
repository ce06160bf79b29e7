"""Polynomial prefix hashes of byte strings, modulo 2**64, in numpy.

P[i] is the sum of table[byte j] * BASE**j for j < i; the hash of bytes i to j is (P[j] - P[i]) * BASE**-i, so any
substring's hash takes two look-ups. BASE is odd, so its inverse exists.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
TABLE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1), kept and grown by doubling."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[int(base)] = have if size <= 1 << 23 else _powers.get(int(base), have[: 1 << 16])
    return have[:n]


def prefix(data: np.ndarray) -> np.ndarray:
    """P[0] ... P[n] of an array of bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * powers(BASE, len(data)), out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def substrings(p: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of substrings of the bytes that p was made from."""
    return (p[end] - p[begin]) * powers(INVERSE, len(p))[begin]
