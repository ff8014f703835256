"""Array arithmetic shared by operators that hash stretches of bytes.

Every byte value maps to a fixed 64-bit number; the hash of a stretch is a
polynomial in an odd base modulo 2^64, taken from prefix sums, so a stretch of
any length and place costs the same.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2^64, kept for the longest n so far."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        row = np.full(n + 1, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
        row[0] = 1
        _POWERS[base] = have = np.cumprod(row, dtype=np.uint64)
    return have[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64 (xor-shift and multiply)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(29))
    x = x * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


class Stretches:
    """Hashes of stretches ``[start, stop)`` of a byte array."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * _powers(BASE, n)[:n], out=self.sums[1:])
        self.back = _powers(BASE_INVERSE, n)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """The hash of every window of ``width`` bytes, unmixed."""
        return (self.sums[width:] - self.sums[:-width]) * self.back[: len(self.sums) - width]
