"""Polynomial hashes of byte strings, whole buffers at a time.

``prefix[i]`` sums the letters before ``i``, letter ``j`` times base^-j, modulo 2^64. A
substring's hash is a difference of two entries times a power of the base, so it depends
on the bytes alone and costs the same at any length.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
BUFFER = 1 << 19  # bytes hashed at once; the tables have as many powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    letters = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
    base = 0x5851F42D4C957F2D
    powers = np.full(2 * BUFFER, U(base))
    inverse = np.full(2 * BUFFER, U(pow(base, -1, 1 << 64)))
    powers[0] = inverse[0] = 1
    return letters, np.multiply.accumulate(powers), np.multiply.accumulate(inverse)


def prefix_sums(buffer: np.ndarray) -> np.ndarray:
    letters, _, inverse = _tables()
    sums = np.zeros(len(buffer) + 1, U)
    np.cumsum(letters[buffer] * inverse[: len(buffer)], out=sums[1:])
    return sums


def substring_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of buffer[begin:end] for arrays of places."""
    return (sums[end] - sums[begin]) * _tables()[1][begin]


def all_hashes(sums: np.ndarray, length: int) -> np.ndarray:
    """Hashes of every substring of one length."""
    n = max(0, len(sums) - length)
    return (sums[length : length + n] - sums[:n]) * _tables()[1][:n]


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if width > done else values
