"""Words of byte buffers, and hashes of substrings, in numpy.

A word is a run of bytes without ASCII white space.
"""

from __future__ import annotations

import numpy as np

AT_ONCE = 1 << 16  # words hashed at a time: bounds memory for texts of any length
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\v\f")] = True
_RNG = np.random.default_rng(20240229)
_TABLES = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F | 1))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base modulo 2^64, and of its inverse."""
    base = int(_BASES[which])
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b & (2**64 - 1), np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


class Hasher:
    """Prefix polynomial hashes of a buffer; any substring's hash in constant time."""

    def __init__(self):
        self.size = 0

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 2 * self.size)
            self.pow, self.inv = zip(*(_powers(self.size + 1, i) for i in (0, 1)))

    def prefix(self, buf: np.ndarray, which: int) -> np.ndarray:
        self._grow(len(buf))
        h = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_TABLES[which][buf] * self.pow[which][: len(buf)], out=h[1:])
        return h

    def grams(self, h: np.ndarray, k: int) -> np.ndarray:
        n = len(h) - k
        return (h[k:] - h[:n]) * self.inv[0][:n]

    def of(self, h: np.ndarray, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (h[end] - h[start]) * self.inv[which][start]


def word_places(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each word of a buffer of bytes."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[buf], [True])).astype(np.int8)))
    return edge[::2], edge[1::2]


def each_word(buf: np.ndarray, start: np.ndarray, end: np.ndarray, which: int, hasher: Hasher) -> np.ndarray:
    """A hash of each word."""
    one = np.empty(len(start), np.uint64)
    for a in range(0, len(start), AT_ONCE):
        s, e = start[a : a + AT_ONCE], end[a : a + AT_ONCE]
        h = hasher.prefix(buf[s[0] : e[-1]], which)
        one[a : a + AT_ONCE] = mix(mix(hasher.of(h, which, s - s[0], e - s[0]) + (e - s).astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15))
    return one
