"""Vectorised scans over the bytes of many texts at once (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np

_U = np.uint64

# Word separators: space and \t \n \v \f \r.
_NONSPACE = np.ones(256, bool)
_NONSPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of each text's first word (length texts + 1)."""
    inside = _NONSPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    lens = np.diff(offsets)
    begin, end = offsets[:-1][lens > 0], offsets[1:][lens > 0] - 1
    first[begin] = inside[begin]
    last[end] = inside[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Rolling:
    """Polynomial hashes modulo 2^64 of any spans of a byte buffer.

    With an odd base the powers have inverses, so the hash of a span is a
    difference of two prefix sums times one inverse power.
    """

    _tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int = 0x9E3779B97F4A7C15):
        n = len(data) + 1
        power, inverse = self._powers(base, n)
        self.inverse = inverse
        self.prefix = np.zeros(n, _U)
        np.cumsum((data.astype(_U) + _U(1)) * power[:n - 1], out=self.prefix[1:])

    @classmethod
    def _powers(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        got = cls._tables.get(base)
        if got is None or len(got[0]) < n:
            size = max(n, 1 << 16)
            got = tuple(
                np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(size - 1, b, _U)]))
                for b in (base, pow(base, -1, 1 << 64))
            )
            if size <= 1 << 23:
                cls._tables[base] = got
        return got

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.prefix[ends] - self.prefix[starts]) * self.inverse[starts]
        return mix(raw ^ ((ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93)))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all spans of ``k`` bytes."""
        n = len(self.prefix) - k
        if n <= 0:
            return np.zeros(0, _U)
        return mix((self.prefix[k:] - self.prefix[:n]) * self.inverse[:n])
