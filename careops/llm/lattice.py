"""The E8 lattice: nearest points and neighbouring cells."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np

from careops.llm.textscan import mix


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled so that all coordinates are integers."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [list(s) for s in product((1, -1), repeat=8) if np.prod(s) == 1]
    return np.array(out, np.int64)


MINIMAL = minimal_vectors()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and correct the worst coordinate if the sum is odd."""
    near = np.rint(x)
    gap = x - near
    odd = np.flatnonzero(near.sum(1).astype(np.int64) & 1)
    worst = np.abs(gap[odd]).argmax(1)
    near[odd, worst] += np.where(gap[odd, worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points of (n, 8) vectors, doubled to integers: the better of D8 and D8 shifted by a half."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.rint(2 * np.where(closer[:, None], whole, half)).astype(np.int64)


def neighbours(x: np.ndarray, cells: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` cells next nearest to each vector among the 240 around its own: (n, count, 8)."""
    if not count:
        return np.zeros((len(x), 0, 8), np.int64)
    rest = x - cells / 2
    toward = rest @ (MINIMAL.T / 2.0)  # all minimal vectors have one length: nearest means largest product
    pick = np.argpartition(-toward, count - 1, axis=1)[:, :count]
    return cells[:, None, :] + MINIMAL[pick]


def cell_key(cells: np.ndarray, salt: int) -> np.ndarray:
    """64-bit keys of lattice points (last axis 8)."""
    key = np.full(cells.shape[:-1], salt, np.uint64)
    for k in range(8):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cells[..., k].astype(np.uint64))
    return key
