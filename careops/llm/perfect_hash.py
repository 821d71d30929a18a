"""A minimal perfect hash of a set of byte strings, built and probed with numpy.

Level by level, the keys that are left are hashed to a bit array of about
twice their number; a key alone at its bit is settled there and the others
go to the next level.  A key's slot is the number of set bits before its own
over all levels, so n keys have the slots 0..n-1.  The keys themselves are
stored in slot order: a probe compares them, so strangers get no slot.
Keys that 64 bits of hash cannot tell apart come last and are found by their
stored bytes alone.
"""

from __future__ import annotations

import struct

import numpy as np

from careops.llm.textscan import mix

_U = np.uint64
SPREAD = 2  # bits of a level for each key that is left
LEVELS = 48


def _bit(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(hashes ^ _U((level * 0x9E3779B97F4A7C15) % (1 << 64))) % _U(size)).astype(np.int64)


class PerfectHash:
    def __init__(self, levels: list[np.ndarray], keys: list[bytes], tail: int):
        """``levels``: boolean arrays; ``keys`` in slot order, the last ``tail`` of them outside the levels."""
        self.levels, self.keys, self.tail = levels, keys, tail
        before = 0
        self.ranks = []
        for bits in levels:
            up = np.cumsum(bits, dtype=np.int64)
            self.ranks.append(up - bits + before)
            before += int(up[-1]) if len(up) else 0

    @classmethod
    def build(cls, keys: list[bytes], hashes: np.ndarray) -> PerfectHash:
        """Of different keys with their 64-bit hashes."""
        left = np.arange(len(keys))
        levels, order = [], []
        while len(left) and len(levels) < LEVELS:
            size = SPREAD * len(left)
            at = _bit(hashes[left], len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            settled = alone[at]
            order.append(left[settled][np.argsort(at[settled])])
            levels.append(alone)
            left = left[~settled]
        slots = np.concatenate([*order, left]) if len(keys) else np.zeros(0, np.int64)
        return cls(levels, [keys[i] for i in slots.tolist()], len(left))

    def __len__(self) -> int:
        return len(self.keys)

    def slots(self, keys: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for one that is not stored."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = _bit(hashes[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = self.ranks[level][at[hit]]
            left = left[~hit]
        stored = self.keys
        if self.tail:
            rest = {k: len(stored) - self.tail + i for i, k in enumerate(stored[-self.tail:])}
            for i in left.tolist():
                out[i] = rest.get(keys[i], -1)
        for i, s in enumerate(out.tolist()):
            if s >= 0 and stored[s] != keys[i]:
                # A key of the tail may share every bit with a settled one.
                out[i] = rest.get(keys[i], -1) if self.tail else -1
        return out

    def dump(self) -> bytes:
        sizes = np.fromiter(map(len, self.keys), np.int64, len(self.keys)).astype("<u4")
        head = struct.pack("<III", len(self.keys), self.tail, len(self.levels))
        bits = b"".join(struct.pack("<I", len(b)) + np.packbits(b).tobytes() for b in self.levels)
        return b"".join([head, bits, sizes.tobytes(), *self.keys])

    @classmethod
    def load(cls, body: bytes) -> PerfectHash:
        n, tail, count = struct.unpack_from("<III", body)
        at, levels = 12, []
        for _ in range(count):
            size, = struct.unpack_from("<I", body, at)
            packed = np.frombuffer(body, np.uint8, -(-size // 8), at + 4)
            levels.append(np.unpackbits(packed, count=size).astype(bool))
            at += 4 + len(packed)
        ends = at + 4 * n + np.cumsum(np.frombuffer(body, "<u4", n, at).astype(np.int64))
        starts = [at + 4 * n, *ends.tolist()]
        return cls(levels, [body[a:b] for a, b in zip(starts, starts[1:])], tail)
