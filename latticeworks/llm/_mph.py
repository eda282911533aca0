"""A minimal perfect hash over 64-bit keys, built and asked in whole arrays.

Keys are hashed into a bit table twice their number; keys alone in their place stay there, the others go on to the next
table.  A key's number is the rank of its bit over all tables.  About 4 bits a key.
"""

from __future__ import annotations

import numpy as np

from ._text import mix

ROUNDS = 40


class MinimalPerfectHash:
    def __init__(self, tables: list[np.ndarray]):
        self.tables = tables
        sums = [np.concatenate([[0], np.cumsum(t, dtype=np.int64)]) for t in tables]
        before = np.cumsum([0, *(int(s[-1]) for s in sums)])
        self.ranks = [s[:-1] + b for s, b in zip(sums, before)]
        self.size = int(before[-1])

    @staticmethod
    def _place(keys: np.ndarray, level: int, n: int) -> np.ndarray:
        return (mix(keys ^ mix(np.array([level + 1], np.uint64))) % np.uint64(n)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        """keys: distinct uint64 values."""
        tables: list[np.ndarray] = []
        left = keys
        while len(left):
            if len(tables) == ROUNDS:
                raise ValueError("keys are not distinct")
            n = max(8, 2 * len(left))
            at = cls._place(left, len(tables), n)
            count = np.bincount(at, minlength=n)
            tables.append((count == 1).astype(np.uint8))
            left = left[count[at] > 1]
        return cls(tables)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1 (a key that was not built in may get any number)."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (t, r) in enumerate(zip(self.tables, self.ranks)):
            if not len(left):
                break
            at = self._place(keys[left], level, len(t))
            hit = t[at] == 1
            out[left[hit]] = r[at[hit]]
            left = left[~hit]
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.tables), *map(len, self.tables)], "<u8").tobytes()
        return head + b"".join(np.packbits(t).tobytes() for t in self.tables)

    @classmethod
    def load(cls, raw: bytes) -> MinimalPerfectHash:
        n = int(np.frombuffer(raw, "<u8", 1)[0])
        sizes = np.frombuffer(raw, "<u8", n, 8).astype(int).tolist()
        at, tables = 8 * (n + 1), []
        for s in sizes:
            k = (s + 7) // 8
            tables.append(np.unpackbits(np.frombuffer(raw, np.uint8, k, at), count=s))
            at += k
        return cls(tables)
