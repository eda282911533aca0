"""Whole blocks of text split into pre-tokens, and each distinct pre-token encoded once.

The split is that of the public pattern of byte-level BPE (contractions, words, numbers and signs with the space before them,
white space), found from the classes of neighbouring characters in whole arrays.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable

import numpy as np

from . import _text as X
from ._repeats import fingerprint

LETTER, NUMBER, BLANK = 1, 2, 3
#: Bytes of text that are split at once.
PIECE = 1 << 19
#: Unicode's White_Space property.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    if not _classes:
        number = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((number.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)), np.uint8, 0x110000)
        table[WHITE_SPACE] = BLANK
        _classes.append(table)
    return _classes[0]


def split(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where the pre-tokens of all rows start, and the n + 1 offsets of the rows' pre-tokens."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n, kind = len(cp), classes()[cp]
    row_start = np.zeros(n + 1, bool)
    row_start[np.searchsorted(lead, off[off < len(data)])] = True
    row_start[n] = True
    start = row_start[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # A run of blanks before something else gives up its last one: a space joins what follows, another stands alone.
    last = np.flatnonzero((kind[:-1] == BLANK) & (kind[1:] != BLANK) & ~row_start[1:-1])
    start[last] = True
    start[last[cp[last] == 0x20] + 1] = False
    quote = np.flatnonzero((cp[:-1] == 0x27) & start[:-1] & (kind[1:] == LETTER) & ~row_start[1:-1])
    if len(quote):
        one = cp[quote + 1]
        two = np.where((quote + 2 < n) & ~row_start[np.minimum(quote + 2, n)], cp[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for chosen, size in ((quote[short], 2), (quote[long], 3)):
            start[chosen + 1] = False
            after = chosen + size
            start[after[after < n]] = True
    at = lead[start]
    return at, np.searchsorted(at, off)


def _same(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether size bytes of a from a_at equal those of b from b_at, for each row."""
    differ, step = np.zeros(len(size), bool), 1 << 17
    for i in range(0, len(size), step):
        n = size[i : i + step].astype(np.int64)
        k = X.ranges(n)
        unequal = a[np.repeat(a_at[i : i + step], n) + k] != b[np.repeat(b_at[i : i + step], n) + k]
        differ[i + np.repeat(np.arange(len(n)), n)[unequal]] = True
    return ~differ


class _Grown:
    """An array that grows by doubling."""

    def __init__(self, kind: type):
        self.data, self.used = np.zeros(1 << 16, kind), 0

    def add(self, x: np.ndarray) -> int:
        """Append x and return where it starts."""
        at = self.used
        while len(self.data) < at + len(x):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[at : at + len(x)] = x
        self.used = at + len(x)
        return at


class DistinctEncoder:
    """Ids of whole rows, with one call of ``encode`` for each distinct pre-token.

    encode: (list of bytes, their fingerprints) -> list of id lists.  Pre-tokens are found by fingerprint, and the bytes of
    every hit are compared, so that a fingerprint that two pre-tokens share costs time and not ids.  Wherever one of
    ``whole`` occurs in a text it is a pre-token of its own.  At most ``limit`` pre-tokens are remembered between blocks.
    """

    def __init__(self, encode: Callable[[list[bytes], np.ndarray], list], whole: list[bytes] | None = None, limit: int = 800_000):
        self.encode, self.limit = encode, limit
        self.whole = re.compile(b"|".join(map(re.escape, sorted(whole, key=len, reverse=True)))) if whole else None
        self.forget()

    def _split(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.whole is None:
            return split(data, off)
        spans = np.array([m.span() for m in self.whole.finditer(data.tobytes())], np.int64).reshape(-1, 2)
        # A match that runs over the end of a row isn't in a text.
        spans = spans[np.searchsorted(off, spans[:, 0], "right") == np.searchsorted(off, spans[:, 1] - 1, "right")]
        if not len(spans):
            return split(data, off)
        at, _ = split(data, np.union1d(off, spans))
        k = np.searchsorted(spans[:, 0], at, "left") - 1
        at = at[(k < 0) | (at >= spans[np.maximum(k, 0), 1])]
        return at, np.searchsorted(at, off)

    def forget(self) -> None:
        self.keys, self.slots, self.known = np.zeros(0, np.uint64), np.zeros(0, np.int32), 0
        self.ids, self.at, self.size = _Grown(np.int32), _Grown(np.int64), _Grown(np.int32)
        self.raw, self.raw_at, self.raw_size = _Grown(np.uint8), _Grown(np.int64), _Grown(np.int32)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 for those not known."""
        if not len(self.keys):
            return np.full(len(key), -1, np.int32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.slots[at], -1)

    def _learn(self, key: np.ndarray, pieces: list[bytes], ids: list) -> None:
        """Keys in ascending order."""
        for one, at, size, flat in ((ids, self.at, self.size, self.ids), (pieces, self.raw_at, self.raw_size, self.raw)):
            sizes = np.fromiter(map(len, one), np.int32, len(one))
            values = np.frombuffer(b"".join(one), np.uint8) if flat is self.raw else np.fromiter((x for y in one for x in y), np.int32, int(sizes.sum()))
            at.add(flat.add(values) + np.cumsum(sizes, dtype=np.int64) - sizes)
            size.add(sizes)
        n, self.known = self.known, self.known + len(key)
        keys, slots = np.concatenate([self.keys, key]), np.concatenate([self.slots, np.arange(n, self.known, dtype=np.int32)])
        order = np.argsort(keys, kind="stable")  # two sorted runs
        self.keys, self.slots = keys[order], slots[order]

    def _told_apart(self, key: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Keys by which pre-tokens are equal exactly if their bytes are: those that clash get a digest instead."""
        _, where, back = np.unique(key, return_index=True, return_inverse=True)
        first = where[back]
        clash = size != size[first]
        alike = np.flatnonzero(~clash & (first != np.arange(len(first))))
        clash[alike] = ~_same(data, at[alike], data, at[first[alike]], size[alike])
        slot = self._find(key[where])
        old = np.flatnonzero(slot >= 0)
        slot, pick = slot[old], where[old]
        other = self.raw_size.data[slot] != size[pick]
        equal = np.flatnonzero(~other)
        other[equal] = ~_same(data, at[pick[equal]], self.raw.data, self.raw_at.data[slot[equal]], size[pick[equal]])
        if other.any():
            clash |= np.isin(key, key[pick[other]])
        if clash.any():
            key = key.copy()
            for i in np.flatnonzero(clash).tolist():
                key[i] = int.from_bytes(hashlib.blake2b(data[at[i] : at[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
        return key

    def rows(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and the n + 1 offsets of the rows' ids."""
        at, row_off = self._split(data, off)
        if not len(at):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        if self.known > self.limit:
            self.forget()
        end = np.append(at[1:], len(data))
        fp = fingerprint(21)
        key = self._told_apart(fp.slices(fp.prefix(data), at, end), data, at, end - at)
        key, where, back = np.unique(key, return_index=True, return_inverse=True)
        slot = self._find(key)
        new = np.flatnonzero(slot < 0)
        if len(new):
            raw, pick = data.tobytes(), where[new]
            pieces = [raw[a:b] for a, b in zip(at[pick].tolist(), end[pick].tolist())]
            self._learn(key[new], pieces, self.encode(pieces, key[new]))
            slot = self._find(key)
        slot = slot[back]
        size = self.size.data[slot].astype(np.int64)
        ids = self.ids.data[np.repeat(self.at.data[slot], size) + X.ranges(size)]
        return ids, np.concatenate([[0], np.cumsum(size)])[row_off]
