"""Vectorised helpers over the bytes of whole texts, used inside Spark tasks.

An Arrow batch of texts is walked in blocks of about a megabyte, so a task's memory follows the longest text and not
the batch.  Nothing here knows about Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK = 1 << 20
#: White space between words: the space and the bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Maps A-Z to a-z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over 64 bits (a bijection)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def column_bytes(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text or binary column and the n + 1 offsets of its rows; null is empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_string(col.type):
        col = col.cast(pa.binary())
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    _, off, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def blocks(batch: pa.RecordBatch, name: str, limit: int = BLOCK):
    """Yield (first row, last row + 1, bytes, offsets from 0) with whole rows of about ``limit`` bytes each."""
    data, off = column_bytes(batch, name)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def column_ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A whole-number column without nulls as int64."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.int64()).to_numpy(zero_copy_only=False)


def binaries(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary values that lie one after another in data."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def words(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the words of each row, and the n + 1 offsets of the rows' words.

    space: for each byte, whether it lies between words.
    """
    n = len(data)
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(space[data], out=inside[1:-1])
    edge = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    first[edge] = inside[1:-1][edge]
    last[edge - 1] = inside[1:-1][edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


#: A Mersenne prime: sums are reduced by a mask and a shift.
PRIME = U64((1 << 31) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """A value below 2**32 that is congruent modulo PRIME, for x below 2**63."""
    return (x & PRIME) + (x >> U64(31))


def _residue(x: np.ndarray) -> np.ndarray:
    """The remainder modulo PRIME, for x below 2**63."""
    x = _reduced(_reduced(x))
    x[x >= PRIME] -= PRIME
    return x


class Fingerprint:
    """Fingerprints of any slice of a symbol sequence by one pass of prefix sums.

    Two sums of symbol values times powers of a base, modulo the prime 2**31 - 1, each divided by the power at the slice's
    start; values and bases of the two were drawn apart.  Two different slices of n symbols agree for at most a share of
    (n / 2**31)**2 of all bases, whatever the slices are; a modulus of 2**64 has no such bound (Thue-Morse sequences).
    """

    #: Both bases with their inverses, and their powers, which all fingerprints of a process share.
    bases = [(b, pow(b, -1, int(PRIME))) for b in (1_462_731_659, 1_903_528_171)]
    powers = [(np.ones(1, np.uint32), np.ones(1, np.uint32))] * 2

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.tables = [rng.choice(int(PRIME) - 1, 256, replace=False).astype(U64) + U64(1) for _ in range(2)]

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(1, np.uint32)
        while len(out) < n:
            out = np.concatenate([out, _residue(out * U64(pow(base, len(out), int(PRIME)))).astype(np.uint32)])
        return out

    @classmethod
    def grow(cls, n: int) -> None:
        if len(cls.powers[0][0]) < n:
            cls.powers = [(cls._powers(up, max(n, 1 << 16)), cls._powers(down, max(n, 1 << 16))) for up, down in cls.bases]

    def prefix(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two prefix sums of bytes (uint8) or of 64-bit symbols (fingerprints)."""
        self.grow(len(symbols) + 1)
        out = []
        for k, (table, (up, _)) in enumerate(zip(self.tables, self.powers)):
            values = table[symbols] if symbols.dtype == np.uint8 else (symbols >> U64(33 * k)) & PRIME
            total = np.zeros(len(symbols) + 1, U64)
            np.cumsum(_reduced(values * up[: len(symbols)]), out=total[1:])
            out.append(total)
        return out[0], out[1]

    def slices(self, prefix: tuple[np.ndarray, np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        one, two = (_residue(_reduced(_reduced(total[hi] - total[lo])) * down[lo]) for total, (_, down) in zip(prefix, self.powers))
        return mix(mix(one | two << U64(31)) + (hi - lo).astype(U64) * U64(0x9E3779B97F4A7C15))


def word_symbols(fp: Fingerprint, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A fingerprint of each word."""
    return fp.slices(fp.prefix(data), starts, ends)


def i64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..l-1 for each length l, one after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths)
