"""Byte-level BPE encoding and decoding (operator 2)."""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._mph import MinimalPerfectHash
from ._pretokens import PIECE, DistinctEncoder
from ._repeats import fingerprint


class Vocabulary:
    """Ranks of a byte-level BPE file.

    Whole pre-tokens that are entries are found by a minimal perfect hash, whose entry's fingerprint and bytes are compared;
    others are merged with a heap of pair ranks over linked bytes.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = sorted(ranks, key=ranks.__getitem__)
        self.numbers = np.array([ranks[t] for t in tokens], np.int64)
        data, off = np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        fp = fingerprint(21)
        keys = fp.slices(fp.prefix(data), off[:-1], off[1:])
        self.mph = MinimalPerfectHash.build(keys)
        place = self.mph.number(keys)
        self.stored, self.entry = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.int64)
        self.stored[place], self.entry[place] = keys, np.arange(len(keys))
        self.tokens = tokens
        most = int(self.numbers.max()) + 1
        self.at, self.size = np.zeros(most, np.int64), np.zeros(most, np.int64)
        self.at[self.numbers], self.size[self.numbers], self.data = off[:-1], np.diff(off), data
        self.text = [str(i) for i in range(most)]
        self.single = [ranks[bytes([i])] for i in range(256)]
        get, pairs = ranks.get, {}
        for t, rank in ranks.items():
            for k in range(1, len(t)):
                a, b = get(t[:k]), get(t[k:])
                if a is not None and b is not None:
                    pairs[a << 24 | b] = rank
        self.pairs = pairs
        self.encoder = DistinctEncoder(self.encode_pieces)

    def merge(self, piece: bytes) -> list[int]:
        """Merge the lowest ranked, leftmost pair until none is left."""
        n, pairs, single = len(piece), self.pairs.get, self.single
        ids = [single[b] for b in piece]
        heap = [(r << 32) | i for i in range(n - 1) if (r := pairs(ids[i] << 24 | ids[i + 1])) is not None]
        if not heap:
            return ids
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            x = pop(heap)
            rank, i = x >> 32, x & 0xFFFFFFFF
            a = ids[i]
            if a < 0:
                continue
            j = after[i]
            if j >= n or pairs(a << 24 | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := pairs(rank << 24 | ids[k])) is not None:
                    push(heap, (r << 32) | i)
            p = before[i]
            if p >= 0 and (r := pairs(ids[p] << 24 | rank)) is not None:
                push(heap, (r << 32) | p)
        return [x for x in ids if x >= 0]

    def encode_pieces(self, pieces: list[bytes], keys: np.ndarray) -> list:
        place = self.mph.number(keys)
        hit = (place >= 0) & (self.stored[place] == keys)
        entry, merge, tokens, number = self.entry[place].tolist(), self.merge, self.tokens, self.numbers.tolist()
        return [(number[e],) if h and tokens[e] == p else merge(p) for p, h, e in zip(pieces, hit.tolist(), entry)]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[ids]
        return self.data[np.repeat(self.at[ids], size) + X.ranges(size)], np.concatenate([[0], np.cumsum(size)])[off]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _lists(flat: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat.astype(np.int32)))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids: the byte-level BPE ids of each whole text, pre-token by pre-token, without special tokens.

    A null or empty text has no ids; doc_id is passed on as it is, null too; repeated rows are encoded alike; other columns
    are ignored.  ``path`` is a rank file (base64 token and rank a line) that every machine has.
    """

    def scan(batches):
        v = vocabulary(path)
        for batch in batches:
            doc = batch.column(0)
            for lo, hi, data, off in X.blocks(batch, "text", PIECE):
                ids, id_off = v.encoder.rows(data, off)
                yield pa.RecordBatch.from_arrays([doc[lo:hi], _lists(ids, id_off)], names=["doc_id", "ids"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def _id_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column(batch.schema.get_field_index("ids")).fill_null([])
    off = ids.offsets.to_numpy()
    return ids.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]], (off - off[0]).astype(np.int64)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded: the bytes that the ids stand for; null ids are none."""

    def scan(batches):
        v = vocabulary(path)
        for batch in batches:
            ids, off = _id_rows(batch)
            for lo in range(0, batch.num_rows, 256):
                hi = min(lo + 256, batch.num_rows)
                part = off[lo : hi + 1]
                data, at = v.decode(ids[part[0] : part[-1]], part - part[0])
                raw = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], raw], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(scan, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")


def _digest(path: str):
    def scan(batches):
        text = vocabulary(path).text.__getitem__
        for batch in batches:
            ids, off = _id_rows(batch)
            raw = batch.column(2)
            sums = [hashlib.sha256(" ".join(map(text, ids[a:b].tolist())).encode()).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            out = [hashlib.sha256(x.as_buffer()).hexdigest() for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(sums, pa.string()), pa.array(out, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return scan


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
    return out.mapInArrow(_digest(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
