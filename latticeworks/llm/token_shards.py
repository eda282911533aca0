"""Token-id shards with keyed access (operator 7).

A shard file, little-endian throughout:

    "TOKS" | version u32 | documents u64 | ids u64 | bytes an id u32 | bytes of the hash u32
    the hash (see ``_mph``) | documents x (fingerprint u32, length u32, first id u64), by the key's number
    documents x key i64, in stored order | documents x turn u32 | the ids, document after document

The minimal perfect hash gives a key's number; the stored fingerprint tells keys that the shard does not have.  A document's
key is its doc_id and its turn: 0, or 1, 2, ... for further rows of that doc_id.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import new_folder, shared_folder
from . import _text as X
from ._files import opened, replaced
from ._mph import MinimalPerfectHash
from ._pretokens import PIECE, DistinctEncoder

HEAD = np.dtype([("magic", "S4"), ("version", "<u4"), ("documents", "<u8"), ("ids", "<u8"), ("width", "<u4"), ("hash", "<u4")])
ENTRY = np.dtype([("fingerprint", "<u4"), ("length", "<u4"), ("first", "<u8")])
END_ID = 0
_encoders: dict[tuple[str, bool], DistinctEncoder] = {}


def _key_hash(keys: np.ndarray, turns: np.ndarray) -> np.ndarray:
    return X.mix(X.mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(0x51ED270B0A1F39C1)) + turns.astype(np.uint64))


def _encoder(path: str, plain: bool) -> DistinctEncoder:
    """The tokenizers library over distinct pre-tokens; those that open with a space are passed many to a call.

    The strings of special tokens in a text are those tokens, as is the library's default, unless plain is set.
    """
    if (path, plain) not in _encoders:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.encode_special_tokens = plain
        library.no_padding()
        library.no_truncation()
        added = library.get_added_tokens_decoder().values()
        if any(t.single_word or t.lstrip or t.rstrip for t in added):
            raise ValueError("added tokens that look at their surroundings are not supported")
        whole = [t.content.encode() for t in added if not (plain and t.special)]

        def encode(pieces: list[bytes], _) -> list:
            texts = [p.decode() for p in pieces]
            out: list = [None] * len(texts)
            joined = [i for i, t in enumerate(texts) if len(t) > 1 and t[0] == " " and t[1].isalpha()]
            single = [i for i, t in enumerate(texts) if not (len(t) > 1 and t[0] == " " and t[1].isalpha())]
            for k in range(0, len(joined), 512):
                part = joined[k : k + 512]
                e = library.encode("".join(texts[i] for i in part), add_special_tokens=False)
                ids, at = e.ids, np.flatnonzero(np.diff(np.array(e.word_ids, np.int64), prepend=-1))
                if len(at) != len(part):
                    single += part
                    continue
                for i, a, b in zip(part, at.tolist(), [*at[1:].tolist(), len(ids)]):
                    out[i] = ids[a:b]
            for i, e in zip(single, library.encode_batch([texts[i] for i in single], add_special_tokens=False)):
                out[i] = e.ids
            return out

        _encoders[path, plain] = DistinctEncoder(encode, whole)
    return _encoders[path, plain]


def _id_bytes(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4


def _write(tokenizer: str, folder: str, width: int, plain: bool):
    def scan(batches):
        enc, shard = _encoder(tokenizer, plain), TaskContext.get().partitionId()
        keys, lengths, parts = [], [], []
        for batch in batches:
            docs = X.column_ints(batch, "doc_id")
            for lo, hi, data, off in X.blocks(batch, "text", PIECE):
                ids, id_off = enc.rows(data, off)
                n = np.diff(id_off)
                if len(ids) and int(ids.max()) >> (8 * width):
                    raise ValueError(f"id {int(ids.max())} needs more than {width} bytes")
                out = np.full(len(ids) + len(n), END_ID, f"<u{width}")
                out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                keys.append(docs[lo:hi])
                lengths.append(n + 1)
                parts.append(out.tobytes())
        if not keys:
            return
        key, size = np.concatenate(keys), np.concatenate(lengths)
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        turn = X.ranges(np.diff(np.append(new, len(key)))).astype("<u4")
        first, hashed = np.cumsum(size) - size, _key_hash(key, turn)
        mph = MinimalPerfectHash.build(hashed)
        index = np.zeros(len(key), ENTRY)
        number = mph.number(hashed)
        index["fingerprint"][number], index["length"][number], index["first"][number] = (hashed >> np.uint64(32)).astype("<u4"), size, first
        raw = mph.dump()
        head = np.array([(b"TOKS", 2, len(key), int(size.sum()), width, len(raw))], HEAD)
        name = f"{folder}/ids-{shard:06d}.bin"
        with replaced(name) as f:
            for x in (head.tobytes(), raw, index.tobytes(), key.astype("<i8").tobytes(), turn.tobytes(), *parts):
                f.write(x)
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([name]), pa.array([len(key)]), pa.array([int(size.sum())])], names=["shard", "path", "documents", "ids"])

    return scan


class Shard:
    """Keyed access to one file."""

    def __init__(self, uri: str):
        self.file = opened(uri)
        self.head = np.frombuffer(self.file.read(HEAD.itemsize), HEAD)[0]
        n = int(self.head["documents"])
        self.mph = MinimalPerfectHash.load(self.file.read(int(self.head["hash"])))
        self.index = np.frombuffer(self.file.read(n * ENTRY.itemsize), ENTRY)
        self.keys, self.turns = np.frombuffer(self.file.read(n * 8), "<i8"), np.frombuffer(self.file.read(n * 4), "<u4")
        self.payload = HEAD.itemsize + int(self.head["hash"]) + n * (ENTRY.itemsize + 12)

    def find(self, keys: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """Index rows of keys, -1 for those the shard does not have (but for one in 2**32)."""
        hashed = _key_hash(keys, turns)
        number = self.mph.number(hashed)
        return np.where((number >= 0) & (self.index["fingerprint"][number] == (hashed >> np.uint64(32)).astype("<u4")), number, -1)

    def ids(self, first: int, length: int) -> np.ndarray:
        width = int(self.head["width"])
        self.file.seek(self.payload + first * width)
        return np.frombuffer(self.file.read(length * width), f"<u{width}")

    def close(self) -> None:
        self.file.close()


def write_shards(docs: DataFrame, tokenizer: str, folder: str, width: int | None = None, plain: bool = False) -> DataFrame:
    """Encode every whole text, append id 0, and write shards in ascending doc_id order; returns shard, path, documents, ids, start.

    A null or empty text is the end id alone.  Rows of one doc_id follow each other by their texts (null last) and are keyed by
    their turn; rows without a doc_id have no key and are left out.  Other columns are ignored.  ``width`` is the bytes of an id
    (by default 2 or 4, as the vocabulary needs).  The strings of special tokens in a text become those tokens unless ``plain``.
    ``start`` is the number of ids in all shards before.
    """
    shared_folder(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    ranged = keyed.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.col("text").asc_nulls_last())
    manifest = ranged.mapInArrow(_write(tokenizer, folder, width or _id_bytes(tokenizer), plain), "shard long, path string, documents long, ids long").checkpoint()
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, through the index of its shard."""

    def scan(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(path)
                keys = shard.keys
                rows = shard.index[shard.find(keys, shard.turns)]
                for lo in range(0, len(keys), 4096):
                    part = rows[lo : lo + 4096]
                    sums = [zlib.crc32(shard.ids(int(r["first"]), int(r["length"])).astype("<u4").tobytes()) for r in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[lo : lo + 4096].astype(np.int64)), pa.array(part["first"].astype(np.int64) + base), pa.array(part["length"].astype(np.int64)), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                shard.close()

    shards = max(1, manifest.count())  # a number given is kept; else small rows would meet in one task
    return manifest.select("path", "start").repartition(shards, "path").mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, keys: list[int]) -> DataFrame:
    """doc_id and ids of the given keys (a stated, short list), each found by its shards' hashes; a row for each turn of a key."""
    wanted = np.array(keys, np.int64)

    def scan(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                shard, left, turn = Shard(path), wanted, 0
                while len(left):
                    at = shard.find(left, np.full(len(left), turn))
                    left, at, turn = left[at >= 0], at[at >= 0], turn + 1
                    found = [shard.ids(int(r["first"]), int(r["length"])).astype(np.int32).tolist() for r in shard.index[at]]
                    yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "ids"])
                shard.close()

    return manifest.select("path").repartition("path").mapInArrow(scan, "doc_id long, ids array<int>")


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_shards(write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), new_folder(spark, "token-shards")))
