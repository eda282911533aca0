"""Alignment of a byte-level and a piece tokenizer over a corpus (operator 11).

An id pair is linked where a token of each ends at one byte.  What documents hold a pair, and how often, is an inverted index
of compressed bitmaps: documents are numbered within stretches, and a stretch has for each pair one container a plane.  Plane
k holds the documents whose number of links has bit k set, so the planes' union is the pair's documents and the planes'
populations, weighted by 2**k, add up to its links.  A container lists its documents as 16-bit numbers, or is a plain bitmap
where that is smaller.  A pair that every document holds is a row a stretch and plane and never one row.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import shared_folder
from . import _text as X
from ._components import written
from ._pretokens import PIECE, DistinctEncoder
from .token_shards import _encoder

#: A stretch ends after so many documents or (document, pair) entries.
STRETCH_DOCUMENTS, STRETCH_ENTRIES = 1 << 16, 1_500_000
DOCUMENT = "stretch long, place int, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, groups string"
CONTAINER = "a int, b int, plane int, population int, documents int, dense boolean, bits binary"
_aligners: dict[tuple[str, str], Aligner] = {}


class Bytes:
    """The bytes of each id of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))

    def checked(self, encode):
        """encode, with [-1] for a piece whose tokens' bytes are not its own."""
        return lambda pieces, keys: [ids if b"".join([self.tokens[i] for i in ids]) == piece else [-1] for piece, ids in zip(pieces, encode(pieces, keys))]


def byte_level(path: str) -> Bytes:
    """Tokens of a byte-level vocabulary: printable bytes stand for themselves, the others for 256 and on in their order."""
    from tokenizers import Tokenizer

    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    vocabulary = Tokenizer.from_file(path).get_vocab()
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        tokens[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return Bytes(tokens)


class PieceEncoder(DistinctEncoder):
    """A piece tokenizer over distinct words, each with the spaces before it.

    No piece of the vocabulary has its sign for a space after another sign, so no merge reaches over such a place, and words
    encoded one by one give the ids of the whole text.  Rows open with the space that the tokenizer adds.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)
        pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())]
        if any(a != "▁" and b == "▁" for p in pieces for a, b in zip(p, p[1:])):
            raise ValueError(f"{path} has pieces that reach over the start of a word")
        self.bytes = Bytes([bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        alone = library.piece_to_id("▁")  # the library gives an empty text no space
        super().__init__(self.bytes.checked(lambda words, _: [[alone] if w == b" " else ids for w, ids in zip(words, library.encode([w[1:].decode() for w in words], num_threads=1))]))

    def _split(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.zeros(len(data) + 1, bool)
        start[off] = True
        start[1:-1] |= (data[1:] == 0x20) & (data[:-1] != 0x20)
        at = np.flatnonzero(start[:-1])
        return at, np.searchsorted(at, off)


@lru_cache(maxsize=1)
def _decimals(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of all numbers of so many bits, with a place behind them, and how many digits there are."""
    texts = np.arange(1 << bits).astype(bytes)
    width = texts.dtype.itemsize
    return np.hstack([texts.view(np.uint8).reshape(-1, width), np.zeros((len(texts), 1), np.uint8)]), np.char.str_len(texts)


class Aligned:
    """What a block of rows gave: for each row its tokens' and groups' numbers, and for each group its row and id pair."""

    def __init__(self, rows: int, a: tuple, b: tuple, off: np.ndarray, sizes: tuple[np.ndarray, np.ndarray]):
        kept = np.ones(rows, bool)
        for ids, at in (a, b):
            kept[np.searchsorted(at, np.flatnonzero(ids < 0), "right") - 1] = False
        sides = []
        for (ids, at), size in zip((a, b), sizes):
            n = np.where(kept, np.diff(at), 0)
            ids, row = ids[np.repeat(kept, np.diff(at))], np.repeat(np.arange(rows), n)
            end = np.cumsum(size[ids])
            first = np.cumsum(n) - n
            before = np.concatenate([[0], end])[first]
            sides.append((ids, n, row, end - before[row] + off[:-1][row]))
        (self.a, self.n_a, row_a, end_a), (self.b, self.n_b, row_b, end_b) = sides
        ends_a, ends_b = (np.zeros(int(off[-1]) + 1, bool) for _ in "ab")
        ends_a[end_a], ends_b[end_b] = True, True
        self.closes_a, self.closes_b = ends_b[end_a], ends_a[end_b]
        last_a, last_b = np.flatnonzero(self.closes_a), np.flatnonzero(self.closes_b)
        self.row, self.pair = row_a[last_a], self.a[last_a].astype(np.int64) << 16 | self.b[last_b]
        self.n_groups = np.bincount(self.row, minlength=rows)
        self.last_a, self.last_b = last_a, last_b

    def texts(self) -> list[bytes]:
        """Each row's groups as text: ids joined by commas, A's and B's by a bar, groups by semicolons."""
        of_a, of_b = (np.cumsum(c) - c for c in (self.closes_a, self.closes_b))
        at_a = np.arange(len(self.a)) + np.concatenate([[0], self.last_b + 1])[of_a]
        at_b = np.arange(len(self.b)) + self.last_a[of_b] + 1
        total = len(self.a) + len(self.b)
        ids, sign = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        sign[at_a[self.closes_a]], sign[at_b[self.closes_b]] = ord("|"), ord(";")
        table, digits = _decimals(max(16, int(ids.max(initial=0)).bit_length()))
        size, shown = digits[ids], table[ids]
        shown[np.arange(total), size] = sign
        flat = shown[np.arange(shown.shape[1]) <= size[:, None]].tobytes()
        end = np.concatenate([[0], np.cumsum(size + 1)])[np.cumsum(self.n_a + self.n_b)].tolist()
        return [flat[lo : hi - 1] if hi > lo else b"" for lo, hi in zip([0, *end], end)]


class Aligner:
    def __init__(self, byte_model: str, piece_model: str):
        self.bytes, self.pieces = byte_level(byte_model), PieceEncoder(piece_model)
        self.encoder = DistinctEncoder(self.bytes.checked(_encoder(byte_model, True).encode))

    def __call__(self, data: np.ndarray, off: np.ndarray) -> Aligned:
        """Align rows of text; each row that isn't empty gets a space before it."""
        full = np.diff(off) > 0
        moved = off + np.concatenate([[0], np.cumsum(full)])
        spaced = np.full(int(moved[-1]), 0x20, np.uint8)
        text = np.ones(len(spaced), bool)
        text[moved[:-1][full]] = False
        spaced[text] = data
        return Aligned(len(full), self.encoder.rows(spaced, moved), self.pieces.rows(spaced, moved), moved, (self.bytes.size, self.pieces.bytes.size))


class Stretch:
    """Entries (pair, place, links) of one stretch of documents, and their containers."""

    def __init__(self, number: int):
        self.number, self.documents, self.entries, self.parts = number, 0, 0, []

    def add(self, block: Aligned) -> None:
        code, links = np.unique(block.pair << 16 | (self.documents + block.row), return_counts=True)
        self.parts.append((code, links))
        self.documents += len(block.n_a)
        self.entries += len(code)

    def containers(self, schema: pa.Schema):
        """Record batches of CONTAINER rows."""
        code, links = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(code)
        code, links = code[order], links[order]
        counted = np.zeros(len(code), bool)
        first = np.flatnonzero(np.diff(code >> 16, prepend=-1))
        documents = np.diff(np.append(first, len(code)))
        for plane in range(int(links.max()).bit_length() if len(links) else 0):
            there = np.flatnonzero(links >> plane & 1)
            pair, place = code[there] >> 16, (code[there] & 0xFFFF).astype("<u2")
            lo = np.flatnonzero(np.diff(pair, prepend=-1))
            n, of = np.diff(np.append(lo, len(pair))), np.searchsorted(first, there[lo], "right") - 1
            new = np.where(counted[of], 0, documents[of])  # a pair's documents are told with its first plane
            counted[of] = True
            width = (self.documents + 7) // 8
            dense = 2 * n > width
            for chosen, bits in ((~dense, None), (dense, width)):
                k = np.flatnonzero(chosen)
                if not len(k):
                    continue
                inside = place[np.repeat(lo[k], n[k]) + X.ranges(n[k])]
                if bits is None:
                    values = X.binaries(inside.view(np.uint8), 2 * n[k])
                else:
                    maps = np.zeros((len(k), 8 * width), bool)
                    maps[np.repeat(np.arange(len(k)), n[k]), inside] = True
                    values = X.binaries(np.packbits(maps, axis=1).ravel(), np.full(len(k), width))
                cells = {"stretch": np.full(len(k), self.number), "a": pair[lo[k]] >> 16, "b": pair[lo[k]] & 0xFFFF, "plane": np.full(len(k), plane), "population": n[k], "documents": new[k], "dense": np.full(len(k), bits is not None), "bits": values}
                yield _filled(schema, cells, len(k))


def _filled(schema: pa.Schema, cells: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cells[f.name]).cast(f.type) if f.name in cells else pa.nulls(n, f.type) for f in schema], schema=schema)


_SCHEMA = pa.schema([("stretch", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups")), ("groups_sha256", pa.string()), ("groups", pa.string()), *((c, pa.int32()) for c in ("a", "b", "plane", "population", "documents")), ("dense", pa.bool_()), ("bits", pa.binary())])


def _index(byte_model: str, piece_model: str, groups: bool):
    def scan(batches):
        if (byte_model, piece_model) not in _aligners:
            _aligners[byte_model, piece_model] = Aligner(byte_model, piece_model)
        align, number = _aligners[byte_model, piece_model], TaskContext.get().partitionId() << 32
        stretch = Stretch(number)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for lo, hi, data, off in X.blocks(batch, "text", PIECE):
                for p in range(lo, hi, STRETCH_DOCUMENTS):
                    q = min(hi, p + STRETCH_DOCUMENTS)
                    if stretch.documents and (stretch.documents + q - p > STRETCH_DOCUMENTS or stretch.entries > STRETCH_ENTRIES):
                        yield from stretch.containers(_SCHEMA)
                        stretch = Stretch(stretch.number + 1)
                    part = off[p - lo : q - lo + 1]
                    block = align(data[part[0] : part[-1]], part - part[0])
                    texts = block.texts()
                    sums = [hashlib.sha256(t).hexdigest() if t else "" for t in texts]
                    cells = {"stretch": np.full(q - p, stretch.number), "place": stretch.documents + np.arange(q - p), "doc_id": ids.slice(p, q - p), "n_a": block.n_a, "n_b": block.n_b, "n_groups": block.n_groups, "groups_sha256": sums}
                    yield _filled(_SCHEMA, cells | ({"groups": [t.decode() for t in texts]} if groups else {}), q - p)
                    stretch.add(block)
        if stretch.documents:
            yield from stretch.containers(_SCHEMA)

    return scan


def align(docs: DataFrame, byte_model: str, piece_model: str, groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """The aligned documents (DOCUMENT) and the pairs' containers (stretch and CONTAINER), from one pass over whole texts.

    ``byte_model`` (A) encodes a space and the text, ``piece_model`` (B), which adds that space, the text; strings of special
    tokens in texts are plain text.  Null and empty texts, and those that the bytes of either's tokens don't give back, have no
    tokens: numbers of 0 and ''.  Every row of docs is a document, repeated ones and those without a doc_id included; other
    columns are ignored.  ``groups`` adds the groups as text (``a1,a2|b1;a3|b2,b3``); their digest is always there.
    """
    shared_folder(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = written(rows.mapInArrow(_index(byte_model, piece_model, groups), f"{DOCUMENT}, {CONTAINER}"))
    names = lambda schema: [c.split()[0] for c in schema.split(", ")]
    return both.where("place IS NOT NULL").select(*names(DOCUMENT)), both.where("place IS NULL").select("stretch", *names(CONTAINER))


def pair_counts(containers: DataFrame) -> DataFrame:
    """a, b, n_documents, n_links of each pair, its share of b's links, and whether none of b's pairs has more (best)."""
    weight: Column = F.expr("shiftleft(cast(population as bigint), plane)")
    counts = written(containers.groupBy("a", "b").agg(F.sum("documents").alias("n_documents"), F.sum(weight).alias("n_links")))
    of_b = counts.groupBy("b").agg(F.max("n_links").alias("most"), F.sum("n_links").alias("every"))
    return counts.join(of_b, "b").select("a", "b", "n_documents", "n_links", (F.col("n_links") / F.col("every")).alias("share"), (F.col("n_links") == F.col("most")).alias("best"))


def _places(batch: pa.RecordBatch, rows: np.ndarray, dense: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index into rows, and place, of every document in these rows' containers."""
    data, off = X.column_bytes(batch, "bits")
    n = (off[1:] - off[:-1])[rows]
    flat = data[np.repeat(off[:-1][rows], n) + X.ranges(n)]
    if not dense:
        return np.repeat(np.arange(len(rows)), n // 2), flat.view("<u2").astype(np.int64)
    bit = np.flatnonzero(np.unpackbits(flat))
    of = np.repeat(np.arange(len(rows)), n)[bit // 8]
    return of, bit - 8 * (np.cumsum(n) - n)[of]


def _returned(batches):
    """Rows (stretch, plane, dense, bits, n_links, best) in order of stretches; sums for each document of a stretch."""
    number, total = None, np.zeros((2, 0), np.int64)

    def rows():
        there = np.flatnonzero(total[0])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(there), number)), pa.array(there.astype(np.int32)), pa.array(total[0][there]), pa.array(total[1][there])], names=["stretch", "place", "count_sum", "n_best"])

    for batch in batches:
        stretch, plane, links = (X.column_ints(batch, c) for c in ("stretch", "plane", "n_links"))
        dense, best = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("dense", "best"))
        cut = np.flatnonzero(np.diff(stretch)) + 1
        for lo, hi in zip([0, *cut], [*cut, len(stretch)]):
            if lo == hi:
                continue
            if number != stretch[lo]:
                if number is not None:
                    yield rows()
                number, total = int(stretch[lo]), np.zeros((2, STRETCH_DOCUMENTS), np.int64)
            for kind in (False, True):
                k = lo + np.flatnonzero(dense[lo:hi] == kind)
                of, place = _places(batch, k, kind)
                weight = np.left_shift(1, plane[k])
                np.add.at(total[0], place, (links[k] * weight)[of])
                np.add.at(total[1], place, (best[k] * weight)[of])
    if number is not None:
        yield rows()


def document_scores(containers: DataFrame, pairs: DataFrame) -> DataFrame:
    """stretch, place, count_sum (of the links' counts) and n_best of each document with links: the containers take their pairs'
    counts, and go back to their stretch."""
    told = containers.join(pairs.select("a", "b", "n_links", "best"), ["a", "b"]).select("stretch", "plane", "dense", "bits", "n_links", "best")
    return told.repartition("stretch").sortWithinPartitions("stretch").mapInArrow(_returned, "stretch long, place int, count_sum long, n_best long")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    documents, containers = align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    scored = documents.join(document_scores(containers, pair_counts(containers)), ["stretch", "place"], "left")
    return scored.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
