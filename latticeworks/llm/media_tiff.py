"""TIFF media columns (operator 9): texts stored as grey images, and any such image read back page by page.

The reader walks the image directories of classic little- or big-endian TIFF files with 8-bit grey or multi-sample pixels, in
strips or tiles, uncompressed or compressed with PackBits, LZW or deflate, with or without the horizontal predictor.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X

WIDTH = 64
#: Rows of a page and of a strip at most.
PAGE_ROWS, STRIP_ROWS = 16384, 4096
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: The codec of a text is chosen by the CRC of its payload, whatever its size; deflate goes with the predictor.
CODECS = (LZW, PACKBITS, DEFLATE)
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


def packbits(data: bytes) -> bytes:
    """Runs of three bytes or more are counted, all others are copied, at most 128 at a time."""
    raw = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero(np.concatenate([[True], raw[1:] != raw[:-1]])) if len(raw) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(raw)))
    long = sizes >= 3
    out, done = bytearray(), 0

    def copy(to: int) -> None:
        for i in range(done, to, 128):
            part = data[i : min(i + 128, to)]
            out.append(len(part) - 1)
            out.extend(part)

    for at, n in zip(starts[long].tolist(), sizes[long].tolist()):
        copy(at)
        done = at + n
        for k in range(0, n, 128):
            m = min(128, n - k)
            out += bytes([257 - m, data[at]]) if m > 1 else bytes([0, data[at]])
    copy(len(data))
    return bytes(out)


def unpackbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def _bit_width(entries: int) -> int:
    """Bits of the next code for a writer's table of so many entries; a reader's table is one entry behind."""
    return 9 if entries < 512 else 10 if entries < 1024 else 11 if entries < 2048 else 12


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: clear code 256, end code 257, high bits first, codes one step wider than the table needs."""
    if not data:
        return bytes([0x80, 0x40, 0x40])
    table: dict[int, int] = {}
    get, acc, bits, out = table.get, 256, 9, bytearray()
    used, word, size = 258, data[0], 9
    for byte in data[1:]:
        pair = word << 8 | byte
        longer = get(pair)
        if longer is not None:
            word = longer
            continue
        acc, bits = acc << size | word, bits + size
        table[pair] = used
        used += 1
        size = _bit_width(used)
        if used == 4094:
            acc, bits = acc << 12 | 256, bits + 12
            table.clear()
            used, size = 258, 9
        if bits > 512:
            rest = bits & 7
            out += (acc >> rest).to_bytes(bits >> 3, "big")
            acc, bits = acc & ((1 << rest) - 1), rest
        word = byte
    acc, bits = acc << size | word, bits + size
    size = _bit_width(used + 1)
    acc, bits = acc << size | 257, bits + size
    fill = -bits % 8
    return bytes(out) + (acc << fill).to_bytes((bits + fill) >> 3, "big")


def unlzw(data: bytes) -> bytes:
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, acc, bits, last, size = base.copy(), bytearray(), 0, 0, b"", 9
    for byte in data:
        acc, bits = acc << 8 | byte, bits + 8
        if bits < size:
            continue
        bits -= size
        code, acc = acc >> bits, acc & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, last, size = base.copy(), b"", 9
            continue
        if not last:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
        out += word
        last = word
        size = _bit_width(len(table) + 1)
    return bytes(out)


def _packed(raw: np.ndarray, compression: int, predictor: int) -> bytes:
    """raw: rows x columns of one strip."""
    if predictor == 2:
        raw = np.diff(raw, axis=1, prepend=np.zeros((len(raw), 1), np.uint8))
    data = raw.tobytes()
    return zlib.compress(data, 1) if compression == DEFLATE else lzw(data) if compression == LZW else packbits(data) if compression == PACKBITS else data


def write_tiff(payload: np.ndarray) -> bytes:
    """A little-endian TIFF of WIDTH columns with one page for each PAGE_ROWS rows; payload: bytes, a multiple of WIDTH."""
    compression = CODECS[zlib.crc32(payload) % len(CODECS)]
    predictor = 2 if compression == DEFLATE else 1
    image = payload.reshape(-1, WIDTH)
    parts, at, link = [b"II*\0\0\0\0\0"], 8, 4
    links = []
    for p in range(0, len(image), PAGE_ROWS):
        page = image[p : p + PAGE_ROWS]
        strips = [_packed(page[r : r + STRIP_ROWS], compression, predictor) for r in range(0, len(page), STRIP_ROWS)]
        places = []
        for s in strips:
            s += b"\0" * (len(s) % 2)
            places.append(at)
            parts.append(s)
            at += len(s)
        many = len(strips) > 1
        arrays = at
        if many:
            parts.append(struct.pack(f"<{2 * len(strips)}I", *places, *map(len, strips)))
            at += 8 * len(strips)
        tags = [(256, 4, 1, WIDTH), (257, 4, 1, len(page)), (258, 3, 1, 8), (259, 3, 1, compression), (262, 3, 1, 1), (273, 4, len(strips), arrays if many else places[0]), (277, 3, 1, 1), (278, 4, 1, STRIP_ROWS), (279, 4, len(strips), arrays + 4 * len(strips) if many else len(strips[0])), (317, 3, 1, predictor)]
        links.append((link, at))
        link = at + 2 + 12 * len(tags)
        parts.append(struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + b"\0\0\0\0")
        at = link + 4
    out = bytearray(b"".join(parts))
    for where, to in links:
        struct.pack_into("<I", out, where, to)
    return bytes(out)


def _directory(raw: bytes, order: str, at: int) -> tuple[dict, int]:
    tags = {}
    (n,) = struct.unpack_from(order + "H", raw, at)
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
        size, place = _SIZES.get(kind, 1), at + 10 + 12 * i
        if size * count > 4:
            (place,) = struct.unpack_from(order + "I", raw, place)
        if kind in (1, 3, 4):
            tags[tag] = struct.unpack_from(f"{order}{count}{'BHI'[(1, 3, 4).index(kind)]}", raw, place)
    (following,) = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)
    return tags, following


def _unpacked(data: bytes, compression: int) -> bytes:
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if compression == LZW:
        return unlzw(data)
    if compression == PACKBITS:
        return unpackbits(data)
    if compression == NONE:
        return data
    raise ValueError(f"compression {compression} is not supported")


def read_tiff(raw: bytes):
    """Yield (page, array of rows x columns x samples, compression, predictor) for each image directory."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", raw, 4)
    page, seen = 0, set()
    while at and at not in seen:
        seen.add(at)
        t, at = _directory(raw, order, at)
        width, height, samples = t[256][0], t[257][0], t.get(277, (1,))[0]
        compression, predictor = t.get(259, (NONE,))[0], t.get(317, (1,))[0]
        if set(t.get(258, (8,))) != {8} or predictor not in (1, 2) or t.get(284, (1,))[0] != 1:
            raise ValueError("only 8-bit chunky samples are supported")
        tiled = 324 in t
        wide, high = (t[322][0], t[323][0]) if tiled else (width, min(t.get(278, (height,))[0], height))
        image = np.zeros((height, width, samples), np.uint8)
        across = -(-width // wide)
        for k, (place, size) in enumerate(zip(t[324 if tiled else 273], t[325 if tiled else 279])):
            y, x = k // across * high, k % across * wide
            rows = high if tiled else min(high, height - y)
            block = np.frombuffer(_unpacked(raw[place : place + size], compression), np.uint8, rows * wide * samples).reshape(rows, wide, samples)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=np.uint8)
            image[y : y + rows, x : x + wide] = block[: height - y, : width - x]
        yield page, image, compression, predictor
        page += 1


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text's UTF-8 bytes, filled with bytes 0 to a positive multiple of 64, as a TIFF.

    A null text is empty.  doc_id is passed on as it is; repeated rows give equal values; other columns are ignored.
    """

    def scan(batches):
        for batch in batches:
            for lo, hi, data, off in X.blocks(batch, "text"):
                n = np.diff(off)
                media = []
                for a, k in zip(off[:-1].tolist(), n.tolist()):
                    payload = np.zeros(max(WIDTH, -(-k // WIDTH) * WIDTH), np.uint8)
                    payload[:k] = data[a : a + k]
                    media.append(write_tiff(payload))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(n), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def decode_pages(media: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each page of each media file: the columns to keep, file (its number within the task), media_bytes,
    media_sha256, page, width, height, compression, predictor, mean, samples (the pixels).

    Null media have no pages; a file that is not a TIFF of the supported kinds fails the job.  The pages of a file follow each
    other.  Repeated rows are files of their own.
    """
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary())
    names = ["file", "media_bytes", "media_sha256", "page", "width", "height", "compression", "predictor", "mean", "samples"]

    def scan(batches):
        file = 0
        for batch in batches:
            rows, where, held = [], [], 0

            def out():
                kept = [batch.column(k).take(pa.array(where, pa.int64())) for k in range(len(keep))]  # noqa: B023
                return pa.RecordBatch.from_arrays([*kept, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=[*keep, *names])  # noqa: B023

            for i, m in enumerate(batch.column(len(keep))):
                if not m.is_valid:
                    continue
                raw = m.as_buffer().to_pybytes()
                whole = hashlib.sha256(raw).hexdigest()
                for page, image, compression, predictor in read_tiff(raw):
                    where.append(i)
                    rows.append((file, len(raw), whole, page, image.shape[1], image.shape[0], compression, predictor, float(image.mean()), image.tobytes()))
                    held += image.size
                    if held >= X.BLOCK:
                        yield out()
                        rows, where, held = [], [], 0
                file += 1
            yield out()

    fields = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in keep)
    return media.select(*keep, "media").mapInArrow(scan, f"{fields}, file long, media_bytes long, media_sha256 string, page int, width int, height int, compression int, predictor int, mean double, samples binary")


def media_digest(media: DataFrame) -> DataFrame:
    """Each stored file read back page by page and summed up; the pages of a file follow each other, so nothing is exchanged."""

    class Sum:
        def __init__(self, own: tuple):
            self.own, self.whole, self.tail, self.total, self.pages, self.kinds = own, hashlib.sha256(), b"", 0, 0, set()
            self.histogram = np.zeros(256, np.int64)

        def add(self, data: bytes, kind: str) -> None:
            self.whole.update(data)
            self.tail, self.total, self.pages = (self.tail + data[-64:])[-64:], self.total + len(data), self.pages + 1
            self.kinds.add(kind)
            self.histogram += np.bincount(np.frombuffer(data, np.uint8), minlength=256)

        def row(self) -> tuple:
            doc, n, media_bytes, media_sha256 = self.own
            share = self.histogram[self.histogram > 0] / max(self.total, 1)
            feature = {"pages": self.pages, "rows": self.total // WIDTH, "kinds": sorted(self.kinds), "mean": round(float(self.histogram @ np.arange(256)) / max(self.total, 1), 6), "entropy": round(float(-(share * np.log2(share)).sum()), 6) + 0.0}
            return doc, n, self.total, self.whole.hexdigest(), zlib.crc32(self.tail), media_bytes, media_sha256, json.dumps(feature, sort_keys=True)

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def scan(batches):
        last, current = None, None
        for batch in batches:
            rows = []
            cells = [batch.column(k).to_pylist() for k in range(5)]
            form = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("compression", "predictor")]
            pixels = batch.column(batch.schema.get_field_index("samples"))
            for i, (doc, n, file, size, digest) in enumerate(zip(*cells)):
                if file != last:
                    if current is not None:
                        rows.append(current.row())
                    last, current = file, Sum((doc, n, size, digest))
                current.add(pixels[i].as_buffer().to_pybytes(), f"{form[0][i]}/{form[1][i]}")
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
        rows = [current.row()] if current is not None else []
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return decode_pages(media, ("doc_id", "n_bytes")).mapInArrow(scan, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(encode_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
