"""WARC bundles in seekable Zstandard (operator 4).

A bundle is a file of independent Zstandard frames that hold whole WARC/1.1 records, then a skippable frame with the seek
table: a pair of sizes (compressed, decompressed) for each frame and a footer of frame count, flags and magic number.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from contextlib import ExitStack

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import new_folder, shared_folder
from ._files import opened, replaced

FRAME_BYTES = 1 << 18
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = "page_id long, path string, frame int, offset int, length int"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit leaves its payload out."""
    block = HTTP if refers_to is not None else HTTP + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", "2000-01-01T00:00:00Z")]
    if url:
        fields.append(("WARC-Target-URI", " ".join(url.split())))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Fields, payload and end of the record at a place."""
    end = raw.index(b"\r\n\r\n", at)
    lines = raw[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = raw[end + 4 : end + 4 + int(fields["Content-Length"])]
    return fields, block[block.index(b"\r\n\r\n") + 4 :], end + 8 + len(block)


class BundleWriter:
    def __init__(self, stream):
        self.stream, self.pending, self.held, self.frames = stream, [], 0, []
        self.packer = zstandard.ZstdCompressor(level=3)

    def add(self, raw: bytes) -> tuple[int, int]:
        """Frame number and offset in the frame of a record."""
        if self.held and self.held + len(raw) > FRAME_BYTES:
            self.flush()
        place = len(self.frames), self.held
        self.pending.append(raw)
        self.held += len(raw)
        return place

    def flush(self) -> None:
        if self.held:
            packed = self.packer.compress(b"".join(self.pending))
            self.stream.write(packed)
            self.frames.append((len(packed), self.held))
            self.pending, self.held = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class BundleReader:
    def __init__(self, stream):
        self.stream = stream
        stream.seek(0, 2)
        size = stream.tell()
        stream.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", stream.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        entry = 12 if flags & 0x80 else 8
        stream.seek(size - 9 - n * entry)
        table = stream.read(n * entry)
        self.frames, at = [], 0
        for i in range(n):
            packed, raw = struct.unpack_from("<II", table, i * entry)
            self.frames.append((at, packed, raw))
            at += packed
        self.unpacker, self.current = zstandard.ZstdDecompressor(), (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.current[0] != k:
            at, packed, raw = self.frames[k]
            self.stream.seek(at)
            self.current = k, self.unpacker.decompress(self.stream.read(packed), max_output_size=raw)
        return self.current[1]


def roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, digest, refers_to: among equal payloads of at least so many bytes, all but the largest page_id refer to it."""
    keyed = pages.select("page_id", "digest", "n").distinct()
    kept = keyed.where(F.col("n") >= least_bytes).groupBy("digest", "n").agg(F.max("page_id").alias("kept"))
    return keyed.join(kept, ["digest", "n"], "left").select("page_id", "digest", F.when(F.col("page_id") < F.col("kept"), F.col("kept")).alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write each page as a WARC record and return the index: page_id, path, frame, offset (in the frame), length.

    The payload is html in UTF-8; null is empty.  A null page_id is written as a response without an index key (null).
    Repeated rows are records of equal roles.  A null url has no target field; other columns are ignored; no pages give an
    empty index.
    """

    def write(batches):
        name = f"{folder}/bundle-{TaskContext.get().partitionId():06d}.warc.zst"
        ids, places = [], []
        with replaced(name) as stream:
            w = BundleWriter(stream)
            for batch in batches:
                for page, url, html, refers in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    raw = record(page, url, html.encode(), refers)
                    ids.append(page)
                    places.append((*w.add(raw), len(raw)))
            w.close()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([name] * len(ids), pa.string()), *(pa.array([p[k] for p in places], pa.int32()) for k in range(3))], names=["page_id", "path", "frame", "offset", "length"])

    shared_folder(pages.sparkSession)
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    given = given.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    role = roles(given.withColumn("n", F.octet_length("html")), least_bytes).where("page_id IS NOT NULL")
    rows = given.join(role.hint("merge"), ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")
    return rows.mapInArrow(write, INDEX).checkpoint()


def read_bundles(index: DataFrame) -> DataFrame:
    """The records that the index names, through each bundle's seek table: page_id, payload_bytes, payload_digest, record_type,
    refers_to, payload (null for a revisit).  A payload that doesn't match its digest fails the job."""

    def read(batches):
        path, reader = None, None
        with ExitStack() as held:  # one bundle is open at a time
            for batch in batches:
                out = []
                for name, frame, offset in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    if name != path:
                        held.close()
                        path, reader = name, BundleReader(held.enter_context(opened(name)))
                    fields, payload, _ = parse(reader.frame(frame), offset)
                    digest, kind, page = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], fields["WARC-Record-ID"][10:-1]
                    if kind == "response" and base32_sha1(payload) != digest:
                        raise ValueError(f"record {page} is damaged")
                    refers = int(fields["WARC-Refers-To"][10:-1]) if kind == "revisit" else None
                    out.append((None if page == "None" else int(page), int(fields["Payload-Length"]), digest, kind, refers, payload.decode() if kind == "response" else None))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    bundles = max(1, index.select("path").distinct().count())  # a number given is kept; else small rows would meet in one task
    placed = index.select("path", "frame", "offset").repartition(bundles, "path").sortWithinPartitions("path", "frame", "offset")
    return placed.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")


def op4_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_folder(spark, "warc"))
    return read_bundles(index).drop("payload")
