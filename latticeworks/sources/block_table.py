"""Block tables in CSV as a data source: columns by their header's names, and a dialect for each file."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..plans.dims import DEFAULT_BLOCK

SPLIT_BYTES = 64 << 20
ROWS = 1 << 14


@dataclass
class Piece(InputPartition):
    """The lines that start in [start, end) of a file, and what its header names."""

    path: str
    start: int
    end: int
    names: list[str]


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def _names(line: bytes) -> list[str]:
    return [n.strip().lower() for n in next(csv.reader([line.decode("utf-8-sig")]), [])]


class BlockTable(DataSource):
    """``spark.read.format("block_table").load(path)``: x, y, z, block of a CSV file or a folder of such files.

    Each file has a header of its own, in any order and with any other columns; ``block`` may be missing.  States may be quoted
    or hold bare commas.  Places are whole numbers; a blank block becomes the option ``default``.  A file without x, y, z, and
    an input without any row, are errors.  Large files are read in pieces of the option ``split`` bytes; a row is one line.
    """

    @classmethod
    def name(cls) -> str:
        return "block_table"

    def schema(self) -> str:
        return "x int, y int, z int, block string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return BlockReader(self.options["path"], self.options.get("default", DEFAULT_BLOCK), int(self.options.get("split", SPLIT_BYTES)))


class BlockReader(DataSourceReader):
    def __init__(self, path: str, default: str, split: int):
        self.path, self.default, self.split = path, default, split

    def partitions(self) -> list[Piece]:
        fs, at = _filesystem(self.path)
        found = fs.get_file_info(at)
        if found.type == pafs.FileType.Directory:
            infos = fs.get_file_info(pafs.FileSelector(at, recursive=True))
            files = sorted((i for i in infos if i.type == pafs.FileType.File and not any(p[:1] in "._" for p in i.path[len(at) :].strip("/").split("/"))), key=lambda i: i.path)
        elif found.type == pafs.FileType.File:
            files = [found]
        else:
            raise ValueError(f"{self.path} isn't there")
        pieces = []
        for info in files:
            if not info.size:
                continue
            with fs.open_input_stream(info.path) as f:
                head = _first_line(f)
            names = _names(head)
            if not {"x", "y", "z"} <= set(names):
                raise ValueError(f"{info.path} must have columns x, y, z")
            uri = info.path if self.path.startswith(("/", "file:")) else self.path[: self.path.index("://")] + "://" + info.path
            pieces += [Piece(uri, lo, min(lo + self.split, info.size), names) for lo in range(len(head), info.size, self.split)]
        if not pieces:
            raise ValueError(f"{self.path} has no block rows")
        return pieces

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        fs, at = _filesystem(piece.path)
        places = [piece.names.index(c) for c in "xyz"]
        block = piece.names.index("block") if "block" in piece.names else None
        width = len(piece.names)
        schema = pa.schema([*((c, pa.int32()) for c in "xyz"), ("block", pa.string())])
        with fs.open_input_file(at) as f:
            lines = _lines(f, piece.start, piece.end)
            rows = csv.reader(line for line in lines if line.strip())
            while part := list(islice(rows, ROWS)):
                cells: list[list] = [[], [], [], []]
                for r in part:
                    if block is not None and len(r) > width:  # bare commas: the surplus is the state's
                        extra = len(r) - width
                        r[block : block + extra + 1] = [",".join(r[block : block + extra + 1])]
                    for to, k in zip(cells, places):
                        to.append(int(r[k]))
                    cells[3].append((r[block].strip() if block is not None and block < len(r) else "") or self.default)
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cells, schema)], schema=schema)


def _first_line(f: pa.NativeFile) -> bytes:
    head = b""
    while b"\n" not in head:
        more = f.read(1 << 12)
        if not more:
            return head
        head += more
    return head[: head.index(b"\n") + 1]


def _lines(f: pa.NativeFile, start: int, end: int) -> Iterator[str]:
    """Lines that start in [start, end): a piece that begins inside a line leaves it to the one before."""
    at = start - 1  # the header's end, or a byte of the piece before: a line begins after the next line break
    f.seek(at)
    left, skip = b"", True
    while True:
        more = f.read(1 << 20)
        data = left + more
        if not data:
            return
        lines = data.split(b"\n")
        left = lines.pop() if more else b""
        for line in lines:
            if not skip:
                if at >= end:
                    return
                yield line.decode().rstrip("\r")
            skip = False
            at += len(line) + 1
        if not more or at >= end and not skip:
            return


def read_block_table(spark: SparkSession, path: str, default: str = DEFAULT_BLOCK):
    spark.dataSource.register(BlockTable)
    return spark.read.format("block_table").option("default", default).load(path)
