"""Whole files written and read by tasks through a URI (local, HDFS or an object store, as pyarrow supports)."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs


def _local(uri: str) -> str | None:
    return "/" + uri.split(":", 1)[1].lstrip("/") if uri.startswith("file:") else None


@contextmanager
def replaced(uri: str) -> Iterator:
    """A stream whose file appears under its name only when it is whole, so that a task can be run again or twice at once."""
    path, attempt = _local(uri), f".{uuid.uuid4().hex}"
    if path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path + attempt, "wb") as f:
            yield f
        os.replace(path + attempt, path)
        return
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path + attempt) as f:
        yield f
    fs.move(path + attempt, path)


def opened(uri: str):
    """A seekable file to read."""
    path = _local(uri)
    if path:
        return open(path, "rb")
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)
