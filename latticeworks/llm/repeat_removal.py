"""Substring dedup over words (operator 1) and suffix dedup over bytes (operator 10)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._repeats import Plan, numbered, repeated_starts

WORD_WINDOW = 20
BYTE_WINDOW = 400


def _marked(batch: pa.RecordBatch, lo: int, hi: int, unit_off: np.ndarray, width: int) -> np.ndarray:
    """Which of a block's symbols are covered by a repeated window of their row."""
    runs = batch.column(batch.schema.get_field_index("starts"))
    lists = runs.offsets.to_numpy()
    a, b = lists[lo], lists[hi]
    row = np.repeat(np.arange(hi - lo), np.diff(lists[lo : hi + 1]))
    start = runs.values.field("start").to_numpy(zero_copy_only=False)[a:b]
    size = runs.values.field("size").to_numpy(zero_copy_only=False)[a:b].astype(np.int64)
    begin, end = unit_off[row] + start, unit_off[row + 1]
    n = int(unit_off[-1])
    change = np.bincount(np.minimum(begin, end), minlength=n + 1) - np.bincount(np.minimum(begin + size - 1 + width, end), minlength=n + 1)
    return np.cumsum(change)[:n] > 0


def _binary(data: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.Array.from_buffers(kind, len(off) - 1, [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def _cut_words(batches):
    for batch in batches:
        ids, turns = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "turn"))
        for lo, hi, data, off in X.blocks(batch, "text"):
            starts, ends, word_off = X.words(data, off)
            gone = _marked(batch, lo, hi, word_off, WORD_WINDOW)
            row = np.searchsorted(off, starts, "right") - 1
            kept = np.flatnonzero(~gone)
            edge = np.zeros(len(data) + 1, np.int8)
            edge[starts[kept]] += 1
            edge[ends[kept]] -= 1
            keep = np.cumsum(edge[:-1]) > 0
            more = kept[:-1][row[kept[:-1]] == row[kept[1:]]]
            out = data.copy()
            out[ends[more]] = 32
            keep[ends[more]] = True
            new_off = np.concatenate([[0], np.cumsum(keep)])[off]
            yield pa.RecordBatch.from_arrays(
                [ids[lo:hi], turns[lo:hi], pa.array(np.diff(word_off).astype(np.int64)), pa.array(_sums(gone, word_off)), _binary(out[keep], new_off, pa.string())],
                names=["doc_id", "turn", "n_words", "n_removed", "kept_text"],
            )


def _cut_bytes(batches):
    for batch in batches:
        ids, turns = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "turn"))
        for lo, hi, data, off in X.blocks(batch, "text"):
            gone = _marked(batch, lo, hi, off, BYTE_WINDOW)
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            inner = off[:-1][(np.diff(off) > 0)]
            opens[inner] = gone[inner]
            yield pa.RecordBatch.from_arrays(
                [ids[lo:hi], turns[lo:hi], pa.array(np.diff(off).astype(np.int64)), pa.array(_sums(gone, off)), pa.array(_sums(opens, off)), _binary(data[~gone], np.concatenate([[0], np.cumsum(~gone)])[off], pa.binary())],
                names=["doc_id", "turn", "n_bytes", "n_removed", "n_spans", "kept"],
            )


def _apply(docs: DataFrame, plan: Plan, cut, schema: str) -> DataFrame:
    texts = numbered(docs, plan.first)
    none = F.expr("cast(array() as array<struct<start:int,size:int>>)")
    joined = texts.select("doc_id", "turn", "text").join(repeated_starts(texts, plan), ["doc_id", "turn"], "left").withColumn("starts", F.coalesce("starts", none))
    return joined.mapInArrow(cut, schema)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """Remove the words of every 20-word window that also starts earlier in the corpus.

    Words are runs of anything but the space and bytes 9 to 13.  "Earlier" is a smaller doc_id, or the same document and an
    earlier start; windows are judged on the input.  Anchors that windows share are joined and extended both ways to whole
    runs of windows (see ``_repeats``), so the cost follows the text and not the pairs of its copies.

    Returns doc_id, turn, n_words, n_removed, kept_text (the kept words joined by one space), one row per input row.  A null text
    has no words and an empty kept_text.  A null doc_id is kept as it is, unjudged.  Rows of one doc_id follow each other by
    their texts, each judged on its own, so one of several equal rows keeps what no other document has earlier; ``turn`` (0
    for the first) tells them apart.  Other columns are ignored.
    """
    return _apply(docs, Plan(WORD_WINDOW, 6, 15, True, True), _cut_words, "doc_id long, turn int, n_words long, n_removed long, kept_text string")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """Remove the bytes of every 400-byte string that also starts anywhere else in the corpus, the same document included.

    Matches never cross documents; overlaps count; strings are judged on the input.  Equal fingerprints
    of winnowed anchors replace prefix doubling of every position (see the README): sampled positions are compared by the core
    around their anchor, then by the whole run, then single positions by the pair of fingerprints of their first and second
    200 bytes; a position leaves the sort as soon as it is unique or known to repeat over 400 bytes.

    Returns doc_id, turn, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes), one row per input row.
    Equal rows (of doc_id and text) are one document given twice and both get that document's result; different texts under
    one doc_id are documents of their own.  Nulls and other columns as in ``substring_dedup``.
    """
    return _apply(docs, Plan(BYTE_WINDOW, 32, 96, False, False), _cut_bytes, "doc_id long, turn int, n_bytes long, n_removed long, n_spans long, kept binary")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(_documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s FROM t WHERE len(w) >= 20),
g AS (SELECT p.doc_id, p.s, array_to_string(t.w[p.s : p.s + 19], ' ') AS g FROM p JOIN t USING (doc_id)),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM r WHERE k > 1),
l AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM t LEFT JOIN l USING (doc_id)
"""
