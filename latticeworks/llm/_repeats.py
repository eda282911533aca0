"""Repeated windows of a fixed width over symbol sequences (words or bytes) in a distributed table of texts.

Every window picks the smallest fingerprint among its k-grams as its *anchor*, so equal windows pick the same place.
Windows that follow each other and share an anchor (and a band of offsets to it) form one *run*, one row:

* ``core``: fingerprint of the symbols that every window of such a band must contain; equal windows lie in runs of equal core;
* ``whole``: fingerprint of the run's full extent; runs of equal core and whole have all their windows in common.

A run's place ``at`` is its row's turn (0, but for further rows of one doc_id) times 2**32, plus its first symbol's number.
Runs are exchanged by core and sorted by (core, whole, doc_id, at).  Where all runs of a core agree, the run is settled
at once.  Where they differ, one run of each content stays open, and its single windows are fetched from the texts and ranked
by the pair of fingerprints of their two halves.  Unique cores end in the first sort.

Copies within one task are folded before the exchange, so a core that a third of the rows share sends one row per task and
content; the sorted pass holds one row of state, however large a group is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as X

RUN = "core long, whole long, doc_id long, at long, meta int"
FOLD = 1 << 19


@dataclass(frozen=True)
class Plan:
    """width: symbols of a window; gram: symbols of an anchor; band: windows of a run at most; first: keep the first window
    of each content (else all of them are repeats); of_words: symbols are words, else bytes."""

    width: int
    gram: int
    band: int
    first: bool
    of_words: bool


def _sliding_argmin(v: np.ndarray, m: int) -> np.ndarray:
    """Place of the leftmost smallest of v[i:i+m], for each i with such a slice."""
    n = len(v) - m + 1
    val, at, have = v, np.arange(len(v), dtype=np.int32), 1
    while have < m:
        step = min(have, m - have)
        size = len(val) - step
        later = val[step:] < val[:size]
        val, at = np.where(later, val[step:], val[:size]), np.where(later, at[step:], at[:size])
        have += step
    return at[:n]


_fp: dict[int, X.Fingerprint] = {}


def fingerprint(seed: int) -> X.Fingerprint:
    if seed not in _fp:
        _fp[seed] = X.Fingerprint(seed)
    return _fp[seed]


def _symbols(plan: Plan, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not plan.of_words:
        return data, off
    starts, ends, word_off = X.words(data, off)
    return X.word_symbols(fingerprint(1), data, starts, ends), word_off


def _windows(plan: Plan, off: np.ndarray) -> np.ndarray:
    """Starts of all windows that lie within a row."""
    sizes = np.maximum(np.diff(off) - plan.width + 1, 0)
    return np.repeat(off[:-1], sizes) + X.ranges(sizes)


def _runs(plan: Plan, data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray] | None:
    sym, off = _symbols(plan, data, off)
    p = _windows(plan, off)
    if not len(p):
        return None
    fp = fingerprint(2)
    pre = fp.prefix(sym)
    at = np.arange(len(sym) - plan.gram + 1)
    gram = fp.slices(pre, at, at + plan.gram)
    anchor = _sliding_argmin(gram, plan.width - plan.gram + 1)[p]
    band = (anchor - p) // plan.band
    new = np.ones(len(p), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1) | (band[1:] != band[:-1])
    new[np.searchsorted(p, off[:-1][np.diff(off) >= plan.width])] = True
    i = np.flatnonzero(new)
    size = np.diff(np.append(i, len(p)))
    lo, a, b = p[i], anchor[i].astype(np.int64), band[i].astype(np.int64)
    core_lo = a - b * plan.band
    core = fp.slices(pre, core_lo, core_lo - plan.band + 1 + plan.width) ^ X.mix(b.astype(X.U64) + X.U64(77))
    whole = fp.slices(pre, lo, lo + size - 1 + plan.width) ^ X.mix((a - lo).astype(X.U64) + X.U64(99))
    row = np.searchsorted(off, lo, "right") - 1
    return {"core": X.i64(core), "whole": X.i64(whole), "row": row, "start": lo - off[row], "size": size.astype(np.int32)}


# meta = size * 4 + 2 * (some equal run is known) + (the run is settled as repeated)
def _batch(core, whole, doc, at, meta) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(core, pa.int64()), pa.array(whole, pa.int64()), pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(meta, pa.int32())], names=["core", "whole", "doc_id", "at", "meta"])


def _fold(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    """One row of each (core, whole) goes on; its copies within this task are settled."""
    if not parts:
        return
    core, whole, doc, at, meta = (np.concatenate(x) for x in zip(*parts))
    o = np.lexsort((at, doc, whole, core))
    core, whole, doc, at, meta = core[o], whole[o], doc[o], at[o], meta[o]
    again = np.zeros(len(core), bool)
    again[1:] = (core[1:] == core[:-1]) & (whole[1:] == whole[:-1])
    copied = np.zeros(len(core), bool)
    copied[:-1] = again[1:]
    meta = meta + np.where(again, 1, 0) + np.where(copied & ~again, 2, 0)
    core = np.where(again, X.i64(X.mix(doc.astype(np.uint64) + at.astype(np.uint64))), core)
    yield _batch(core, whole, doc, at, meta)


def _scan(plan: Plan) -> Callable:
    def scan(batches):
        parts, held = [], 0
        for batch in batches:
            docs, turns = X.column_ints(batch, "doc_id"), X.column_ints(batch, "turn")
            for lo, _, data, off in X.blocks(batch, "text"):
                if (r := _runs(plan, data, off)) is not None:
                    row = lo + r["row"]
                    parts.append((r["core"], r["whole"], docs[row], (turns[row] << 32) + r["start"], r["size"] * 4))
                    held += len(r["core"])
                if held >= FOLD:
                    yield from _fold(parts)
                    parts, held = [], 0
        yield from _fold(parts)

    return scan


def _settle(first: bool, windows: bool) -> Callable:
    """Pass over rows sorted by (core, whole, doc_id, at).  Rows settled as repeats carry an odd meta; open ones an even one."""

    def settle(batches):
        carry, known, several = None, False, False
        for batch in batches:
            core, whole, doc, place, meta = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            done = meta % 2 == 1
            if done.any():
                yield _batch(core[done], whole[done], doc[done], place[done], meta[done])
                core, whole, doc, place, meta = (x[~done] for x in (core, whole, doc, place, meta))
            if not len(core):
                continue
            if carry is not None:
                core, whole, doc, place, meta = (np.concatenate([[a], b]) for a, b in zip(carry, (core, whole, doc, place, meta)))
            new_core = np.ones(len(core), bool)
            new_core[1:] = core[1:] != core[:-1]
            new = new_core.copy()
            new[1:] |= whole[1:] != whole[:-1]
            at = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            count = np.bincount(run)
            count += np.bincount(run, (meta // 2) % 2 == 1).astype(np.int64)
            group = np.cumsum(new_core[at]) - 1
            contents = np.bincount(group)
            if carry is not None:
                count[0] += known
                contents[0] += several
            repeated = ~new
            ready = at[:-1]  # the last run may go on
            if not first:
                repeated[ready] = count[:-1] > 1
            yield _batch(core[repeated], whole[repeated], doc[repeated], place[repeated], meta[repeated] // 4 * 4 + 1)
            if not windows:
                still = ready[contents[group[:-1]] > 1]
                yield _batch(core[still], whole[still], doc[still], place[still], meta[still] // 4 * 4)
            last = at[-1]
            carry = core[last], whole[last], doc[last], place[last], meta[last]
            known, several = bool(count[-1] > 1), bool(contents[-1] > 1)
        if carry is not None:
            c = [np.array([x]) for x in carry]
            if not first and known:
                yield _batch(*c[:4], c[4] // 4 * 4 + 1)
            if not windows and several:
                yield _batch(*c[:4], c[4] // 4 * 4)

    return settle


def _open_windows(plan: Plan) -> Callable:
    """Single windows of open runs, with the fingerprints of their two halves."""

    def expand(batches):
        fp, parts, held = fingerprint(3), [], 0
        for batch in batches:
            docs, turns = X.column_ints(batch, "doc_id"), X.column_ints(batch, "turn")
            runs = batch.column(batch.schema.get_field_index("runs"))
            lists, flat = runs.offsets.to_numpy(), runs.values
            starts, sizes = flat.field("start").to_numpy(zero_copy_only=False), flat.field("size").to_numpy(zero_copy_only=False)
            for lo, hi, data, off in X.blocks(batch, "text"):
                sym, off = _symbols(plan, data, off)
                a, b = lists[lo], lists[hi]
                row = np.repeat(np.arange(hi - lo), np.diff(lists[lo : hi + 1]))
                n = sizes[a:b].astype(np.int64)
                start = np.repeat(starts[a:b].astype(np.int64), n) + X.ranges(n)
                row = np.repeat(row, n)
                at = off[row] + start
                pre, half = fp.prefix(sym), plan.width // 2
                one, two = fp.slices(pre, at, at + half), fp.slices(pre, at + half, at + plan.width)
                parts.append((X.i64(one), X.i64(two), docs[lo + row], (turns[lo + row] << 32) + start, np.full(len(at), 4, np.int32)))
                held += len(at)
                if held >= FOLD:
                    yield from _fold(parts)
                    parts, held = [], 0
        yield from _fold(parts)

    return expand


def _sorted_by_core(rows: DataFrame) -> DataFrame:
    return rows.repartition("core").sortWithinPartitions("core", "whole", "doc_id", "at")


def repeated_ids(docs: DataFrame) -> DataFrame:
    """The doc_id that several rows have; written, since most tables have none and a caller asks."""
    return docs.select("doc_id").where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id").checkpoint()


def with_turns(docs: DataFrame, name: str = "turn") -> DataFrame:
    """docs and a column that numbers the rows of one doc_id from 0 by their texts.

    A window function numbers the rows of repeated ids alone; equal rows may be numbered either way.
    """
    again, zero = repeated_ids(docs), F.lit(0).alias(name)
    if again.isEmpty():
        return docs.select("*", zero)
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("text")) - 1
    several = docs.join(again, "doc_id", "left_semi").select("*", turn.alias(name))
    return docs.join(again, "doc_id", "left_anti").select("*", zero).unionByName(several)


def numbered(docs: DataFrame, first: bool) -> DataFrame:
    """doc_id, turn, text, own: turn tells rows of one doc_id apart; own rows are searched.

    Where windows after the first are repeats (first), equal rows are a document and its copy; else they are one document.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if first:
        return with_turns(texts).withColumn("own", F.lit(True))
    again = repeated_ids(texts)
    once = lambda df: df.select("doc_id", F.lit(0).alias("turn"), "text", F.lit(True).alias("own"))
    if again.isEmpty():
        return once(texts)
    turn = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("text")) - 1
    own = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("text")) == 1
    several = texts.join(again, "doc_id", "left_semi").select("doc_id", turn.alias("turn"), "text", own.alias("own"))
    return once(texts.join(again, "doc_id", "left_anti")).unionByName(several)


def repeated_starts(texts: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, turn, starts array<struct<start, size>>): all windows [start, start + size) that are repeats, for each row of
    ``numbered`` texts with any.  Rows without a doc_id take no part."""
    searched = texts.where("own AND doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "turn", "text")
    runs = _sorted_by_core(searched.mapInArrow(_scan(plan), RUN)).mapInArrow(_settle(plan.first, False), RUN)
    runs = runs.select("doc_id", "at", "meta").checkpoint()
    turn, start = F.shiftright("at", 32).cast("int").alias("turn"), F.col("at").bitwiseAND(0xFFFFFFFF).cast("int").alias("start")
    placed = lambda df: df.select("doc_id", turn, start, F.expr("meta div 4").cast("int").alias("size"))
    gathered = lambda df, name: df.groupBy("doc_id", "turn").agg(F.collect_list(F.struct("start", "size")).alias(name))
    windows = searched.join(gathered(placed(runs.where("meta % 2 = 0")), "runs"), ["doc_id", "turn"]).mapInArrow(_open_windows(plan), RUN)
    ranked = _sorted_by_core(windows).mapInArrow(_settle(plan.first, True), RUN)
    return gathered(placed(runs.where("meta % 2 = 1")).unionByName(placed(ranked.where("meta % 2 = 1"))), "starts")
