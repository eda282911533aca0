"""Toxicity (operator 8): a linear-chain conditional random field over the words of whole texts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import shared_folder
from . import _text as X
from ._repeats import fingerprint

#: The fit's only bound: labelled documents to learn from (those of smallest hashed id).  All their features are counted, all
#: that mark toxic documents are kept, and so is every sequence around a marked word.  Scoring has no bound.
TRAIN_DOCUMENTS = 24_000
#: Features are a word and its prefixes of so many bytes, its shape, and whether its neighbours are marked.
PREFIXES = (3, 4, 5, 6, 7)
SHAPES = 12
#: A mark stands in so many toxic documents, and so large a share of all documents that hold it are toxic.
LEAST_TOXIC, LEAST_SHARE = 3, 0.5
PRIOR_DOCUMENTS = 3
#: Words on each side of a training sequence's centre; one in so many words without a mark is a centre and weighs as many;
#: rounds of training.
CONTEXT, SPACING, ROUNDS = 5, 200, 150
THRESHOLD = 0.7
WORD_BYTE = np.array([chr(i).isalnum() and i < 128 or i >= 128 for i in range(256)])


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.concatenate([[False], WORD_BYTE[data], [False]])
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
    first[edge], last[edge - 1] = inside[1:-1][edge], inside[1:-1][edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """words x features: the lower-cased word, and its prefixes where they are shorter than it (else 0)."""
    fp = fingerprint(31)
    pre = fp.prefix(X.LOWER[data])
    out = np.zeros((len(starts), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = fp.slices(pre, starts, ends)
    for k, size in enumerate(PREFIXES, 1):
        long = np.flatnonzero(ends - starts > size)
        out[long, k] = fp.slices(pre, starts[long], starts[long] + size) ^ np.uint64(0xABCDEF * size)
    return out


def _document_counts(chosen: np.ndarray | None):
    """feature, n_toxic, n_clean: documents of this task that hold a feature (of the chosen ones)."""

    def scan(batches):
        rows = {0: [], 1: []}
        for batch in batches:
            toxic = X.column_ints(batch, "toxic")
            for lo, hi, data, off in X.blocks(batch, "text"):
                starts, ends, word_off = _words(data, off)
                f = _features(data, starts, ends)
                doc = np.repeat(np.repeat(np.arange(lo, hi), np.diff(word_off)), f.shape[1])
                f = f.reshape(-1)
                keep = f != 0
                if chosen is not None:
                    keep &= _known(chosen, f)
                doc, f = doc[keep], f[keep]
                o = np.lexsort((f, doc))
                doc, f = doc[o], f[o]
                new = np.ones(len(f), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (f[1:] != f[:-1])
                for label in (0, 1):
                    rows[label].append(f[new][toxic[doc[new]] == label])
        one, zero = (np.unique(np.concatenate(rows[label]) if rows[label] else np.zeros(0, np.uint64), return_counts=True) for label in (1, 0))
        feature = np.concatenate([one[0], zero[0]])
        yield pa.RecordBatch.from_arrays([pa.array(X.i64(feature)), pa.array(np.concatenate([one[1], 0 * zero[1]]).astype(np.int64)), pa.array(np.concatenate([0 * one[1], zero[1]]).astype(np.int64))], names=["feature", "n_toxic", "n_clean"])

    return scan


def _known(ordered: np.ndarray, f: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(f.shape, bool)
    at = np.minimum(np.searchsorted(ordered, f), len(ordered) - 1)
    return ordered[at] == f


COUNTS = "feature long, n_toxic long, n_clean long"


class Marks:
    """Features that mark toxic documents, sorted, with the documents that hold each: toxic ones and all."""

    def __init__(self, features: np.ndarray, n_toxic: np.ndarray, n_all: np.ndarray, base: float):
        o = np.argsort(features)
        self.features, self.n_toxic, self.n_all, self.base = features[o], n_toxic[o], n_all[o], base

    def trust(self, less_toxic: int = 0, less_all: int = 0) -> np.ndarray:
        """Each mark's share of toxic documents, shrunk to the base rate as if PRIOR_DOCUMENTS more had been seen, without so
        many documents of its own (0 where the rest wouldn't make it a mark); the last entry is for no mark."""
        toxic, every = self.n_toxic - less_toxic, self.n_all - less_all
        out = (toxic + PRIOR_DOCUMENTS * self.base) / (every + PRIOR_DOCUMENTS)
        return np.append(np.where((toxic >= LEAST_TOXIC) & (toxic >= LEAST_SHARE * every), out, 0.0), 0.0)

    def numbers(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """words x features: numbers of marks (their number: none), then of shapes and of marked neighbours; with the words'
        starts, ends and rows' offsets."""
        starts, ends, word_off = _words(data, off)
        f, none = _features(data, starts, ends), len(self.features)
        known = _known(self.features, f)
        marked = known.any(axis=1)
        out = np.full((len(starts), f.shape[1] + 3), none, np.int32)
        out[:, :-3][known] = np.searchsorted(self.features, f[known])
        out[:, -3] = none + 1 + _shapes(data, starts, ends)
        inner = np.ones(len(starts) + 1, bool)
        inner[word_off] = False
        out[1:, -2][marked[:-1] & inner[1:-1]] = none + 1 + SHAPES
        out[:-1, -1][marked[1:] & inner[1:-1]] = none + 2 + SHAPES
        return out, starts, ends, word_off

    @property
    def columns(self) -> int:
        """Marks, none, shapes and neighbours."""
        return len(self.features) + 3 + SHAPES


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Lower case, capitalised, upper case or with digits, of up to three, up to eight or more bytes."""
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    digit = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    n, capital = ends - starts, upper[ends] - upper[starts]
    kind = np.select([digit[ends] > digit[starts], 2 * capital > n, capital > 0], [3, 2, 1], 0)
    return kind * 3 + np.select([n <= 3, n <= 8], [0, 1], 2)


def marking_features(train: DataFrame) -> Marks:
    """Features that stand in LEAST_TOXIC toxic documents or more, LEAST_SHARE of all that hold them, and more often than
    chance alone makes likely."""
    total = lambda df: df.groupBy("feature").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))
    often = total(train.where("toxic = 1").mapInArrow(_document_counts(None), COUNTS)).where(f"n_toxic >= {LEAST_TOXIC}")
    chosen = np.sort(X.U64(1) * often.select("feature").toArrow()["feature"].to_numpy().view(np.uint64))  # of the bounded labelled texts
    toxic, all_docs = train.agg(F.sum("toxic"), F.count("*")).first()
    base = min(max((toxic or 0) / max(all_docs, 1), 1e-6), 1 - 1e-6)
    both = total(train.mapInArrow(_document_counts(chosen), COUNTS)).where(f"n_toxic >= {LEAST_SHARE} * (n_toxic + n_clean)")
    n, share = F.col("n_toxic") + F.col("n_clean"), F.col("n_toxic") / (F.col("n_toxic") + F.col("n_clean"))
    clean = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    both = both.where(n * (share * F.log(share / base) + clean) > 0.5 * float(np.log(10 * max(len(chosen), 1))))
    best = both.toArrow()
    n_toxic = best["n_toxic"].to_numpy()
    return Marks(best["feature"].to_numpy().view(np.uint64), n_toxic, n_toxic + best["n_clean"].to_numpy(), base if toxic else 0.0)


def _sequences(marks: Marks):
    """Training sequences: the features and tags of CONTEXT words around a centre, which is a marked word or one in SPACING of
    the others, by a hash of its place and its text's length (so rows that share a block don't matter).  A word is tagged
    toxic if it is marked and its document is; tag -1 stands beyond a text's ends."""

    def scan(batches):
        for batch in batches:
            toxic = X.column_ints(batch, "toxic")
            for lo, hi, data, off in X.blocks(batch, "text"):
                number, starts, _, word_off = marks.numbers(data, off)
                n = np.diff(word_off)
                row = np.repeat(np.arange(hi - lo), n)
                marked = (number[:, :-3] < len(marks.features)).any(axis=1)
                place = np.arange(len(starts)) - word_off[row]
                drawn = X.mix((n[row].astype(X.U64) << X.U64(32)) + place.astype(X.U64)) % X.U64(SPACING) == 0
                centre = np.flatnonzero(marked | drawn)
                at = centre[:, None] + np.arange(-CONTEXT, CONTEXT + 1)
                valid = (at >= word_off[row[centre]][:, None]) & (at < word_off[row[centre] + 1][:, None])
                at = np.where(valid, at, 0)
                tags = np.where(valid, marked[at] & (toxic[lo + row[centre]] == 1)[:, None], -1).astype(np.int8)
                feats = np.where(valid[:, :, None], number[at], len(marks.features)).astype(np.int32)
                weight = np.where(marked[centre], 1, SPACING).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in feats], pa.binary()), pa.array([x.tobytes() for x in tags], pa.binary()), pa.array(weight)], names=["features", "tags", "weight"])

    return scan


class Crf:
    """Two tags (0 clean, 1 toxic); a word's score for tag 1 is bias plus its features' weights; step[a, b] scores a change of tag."""

    def __init__(self, marks: Marks, weights: np.ndarray, bias: float, step: np.ndarray, slope: float = 1.0, offset: float = 0.0):
        self.marks, self.weights, self.bias, self.step, self.slope, self.offset = marks, weights, bias, step, slope, offset

    @staticmethod
    def _chains(unary: np.ndarray, valid: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of tag 1 for words x chains of scores, and the marginals of each pair of tags of neighbours (words - 1 x
        2 x 2 x chains), by the odds of the two tags; words that are not valid are skipped."""
        wide, m = len(unary), np.exp(step)
        odds = np.exp(np.clip(unary, -30, 30))
        forward, after = odds.copy(), np.ones_like(odds)
        for k in range(1, wide):
            f = np.minimum(forward[k - 1], 1e15)
            forward[k] = odds[k] * np.where(valid[k - 1], (m[0, 1] + m[1, 1] * f) / (m[0, 0] + m[1, 0] * f), 1.0)
        for k in range(wide - 1, 0, -1):
            g = np.minimum(odds[k] * after[k], 1e15)
            after[k - 1] = np.where(valid[k], (m[1, 0] + m[1, 1] * g) / (m[0, 0] + m[0, 1] * g), 1.0)
        both = np.minimum(forward, 1e15) * after
        f, g = np.minimum(forward[:-1], 1e15), np.minimum(odds[1:] * after[1:], 1e15)
        pair = np.stack([np.stack([np.full_like(f, m[0, 0]), m[0, 1] * g], axis=1), np.stack([m[1, 0] * f, m[1, 1] * f * g], axis=1)], axis=1)
        return both / (1 + both), pair / pair.sum(axis=(1, 2), keepdims=True)

    @classmethod
    def fit(cls, marks: Marks, features: np.ndarray, tags: np.ndarray, often: np.ndarray) -> Crf:
        """Gradient ascent on the likelihood of tagged sequences, with a little shrinkage; often: how often each one counts."""
        k, size, tags = len(marks.features), marks.columns, np.ascontiguousarray(tags.T)
        valid, y = tags >= 0, (tags == 1).astype(float)
        features = np.ascontiguousarray(features.transpose(1, 0, 2))
        flat = features.reshape(-1)
        weights, bias, step = np.zeros(size), -2.0, np.zeros((2, 2))
        squares = [np.full(size, 1e-3), 1e-3, np.full((2, 2), 1e-3)]
        both = (valid[:-1] & valid[1:]) * often
        seen = np.array([[(both * ((tags[:-1] == a) & (tags[1:] == b))).sum() for b in (0, 1)] for a in (0, 1)])
        n = max(len(often), 1)
        for _ in range(ROUNDS):
            p, pairs = cls._chains(bias + weights[features].sum(axis=2), valid, step)
            error = np.where(valid, y - p, 0.0) * often
            g = np.bincount(flat, np.repeat(error.reshape(-1), features.shape[2]), minlength=size)
            g[k] = 0
            grads = [g / n - 1e-6 * weights, error.sum() / n - 1e-6 * bias, (seen - np.einsum("kabn,kn->ab", pairs, both)) / n - 1e-6 * step]
            for i, grad in enumerate(grads):
                squares[i] = squares[i] + np.square(grad)
            weights, bias, step = (x + 0.5 * grad / np.sqrt(s) for x, grad, s in zip((weights, bias, step), grads, squares))
        return cls(marks, weights, float(bias), step)

    def marginals(self, unary: np.ndarray, word_off: np.ndarray) -> np.ndarray:
        """Marginals of tag 1 at all words of many texts, by forward-backward on the odds of the two tags; unary: each word's
        score.  Texts step together, the longest first, so that those still running are a slice."""
        n = np.diff(word_off)
        order = np.argsort(-n, kind="stable")
        start, size = word_off[:-1][order], n[order]
        odds, m = np.exp(np.clip(unary, -30, 30)), np.exp(self.step)
        running = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
        forward, after = odds.copy(), np.ones(len(unary))
        for t in range(1, len(running)):
            at = start[: running[t]] + t
            f = np.minimum(forward[at - 1], 1e15)
            forward[at] = odds[at] * (m[0, 1] + m[1, 1] * f) / (m[0, 0] + m[1, 0] * f)
        for t in range(len(running) - 1, 0, -1):
            at = start[: running[t]] + t
            g = np.minimum(odds[at] * after[at], 1e15)
            after[at - 1] = (m[1, 0] + m[1, 1] * g) / (m[0, 0] + m[0, 1] * g)
        both = np.minimum(forward, 1e15) * after
        return both / (1 + both)

    def evidence(self, data: np.ndarray, off: np.ndarray, trust: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        """Log odds of each row that one of its words is toxic, from every word's marginal times its marks' trust (the base rate
        for a word without marks); then the rows, starts, ends and marginals of the words that the field tags.
        trust: (numbers of marks, rows) -> their trust."""
        number, starts, ends, word_off = self.marks.numbers(data, off)
        p = self.marginals(self.bias + self.weights[number].sum(axis=1), word_off)
        row = np.repeat(np.arange(len(off) - 1), np.diff(word_off))
        marked = (number[:, :-3] < len(self.marks.features)).any(axis=1)
        sure = np.full(len(p), self.marks.base)
        sure[marked] = trust(number[marked, :-3], row[marked]).max(axis=1, initial=0.0)
        none = np.bincount(row, np.log1p(-np.minimum(sure * p, 1 - 1e-9)), len(off) - 1) + np.log1p(-FLOOR)
        hit = np.flatnonzero(p >= 0.5)
        return np.log(np.maximum(-np.expm1(none), 1e-12)) - none, row[hit], starts[hit], ends[hit], p[hit]

    def score(self, odds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * odds + self.offset, -30, 30)))


#: The chance that a text without any word is toxic, before calibration.
FLOOR = 0.01


def _left_out_odds(crf: Crf):
    """odds, toxic of labelled texts, where each text's own label is taken out of its marks' trust."""

    def scan(batches):
        trusts = np.stack([crf.marks.trust(label, 1) for label in (0, 1)])
        for batch in batches:
            toxic = X.column_ints(batch, "toxic")
            for lo, hi, data, off in X.blocks(batch, "text"):
                odds = crf.evidence(data, off, lambda number, row: trusts[toxic[lo + row][:, None], number])[0]  # noqa: B023
                yield pa.RecordBatch.from_arrays([pa.array(odds), pa.array(toxic[lo:hi])], names=["odds", "toxic"])

    return scan


def calibration(odds: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic regression of toxic on odds, by Newton's method with a little shrinkage to (1, 0)."""
    w, x = np.array([1.0, 0.0]), np.stack([odds, np.ones(len(odds))], axis=1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - toxic) + (w - [1.0, 0.0])
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), gradient)
    return max(float(w[0]), 1e-3), float(w[1])


def train_crf(labelled: DataFrame) -> Crf:
    """labelled: doc_id, text, toxic; at most TRAIN_DOCUMENTS of them.  The last step fits how a text's odds become a score."""
    marks = marking_features(labelled)
    rows = labelled.mapInArrow(_sequences(marks), "features binary, tags binary, weight long")
    rows = rows.groupBy("features", "tags").agg(F.sum("weight").alias("weight")).orderBy("features", "tags").toArrow()
    if not rows.num_rows:
        return Crf(marks, np.zeros(marks.columns), -2.0, np.zeros((2, 2)))
    wide = 2 * CONTEXT + 1
    features = np.frombuffer(b"".join(x.as_py() for x in rows["features"]), np.int32).reshape(-1, wide, 4 + len(PREFIXES))
    tags = np.frombuffer(b"".join(x.as_py() for x in rows["tags"]), np.int8).reshape(-1, wide)
    crf = Crf.fit(marks, features, tags, rows["weight"].to_numpy())
    known = labelled.mapInArrow(_left_out_odds(crf), "odds double, toxic long").orderBy("odds", "toxic").toArrow()  # one number a labelled document
    crf.slope, crf.offset = calibration(known["odds"].to_numpy(), known["toxic"].to_numpy())
    return crf


def score_texts(docs: DataFrame, crf) -> DataFrame:
    """doc_id, score, spans (start and end byte and marginal of each offending word); crf: a broadcast ``Crf``."""

    def scan(batches):
        model: Crf = crf.value
        trust = model.marks.trust()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))
        for batch in batches:
            for lo, hi, data, off in X.blocks(batch, "text"):
                odds, row, starts, ends, p = model.evidence(data, off, lambda number, _: trust[number])
                spans: list[list] = [[] for _ in range(hi - lo)]
                for r, a, b, q in zip(row.tolist(), (starts - off[row]).tolist(), (ends - off[row]).tolist(), p.tolist()):
                    spans[r].append({"start": a, "end": b, "marginal": q})
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(model.score(odds)), pa.array(spans, kind)], names=["doc_id", "score", "spans"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, spans array<struct<start:long,end:long,marginal:double>>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every whole text; labels: doc_id and toxic (1 or 0), to learn from.

    Words that mark toxic documents are tagged in the labelled texts, and a linear-chain field over all words is fitted to those
    tags by their prefixes, shapes and neighbours.  Its forward-backward marginals, those of all words, each times its mark's
    trust or the base rate, give the odds that a text has a toxic word; how odds become scores is fitted to the labelled
    texts, each judged without its own label.  How rows are laid out in partitions changes nothing.

    Returns doc_id, score, spans (byte offsets of the words that the field tags), one row per input row.  A null or empty text
    has the score of one without words.  Null ids or labels take no part in learning; with no labels every score is that
    one.  Repeated rows score alike; other columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    some = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCUMENTS)  # bounded, so it may be broadcast
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id").checkpoint()
    return score_texts(docs, spark.sparkContext.broadcast(train_crf(labelled)))


def op8_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    scored = toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))
