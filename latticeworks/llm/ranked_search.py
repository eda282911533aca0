"""Ranked lexical search over hashed max-sketches (operator 12).

A document's score for a query adds up, over the query's terms, the term's weight times its impact in the document, which
grows with the term's occurrences.  A sketch hashes the document's terms to a power of two of cells and keeps in each cell the
most occurrences of a term there, so the cell of any term bounds its impact from above, and one look-up a term bounds a
document's score.  Documents are rescored from their whole texts in descending order of bounds, until no bound is left that
reaches the score of the k-th best.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import shared_folder
from . import _text as X
from ._components import written
from ._pretokens import _same
from ._repeats import fingerprint

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes between terms: ASCII but for digits and letters.
BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Cells of a sketch for each distinct term, rounded up to a power of two; a cell of FULL holds so many occurrences or more.
CELLS_A_TERM, LEAST_CELLS, FULL = 12, 64, 255
#: Documents a query that are rescored in the first rounds, the best bounds first; a last round takes all that are left.
ROUNDS = (40, 640)
#: Queries that are looked up at once, and (document, query) pairs up to which document ids are sent to the texts.
BLOCK, SEND_PAIRS = 512, 200_000
#: Documents times terms of the queries that are looked up at once.
AT_ONCE = 1 << 19


def _words(data: np.ndarray, off: np.ndarray):
    """Bytes in lower case, starts and ends of terms, the rows' n + 1 offsets in them, and the terms' fingerprints."""
    low = X.LOWER[data]
    starts, ends, at = X.words(low, off, BETWEEN)
    return low, starts, ends, at, X.word_symbols(fingerprint(31), low, starts, ends)


def _place(fp: np.ndarray) -> np.ndarray:
    return (X.mix(fp) >> np.uint64(24)).astype(np.int64)


def _sketches(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        for lo, hi, data, off in X.blocks(batch, "text"):
            *_, at, fp = _words(data, off)
            n = np.diff(at)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((fp, row))
            fp, row = fp[order], row[order]
            first = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (row[1:] != row[:-1])])) if len(fp) else np.zeros(0, np.int64)
            found, fp, row = np.diff(np.append(first, len(fp))), fp[first], row[first]
            distinct = np.bincount(row, minlength=len(n))
            cells = np.where(distinct, np.maximum(LEAST_CELLS, 1 << np.ceil(np.log2(np.maximum(1, distinct * CELLS_A_TERM))).astype(np.int64)), 0)
            flat, base = np.zeros(int(cells.sum()), np.uint8), np.cumsum(cells) - cells
            np.maximum.at(flat, base[row] + (_place(fp) & (cells[row] - 1)), np.minimum(found, FULL).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n), X.binaries(flat, cells)], schema=schema)


def sketch_index(docs: DataFrame) -> DataFrame:
    """doc_id, n (terms with repeats) and sketch of each row of docs, written; it serves any queries."""
    shared_folder(docs.sparkSession)
    return written(_texts(docs).mapInArrow(_sketches, "doc_id long, n long, sketch binary"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


@dataclass
class Queries:
    """A block of queries: their distinct terms, and for each query where its terms are, how often it has them and its limits."""

    terms: list[bytes]
    of: np.ndarray  # a query's distinct terms, one query after another
    times: np.ndarray
    start: np.ndarray  # n + 1 offsets

    def __post_init__(self) -> None:
        size = np.fromiter(map(len, self.terms), np.int64, len(self.terms))
        self.raw, self.end = np.frombuffer(b"".join(self.terms), np.uint8), np.cumsum(size)
        fp = X.word_symbols(fingerprint(31), self.raw, self.end - size, self.end)
        self.order = np.argsort(fp)
        self.fp = fp[self.order]
        if (self.fp[1:] == self.fp[:-1]).any():
            raise ValueError("two terms of the queries have one fingerprint")
        self.size, self.cell = size, _place(fp)

    def found(self, data: np.ndarray, off: np.ndarray):
        """Row, term and occurrences of every term of the queries in each row, told by its bytes; and the rows' numbers of terms."""
        low, starts, ends, at, fp = _words(data, off)
        k = np.minimum(np.searchsorted(self.fp, fp), len(self.fp) - 1)
        hit = np.flatnonzero(self.fp[k] == fp)
        term, size = self.order[k[hit]], (ends - starts)[hit]
        alike = np.flatnonzero(self.size[term] == size)
        hit, term, size = hit[alike], term[alike], size[alike]
        equal = _same(low, starts[hit], self.raw, (self.end - self.size)[term], size)
        code, times = np.unique(np.searchsorted(at, hit[equal], "right") * len(self.fp) + term[equal], return_counts=True)
        return code // len(self.fp) - 1, code % len(self.fp), times, np.diff(at)

    def weigh(self, documents: int, terms: int, holding: np.ndarray) -> None:
        """Set the weights, and leave out terms that no document has and queries without others."""
        self.documents, self.all_terms = documents, terms
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * h + 1))) for h in holding.tolist()], np.int64)
        query = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        there = holding[self.of] > 0
        self.of, self.weight, query = self.of[there], (weight[self.of] * self.times)[there], query[there]
        self.asked, self.start = np.unique(query, return_index=True)

    def slope(self, n: np.ndarray) -> np.ndarray:
        """Twelve times m of documents of n terms."""
        return 12 * (75 + 25 * n * self.documents // max(1, self.all_terms))


def _impact(times: np.ndarray, slope: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * times // (1000 * times + slope)


def _holding(queries: Queries):
    def scan(batches):
        total = np.zeros(len(queries.terms), np.int64)
        for batch in batches:
            for *_, data, off in X.blocks(batch, "text"):
                total += np.bincount(queries.found(data, off)[1], minlength=len(total))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["term", "holding"])

    return scan


class _Best:
    """The k best of each query seen so far: (query, bound, document)."""

    def __init__(self, queries: int, k: int | None):
        self.k, self.parts, self.held = k, [], 0
        self.least = np.zeros(queries, np.int64)

    def add(self, query: np.ndarray, bound: np.ndarray, doc: np.ndarray) -> None:
        self.parts.append((query, bound, doc))
        self.held += len(query)
        if self.held > 4 * len(self.least) * self.k:
            self.prune()

    def prune(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, bound, doc = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((doc, -bound, query))
        query, bound, doc = query[order], bound[order], doc[order]
        place = X.ranges(np.bincount(query, minlength=len(self.least)))
        full = place == self.k - 1
        self.least[query[full]] = bound[full]
        kept = place < self.k
        self.parts = [(query[kept], bound[kept], doc[kept])]
        self.held = int(kept.sum())
        return self.parts[0]


def _bounds(queries: Queries, least: np.ndarray, seen: np.ndarray, k: int | None):
    """Pairs whose bound is at least the query's least and that come after the last seen one (bound, doc_id) of the query; the
    k best of each query only, if k is given."""

    def batch_of(query, bound, doc):
        return pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(bound), pa.array(doc)], names=["query", "bound", "doc_id"])

    times = np.arange(FULL + 1)

    def scan(batches):
        best = _Best(len(least), k)
        for batch in batches:
            doc, n = X.column_ints(batch, "doc_id"), X.column_ints(batch, "n")
            data, off = X.column_bytes(batch, "sketch")
            step = max(1, AT_ONCE // (len(queries.cell) + len(queries.of) + 1))
            for lo in range(0, len(doc), step):
                hi = min(len(doc), lo + step)
                at, cells = off[lo:hi, None], np.diff(off[lo : hi + 1])[:, None]
                impact = _impact(times, queries.slope(n[lo:hi])[:, None])
                impact[:, FULL] = 1_000_000  # what no number of occurrences reaches
                held = np.take_along_axis(impact, data[at + (queries.cell & (cells - 1))].astype(np.int64), 1)
                bound = np.add.reduceat(held[:, queries.of] * queries.weight, queries.start, axis=1)
                after = (bound < seen[:, 0]) | ((bound == seen[:, 0]) & (doc[lo:hi, None] > seen[:, 1]))
                row, query = np.nonzero(after & (bound >= np.maximum(least, best.least)))
                found = (query, bound[row, query], doc[lo:hi][row])
                if k is None:
                    yield batch_of(*found)
                else:
                    best.add(*found)
        if k is not None:
            yield batch_of(*best.prune())

    return scan


def _exact(queries: Queries):
    """Scores of rows (doc_id, text, asked: queries)."""

    def scan(batches):
        size = np.diff(np.append(queries.start, len(queries.of)))
        for batch in batches:
            doc, asked = X.column_ints(batch, "doc_id"), batch.column(batch.schema.get_field_index("asked"))
            for lo, hi, data, off in X.blocks(batch, "text"):
                part = asked.slice(lo, hi - lo)
                row, query = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy()), part.flatten().to_numpy().astype(np.int64)
                at, term, times, n = queries.found(data, off)
                known = at * len(queries.terms) + term
                impact = np.append(_impact(times, queries.slope(n)[at]), 0)
                step = max(1, AT_ONCE // max(1, int(size.max(initial=1))))
                for k in range(0, len(row), step):
                    r, q = row[k : k + step], query[k : k + step]
                    where = np.repeat(queries.start[q], size[q]) + X.ranges(size[q])
                    wanted = np.repeat(r, size[q]) * len(queries.terms) + queries.of[where]
                    i = np.minimum(np.searchsorted(known, wanted), max(0, len(known) - 1))
                    i = np.where(known[i] == wanted, i, len(known)) if len(known) else np.full(len(wanted), 0)
                    score = np.add.reduceat(impact[i] * queries.weight[where], np.cumsum(size[q]) - size[q])
                    there = score > 0
                    yield pa.RecordBatch.from_arrays([pa.array(q[there].astype(np.int32)), pa.array(doc[lo:hi][r[there]]), pa.array(score[there])], names=["query", "doc_id", "score"])

    return scan


def _best(scores: DataFrame, k: int) -> DataFrame:
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")))
    return ranked.where(F.col("rank") <= k)


def _search_block(texts: DataFrame, index: DataFrame, queries: Queries, k: int) -> DataFrame | None:
    """query, doc_id, score, rank of one block of queries; None without queries that any document answers."""
    spark = texts.sparkSession
    count = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = np.zeros(len(queries.terms), np.int64)
    for r in texts.mapInArrow(_holding(queries), "term int, holding long").groupBy("term").agg(F.sum("holding").alias("holding")).collect():  # one row a term of the queries
        holding[r.term] = r.holding
    queries.weigh(*count, holding)
    if not len(queries.asked):
        return None
    ranked = index.where("n > 0 AND doc_id IS NOT NULL")
    least, seen = np.ones(len(queries.asked), np.int64), np.full((len(queries.asked), 2), np.iinfo(np.int64).max)
    scores = asked = None
    for limit in (*ROUNDS, None):
        pairs = ranked.mapInArrow(_bounds(queries, least, seen, limit), "query int, bound long, doc_id long")
        if limit:
            place = Window.partitionBy("query").orderBy(F.desc("bound"), "doc_id")
            pairs = pairs.withColumn("place", F.row_number().over(place)).where(F.col("place") <= limit)
        pairs = written(pairs)
        new = pairs.select("query", "doc_id").distinct()
        if asked is not None:  # of rows of one doc_id some may have come before
            new = new.join(asked, ["query", "doc_id"], "left_anti")
        asked = written(new) if asked is None else written(asked.unionByName(new))
        by_doc = new.groupBy("doc_id").agg(F.collect_list("query").alias("asked"))  # at most a block's queries a row
        by_doc = F.broadcast(by_doc) if pairs.limit(SEND_PAIRS + 1).count() <= SEND_PAIRS else by_doc
        found = texts.join(by_doc, "doc_id").select("doc_id", "text", "asked").mapInArrow(_exact(queries), "query int, doc_id long, score long")
        scores = written(_best(found if scores is None else scores.unionByName(found), k).drop("rank"))
        if limit is None:
            break
        # One row a query of the block: what the k-th best scores, and where the bounds went on.
        for r in scores.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).collect():
            least[r.query] = r.least if r.n == k else 1
        open_, last = np.zeros(len(least), bool), pairs.where(F.col("place") == limit).select("query", "bound", "doc_id").collect()
        for r in last:
            open_[r.query], seen[r.query] = r.bound >= least[r.query], (r.bound, r.doc_id)
        least[~open_] = np.iinfo(np.int64).max
        if not open_.any():
            break
    return _best(scores, k).join(F.broadcast(spark.createDataFrame(list(enumerate(queries.asked.tolist())), "query int, number long")), "query")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, index: DataFrame | None = None) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents of highest score for each item, equal scores by ascending doc_id.

    Whole texts count; a null or empty text has no terms.  Rows of one doc_id are documents of their own; a row without a
    doc_id counts in the statistics and is never a result.  Distinct rows (item_id, text) of items are queries; one without a
    term that a document has gives no rows.  Other columns are ignored.  ``index`` is ``sketch_index(docs)``, made here if it
    isn't given.  Queries are dealt into blocks of some BLOCK; terms of a block's queries are sent to every task, its documents
    are not: they are looked up by their sketches and, where the bound asks for it, by their texts.
    """
    spark, texts = docs.sparkSession, _texts(docs)
    index = sketch_index(docs) if index is None else index
    lower = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    blocks = max(1, math.ceil(asked.count() / BLOCK))
    terms = F.regexp_extract_all("lower", F.lit(TERM), 0).alias("terms")
    asked = written(asked.withColumn("lower", lower).select("item_id", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block"), terms))
    out = None
    for b in range(blocks):
        rows = asked.where(F.col("block") == b).select("item_id", "terms").collect()
        number: dict[bytes, int] = {}
        of, times, start = [], [], [0]
        for r in rows:
            counts: dict[int, int] = {}
            for t in r.terms:
                i = number.setdefault(t.encode(), len(number))
                counts[i] = counts.get(i, 0) + 1
            of += counts
            times += counts.values()
            start.append(len(of))
        if not of:
            continue
        found = _search_block(texts, index, Queries(list(number), np.array(of), np.array(times), np.array(start)), k)
        if found is None:
            continue
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"number long, item_id {items.schema['item_id'].dataType.simpleString()}")
        part = written(found.join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    return out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY doc_id),
g AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d), m AS (SELECT doc_id, 100 - 25 + (25 * n * n_docs) // n_terms AS m FROM d CROSS JOIN g),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f CROSS JOIN g GROUP BY term, n_docs),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20"""
