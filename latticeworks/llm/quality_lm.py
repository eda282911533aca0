"""Quality classifier (operator 3): an interpolated modified Kneser-Ney model over the characters of trusted texts.

Grams are strings of up to ORDER characters, as they stand, so the model grows with the corpus and its scripts.  Counts,
histories and lower orders are joined in Spark, sharded by gram.  A text's bits are summed over its grams: where the model
lies below a stated size it is sent to the texts; beyond it, each text's distinct grams are joined with the model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import shared_folder
from . import _text as X

#: Characters of a gram; START stands before a text (a code point that no text has a use for).
ORDER, START = 4, 0xFFFF
#: A document stays if its bits a character are at most MARGIN_BITS over the QUANTILE of held-out trusted documents of its
#: language and about its length: of its own power of two where LEAST of them are, else of the nearest as well.
QUANTILE, MARGIN_BITS, LEAST = 0.995, 0.1, 30
#: Lengths, as powers of two, that are taken together where few trusted documents are; then all lengths.
WIDTHS = (0, 1, 3)
#: One trusted document in FOLDS isn't counted into the model; the limits are set by those.
FOLDS = 5
#: Up to so many trusted ids, and rows of the model (16 bytes each), are sent to the texts; beyond, rows are exchanged.
SEND_IDS, SEND_GRAMS = 200_000, 4_000_000
#: Most frequent grams that are joined by broadcast where the others are exchanged, so that no gram of every text is a hot key.
HEAD = 100_000
#: Distinct grams that a task holds before it hands them on.
HELD = 1 << 20
_FACTORS = np.random.default_rng(51).integers(1 << 60, 1 << 63, 8).astype(X.U64) | X.U64(1)


def _symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of a block with ORDER - 1 start symbols before each row, the places of its characters, and the rows' offsets."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at, pad = np.searchsorted(lead, off), ORDER - 1
    n = np.diff(at)
    sym = np.full(len(cp) + pad * len(n), START, np.uint32)
    place = np.arange(len(cp)) + pad * (np.repeat(np.arange(len(n)), n) + 1)
    sym[place] = cp
    return sym, place, at


def _keys(sym: np.ndarray, place: np.ndarray, order: int, back: int = 0) -> np.ndarray:
    """64-bit keys of the grams of so many symbols that end ``back`` symbols before each place."""
    key = np.full(len(place), X.U64(order))
    for k in range(order):
        key += sym[place - back - k].astype(X.U64) * _FACTORS[k]
    return X.mix(key)


def _strings(sym: np.ndarray, place: np.ndarray) -> list[str]:
    """The grams of ORDER symbols that end at each place."""
    flat = np.stack([sym[place - k] for k in range(ORDER - 1, -1, -1)], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    return [flat[i : i + ORDER] for i in range(0, len(flat), ORDER)]


def _count(batches):
    keys, counts, grams = np.zeros(0, X.U64), np.zeros(0, np.int64), np.zeros(0, object)

    def out():
        return pa.RecordBatch.from_arrays([pa.array(grams.tolist(), pa.string()), pa.array(counts)], names=["gram", "n"])

    for batch in batches:
        for _, _, data, off in X.blocks(batch, "text"):
            sym, place, _ = _symbols(data, off)
            key, first, n = np.unique(_keys(sym, place, ORDER), return_index=True, return_counts=True)
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            old = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            counts[at[old]] += n[old]
            new = np.array(_strings(sym, place[first[~old]]) + [None], object)[:-1]
            keys, counts, grams = np.concatenate([keys, key[~old]]), np.concatenate([counts, n[~old]]), np.concatenate([grams, new])
            o = np.argsort(keys, kind="stable")
            keys, counts, grams = keys[o], counts[o], grams[o]
            if len(keys) > HELD:
                yield out()
                keys, counts, grams = keys[:0], counts[:0], grams[:0]
    yield out()


def _discounts(counts: DataFrame) -> Column:
    """The discount of a count of this order, by how many grams have the counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in counts.agg(*(F.count(F.when(F.col("n") == k, 1)) for k in range(1, 5))).first())
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d = [min(max(k - (k + 1) * y * b / a, 0.05 * k), 0.95 * k) if a and b else 0.5 for a, b, k in ((n1, n2, 1), (n2, n3, 2), (n3, n4, 3))]
    return F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])


def train(texts: DataFrame) -> DataFrame:
    """The model of all given texts: gram, bits, below, n.

    bits: -log2 of the interpolated probability of the gram's last symbol after the others.  below: -log2 of the weight that
    the lower order has after the whole gram as a history (null where nothing follows it; bits are null where the gram is only
    a history, as start symbols are).  The empty gram stands for symbols never seen.  The highest order uses counts; lower ones use the number of different symbols before a gram.
    """
    counts = {ORDER: texts.select("text").mapInArrow(_count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).checkpoint()}
    for order in range(ORDER - 1, 0, -1):
        counts[order] = counts[order + 1].groupBy(F.substring("gram", 2, order).alias("gram")).agg(F.count("*").alias("n")).checkpoint()
    base = 1.0 / (counts[1].count() + 1)
    tables = []
    for order in range(1, ORDER + 1):
        cut, history = _discounts(counts[order]), F.substring("gram", 1, order - 1)
        totals = counts[order].groupBy(history.alias("history")).agg(F.sum("n").alias("total"), (F.sum(cut) / F.sum("n")).alias("weight"))
        seen = counts[order].join(totals, history == F.col("history")).select("gram", "n", "weight", ((F.col("n") - cut) / F.col("total")).alias("own"))
        if order == 1:
            p = seen.select("gram", "n", (F.col("own") + F.col("weight") * base).alias("p"))
            tables.append(totals.select(F.lit("").alias("gram"), F.lit(float(-np.log2(base))).alias("bits"), (-F.log2("weight")).alias("below"), F.col("total").alias("n")))
        else:
            lower = p.select(F.col("gram").alias("shorter"), F.col("p").alias("lower"))
            p = seen.join(lower, F.substring("gram", 2, order - 1) == F.col("shorter")).select("gram", "n", (F.col("own") + F.col("weight") * F.col("lower")).alias("p"))
            weights = totals.select("history", "weight", "total")
            met = tables[-1].join(weights, F.col("gram") == F.col("history"), "full")
            tables[-1] = met.select(F.coalesce("gram", "history").alias("gram"), "bits", (-F.log2("weight")).alias("below"), F.coalesce("n", "total").alias("n"))
        p = p.checkpoint()
        tables.append(p.select("gram", (-F.log2("p")).alias("bits"), F.lit(None).cast("double").alias("below"), "n"))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.checkpoint()


class Lookup:
    """Bits and weights by key, in sorted arrays with a table of where each leading part starts."""

    def __init__(self, grams: list[str], bits: np.ndarray, below: np.ndarray):
        size = np.fromiter(map(len, grams), np.int64, len(grams))
        sym = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32)
        end, key = np.cumsum(size), np.full(len(grams), size.astype(X.U64))
        for k in range(ORDER):
            has = size > k
            key[has] += sym[end[has] - 1 - k].astype(X.U64) * _FACTORS[k]
        key = X.mix(key)
        o = np.argsort(key)
        self.key, self.bits, self.below = key[o], bits[o], np.nan_to_num(below[o])
        self.shift = X.U64(64 - max(8, int(len(key)).bit_length() + 1))
        self.start = np.searchsorted(self.key >> self.shift, np.arange((1 << int(64 - int(self.shift))) + 1, dtype=X.U64)).astype(np.int32)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Rows of keys, -1 for those not there."""
        end = len(self.key)
        at = self.start[key >> self.shift].astype(np.int64)
        left = np.flatnonzero(at < end)
        while len(left):
            left = left[self.key[at[left]] < key[left]]
            at[left] += 1
            left = left[at[left] < end]
        return np.where((at < end) & (self.key[np.minimum(at, end - 1)] == key), at, -1)

    def symbol_bits(self, sym: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Bits of the symbol at each place after those before it."""
        out, left = np.zeros(len(place)), np.arange(len(place))
        if not len(self.key):
            return out
        for order in range(ORDER, -1, -1):
            at = self.find(_keys(sym, place[left], order))
            has = (at >= 0) & ~np.isnan(self.bits[at])
            out[left[has]] += self.bits[at[has]]
            left = left[~has]
            if not len(left):
                break
            at = self.find(_keys(sym, place[left], order - 1, 1))
            out[left] += np.where(at >= 0, self.below[at], 0.0)
        return out


def _sent_scores(texts: DataFrame, model: DataFrame) -> DataFrame:
    """texts without text, with n_symbols and bits; the model is sent to them, so nothing is exchanged."""
    t = model.toArrow()
    lookup = texts.sparkSession.sparkContext.broadcast(Lookup(t["gram"].to_pylist(), t["bits"].to_numpy(), t["below"].to_numpy()))
    keep = [c for c in texts.columns if c != "text"]

    def scan(batches):
        for batch in batches:
            for lo, hi, data, off in X.blocks(batch, "text", X.BLOCK // 4):
                sym, place, at = _symbols(data, off)
                total, n = np.concatenate([[0.0], np.cumsum(lookup.value.symbol_bits(sym, place))]), np.diff(at)
                kept = [batch.column(batch.schema.get_field_index(c))[lo:hi] for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n.astype(np.int64), mask=n == 0), pa.array(total[at[1:]] - total[at[:-1]], mask=n == 0)], names=[*keep, "n_symbols", "bits"])

    fields = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep)
    return texts.mapInArrow(scan, f"{fields}, n_symbols long, bits double")


def _text_grams(batches):
    """h1, h2, gram, n: the distinct grams of each text."""
    for batch in batches:
        ids = [X.column_ints(batch, c) for c in ("h1", "h2")]
        for lo, hi, data, off in X.blocks(batch, "text", X.BLOCK // 4):
            sym, place, at = _symbols(data, off)
            row = np.repeat(np.arange(hi - lo), np.diff(at))
            key = _keys(sym, place, ORDER)
            o = np.lexsort((key, row))
            new = np.ones(len(o), bool)
            new[1:] = (key[o][1:] != key[o][:-1]) | (row[o][1:] != row[o][:-1])
            first = o[new]
            n = np.diff(np.append(np.flatnonzero(new), len(o)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[0][lo + row[first]]), pa.array(ids[1][lo + row[first]]), pa.array(_strings(sym, place[first]), pa.string()), pa.array(n.astype(np.int64))], names=["h1", "h2", "gram", "n"])


def _joined_scores(texts: DataFrame, model: DataFrame) -> DataFrame:
    """h1, h2, n_symbols, bits of each text, by joins of its distinct grams with the model, longest first."""
    rows = texts.select("h1", "h2", "text").mapInArrow(_text_grams, "h1 long, h2 long, gram string, n long").withColumn("more", F.lit(0.0))
    done = None
    often = model.orderBy(F.desc("n"), "gram").limit(HEAD).select("gram", "bits", "below").checkpoint()  # bounded, so it may be broadcast
    rest = model.join(F.broadcast(often.select("gram")), "gram", "left_anti").select("gram", "bits", "below").checkpoint()

    def met(rows: DataFrame, key: Column, kind: str) -> DataFrame:
        rows = rows.withColumn("key", key)
        head, tail = (t.select(F.col("gram").alias("key"), F.col(kind).alias(name)) for t, name in ((often, "head"), (rest, "tail")))
        return rows.join(F.broadcast(head), "key", "left").join(tail, "key", "left").withColumn("found", F.coalesce("head", "tail")).drop("key", "head", "tail")

    for order in range(ORDER, -1, -1):
        asked = met(rows, F.substring("gram", ORDER - order + 1, order), "bits").checkpoint()
        hit = asked.where("found IS NOT NULL").select("h1", "h2", "n", ((F.col("found") + F.col("more")) * F.col("n")).alias("bits"))
        done = hit if done is None else done.unionByName(hit)
        if order:
            rows = met(asked.where("found IS NULL").drop("found"), F.substring("gram", ORDER - order + 1, order - 1), "below")
            rows = rows.withColumn("more", F.col("more") + F.coalesce("found", F.lit(0.0))).drop("found")
    return done.groupBy("h1", "h2").agg(F.sum("n").alias("n_symbols"), F.sum("bits").alias("bits"))


def bits_of_texts(texts: DataFrame, model: DataFrame, send: int = SEND_GRAMS) -> DataFrame:
    """texts without text, with n_symbols and bits, null without text; equal texts have equal bits."""
    if model.count() <= send:
        return _sent_scores(texts, model)
    hashes = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("again"), "text").alias("h2")]
    scored = _joined_scores(texts.select("text", *hashes).where("text <> ''").dropDuplicates(["h1", "h2"]), model)
    return texts.select("*", *hashes).join(scored, ["h1", "h2"], "left").drop("h1", "h2", "text")


def limits(known: DataFrame, quantile: float) -> tuple[DataFrame, DataFrame]:
    """(lang, size, limit) by language and power of two of the length, and (lang, limit) of all lengths; lang null is the limit
    over all languages.  known: lang, size, per (bits a character) of trusted documents."""
    reach = F.explode(F.array(*(F.struct(F.lit(w).alias("w"), F.lit(k).alias("k")) for w in WIDTHS for k in range(-w, w + 1)))).alias("x")
    near = known.select("lang", "size", "per", reach).groupBy("lang", (F.col("size") + F.col("x.k")).alias("size"), F.col("x.w").alias("w"))
    at = F.percentile_approx("per", quantile, 10000)
    near = near.agg(F.count("*").alias("n"), at.alias("limit")).where(F.col("n") >= LEAST).groupBy("lang", "size").agg(F.min(F.struct("w", "limit")).alias("s"))
    whole = known.groupBy("lang").agg(F.count("*").alias("n"), at.alias("limit")).where(F.col("n") >= LEAST)
    overall = known.agg(F.lit(None).cast("string").alias("lang"), at.alias("limit"))
    return near.select("lang", "size", F.col("s.limit").alias("limit")), whole.select("lang", "limit").unionByName(overall)


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, margin_bits: float = MARGIN_BITS, send: int = SEND_GRAMS) -> DataFrame:
    """Judge every document by the perplexity of its whole text under a model of the trusted documents.

    trusted: the doc_id of documents known to be good.  The model is counted over all of their texts but one in FOLDS, by which
    the limits of each language and length are set (by all of them where none is left out).

    Returns doc_id, lang, n_symbols, perplexity, max_perplexity, keep, one row per input row.  A null or empty text has no
    perplexity and stays; so does everything, at perplexity 1, if no trusted text is given.  A null lang has the limit over all languages.
    Repeated rows are judged alike, each by its own text; other columns are ignored.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    texts = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    ids = trusted.select("doc_id").where("doc_id IS NOT NULL").distinct().withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS))).checkpoint()
    sent = F.broadcast(ids) if ids.count() <= SEND_IDS else ids
    counted = ids.where("fold > 0").isEmpty()
    model = train(texts.join(sent if counted else sent.where("fold > 0"), "doc_id", "left_semi"))
    scored = bits_of_texts(texts, model, send).select("doc_id", "lang", "n_symbols", (F.col("bits") / F.col("n_symbols")).alias("per"), F.floor(F.log2("n_symbols")).cast("int").alias("size")).checkpoint()
    known = scored.join(sent, "doc_id").where("per IS NOT NULL").checkpoint()
    apart = known.where("fold = 0")
    near, whole = limits(known if apart.isEmpty() else apart, quantile)
    whole = whole.checkpoint()
    overall = whole.where("lang IS NULL").agg(F.max("limit").alias("overall"))
    by_lang = whole.where("lang IS NOT NULL").withColumnRenamed("limit", "by_lang")
    out = scored.join(near.where("lang IS NOT NULL"), ["lang", "size"], "left").join(by_lang, "lang", "left").crossJoin(F.broadcast(overall))
    limit = F.coalesce("limit", "by_lang", "overall") + margin_bits
    return out.select("doc_id", "lang", "n_symbols", F.pow(F.lit(2.0), "per").alias("perplexity"), F.when(F.col("per").isNotNull(), F.pow(F.lit(2.0), limit)).alias("max_perplexity"), F.coalesce(F.col("per") <= limit, F.lit(True)).alias("keep"))


def op3_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.where("quality = 1"))
