"""N-gram Jaccard join (operator 5): prefix filtering under several global token orders."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._components import components, merged, written
from ._repeats import fingerprint

WORDS = 5
PERCENT = 75
#: Bins of the frequency sketch that sets the first order; a fixed size, so it may be broadcast.
BINS, SEGMENT = 1 << 23, 1 << 16
#: Orders that a candidate pair must share a prefix token under, beside the first.
OTHER_ORDERS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
#: Rounds in which a token's documents meet the one with most links that was no hub yet, before all open pairs are compared.
#: A round is spared where the open groups hold at most PAIRS_A_ROW pairs a row, that is, where they are small.
HUB_ROUNDS, PAIRS_A_ROW = 2, 100
#: Bits of the parity bitmap that open pairs are judged by as they are joined, in words of 64.
PARITY_WORDS = 8
#: Pairs of one hub that are compared in one group; the hub's row is copied to each of its groups.
GROUP_PAIRS = 256
#: Up to so many document ids are sent to the texts; beyond, the texts are exchanged.
SEND_IDS = 200_000


def _grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all shingles of a block and their rows; a row of 1 to 4 words has one, its whole sequence."""
    low = X.LOWER[data]
    starts, ends, word_off = X.words(low, off)
    sym = X.word_symbols(fingerprint(11), low, starts, ends)
    fp = fingerprint(12)
    pre = fp.prefix(sym)
    n = np.diff(word_off)
    count = np.where(n >= WORDS, n - WORDS + 1, (n > 0).astype(n.dtype))
    row = np.repeat(np.arange(len(n)), count)
    lo = np.repeat(word_off[:-1], count) + X.ranges(count)
    return fp.slices(pre, lo, np.minimum(lo + WORDS, word_off[row + 1])), row


def _sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted within each row, and the n + 1 offsets of the rows."""
    gram, row = _grams(data, off)
    o = np.lexsort((gram, row))
    gram, row = gram[o], row[o]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    gram, row = gram[new], row[new]
    return gram, np.searchsorted(row, np.arange(len(off)))


def _prefix_size(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n - (PERCENT * n + 99) // 100 + 1, 0)


def _count_bins(batches):
    total = np.zeros(BINS, np.uint32)
    for batch in batches:
        for _, _, data, off in X.blocks(batch, "text"):
            total += np.bincount((_grams(data, off)[0] >> np.uint64(40)).astype(np.int64) % BINS, minlength=BINS).astype(np.uint32)
    small = np.minimum(total, 255).astype(np.uint8).reshape(-1, SEGMENT)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(small)), pa.int32()), pa.array([x.tobytes() for x in small], pa.binary())], names=["segment", "counts"])


def _add_bins(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            total[k] = total.get(k, np.zeros(SEGMENT, np.uint32)) + np.frombuffer(x.as_buffer(), np.uint8)
    classes = [np.log2(x + 1).astype(np.uint8).tobytes() for x in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(classes, pa.binary())], names=["segment", "counts"])


def frequency_classes(texts: DataFrame) -> bytes:
    """The binary logarithm of how often the shingles of each bin occur: BINS bytes, whatever the input."""
    schema = "segment int, counts binary"
    rows = texts.mapInArrow(_count_bins, schema).repartition("segment").mapInArrow(_add_bins, schema).collect()
    found = {r.segment: bytes(r.counts) for r in rows}
    return b"".join(found.get(k, bytes(SEGMENT)) for k in range(BINS // SEGMENT))


def _bitmaps(gram: np.ndarray, off: np.ndarray) -> list[bytes]:
    """Parity bitmaps of as many bits as the largest power of two up to the set's size, 64 at least."""
    n = np.diff(off)
    bits = 1 << np.maximum(np.floor(np.log2(np.maximum(n, 1))).astype(np.int64), 6)
    base = np.concatenate([[0], np.cumsum(bits)])
    row = np.repeat(np.arange(len(n)), n)
    where = base[row] + (X.mix(gram) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(where, minlength=base[-1]) & 1).astype(np.uint8)
    packed = np.packbits(odd, bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(base[:-1].tolist(), base[1:].tolist())]


def _parities(gram: np.ndarray, off: np.ndarray) -> pa.Array:
    """Parity bitmaps of PARITY_WORDS words, whatever the set's size, as lists of 64-bit integers."""
    n, bits = len(off) - 1, 64 * PARITY_WORDS
    where = np.repeat(np.arange(n), np.diff(off)) * bits + (X.mix(gram) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(where, minlength=n * bits) & 1).astype(np.uint8)
    packed = np.packbits(odd, bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * PARITY_WORDS), pa.array(packed))


def _profile(batches):
    """doc_id, two fingerprints of the set, its size and its two bitmaps."""
    for batch in batches:
        docs = X.column_ints(batch, "doc_id")
        for lo, hi, data, off in X.blocks(batch, "text"):
            gram, set_off = _sets(data, off)
            n = np.diff(set_off)
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(X.mix(gram ^ np.uint64(s)))]) for s in (0x1234567, 0x7654321 << 8)]
            keys = [X.i64(s[set_off[1:]] - s[set_off[:-1]]) for s in sums]
            yield pa.RecordBatch.from_arrays([pa.array(docs[lo:hi]), *map(pa.array, keys), pa.array(n.astype(np.int32)), pa.array(_bitmaps(gram, set_off), pa.binary()), _parities(gram, set_off)], names=["doc_id", "k1", "k2", "n", "bitmap", "parity"])


def _prefixes(classes) -> Callable:
    """doc_id's set fingerprints and the first tokens of its set under the first order: rare bins first, then by value."""

    def scan(batches):
        rank = np.frombuffer(classes.value, np.uint8)
        for batch in batches:
            for _, _, data, off in X.blocks(batch, "text"):
                gram, set_off = _sets(data, off)
                n = np.diff(set_off)
                row = np.repeat(np.arange(len(n)), n)
                o = np.lexsort((gram, rank[(gram >> np.uint64(40)).astype(np.int64) % BINS], row))
                gram = gram[o]
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(X.mix(gram ^ np.uint64(s)))]) for s in (0x1234567, 0x7654321 << 8)]
                keys = [X.i64(s[set_off[1:]] - s[set_off[:-1]]) for s in sums]
                size = _prefix_size(n)
                taken = gram[np.repeat(set_off[:-1], size) + X.ranges(size)]
                at = np.concatenate([[0], np.cumsum(size)]) * 8
                tokens = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(taken.tobytes())])
                yield pa.RecordBatch.from_arrays([*map(pa.array, keys), tokens], names=["k1", "k2", "prefix"])

    return scan


def _postings(batches):
    """(token, doc_id, place): place holds the set's size and the token's position in it."""
    for batch in batches:
        docs, n = X.column_ints(batch, "doc_id"), X.column_ints(batch, "n")
        data, off = X.column_bytes(batch, "prefix")
        tokens = np.frombuffer(data[off[0] : off[-1]].tobytes(), np.int64)
        size = np.diff(off) // 8
        yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.repeat(docs, size)), pa.array((np.repeat(n, size) << 32) + X.ranges(size))], names=["token", "doc_id", "place"])


def _shared(batches):
    """Of rows sorted by (token, turn), those of tokens with two documents or more, with the first document as hub."""
    names = ["token", "doc_id", "place", "hub", "hub_place"]

    def rows(*cols):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in cols], names=names)

    carry = None  # token, hub, hub's place, whether its own row is out
    for batch in batches:
        token, doc, place = (X.column_ints(batch, c) for c in names[:3])
        if not len(token):
            continue
        if carry is not None:
            token, doc, place = (np.concatenate([[a], b]) for a, b in zip(carry[:3], (token, doc, place)))
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(token)))
        first = np.repeat(at, size)
        out = np.repeat(size > 1, size)
        if carry is not None and carry[3]:
            out[0] = False
        yield rows(token[out], doc[out], place[out], doc[first][out], place[first][out])
        last = at[-1]
        known = size[-1] > 1 or (carry is not None and carry[3] and len(at) == 1)
        carry = token[last], doc[last], place[last], bool(known)


def _bound(batches):
    """Pairs whose bitmaps leave an overlap of PERCENT possible."""
    for batch in batches:
        a, b, na, nb = (X.column_ints(batch, c) for c in ("a", "b", "na", "nb"))
        maps = zip(batch.column(batch.schema.get_field_index("ma")), batch.column(batch.schema.get_field_index("mb")))
        keep = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(maps):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            while len(x) > len(y):
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            while len(y) > len(x):
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            most = (na[i] + nb[i] - int(np.bitwise_count(x ^ y).sum())) // 2
            keep[i] = 100 * most >= PERCENT * (na[i] + nb[i] - most)
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])


def _set_rows(batches):
    """One row of the document's set for each group that it is compared in."""
    for batch in batches:
        docs = X.column_ints(batch, "doc_id")
        groups = batch.column(batch.schema.get_field_index("groups")).to_pylist()
        for lo, hi, data, off in X.blocks(batch, "text"):
            gram, set_off = _sets(data, off)
            for i in range(lo, hi):
                s, k = gram[set_off[i - lo] : set_off[i - lo + 1]].tobytes(), len(groups[i])
                yield pa.RecordBatch.from_arrays([pa.array([g["hub"] for g in groups[i]], pa.int64()), pa.array([g["part"] for g in groups[i]], pa.int64()), pa.array([int(docs[i])] * k, pa.int64()), pa.array([s] * k, pa.binary())], names=["hub", "part", "doc_id", "tokens"])


def _first_under(order: int, s: np.ndarray) -> np.ndarray:
    return np.sort(X.mix(s ^ np.uint64(order)))[: int(_prefix_size(np.array([len(s)]))[0])]


def _verify(batches):
    """Links between the hub, whose row comes first in each group, and its documents."""
    hub, own, own_prefixes = None, None, None
    for batch in batches:
        h, d = X.column_ints(batch, "hub"), X.column_ints(batch, "doc_id")
        links = []
        for i, tokens in enumerate(batch.column(batch.schema.get_field_index("tokens"))):
            s = np.frombuffer(tokens.as_buffer().to_pybytes(), np.uint64)
            if h[i] == d[i]:
                hub, own, own_prefixes = h[i], s, [_first_under(o, s) for o in OTHER_ORDERS]
                continue
            if hub != h[i] or not all(len(np.intersect1d(p, _first_under(o, s), assume_unique=True)) for o, p in zip(OTHER_ORDERS, own_prefixes)):
                continue
            common = len(np.intersect1d(own, s, assume_unique=True))
            if 100 * common >= PERCENT * (len(own) + len(s) - common):
                links.append((h[i], d[i]))
        x = np.array(links, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])


def _groups(pairs: DataFrame) -> DataFrame:
    """(doc_id, hub, part): the rows that compare each pair (a, b).  The end with most pairs is the hub; its documents are dealt
    over parts of about GROUP_PAIRS, and it has a row in each part."""
    pairs_of = pairs.select(F.col("a").alias("end")).union(pairs.select("b")).groupBy("end").agg(F.count("*").alias("pairs"))
    one, two = (pairs_of.select(F.col("end").alias(c), F.col("pairs").alias(f"{c}_pairs")) for c in ("a", "b"))
    first = F.col("a_pairs") >= F.col("b_pairs")
    parts = F.ceil(F.greatest("a_pairs", "b_pairs") / GROUP_PAIRS)
    ends = pairs.join(one, "a").join(two, "b").select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("doc_id"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), parts.alias("parts"))
    ends = ends.select("doc_id", "hub", F.pmod(F.xxhash64("doc_id"), "parts").alias("part"))
    return ends.union(ends.select(F.col("hub").alias("doc_id"), "hub", "part").distinct())


def _links(pairs: DataFrame, profile: DataFrame, texts: DataFrame) -> DataFrame:
    """Of candidate pairs (a, b), those that link: by bitmap, then by the other orders and the sets themselves."""
    one = profile.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("ma"))
    two = profile.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("mb"))
    left = pairs.join(one, "a").join(two, "b").where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)").select("a", "b", "na", "nb", "ma", "mb")
    left = written(left.mapInArrow(_bound, "a long, b long"))
    groups = _groups(left).groupBy("doc_id").agg(F.collect_list(F.struct("hub", "part")).alias("groups"))
    small = left.count() <= SEND_IDS
    rows = texts.join(F.broadcast(groups) if small else groups, "doc_id").mapInArrow(_set_rows, "hub long, part long, doc_id long, tokens binary")
    rows = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("hub") != F.col("doc_id"))
    return written(rows.mapInArrow(_verify, "a long, b long"))


def _early() -> Column:
    """Whether a link with a set of the same size or a larger one can have this token as its first common one.

    Of sets of sizes m <= n that link, m * 2 * PERCENT / (100 + PERCENT) tokens are common at least.
    """
    size = F.shiftright("place", 32)
    return (size - F.col("place").bitwiseAND(0xFFFFFFFF)) * (100 + PERCENT) >= size * 2 * PERCENT


def _still_open(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """Rows (token, doc_id, place, comp) of tokens whose documents are in several components, one of them early enough."""
    labelled = rows.select("token", "doc_id", "place").join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    tokens = labelled.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(_early()).alias("early")).where("lo < hi AND early").select("token")
    return labelled.join(tokens, "token")


def _ordered(rows: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of documents and hubs, once each."""
    return rows.select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).distinct()


def _apart(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """Rows whose document and hub are in different components."""
    one, two = (comp.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp")) for c in ("doc_id", "hub"))
    labelled = rows.join(one, "doc_id", "left").join(two, "hub", "left")
    return labelled.where(F.coalesce("doc_id_comp", "doc_id") != F.coalesce("hub_comp", "hub"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Group documents whose sets of five-word shingles have a Jaccard similarity of 0.75 or more, transitively.

    A-Z are lower-cased; words are runs of anything but the space and bytes 9 to 13.  A document of one to four words has one
    shingle; one without words or text has none and is linked with nothing.  Documents of equal sets are folded into their
    smallest doc_id first.  A pair is a candidate if it shares a token of both prefixes under the first order (rare bins
    first), then if parity bitmaps leave the overlap possible, then if it shares prefix tokens under two more orders; then the
    sets are compared.  In a token's group every document meets a hub: first each document the hub of most of its tokens, then
    its other hubs, if they are still in different components; then all pairs that still are, unless a parity bitmap of
    fixed size rules them out as they are joined.

    Returns doc_id, n_shingles, component_id (the smallest doc_id that links reach), one row per input row; a null doc_id
    keeps a null component_id.  Other columns are ignored.  Two rows of one doc_id share a component if either links.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = given.where("doc_id IS NOT NULL")
    spark = docs.sparkSession
    classes = spark.sparkContext.broadcast(frequency_classes(texts))
    profile = texts.mapInArrow(_profile, "doc_id long, k1 long, k2 long, n int, bitmap binary, parity array<long>").checkpoint()
    same = profile.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"))
    firsts = texts.mapInArrow(_prefixes(classes), "k1 long, k2 long, prefix binary").groupBy("k1", "k2").agg(F.first("prefix").alias("prefix"))
    reps = firsts.join(same, ["k1", "k2"]).select(F.col("rep").alias("doc_id"), F.col("n").cast("long").alias("n"), "prefix")
    postings = reps.mapInArrow(_postings, "token long, doc_id long, place long")
    turn = F.xxhash64("doc_id", F.col("token").bitwiseAND(3))
    shared = postings.repartition("token").sortWithinPartitions("token", turn, "doc_id").mapInArrow(_shared, "token long, doc_id long, place long, hub long, hub_place long").checkpoint()
    size, pos = (lambda c: F.shiftright(c, 32)), (lambda c: F.col(c).bitwiseAND(0xFFFFFFFF))

    def able(p, q):
        """Length and position leave the needed overlap possible."""
        need = F.ceil((size(p) + size(q)) * PERCENT / (100 + PERCENT))
        return (100 * F.least(size(p), size(q)) >= PERCENT * F.greatest(size(p), size(q))) & (F.least(size(p) - pos(p), size(q) - pos(q)) >= need)

    meets = shared.where((F.col("hub") != F.col("doc_id")) & able("place", "hub_place")).groupBy("doc_id", "hub").agg(F.count("*").alias("n")).checkpoint()
    nearest = meets.groupBy("doc_id").agg(F.max(F.struct("n", "hub")).alias("s")).select("doc_id", "s.hub")
    links = _links(_ordered(nearest), profile, texts)
    comp = components(links)
    more = _links(_ordered(_apart(meets, comp)), profile, texts)
    links, comp = links.union(more), merged(comp, more)
    used = shared.select("hub").distinct()
    rest = written(_still_open(shared, comp))
    classes.destroy()  # what needed it is written
    for _ in range(HUB_ROUNDS):
        held = rest.groupBy("token").agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).first()
        if not held["rows"] or held["pairs"] <= PAIRS_A_ROW * held["rows"]:
            break
        degree = links.select(F.col("a").alias("doc_id")).union(links.select("b")).groupBy("doc_id").agg(F.count("*").alias("degree"))
        fresh = rest.join(used, rest.doc_id == used.hub, "left_anti").join(degree, "doc_id", "left")
        best = written(fresh.groupBy("token").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), turn.alias("turn"), F.col("doc_id").alias("hub"), F.col("place").alias("hub_place"), F.col("comp").alias("hub_comp"))).alias("s")).select("token", "s.hub", "s.hub_place", "s.hub_comp"))
        pairs = rest.join(best, "token").where((F.col("comp") != F.col("hub_comp")) & able("place", "hub_place"))
        more = _links(_ordered(pairs), profile, texts)
        links, comp = links.union(more), merged(comp, more)
        used = used.union(best.select("hub")).distinct()
        rest = written(_still_open(rest, comp))
    # The smaller set's token is early; sizes that can link are in one band or the next, as a band is wider than 100 / PERCENT.
    band = F.floor(F.log(size("place").cast("double")) / math.log(100 / PERCENT + 0.01))
    rest = rest.join(profile.select("doc_id", "parity"), "doc_id").withColumn("band", band)
    x, y = (rest.select("token", "band", F.col("doc_id").alias(c), F.col("place").alias(f"{c}_place"), F.col("comp").alias(f"{c}_comp"), F.col("parity").alias(f"{c}_parity"), _early().alias(f"{c}_early")) for c in ("doc_id", "hub"))
    x = x.where("doc_id_early").withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    smaller = (size("doc_id_place") < size("hub_place")) | ((size("doc_id_place") == size("hub_place")) & (F.col("doc_id") < F.col("hub")))
    # Bits that differ are at most the tokens that only one set has, of which a link leaves this share of both sizes.
    differ = reduce(add, (F.bit_count(F.col("doc_id_parity")[k].bitwiseXOR(F.col("hub_parity")[k])) for k in range(PARITY_WORDS)))
    near = differ * (100 + PERCENT) <= (size("doc_id_place") + size("hub_place")) * (100 - PERCENT)
    rest_pairs = _ordered(x.join(y, ["token", "band"]).where(smaller & (F.col("doc_id_comp") != F.col("hub_comp")) & able("doc_id_place", "hub_place") & near))
    more = _links(rest_pairs, profile, texts)
    if not more.isEmpty():
        comp = merged(comp, more)
    ids = profile.select("doc_id", "k1", "k2", "n").distinct().join(same, ["k1", "k2", "n"], "left").join(comp, F.col("rep") == F.col("node"), "left")
    ids = ids.groupBy("doc_id").agg(F.max("n").cast("long").alias("n_shingles"), F.min(F.coalesce("comp", "rep", "doc_id")).alias("component_id"))
    return given.select("doc_id").join(ids, "doc_id", "left").withColumn("n_shingles", F.coalesce("n_shingles", F.lit(0).cast("long")))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
