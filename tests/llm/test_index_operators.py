"""Token alignment, ranked search and balanced shards against brute force, with nulls, repeats, long texts and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from latticeworks.llm import balanced_shards, ranked_search, token_alignment
from latticeworks.plans.storage import new_folder

SCHEMA = "doc_id long, text string, lang string, n long, bits string, place string, shard string, size string"
A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghéß漢") for _ in range(rng.randint(1, 7))) for _ in range(120)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    out = [None, "", " ", "  two  spaces ", "One", "one ONE One", "<s> and <|endoftext|> are text", "a ▁ sign", "tab\tand\nlines\r\n", "it's we'll 12,345 …", "\u0000 zero", "é 🙂 क्षि", "x" * 3000, line(8000), line(40), line(40)]
    return out + [out[-1]] * 5 + [line(rng.randint(1, 120)) for _ in range(30)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", 1, "b", "p", "s", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], (None, "without an id one", None, 1, "b", "p", "s", "z")], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- alignment -------------------------------------------------------------------------------------------------------
def _ends(tokens):
    out, n = [], 0
    for t in tokens:
        n += len(t)
        out.append(n)
    return out


def aligned(texts):
    """Per text: tokens of both, groups, links; None without tokens."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    pieces, library = SentencePieceProcessor(model_file=B), Tokenizer.from_file(A)
    library.encode_special_tokens = True
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        a, b, want = library.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text), (" " + text).encode()
        raw_a = [bytes(byte[c] for c in library.id_to_token(i)) for i in a]
        raw_b = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(raw_a) != want or b"".join(raw_b) != want:
            out.append(None)
            continue
        ends_a, ends_b = _ends(raw_a), _ends(raw_b)
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            to_a, to_b = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append((a[i:to_a], b[j:to_b]))
            links.append((a[to_a - 1], b[to_b - 1]))
            i, j = to_a, to_b
        out.append((a, b, groups, links))
    return out


def test_alignment(docs, texts, empty):
    known = [(r.doc_id, r.text) for r in docs.collect()]
    found = aligned([t for _, t in known])
    count = Counter(link for f in found if f for link in f[3])
    documents = Counter(link for f in found if f for link in set(f[3]))
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    want = []
    for (i, _), f in zip(known, found):
        a, b, groups, links = f or ([], [], [], [])
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        want.append((i, len(a), len(b), len(groups), sum(count[x] for x in links), sum(count[x] == best[x[1]] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else "", text))
    rows, containers = token_alignment.align(docs, A, B, groups=True)
    pairs = token_alignment.pair_counts(containers)
    scored = rows.join(token_alignment.document_scores(containers, pairs), ["stretch", "place"], "left").fillna(0, ["count_sum", "n_best"])
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.count_sum, r.n_best, r.groups_sha256, r.groups) for r in scored.collect()]
    key = lambda t: (t[0] is None, t[0] or 0, t)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(f is None for f in found) == 3 and len(count) > 100  # null, empty, and the text with the sign for a space
    assert {((r.a, r.b), r.n_links, r.n_documents) for r in pairs.collect()} == {(k, n, documents[k]) for k, n in count.items()}
    rows, containers = token_alignment.align(empty, A, B)
    assert rows.count() == 0 and token_alignment.document_scores(containers, token_alignment.pair_counts(containers)).count() == 0


def _small_stretches():
    def scan(batches):  # in a worker, of its own bounds
        token_alignment.STRETCH_ENTRIES, token_alignment.PIECE = 200, 2000
        try:
            yield from token_alignment._index(A, B, False)(batches)
        finally:
            token_alignment.STRETCH_ENTRIES, token_alignment.PIECE = 1_500_000, 1 << 19

    return scan


def test_alignment_over_many_stretches(docs):
    """The same counts whether a pair lies in one container or in many, as a list or as a bitmap."""

    def counts(scan):
        rows = docs.select("doc_id", "text").mapInArrow(scan, f"{token_alignment.DOCUMENT}, {token_alignment.CONTAINER}").checkpoint()
        pairs = token_alignment.pair_counts(rows.where("place IS NULL"))
        return {(r.a, r.b, r.n_links, r.n_documents) for r in pairs.collect()}, rows.select("stretch").distinct().count(), rows.where("dense").count()

    (one, few, dense), (other, many, _) = counts(token_alignment._index(A, B, False)), counts(_small_stretches())
    assert one == other and many > few and dense > 0


# -- search ----------------------------------------------------------------------------------------------------------
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(known, items, k):
    counts = [(i, Counter(terms(t))) for i, t in known]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = set()
    for item, text in set(items):
        scores = []
        for i, c in counts:
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // max(1, n_terms)
            score = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0 and i is not None:
                scores.append((-score, i))
        out |= {(item, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k])}
    return out


@pytest.mark.parametrize("rounds, send, block", [((40, 640), 10**6, 512), ((1, 2), 0, 3)])
def test_search(spark, docs, texts, empty, monkeypatch, rounds, send, block):
    for name, value in (("ROUNDS", rounds), ("SEND_PAIRS", send), ("BLOCK", block)):
        monkeypatch.setattr(ranked_search, name, value)
    rng = random.Random(3)
    words = [t for t in terms(" ".join(x for x in texts if x and len(x) < 3000))]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(12)]
    items += [(12, texts[20]), (13, "one One ONE one"), (14, ""), (15, None), (16, "neverthere neitherthis"), (17, "!?"), (18, texts[20] + " neverthere"), (13, "one One ONE one"), (None, "two spaces")]
    frame = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    known = [(r.doc_id, r.text) for r in docs.collect()]
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in ranked_search.ranked_search(docs, frame, 7).collect()]
    assert len(got) == len(set(got)) and set(got) == ranked(known, items, 7)
    assert ranked_search.ranked_search(empty, frame).count() == 0 and ranked_search.ranked_search(docs, frame.limit(0)).count() == 0


def test_bounds_are_no_less_than_scores(spark, docs):
    """Every cell holds at least the occurrences of each of its terms, also where there are more than a cell can tell."""
    index = {r.doc_id: r for r in ranked_search.sketch_index(docs).collect()}
    many = spark.createDataFrame([(1, "again " * 300 + "once")], "doc_id long, text string")
    index[-1] = ranked_search.sketch_index(many).first()
    for i, text in [(r.doc_id, r.text) for r in docs.collect()] + [(-1, "again " * 300 + "once")]:
        if i is None:
            continue
        sketch, count = index[i].sketch, Counter(terms(text))
        assert index[i].n == sum(count.values())
        if count:
            names = list(count)
            q = ranked_search.Queries([t.encode() for t in names], *([None] * 3))
            assert all(sketch[int(c) & (len(sketch) - 1)] >= min(255, count[t]) for c, t in zip(q.cell, names))


# -- shards ----------------------------------------------------------------------------------------------------------
def dealt(rows, n):
    """Shard and slot of rows (doc_id, text) in their order."""
    key = lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()))
    rows = sorted(rows, key=key)
    sizes = [len((t or "").encode()) + 1 for _, t in rows]
    out, before, slots = Counter(), 0, Counter()
    for (i, t), size in zip(rows, sizes):
        shard = (2 * before + size) * n // (2 * sum(sizes))
        out[i, size, zlib.crc32((t or "").encode()), shard, slots[shard]] += 1
        slots[shard] += 1
        before += size
    return out


@pytest.mark.parametrize("n", [1, 5, 16])
def test_shards(docs, n):
    got = Counter(tuple(r) for r in balanced_shards.balanced_shards(docs, n).collect())
    assert got == dealt([(r.doc_id, r.text) for r in docs.collect()], n)


def test_shards_of_repeated_rows_and_none(spark, empty):
    """A third of all rows are one document's: they are split as any others are."""
    rows = [(7, "the same text") if i % 3 == 0 else (i, f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = balanced_shards.balanced_shards(df)
    assert Counter(tuple(r) for r in got.collect()) == dealt(rows, 16)
    by_shard = got.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("slot").alias("last"), F.count_distinct("slot").alias("slots")).collect()
    assert len(by_shard) == 16 and all(r.slots == r.n == r.last + 1 for r in by_shard)
    assert max(r["bytes"] for r in by_shard) - min(r["bytes"] for r in by_shard) <= 2 * len("the same text ")
    assert balanced_shards.balanced_shards(empty).count() == 0


def test_written_shards(spark, docs):
    folder = new_folder(spark, "shards")
    told = {r.shard: (r["rows"], r.bytes) for r in balanced_shards.write_shards(docs, folder, 4).collect()}
    back = spark.read.parquet(folder)
    assert back.select(*docs.columns).exceptAll(docs.withColumn("shard", F.lit("s"))).count() == 0 and back.count() == docs.count()
    assert {r["shard_"]: r.n for r in back.groupBy("shard_").agg(F.count("*").alias("n")).collect()} == {k: v[0] for k, v in told.items()}
    slots = back.groupBy("shard_").agg(F.count_distinct("slot").alias("n"), F.max("slot").alias("last")).collect()
    assert all(r.n == r.last + 1 for r in slots)
