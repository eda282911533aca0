"""Benchmark decontamination (operator 6), in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import shared_folder

WORDS = 5
PERCENT = 75
#: Up to so many signature rows or candidates are sent to every executor (16 bytes a row); beyond, they are exchanged.
SEND_ROWS = 500_000


def _shingles(df: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """keep and sh: the text's five-word shingles as 64-bit hashes, repeats included; one of all words if there are fewer."""
    split = F.filter(F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(split, lambda w: F.xxhash64(w))

    def shingles(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WORDS))))
        few = F.when(F.size(w) > 0, F.array(F.xxhash64(w, F.lit("short")))).otherwise(F.expr("cast(array() as array<bigint>)"))
        return F.when(F.size(w) >= WORDS, many).otherwise(few)

    # The words are the variable of an outer lambda, so they are computed once a row and not once a shingle.
    return df.select(*keep, F.get(F.transform(F.array(hashed), shingles), 0).alias("sh"))


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SEND_ROWS else df


def benchmark_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of a document and a benchmark item of which it holds 75 % or more of the five-word shingles.

    Items are put into partitions by the size of their shingle set (powers of two).  An item's signature is its smallest
    shingles under a hash order, as many as its partition's largest size needs for any document with 75 % of the item to hold
    one of them (by the pigeonhole principle), so the search loses nothing.  Documents are probed with all their shingles,
    however long they are; pairs that meet are verified by exact containment.

    Text is lower-cased; words are runs of anything but the space and bytes 9 to 13.  An item of one to four words is one
    shingle and is found only in a document of the same words.  Null or empty texts have no shingles and no pairs; rows with a
    null id are left out; repeated rows give one pair; other columns are ignored.

    Returns doc_id, item_id, n_item, n_shared, containment.
    """
    shared_folder(docs.sparkSession)
    item_sets = _shingles(items.where("item_id IS NOT NULL AND text IS NOT NULL"), "text", [F.col("item_id")])
    exploded = item_sets.select("item_id", F.explode("sh").alias("sh")).distinct()
    sized = exploded.groupBy("item_id").agg(F.collect_list("sh").alias("sh")).withColumn("n_item", F.size("sh"))
    top = F.pow(2, F.ceil(F.log2("n_item"))).cast("int")
    need = top - F.ceil(top * PERCENT / 100).cast("int") + 1
    order = F.array_sort(F.transform("sh", lambda x: F.struct(F.xxhash64(x, F.lit(6)).alias("h"), x.alias("sh"))))
    signature = sized.select("item_id", F.explode(F.slice(order, 1, need)).alias("s")).select("item_id", F.col("s.sh").alias("sh")).checkpoint()
    item_rows = exploded.join(sized.select("item_id", "n_item"), "item_id").checkpoint()

    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    probes = _shingles(texts, "text", [F.col("doc_id")]).select("doc_id", F.explode("sh").alias("sh"))
    met = probes.join(_sent(signature, signature.count()), "sh").select("doc_id", "item_id").distinct().checkpoint()

    found = met.select("doc_id").distinct()
    again = _shingles(texts.join(_sent(found, met.count()), "doc_id", "left_semi"), "text", [F.col("doc_id")])
    held = again.select("doc_id", F.explode(F.array_distinct("sh")).alias("sh")).distinct()
    pairs = held.join(_sent(item_rows, item_rows.count()), "sh").join(met, ["doc_id", "item_id"], "left_semi")
    counts = pairs.groupBy("doc_id", "item_id", "n_item").agg(F.count("*").alias("n_shared")).where(F.col("n_shared") * 100 >= F.col("n_item") * PERCENT)
    return counts.select("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), "n_shared", F.round(F.col("n_shared") / F.col("n_item"), 6).alias("containment"))


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION SELECT doc_id, '<' || array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)
  UNION SELECT item_id, '<' || array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, round(count(*) / n_item, 6) AS containment
FROM ds JOIN bs USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING count(*) * 100 >= n_item * 75
"""
