"""A training corpus in five stages, each over all that the one before kept.

Rows of one doc_id are judged together where a stage decides by document, and rows without a doc_id stay, unjudged; no stage
makes more rows of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeworks.llm._repeats import repeated_ids, with_turns
from latticeworks.llm.byte_bpe import encode
from latticeworks.llm.decontamination import benchmark_leaks
from latticeworks.llm.jaccard_join import jaccard_components
from latticeworks.llm.quality_lm import classify
from latticeworks.llm.repeat_removal import substring_dedup
from latticeworks.plans.storage import new_folder

#: No SQL engine here trains the language model of the first stage or merges byte pairs as the last does.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rejected = classify(docs, labels.where("quality = 1")).where("NOT keep").select("doc_id")
    return docs.join(rejected, "doc_id", "left_anti")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near-duplicates, and one of its rows of equal text."""
    others = jaccard_components(docs).where("doc_id <> component_id").select("doc_id")
    kept, again = docs.join(others, "doc_id", "left_anti"), repeated_ids(docs)
    if again.isEmpty():
        return kept
    several = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").unionByName(several)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove words in 20-word windows that also start earlier; texts without such words stay as they are."""
    turn = "_turn"
    while turn in docs.columns:
        turn += "_"
    cut = substring_dedup(docs).where("n_removed > 0").select(F.col("doc_id").alias("cut_id"), F.col("turn").alias("cut_turn"), "kept_text")
    rows = with_turns(docs, turn).alias("rows")
    joined = rows.join(cut.alias("cut"), (F.col("rows.doc_id") == F.col("cut.cut_id")) & (F.col(f"rows.{turn}") == F.col("cut.cut_turn")), "left")
    changed = F.col("cut.kept_text").isNotNull()
    cells = {c: F.col(f"rows.`{c}`") for c in docs.columns}
    cells["text"] = F.coalesce("cut.kept_text", "rows.text")
    if "n_chars" in cells:
        cells["n_chars"] = F.when(changed, F.length("cut.kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(cells["n_chars"])
    return joined.select(*(v.alias(c) for c, v in cells.items()))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    leaks = benchmark_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each text."""
    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).withColumn("n_tokens", F.size("ids"))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
