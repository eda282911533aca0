"""Contiguous shards of nearly equal bytes (operator 13), in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._components import written

SHARDS = 16
#: Rows lie in this order; those equal in all of it but the last are interchangeable.
KEY = ("doc_id", "text_crc32", "size", "digest", "row_id")


def _measured(docs: DataFrame) -> DataFrame:
    """Each row with its number, kept as a whole beside its measures, so that texts are read and hashed once."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    measures = (F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0).cast("long")).alias("text_crc32"), F.xxhash64(text).alias("digest"), F.monotonically_increasing_id().alias("row_id"))
    return docs.select(*measures, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def _dealt(measured: DataFrame, n: int) -> DataFrame:
    """measured (the columns of KEY, written) with shard and slot.

    Rows are put in order by ranges.  Each range's total is one row, and the sum of the totals before a range and of the sizes
    before a row in its range is the row's place in all bytes.  Equal targets cut that line; a row goes to the shard that its
    middle byte lies in, so a cut is at most half a row away from its target.
    """
    ranged = written(measured.repartitionByRange(*KEY).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    earlier, every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()  # one row a range
    base = totals.select("part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "rows")), F.sum("bytes").over(every).alias("total"))
    inside = Window.partitionBy("part").orderBy(*KEY)
    line = ranged.withColumns({"here": F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "nth": F.row_number().over(inside)}).join(F.broadcast(base), "part")
    shard = F.expr(f"cast(((2 * (bytes_before + here) + size) * {n}) div (2 * total) as int)")
    placed = line.select(*KEY, shard.alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("place"))
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # n rows
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("place") - F.col("first"))


def balanced_shards(docs: DataFrame, n: int = SHARDS) -> DataFrame:
    """doc_id, size (bytes of the text plus 1), text_crc32, shard (0 to n - 1), slot (from 0, gapless) of each row of docs.

    Rows lie by doc_id (null first), then by their texts' checksum, and shards are contiguous pieces of that order.  Every row
    counts, repeated ones and those of null or empty text (size 1, checksum 0) included; a row larger than a target may leave
    shards beside it empty.  Only measures are exchanged, never texts, and rows of one doc_id or text are split between ranges
    as any others are.  Other columns are ignored; an empty table gives no rows.
    """
    return _dealt(written(_measured(docs).drop("row")), n).select("doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, folder: str, n: int = SHARDS) -> DataFrame:
    """Write every row of docs unchanged to ``folder`` in a directory a shard, with its slot; returns shard, rows, bytes.

    The two new columns are named shard and slot, with underscores added where docs has such a column.  Texts are exchanged
    once, by the rows' numbers.
    """
    whole = written(_measured(docs))
    dealt = _dealt(whole.drop("row"), n).select("row_id", "shard", "slot", "size")
    names = {c: c for c in ("shard", "slot")}
    for c in names:
        while names[c] in docs.columns:
            names[c] += "_"
    rows = whole.select("row_id", "row").join(dealt, "row_id").select("row.*", F.col("slot").alias(names["slot"]), F.col("shard").alias(names["shard"]))
    rows.write.partitionBy(names["shard"]).parquet(folder)
    return dealt.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def op13_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = balanced_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP13_SQL = """WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
s AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) AS text_crc32 FROM documents CROSS JOIN t),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM s),
k AS (SELECT *, CAST(((2 * before + size) * 16) // (2 * total) AS INT) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM k"""
