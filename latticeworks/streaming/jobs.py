"""Streaming forms of edits, ticks, counters, dirty cells, rates, faces and saving, with pairing from ``stateful``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import cell_of
from ..operators.cell_store import update_faces, upsert_cells
from ..operators.neighbors import FACES
from .stateful import stream_pairing

KINDS = ("bm", "bp", "cr", "join", "leave")


def stream_edits(sdf: DataFrame, watermark: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """The latest edit of each cell and hour (start, x, y, z, at, v), in update mode.

    Hours behind the watermark leave the state, so it holds the recent cells only; the sink keeps each cell's row of greatest
    ``at`` (see ``latest_edits``).
    """
    hours = sdf.withWatermark("ts", watermark).groupBy(F.window("ts", width), "x", "y", "z")
    return hours.agg(F.max(F.struct("ts", "event_id")).alias("at"), F.max_by("v", F.struct("ts", "event_id")).alias("v")).select(F.col("window.start").alias("start"), "x", "y", "z", "at", "v")


def latest_edits(rows: DataFrame) -> DataFrame:
    return rows.groupBy("x", "y", "z").agg(F.max_by("v", "at").alias("v"))


def tick_batches(sdf: DataFrame, tick: str = "50 milliseconds", watermark: str = "1 hour") -> DataFrame:
    """Edits of each tick, gathered in order of their ids."""
    edit = F.struct("event_id", "session_id", "x", "y", "z", "v")
    ticks = sdf.withWatermark("ts", watermark).groupBy(F.window("ts", tick)).agg(F.array_sort(F.collect_list(edit)).alias("edits"))
    return ticks.select(F.col("window.start").alias("tick"), F.size("edits").alias("n"), "edits")


def stream_session_counters(sdf: DataFrame, watermark: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counters of each session and hour, in update mode; hours behind the watermark leave the state, and ``sum_counters`` adds them."""
    hours = sdf.withWatermark("ts", watermark).groupBy(F.window("ts", width), "session_id")
    return hours.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in KINDS)).select(F.col("window.start").alias("start"), "session_id", *KINDS)


def sum_counters(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session_id").agg(*(F.sum(k).alias(k) for k in KINDS))


def stream_dirty_cells(sdf: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Cells that edits touch, once within the watermark's delay; the sink merges a cell that is touched again later."""
    around = F.array(*(F.struct(*((F.col(c) + d).alias(c) for c, d in zip("xyz", o))) for o in ((0, 0, 0), *FACES.values())))
    cells = sdf.withWatermark("ts", watermark).select("ts", F.explode(around).alias("p")).select("ts", *(cell_of(f"p.{c}").alias(f"c{c}") for c in "xyz"))
    return cells.dropDuplicatesWithinWatermark(["cx", "cy", "cz"]).drop("ts")


def rate_metrics(sdf: DataFrame, width: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    out = sdf.withWatermark("ts", watermark).groupBy(F.window("ts", width), "kind").agg(F.count("latency_ms").alias("n"), F.avg("latency_ms").alias("mean"))
    return out.select(F.col("window.start").alias("start"), "kind", "n", F.round("mean", 6).alias("mean"))


def settled_pairs(rows: DataFrame) -> DataFrame:
    """Rows of ``stream_pairing`` as those of ``session_pairing``."""
    return rows.select("session_id", "event_id", "ts", "left_at", (F.unix_micros("left_at") - F.unix_micros("ts")).alias("micros"))


def autosave(sdf: DataFrame, path: str, every: str | None = "10 minutes", checkpoint: str | None = None) -> StreamingQuery:
    """Keep a store of edited cells (see ``upsert_cells``): each trigger writes the whole state of the cells that it touches.

    No edit is too late and no state is held between triggers; a batch that is run again changes nothing.  Without ``every`` it
    saves what is there and ends.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        upsert_cells(batch, path, batch_id)

    return _each_batch(sdf, save, path, every, checkpoint)


def stream_faces(sdf: DataFrame, layer: str, store: str, faces: str, transparent: DataFrame, doors: DataFrame | None = None, every: str | None = "10 seconds", checkpoint: str | None = None) -> StreamingQuery:
    """Keep the visible faces of an edited layer: each trigger saves its edits and makes the faces of the cells around them anew."""

    def update(batch: DataFrame, batch_id: int) -> None:
        upsert_cells(batch, store, batch_id)
        update_faces(batch, layer, store, faces, batch_id, transparent, doors)

    return _each_batch(sdf, update, faces, every, checkpoint)


def _each_batch(sdf: DataFrame, work: Callable[[DataFrame, int], None], path: str, every: str | None, checkpoint: str | None) -> StreamingQuery:
    out = sdf.writeStream.option("checkpointLocation", checkpoint or f"{path}-checkpoint")
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).foreachBatch(work).start()


def run_available(spark: SparkSession, out: DataFrame, folder: str, mode: str, key: list[str]) -> DataFrame:
    """Run a stream over what is there, each batch to a folder of its own; then the last row of each key."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    out.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    rest = [c for c in rows.columns if c not in (*key, "batch")]
    if not rest:
        return rows.select(*key).distinct()
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*key, "last.*")


def source(spark: SparkSession, path: str, schema, prepare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return prepare(spark.readStream.schema(schema).parquet(path))
