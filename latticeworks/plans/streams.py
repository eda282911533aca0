"""Streaming queries over the events table, run to its end."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators.cell_store import read_layer, stored_cells, stored_faces, stored_voxels, upsert_cells, write_layer
from ..operators.voxels import overlay_layers
from ..operators.world import to_cells
from ..streaming import jobs, stateful
from .inputs import VIEWS, view
from .storage import new_folder


def _events(spark, sf_dir, name: str):
    """The edits or session_events view over a stream of the events table."""
    path = f"{sf_dir}/events.parquet"
    raw = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    columns = re.search(r"SELECT (.*) FROM events", VIEWS[name], re.S)[1]
    out = spark.sql(f"SELECT {columns} FROM {{events}}", events=raw)
    return out.withColumn("ts", F.col("ts").cast("timestamp"))


def _query(name: str, make, view: str, mode: str, key: list[str], merge=lambda rows: rows):
    def run(spark, sf_dir):
        return merge(jobs.run_available(spark, make(_events(spark, sf_dir, view)), new_folder(spark, name), mode, key))

    return run


def _ticks(rows):
    return rows.select(F.col("tick").cast("timestamp_ntz").alias("tick"), "n", F.array_join(F.transform("edits", lambda e: e["event_id"].cast("string")), " ").alias("edits"))


def _rates(rows):
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


#: A replayed batch's files hold so many rows at most, so its tasks are even where the table lies in order of time too.
FILE_ROWS = 250_000


def _replay(spark, sf_dir, name: str, run, batches: int = 4) -> None:
    """Call run with a stream of the view's rows after each of several batches in order of time, and after a last row that closes
    it: of session or event -1, without a kind, a hundred days later.

    run goes on from its checkpoint and takes all files that are new, so a trigger has a whole batch however many files it has.
    """
    columns, folder = re.search(r"SELECT (.*) FROM events", VIEWS[name], re.S)[1], new_folder(spark, "replay")
    rows = spark.sql(f"SELECT {columns} FROM {{events}}", events=spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("ts", F.col("ts").cast("timestamp"))
    cuts = rows.agg(F.percentile_approx(F.unix_micros("ts"), [k / batches for k in range(1, batches)], 1000).alias("c"), F.max("ts").alias("last")).first()
    place = sum((F.unix_micros("ts") > c).cast("int") for c in cuts.c or [])
    closing = rows.limit(1).select(*(F.lit(-1).cast(t).alias(c) if c.endswith("_id") else (F.lit(cuts.last) + F.expr("INTERVAL 100 DAYS")).alias(c) if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes))
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/*")
    for k, batch in enumerate([*(rows.where(place == k) for k in range(batches)), closing]):
        batch.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{folder}/{k}")
        run(stream)


def _text(rows):
    return rows.select("cx", "cy", "cz", F.array_join(F.transform("rle", lambda x: x.cast("string")), " ").alias("rle"))


def autosave(spark, sf_dir):
    """Run lengths of the store after all edits, which come in several triggers."""
    path = new_folder(spark, "autosave")
    _replay(spark, sf_dir, "edits", lambda edits: jobs.autosave(edits.where("event_id >= 0"), path, every=None).awaitTermination())
    return _text(stored_cells(spark, path))


def _faces(spark, sf_dir):
    """Layer, transparent values and doors (two of the classes) for faces kept over edits."""
    from . import registry

    get = lambda name: view(spark, sf_dir, name)
    layer = new_folder(spark, "layer")
    write_layer(registry.valued(get), layer)
    return layer, registry.clear_values(get), registry.door_values(get)


def stream_faces(spark, sf_dir):
    """Visible faces of the cells around all edits, kept over several triggers."""
    layer, clear, doors = _faces(spark, sf_dir)
    store, faces = new_folder(spark, "store"), new_folder(spark, "faces")
    _replay(spark, sf_dir, "edits", lambda edits: jobs.stream_faces(edits.where("event_id >= 0"), layer, store, faces, clear, doors, every=None).awaitTermination())
    return stored_faces(spark, faces)


def materialize_cells(spark, sf_dir):
    """The cells of removed blocks, from a layer and a store of edits that are laid out by regions."""
    from . import registry

    edits, layer, store = view(spark, sf_dir, "edits"), new_folder(spark, "layer"), new_folder(spark, "store")
    write_layer(registry.valued(lambda name: view(spark, sf_dir, name)), layer)
    upsert_cells(edits, store, 0)
    cells = to_cells(edits.where("v = 0"))
    return overlay_layers(read_layer(spark, layer, cells), stored_voxels(spark, store, cells=cells))


#: A join's leave comes by so many days later at most in the stream.
LONGEST = 30


def stream_pairing(spark, sf_dir):
    """Joins with their leaves, from a stream joined with itself."""
    rows = _ended(spark, sf_dir, lambda events: jobs.stream_pairing(events, f"{LONGEST} DAYS"), "pairing", "append")
    out = jobs.settled_pairs(rows)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "left_at")})


def _ended(spark, sf_dir, make, name: str, mode: str):
    """All rows that a stream made of the sessions' events gave up to its end."""
    folder = new_folder(spark, name)

    def run(events):
        out = make(events)
        jobs.run_available(spark, out, folder, mode, out.columns)

    with stateful.with_rocksdb(spark):
        _replay(spark, sf_dir, "session_events", run)
    return spark.read.parquet(f"{folder}/out").drop("batch")


TTL = {"bp": 90 * 86400, "bm": 45 * 86400}


def stream_expiry(spark, sf_dir):
    """Events as entities that expire by kind."""
    entities = lambda events: events.select(F.expr("nullif(event_id, -1)").alias("entity_id"), "kind", F.col("ts").alias("created"), F.lit(False).alias("removed"))
    out = _ended(spark, sf_dir, lambda events: stateful.stream_expiry(entities(events), TTL, 60 * 86400), "expiry", "append")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created", "expired_at")})


def stream_rolling_mean(spark, sf_dir):
    out = _ended(spark, sf_dir, lambda events: stateful.stream_rolling_mean(events.where("event_id >= 0"), "session_id", "latency_ms", 10), "means", "update")
    return out.withColumn("mean", F.round("mean", 6))


def stream_throttle(spark, sf_dir):
    out = _ended(spark, sf_dir, lambda events: stateful.stream_throttle(events, 3_600_000_000), "throttle", "append")
    return out.where("session_id >= 0").withColumn("t", F.col("t").cast("double"))


QUERIES = {
    "stream_edits": _query("edits", jobs.stream_edits, "edits", "update", ["start", "x", "y", "z"], jobs.latest_edits),
    "tick_batches": _query("ticks", jobs.tick_batches, "edits", "update", ["tick"], _ticks),
    "stream_session_counters": _query("counters", jobs.stream_session_counters, "session_events", "update", ["start", "session_id"], jobs.sum_counters),
    "stream_dirty_cells": _query("dirty", jobs.stream_dirty_cells, "edits", "append", ["cx", "cy", "cz"]),
    "rate_metrics": _query("rates", jobs.rate_metrics, "session_events", "update", ["start", "kind"], _rates),
}
QUERIES |= {f.__name__: f for f in (autosave, stream_faces, materialize_cells, stream_pairing, stream_expiry, stream_rolling_mean, stream_throttle)}
SQL = {
    "tick_batches": "SELECT time_bucket(INTERVAL '50 milliseconds', ts) AS tick, CAST(count(*) AS INT) AS n, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY event_id) AS edits FROM edits GROUP BY 1",
    "rate_metrics": "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, kind, count(latency_ms) AS n, round(avg(latency_ms), 6) AS mean FROM session_events GROUP BY ALL",
    "stream_edits": "SELECT x, y, z, arg_max(v, (ts, event_id)) AS v FROM edits GROUP BY x, y, z",
    "stream_session_counters": "SELECT session_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS \"{k}\"" for k in jobs.KINDS) + " FROM session_events GROUP BY session_id",
    "stream_rolling_mean": "SELECT session_id, event_id, round(avg(latency_ms) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS mean FROM session_events",
    "stream_expiry": "SELECT event_id AS entity_id, kind, ts AS created, ts + CASE kind WHEN 'bp' THEN INTERVAL 90 DAY WHEN 'bm' THEN INTERVAL 45 DAY ELSE INTERVAL 60 DAY END AS expired_at FROM session_events",
    "stream_pairing": f"SELECT session_id, event_id, ts, CASE WHEN near THEN nt END AS left_at, CASE WHEN near THEN epoch_us(nt) - epoch_us(ts) END AS micros FROM (SELECT *, nk = 'leave' AND nt <= ts + INTERVAL {LONGEST} DAY AS near FROM (SELECT *, lead(kind) OVER w AS nk, lead(ts) OVER w AS nt FROM session_events WHERE kind IN ('join', 'leave') WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)) WHERE kind = 'join')",
    "stream_dirty_cells": "WITH d(dx, dy, dz) AS (VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) SELECT DISTINCT CAST(floor((x+dx)/16) AS INT) AS cx, CAST(floor((y+dy)/16) AS INT) AS cy, CAST(floor((z+dz)/16) AS INT) AS cz FROM edits CROSS JOIN d",
}
