"""Streams over several batches against the batch operators, and what is left of their state."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from latticeworks.operators import sessions as E
from latticeworks.streaming import jobs, stateful

START = dt.datetime(2024, 1, 1)
EVENT = "session_id long, event_id long, ts timestamp, kind string, latency_ms double"


def _events(rng, n=120, sessions=4):
    at = sorted(rng.randrange(0, 3000) for _ in range(n))
    return [(rng.randrange(sessions), i, START + dt.timedelta(minutes=m), rng.choice(("join", "leave", "bp")), None if rng.random() < 0.1 else rng.random() * 100) for i, m in enumerate(at)]


def _stream(spark, folder, batches, schema):
    """One file a batch, taken one by one."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def _run(spark, out, folder, mode):
    """Rows of all batches, and the progress of the last."""
    query = None
    with stateful.with_rocksdb(spark):
        query = out.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/out/batch={i}")).start()
        query.awaitTermination()
    return spark.read.parquet(f"{folder}/out"), query.recentProgress


def _state(spark, folder, name):
    """Rows left in a state variable, and timers that are still set."""
    with stateful.with_rocksdb(spark):
        read = lambda option, value: spark.read.format("statestore").option(option, value).load(f"file://{folder}/checkpoint").collect()
        rows, timers = read("stateVarName", name), read("readRegisteredTimers", "true")
    assert len(timers) == len(rows)
    return rows


def _cut(rows, cuts):
    return [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)]) if a < b]


@pytest.mark.parametrize("cuts", [[], [1, 2, 50], [30, 31, 90, 119]])
def test_means_of_the_last_rows(spark, tmp_path, cuts):
    rows = _events(random.Random(5))
    got, _ = _run(spark, stateful.stream_rolling_mean(_stream(spark, tmp_path, _cut(rows, cuts), EVENT), "session_id", "latency_ms", 4), tmp_path, "update")
    want = E.rolling_mean(spark.createDataFrame(rows, EVENT), "session_id", ["ts", "event_id"], "latency_ms", 4)
    plain = lambda df: {(r.session_id, r.event_id, None if r["mean"] is None else round(r["mean"], 6)) for r in df.collect()}
    assert plain(got) == plain(want) and got.count() == len(rows)


def test_pairing_over_batches(spark, tmp_path):
    rows = _events(random.Random(7), 160, 3)
    closing = [(-1, 10_000, START + dt.timedelta(days=60), None, None)]
    out = jobs.stream_pairing(_stream(spark, tmp_path, [*_cut(rows, [40, 41, 100]), closing], EVENT), "40 DAYS")
    raw, progress = _run(spark, out, tmp_path, "append")
    got = {tuple(r) for r in jobs.settled_pairs(raw.drop("batch")).collect()}
    want = {tuple(r) for r in E.session_pairing(spark.createDataFrame(rows, EVENT)).collect()}
    assert got == want and any(t[3] is None for t in got) and any(t[3] for t in got)
    assert progress[-1].stateOperators[0].numRowsTotal == 0


def test_a_join_without_a_leave_comes_after_the_watermark(spark, tmp_path):
    first = [(1, 1, START, "join", None)]
    later = [(2, 2, START + dt.timedelta(hours=h), "leave", None) for h in (30,)]
    for k, (batches, n) in enumerate([([first], 0), ([first, later], 1)]):
        folder = tmp_path / str(k)
        raw, _ = _run(spark, jobs.stream_pairing(_stream(spark, folder, batches, EVENT), "1 DAY"), folder, "append")
        found = raw.where("session_id = 1").collect()
        assert len(found) == n and all(r.left_at is None for r in found)


@pytest.mark.parametrize("cuts", [[], [1, 70], [40, 41, 100]])
def test_a_join_is_paired_once(spark, tmp_path, cuts):
    """One row a join however many leaves its session has: joins twice in a row, ties of time, batches that overlap within the
    watermark's delay, missing sessions, and rows without a time."""
    rng = random.Random(8)
    rows = [(rng.choice((1, 1, 1, 193, -1, None)), *r[1:]) for r in _events(rng, 160)]
    rows += [(1, 500 + i, START + dt.timedelta(minutes=3100), k, None) for i, k in enumerate(("join", "join", "leave", "leave", "join"))]
    rows += [(2, 600, START, "join", None), (2, 601, START + dt.timedelta(minutes=3101), "leave", None)]
    given = sorted(rows, key=lambda r: (r[2] + dt.timedelta(minutes=rng.randrange(0, 50)), r[1]))
    assert given != sorted(rows, key=lambda r: r[2])
    closing = [(-2, 10_000, START + dt.timedelta(days=60), "bp", None), (5, 10_001, None, "join", None)]
    out = jobs.stream_pairing(_stream(spark, tmp_path, [*_cut(given, cuts), closing], EVENT), "2 DAYS")
    raw, _ = _run(spark, out, tmp_path, "append")
    day = F.expr("left_at <= ts + INTERVAL 2 DAYS")
    want = E.session_pairing(spark.createDataFrame(rows, EVENT)).withColumns({c: F.when(day, F.col(c)) for c in ("left_at", "micros")})
    key = lambda r: tuple((v is None, v or 0) if not isinstance(v, dt.datetime) else (False, v.timestamp()) for v in r)
    assert sorted(jobs.settled_pairs(raw.drop("batch")).collect(), key=key) == sorted(want.collect(), key=key)
    assert raw.count() == sum(r[3] == "join" for r in rows)
    assert _state(spark, tmp_path, "open") == []


ENTITY = "entity_id long, kind string, created timestamp, removed boolean"


def test_entities_expire_by_kind(spark, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    batches = [
        [(1, "drop", at(0), False), (2, "fireball", at(0), False), (3, "drop", at(1), False), (6, None, at(1), None)],
        [(3, "drop", at(2), True), (4, "fireball", at(4), False), (1, "drop", at(3), False)],  # 3 is picked up, 1 is dropped anew
        [(5, "drop", at(20), False)],
        [(None, None, at(600), False)],
    ]
    out = stateful.stream_expiry(_stream(spark, tmp_path, batches, ENTITY), {"fireball": 15}, 300, "1 minute")
    got, progress = _run(spark, out, tmp_path, "append")
    minutes = {r.entity_id: ((r.expired_at - START).total_seconds() / 60, r.batch) for r in got.collect()}
    assert {k: v[0] for k, v in minutes.items()} == {1: 8.0, 2: 0.25, 4: 4.25, 5: 25.0, 6: 6.0}
    assert minutes[2][1] < minutes[1][1] < minutes[5][1] and got.count() == 5
    assert _state(spark, tmp_path, "entity") == []


def test_throttle_drops_its_state(spark, tmp_path):
    rows = _events(random.Random(9))
    closing = [(-1, 10_000, START + dt.timedelta(days=60), "bp", None), (-1, 10_001, START + dt.timedelta(days=90), "bp", None)]
    gap = 45 * 60_000_000
    out = stateful.stream_throttle(_stream(spark, tmp_path, [*_cut(rows, [10, 11, 70]), closing[:1], closing[1:]], EVENT), gap)
    got, progress = _run(spark, out, tmp_path, "append")
    want = E.throttle(spark.createDataFrame(rows, EVENT).withColumn("us", F.unix_micros("ts")), "session_id", "us", gap)
    assert {(r.session_id, r.t) for r in got.where("session_id >= 0").collect()} == {(r.session_id, int(r.t)) for r in want.collect()}
    assert [r.key.session_id for r in _state(spark, tmp_path, "last")] == [-1]  # the last closing row


@pytest.mark.parametrize("cuts", [[], [10, 11, 150, 299]])
def test_throttled_keys_share_a_state(spark, tmp_path, cuts):
    """Keys of one remainder, negative ones, a missing one, ties of time, and rows without a time."""
    rng, group = random.Random(12), stateful.THROTTLE_GROUPS
    ids = (0, group, 2 * group, -1, -1 - group, 5, None)
    rows = [(rng.choice(ids), *r[1:]) for r in _events(rng, 300)]
    batches = [*_cut(rows, cuts), [(0, 10_000, None, "bp", None)]]
    gap = 45 * 60_000_000
    got, _ = _run(spark, stateful.stream_throttle(_stream(spark, tmp_path, batches, EVENT), gap), tmp_path, "append")
    want = E.throttle(spark.createDataFrame(rows, EVENT).withColumn("us", F.unix_micros("ts")), "session_id", "us", gap)
    found = [(r.session_id, r.t) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == {(r.session_id, int(r.t)) for r in want.collect()}
    assert 0 < len(_state(spark, tmp_path, "last")) <= 4


@pytest.mark.parametrize("gap, inclusive", [(45.0, False), (45.0, True), (7.5, False), (0.0, True), (10_000.0, False)])
def test_throttle_of_a_key_in_many_parts(spark, gap, inclusive):
    """A key with most rows, in several parts, ties of time and a null key."""
    rng = random.Random(11)
    rows = [(1 if rng.random() < 0.8 else rng.choice((0, 2, None)), float(rng.randrange(0, 3000))) for _ in range(3000)]
    want, last = [], {}
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        if k not in last or (t - last[k] >= gap if inclusive else t - last[k] > gap):
            want.append((k, t))
            last[k] = t
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in E.throttle(spark.createDataFrame(rows, "k long, t double"), "k", "t", gap, inclusive).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(got, key=key) == want


@pytest.mark.parametrize("name", ["stream_rolling_mean", "stream_throttle"])
def test_a_batch_of_several_files_is_one_trigger(spark, tmp_path, name):
    """Events in files whose times overlap: batches are cut by time and not by file."""
    from latticeworks.plans import registry

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    conf = {"spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got, want = ({tuple(r) for r in registry.queries()[q](spark, str(tmp_path)).collect()} for q in (name, name.removeprefix("stream_")))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want


@pytest.mark.parametrize("name, like", [("autosave", "save_world"), ("stream_faces", None)])
def test_a_store_has_a_version_a_batch(spark, tmp_path, monkeypatch, name, like):
    """Edits in several files make no more versions than batches."""
    from latticeworks.plans import registry, streams

    for table in ("events", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    monkeypatch.setattr(streams, "new_folder", lambda spark, what: f"file://{tmp_path}/{what}")
    conf = {"spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = registry.queries()[name](spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(list((tmp_path / "replay" / "0").glob("*.parquet"))) > 1
    assert rows and 1 < len(list((tmp_path / {"autosave": "autosave", "stream_faces": "faces"}[name]).glob("batch=*"))) <= 5
    if like:
        assert set(rows) == set(registry.queries()[like](spark, str(tmp_path)).collect())


def test_a_batch_of_one_input_file_is_split_among_tasks(spark, tmp_path, monkeypatch):
    """A batch's files hold some rows each, though the table is one file in order of time."""
    from latticeworks.plans import registry, streams

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").coalesce(1).sortWithinPartitions("ts").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(streams, "FILE_ROWS", 100, raising=False)
    monkeypatch.setattr(streams, "new_folder", lambda spark, what: f"file://{tmp_path}/{what}")
    rows = registry.queries()["autosave"](spark, str(tmp_path)).collect()
    sizes = [spark.read.parquet(f"file://{f}").count() for f in (tmp_path / "replay").glob("[0-3]/*.parquet")]
    assert max(sizes) <= 100 and sum(sizes) == spark.read.parquet(f"{tmp_path}/events.parquet").count()
    assert len(list((tmp_path / "autosave").glob("batch=*"))) <= 5
    assert set(rows) == set(registry.queries()["save_world"](spark, str(tmp_path)).collect())
