"""Streams whose state is kept by key: means of the last rows, expiry by time, throttling, pairing.

Their state is in RocksDB, on disk, so it may outgrow a task's memory; ``with_rocksdb`` sets it for the queries that it starts.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which ``transformWithState`` needs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


#: Stands for a missing id inside processors, as pandas turns whole numbers with nulls into floats.
NONE = -(1 << 63)
#: Keys are dealt to so many groups, each with one state, as a call a key costs more than its work.  Fixed for a checkpoint.
GROUPS = 192


def _group(key: str) -> Column:
    return F.pmod(F.hash(key), F.lit(GROUPS)).alias("part")


class _LastN(StatefulProcessor):
    """Mean over each row and the n - 1 before it of its key; the state is a group's last n - 1 values of each key, in order."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "known array<boolean>, keys array<bigint>, vals array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        old = self.last.get() if self.last.exists() else ([], [], [])
        known, keys = (np.concatenate([np.array(o, t), new[c].to_numpy(t)]) for o, c, t in zip(old, ("known", "key"), (bool, np.int64)))
        value = np.concatenate([np.array(old[2], float), new["value"].to_numpy(float)])
        order = np.lexsort((keys, known))  # stable: a key's old values first, then its new ones in order
        known, keys, value, fresh = known[order], keys[order], value[order], order - len(old[0])
        cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(known) != 0)) + 1
        sizes = np.diff([0, *cuts, len(keys)])
        place = np.arange(len(keys)) - np.repeat([0, *cuts], sizes)
        there, sums, counts = ~np.isnan(value), np.zeros(len(value)), np.zeros(len(value), int)
        for back in range(min(self.n, len(value)) - 1, -1, -1):
            at = np.flatnonzero(place >= back)
            at = at[there[at - back]]
            sums[at] += value[at - back]
            counts[at] += 1
        mean = np.divide(sums, counts, out=np.full(len(sums), np.nan), where=counts > 0)
        kept = np.repeat(sizes, sizes) - place < self.n
        self.last.update((known[kept].tolist(), keys[kept].tolist(), value[kept].tolist()))
        made = np.flatnonzero(fresh >= 0)
        yield pd.DataFrame({"known": known[made], "key": keys[made], "event_id": new["event_id"].to_numpy()[fresh[made]], "mean": mean[made]})

    def close(self) -> None:
        pass


def stream_rolling_mean(sdf: DataFrame, key: str, value: str, n: int, watermark: str | None = None) -> DataFrame:
    """key, event_id, mean of value over each row and the n - 1 rows of its key before it (nulls are skipped).

    Rows of a batch are taken in order of (ts, event_id), batches as they come, so over a stream in order the result doesn't
    depend on where batches are cut and is that of ``rolling_mean``.  The state of a key is n - 1 numbers.
    """
    own = F.col(key).cast("long")
    rows = sdf.select(own.isNotNull().alias("known"), F.coalesce(own, F.lit(0)).alias("key"), "ts", "event_id", F.col(value).cast("double").alias("value"))
    rows = rows.withWatermark("ts", watermark) if watermark else rows
    out = rows.withColumn("part", _group("key")).groupBy("part").transformWithStateInPandas(_LastN(n), "known boolean, key long, event_id long, mean double", "Update", "None")
    return out.select(F.when(F.col("known"), F.col("key")).alias(key), "event_id", "mean")


def _millis(micros: int) -> int:
    return -(-micros // 1000)


class _Expiry(StatefulProcessor):
    """A group's living entities, and a timer for the first end among them."""

    def __init__(self, ttl: dict[str, int], default: int):
        self.ttl, self.default = ttl, default

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.entity = handle, handle.getValueState("entity", "ids array<bigint>, kinds array<string>, created array<bigint>")

    def _known(self) -> pd.DataFrame:
        ids, kinds, created = self.entity.get() if self.entity.exists() else ([], [], [])
        return pd.DataFrame({"entity_id": np.array(ids, np.int64), "kind": np.array(kinds, object), "created": np.array(created, np.int64), "removed": np.zeros(len(ids), bool)})

    def _ends(self, rows: pd.DataFrame) -> np.ndarray:
        return rows["created"].to_numpy(np.int64) + 1_000_000 * np.array([self.ttl.get(k, self.default) for k in rows["kind"]], np.int64)

    def _keep(self, rows: pd.DataFrame, after: int) -> None:
        """The group's entities from now on; their timer is later than ``after``."""
        if rows.empty:
            self.entity.clear()
            return
        self.entity.update(tuple(rows[c].tolist() for c in ("entity_id", "kind", "created")))
        self.handle.registerTimer(max(_millis(int(self._ends(rows).min())), after + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        new = new[new["there"].to_numpy(bool)].drop(columns="there")
        if len(new):
            new = new.sort_values(["entity_id", "created", "removed", "kind"]).drop_duplicates("entity_id", keep="last")
            # Of an entity's rows the latest holds; of such of one time, the new one.
            every = pd.concat([self._known(), new[["entity_id", "kind", "created", "removed"]]]).sort_values("created", kind="stable").drop_duplicates("entity_id", keep="last")
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self._keep(every[~every["removed"].to_numpy(bool)], timerValues.getCurrentWatermarkInMs())
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        rows = self._known()
        ends = self._ends(rows)
        over = ends <= 1000 * now
        self._keep(rows[~over], now)
        yield rows[over][["entity_id", "kind", "created"]].assign(expired_at=ends[over])

    def close(self) -> None:
        pass


def stream_expiry(sdf: DataFrame, ttl: dict[str, int], default: int = 300, watermark: str = "1 hour") -> DataFrame:
    """entity_id, kind, created, expired_at of each entity (entity_id, kind, created, removed) once the watermark passes its end.

    ``ttl`` has seconds by kind (a fixed list).  The latest row of an entity counts; one that is removed before its end doesn't
    expire.  The state holds living entities only and is empty when all have expired.  Rows without an id are passed over, but
    their time moves the watermark as any other's does.
    """
    or_none = lambda c: F.coalesce(c, F.lit(0))
    at, kind, there = F.unix_micros("created"), F.coalesce("kind", F.lit("")).alias("kind"), F.col("entity_id").isNotNull() & F.col("created").isNotNull()
    timed = sdf.withWatermark("created", watermark)
    keyed = timed.select(_group("entity_id"), or_none("entity_id").alias("entity_id"), there.alias("there"), kind, or_none(at).alias("created"), F.coalesce("removed", F.lit(False)).alias("removed"), F.col("created").alias("ts"))
    out = keyed.groupBy("part").transformWithStateInPandas(_Expiry(ttl, default), "entity_id long, kind string, created long, expired_at long", "Append", "EventTime")
    return out.select("entity_id", "kind", *(F.timestamp_micros(c).alias(c) for c in ("created", "expired_at")))


def _later(keys: np.ndarray, times: np.ndarray, key: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each of key, the place of its first row later than ``after`` among rows in order of (keys, times), or that of the next
    key's first row where it has none."""
    order = np.lexsort((np.repeat([0, 1], [len(keys), len(key)]), np.concatenate([times, after]), np.concatenate([keys, key])))
    asked = order >= len(keys)
    places = np.empty(len(key), np.int64)
    places[order[asked] - len(keys)] = np.cumsum(~asked)[asked]
    return places


class _Throttle(StatefulProcessor):
    """The last accepted time of each key of a group, and a timer for the first of them that no later row can be too near to."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "keys array<bigint>, times array<bigint>")

    def _known(self) -> tuple[np.ndarray, np.ndarray]:
        keys, times = self.last.get() if self.last.exists() else ([], [])
        return np.array(keys, np.int64), np.array(times, np.int64)

    def _keep(self, keys: np.ndarray, times: np.ndarray, now: int) -> None:
        """The accepted times that a row after ``now`` may be too near to, with a timer for the first."""
        near = times + self.gap > 1000 * now
        if not near.any():
            self.last.clear()
            return
        self.last.update((keys[near].tolist(), times[near].tolist()))
        self.handle.registerTimer(_millis(int(times[near].min()) + self.gap))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        keys, times = (new[c].to_numpy(np.int64) for c in ("key", "t"))
        order = np.lexsort((times, keys))
        keys, times = keys[order], times[order]
        each, at, sizes = np.unique(keys, return_index=True, return_counts=True)
        ends, (before, last) = at + sizes, self._known()  # what is known is in order of keys
        if len(before):
            place = np.minimum(np.searchsorted(before, each), len(before) - 1)
            had = before[place] == each
            at[had] = _later(keys, times, each[had], last[place[had]] + self.gap)
        # From each key's first row on, all keys go from one accepted row to the next together.
        following, taken = _later(keys, times, keys, times + self.gap), [np.empty(0, np.int64)]
        while (more := at < ends).any():
            at, ends = at[more], ends[more]
            taken.append(at)
            at = following[at]
        kept = np.sort(np.concatenate(taken))
        keys, times = keys[kept], times[kept]
        # Later times of a key come after what was known of it.
        every, then = np.concatenate([before, keys]), np.concatenate([last, times])
        order = np.argsort(every, kind="stable")
        every, then = every[order], then[order]
        final = np.append(every[1:] != every[:-1], True)[: len(every)]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self._keep(every[final], then[final], timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({"session_id": keys, "t": times})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(*self._known(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))
        yield from ()

    def close(self) -> None:
        pass


#: Keys of ``stream_throttle`` are dealt by their remainder; a prime, so that ids in even steps are dealt as well.
THROTTLE_GROUPS = 191


def stream_throttle(sdf: DataFrame, min_gap_us: int, watermark: str = "1 hour") -> DataFrame:
    """Accepted events (session_id, t in microseconds), as ``throttle`` over a stream in order.

    The state of a key is its last accepted time, dropped once the watermark is so far past that any later event is accepted.
    Keys share a state by their remainder, as a call a key costs more than its work; a batch's rows of one such group are held
    as 16 bytes each and a few times that while they are sorted.  Rows without a time are passed over.
    """
    key = F.coalesce(F.col("session_id").cast("long"), F.lit(NONE))
    timed = sdf.withWatermark("ts", watermark).where("ts IS NOT NULL")
    rows = timed.select((key % THROTTLE_GROUPS).alias("session_id"), key.alias("key"), F.unix_micros("ts").alias("t"), "ts")
    out = rows.groupBy("session_id").transformWithStateInPandas(_Throttle(min_gap_us), "session_id long, t long", "Append", "EventTime")
    return out.select(F.nullif("session_id", F.lit(NONE)).alias("session_id"), "t")


class _Pairing(StatefulProcessor):
    """A group's joins and leaves that the watermark hasn't passed and joins that may still find a leave, in order, with a timer
    for the first of them that can go."""

    COLUMNS = ("session", "t", "event", "until", "joins")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", ", ".join(f"{c} array<bigint>" for c in self.COLUMNS))

    def _known(self) -> list[np.ndarray]:
        return [np.array(v, np.int64) for v in (self.open.get() if self.open.exists() else [[]] * len(self.COLUMNS))]

    def _settle(self, rows: list[np.ndarray], now: int) -> pd.DataFrame:
        """Joins that no row after ``now`` can change, with their leaves; the others, and rows after it, are kept."""
        order = np.lexsort(rows[2::-1])
        session, t, event, until, joins = rows = [v[order] for v in rows]
        over = 1000 * now
        after = np.append(np.arange(1, len(t)), -1)[: len(t)]
        follows = (after >= 0) & (session[after] == session)
        final = follows & (t[after] <= over)  # the next event of the session is known
        left = final & (joins[after] == 0) & (t[after] <= until)
        done = (joins == 1) & (final | (until <= over))
        kept = (t > over) | ((joins == 1) & ~done)
        if kept.any():
            self.open.update(tuple(v[kept].tolist() for v in rows))
            self.handle.registerTimer(_millis(int(np.where(t > over, t, until)[kept].min())))
        else:
            self.open.clear()
        found = {"left_id": np.where(left, event[after], NONE), "left_at": np.where(left, t[after], NONE)}
        return pd.DataFrame({"session_id": session, "event_id": event, "ts": t} | found)[done]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        new = new[new["t"] != NONE]
        both = [np.concatenate([o, new[c].to_numpy(np.int64)]) for o, c in zip(self._known(), self.COLUMNS)]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        yield self._settle(both, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._settle(self._known(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None:
        pass


def stream_pairing(events: DataFrame, longest: str, watermark: str = "1 hour") -> DataFrame:
    """Each join (session_id, event_id, ts) with the event (left_id, left_at) after it among its session's joins and leaves, where
    that is a leave and comes by ``longest`` at most; nulls where it isn't.

    A join comes once, in append mode, when the watermark is past the event after it or past its ``longest``.  The state
    holds joins and leaves of the watermark's delay and joins of the last ``longest`` that have no event after them.  Rows
    without a time are passed over; rows of other kinds move the watermark too.
    """
    or_none = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NONE))
    micros = lambda c: F.coalesce(F.unix_micros(c), F.lit(NONE))
    # A condition that names the event time isn't tried before the watermark is taken.
    timed = events.withWatermark("ts", watermark).where("kind IN ('join', 'leave') OR ts IS NULL")
    until = micros(F.col("ts") + F.expr(f"INTERVAL {longest}"))
    rows = timed.select(_group("session_id"), or_none("session_id").alias("session"), micros("ts").alias("t"), or_none("event_id").alias("event"), until.alias("until"), F.when(F.col("kind") == "join", F.lit(1)).otherwise(F.lit(0)).cast("long").alias("joins"), "ts")
    out = rows.groupBy("part").transformWithStateInPandas(_Pairing(), "session_id long, event_id long, ts long, left_id long, left_at long", "Append", "EventTime")
    given = lambda c: F.nullif(c, F.lit(NONE))
    times = {c: F.timestamp_micros(given(c)) for c in ("ts", "left_at")}
    return out.select(given("session_id").alias("session_id"), given("event_id").alias("event_id"), times["ts"].alias("ts"), given("left_id").alias("left_id"), times["left_at"].alias("left_at"))
