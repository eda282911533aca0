"""Sessions, messages, rates, throttling, expiry and deny lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.storage import written


COUNTERS = {"bm": "mined", "bp": "placed", "cr": "chunk_requests", "ms": "messages", "r": "respawns", "d": "deaths", "join": "joins", "leave": "leaves"}


def session_rollup(events: DataFrame, firsts: tuple[str, ...] = ("kind",)) -> DataFrame:
    """Per session: first and last time, the first value of each column of firsts that has one, and counters of each kind."""
    first = (F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", "event_id"))).alias(f"first_{c}") for c in firsts)
    return events.groupBy("session_id").agg(F.min("ts").alias("connected"), F.max("ts").alias("last_seen"), *first, *(F.count_if(F.col("kind") == k).alias(n) for k, n in COUNTERS.items()))


def server_info(events: DataFrame, started=None, now=None, region: str | None = None) -> DataFrame:
    """Sessions in all, and those whose last event isn't a leave; with ``started`` and ``now``, the uptime in seconds and the
    region as well.  ``online_players`` lists the names."""
    last = events.groupBy("session_id").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("kind"))
    one = last.agg(F.count("*").alias("sessions"), F.count_if(F.col("kind") != "leave").alias("online"))
    if started is None:
        return one
    seconds = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.lit(started).cast("timestamp"))
    return one.select("*", seconds.alias("uptime"), F.lit(region).alias("region"))


def online_players(events: DataFrame) -> DataFrame:
    """session_id, name of the sessions whose last event isn't a leave; the name is the first one given, or null."""
    at = F.struct("ts", "event_id")
    each = events.groupBy("session_id").agg(F.max_by("kind", at).alias("kind"), F.min_by("name", F.when(F.col("name").isNotNull(), at)).alias("name"))
    return each.where("kind <> 'leave'").select("session_id", "name")


def player_ping(pings: DataFrame, n: int = 30) -> DataFrame:
    """Mean of the latest n latencies, rounded half up, as text; 'disc' where there is none."""
    recent = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("event_id"))
    top = pings.withColumn("rn", F.row_number().over(recent)).where(F.col("rn") <= n)
    mean = S.half_up(F.avg("latency_ms"))
    return top.groupBy("session_id").agg(F.coalesce(mean.cast("string"), F.lit("disc")).alias("ping"))


def rolling_mean(df: DataFrame, key: str, order: list[str], value: str, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn("mean", F.avg(value).over(w))


def recent_n(messages: DataFrame, key: str, order: str, n: int = 100) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return messages.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def _side(inclusive: bool) -> str:
    return "left" if inclusive else "right"


def _segments(batches):
    """(part, key, times) of each run of rows of one part and key, in order; at most a part's rows of one key are held."""
    held: tuple | None = None
    for pdf in batches:
        parts, keys, times = pdf["part"].to_numpy(), pdf["key"], pdf["t"].to_numpy()
        codes, _ = pd.factorize(keys, use_na_sentinel=False)
        cuts = np.flatnonzero((np.diff(parts) != 0) | (np.diff(codes) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(times)]):
            if lo == hi:
                continue
            part, key = parts[lo], keys.iloc[lo]
            if held is not None and held[0] == part and (held[1] == key or pd.isna(held[1]) and pd.isna(key)):
                held[2].append(times[lo:hi])
                continue
            if held is not None:
                yield held[0], held[1], np.concatenate(held[2])
            held = (part, key, [times[lo:hi]])
    if held is not None:
        yield held[0], held[1], np.concatenate(held[2])


def throttle(df: DataFrame, key: str, ts: str, min_gap: float, inclusive: bool = False) -> DataFrame:
    """Events (key, t as a number) accepted: more than min_gap (or as much, if inclusive) after the last accepted of the key.

    Rows are dealt by ranges of key and time, so a key with most of them lies in many parts.  Where a part begins inside a
    key, the time of the last accepted row before it isn't known yet, but the first row that it accepts lies within a gap of
    its first; for each of these rows the part tells where the chain that starts there ends.  Carrying one time over these
    few rows (one a part and key that reaches over its edge) gives each part's start, and all parts accept at once.
    """
    rows = df.select(F.col(key).alias("key"), F.col(ts).cast("double").alias("t")).where(F.col("t").isNotNull())
    kind = rows.schema["key"].dataType.simpleString()
    ranged = written(rows.repartitionByRange("key", "t").withColumn("part", F.spark_partition_id()))
    ordered = lambda df: df.repartition("part").sortWithinPartitions("part", "key", "t")

    def ends(batches):
        for part, name, t in _segments(batches):
            after = np.maximum(np.searchsorted(t, t + min_gap, _side(inclusive)), np.arange(len(t)) + 1)
            chain = np.where(after < len(t), after, np.arange(len(t)))
            while (further := chain[chain] != chain).any():
                chain = np.where(further, chain[chain], chain)
            n = min(len(t), int(np.searchsorted(t, t[0] + max(min_gap, 0), "right")) + 1)
            last = np.flatnonzero(np.append(np.diff(chain[:n]) != 0, True))  # of the starts whose chains end together
            yield pd.DataFrame({"part": [part], "key": [name], "starts": [t[last]], "ends": [t[chain[:n][last]]]})

    def carried(pdf: pd.DataFrame) -> pd.DataFrame:
        last, known = -np.inf, []
        for starts, stops in zip(*(pdf.sort_values("part")[c] for c in ("starts", "ends"))):
            known.append(last)
            i = int(np.searchsorted(starts, last + min_gap, _side(inclusive)))
            last = stops[i] if i < len(starts) else last
        return pd.DataFrame({"part": pdf.sort_values("part")["part"], "key": pdf.sort_values("part")["key"], "last": known})

    # A key of one part needs no start, and keys of several lie at the parts' edges: two a part at most.
    several = ranged.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("key")
    same = lambda other: F.col("key").eqNullSafe(other["name"])
    wide = F.broadcast(several.withColumnRenamed("key", "name"))
    over = ordered(ranged.join(wide, same(wide), "left_semi")).mapInPandas(ends, f"part int, key {kind}, starts array<double>, ends array<double>")
    start = over.groupBy("key").applyInPandas(carried, f"part int, key {kind}, last double")
    begun = F.broadcast(start.select(F.col("part").alias("p"), F.col("key").alias("name"), "last"))
    told = ranged.join(begun, (F.col("part") == begun["p"]) & same(begun), "left").select("part", "key", "t", "last")

    def accept(batches):
        known, last = None, -np.inf
        for pdf in batches:
            chosen = []
            parts, keys, times, before = pdf["part"].to_numpy(), pdf["key"], pdf["t"].to_numpy(), pdf["last"].to_numpy(float)
            codes, _ = pd.factorize(keys, use_na_sentinel=False)
            cuts = np.flatnonzero((np.diff(parts) != 0) | (np.diff(codes) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(times)]):
                if lo == hi:
                    continue
                name = (parts[lo], None if pd.isna(keys.iloc[lo]) else keys.iloc[lo])
                if known != name:
                    last = before[lo] if before[lo] == before[lo] else -np.inf
                known = name
                while True:
                    i = lo + int(np.searchsorted(times[lo:hi], last + min_gap, _side(inclusive)))
                    if i >= hi:
                        break
                    chosen.append(i)
                    last, lo = times[i], i + (not inclusive or min_gap <= 0)
            yield pdf.iloc[chosen][["key", "t"]]

    return ordered(told).mapInPandas(accept, f"key {kind}, t double").withColumnRenamed("key", key)


def expire_ttl(entities: DataFrame, now, ttl_dim: DataFrame) -> DataFrame:
    """Entities (kind, created) not older than their kind's ttl_seconds at ``now``."""
    return entities.join(F.broadcast(ttl_dim), "kind", "left").where(F.col("created").cast("timestamp") + F.make_interval(secs=F.coalesce("ttl_seconds", F.lit(300))) >= F.lit(now).cast("timestamp")).drop("ttl_seconds")


def session_pairing(events: DataFrame) -> DataFrame:
    """Each join with the next leave of its session before another join, and the seconds between; null if none."""
    w = Window.partitionBy("session_id").orderBy("ts", "event_id")
    marks = events.where(F.col("kind").isin("join", "leave"))
    paired = marks.withColumns({"next_kind": F.lead("kind").over(w), "next_ts": F.lead("ts").over(w)}).where("kind = 'join'")
    left = F.when(F.col("next_kind") == "leave", F.col("next_ts"))
    seconds = F.unix_micros(left.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return paired.select("session_id", "event_id", "ts", left.alias("left_at"), seconds.alias("micros"))


def deny_list_anti(sessions: DataFrame, deny: DataFrame) -> DataFrame:
    """Sessions whose token and ip bucket are both not listed, as two equal-key anti joins."""
    return sessions.join(deny.select("token").distinct(), "token", "left_anti").join(deny.select("ip_bucket").distinct(), "ip_bucket", "left_anti")


def stat_metrics(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.when(F.avg(value) > 0, 1000 / F.avg(value)), 6).alias("rate"))
