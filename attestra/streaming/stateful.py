"""Keyed state that leaves: caches and running means whose entries expire by event time.

An entry that a row finds too old counts as gone, whatever the batches, and a timer at its expiry takes it out of the
state once the watermark has passed, so that the state holds live keys only. The state lies in RocksDB (see with_state_store).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .streams import match_in_time


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session, with the state store that several kinds of state and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class Expiring(StatefulProcessor):
    """A processor with one timer a key, which clears the key's state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open()

    def expire_at(self, millis: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(millis)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.clear()
        yield from ()

    def close(self) -> None:
        pass


def in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values("at", kind="stable")


class Cache(Expiring):
    """The first value of a key serves later rows until ttl_ms after it; then the next row's value does."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def open(self) -> None:
        self.entry = self.handle.getValueState("entry", "value string, since long")

    def clear(self) -> None:
        self.entry.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        value, since = self.entry.get() if self.entry.exists() else (None, None)
        out = []
        for at, asked in in_order(rows)[["at", "value"]].itertuples(index=False):
            hit = since is not None and 0 <= at - since < self.ttl_ms
            if not hit and (since is None or at >= since):
                value, since = asked, int(at)
            out.append((key[0], int(at), value if hit or since == at else asked, hit))
        self.entry.update((value, since))
        self.expire_at(since + self.ttl_ms)
        yield pd.DataFrame(out, columns=["key", "at", "value", "hit"])


class Means(Expiring):
    """The running exponential mean of a key, which begins anew after idle_ms without a value."""

    def __init__(self, alpha: float, idle_ms: int):
        self.alpha, self.idle_ms = alpha, idle_ms

    def open(self) -> None:
        self.mean = self.handle.getValueState("mean", "mean double, n long, last long")
        self.recent = self.handle.getListState("recent", "at long")

    def clear(self) -> None:
        self.mean.clear()
        self.recent.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mean, n, last = self.mean.get() if self.mean.exists() else (None, 0, None)
        recent = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        for at, v in in_order(rows).dropna(subset=["value"])[["at", "value"]].itertuples(index=False):
            if last is not None and at - last > self.idle_ms:
                mean, n, recent = None, 0, []
            mean, n, last = (float(v) if mean is None else self.alpha * float(v) + (1 - self.alpha) * mean), n + 1, max(int(at), last or 0)
            recent = [t for t in recent if t > last - self.idle_ms] + [int(at)]
        if mean is not None:
            self.mean.update((mean, n, last))
            self.recent.put([(t,) for t in recent])
            self.expire_at(last + self.idle_ms)
            yield pd.DataFrame([(key[0], mean, n, len(recent))], columns=["key", "ewma", "n", "recent"])


def keyed(stream: DataFrame, key: str, at: str, value: str, late: str):
    rows = stream.select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("event_time"), F.unix_millis(F.col(at).cast("timestamp")).alias("at"), F.col(value).alias("value"))
    return rows.where("key is not null and at is not null").withWatermark("event_time", late).groupBy("key"), rows.schema["key"].dataType.simpleString()


def cached(stream: DataFrame, key: str, at: str, value: str, ttl_ms: int = 5000, late: str = "1 minute") -> DataFrame:
    """(key, at, value, hit) of each row (at in milliseconds of event time): what a cache with that time to live answers, and
    whether it had it. Rows without a key or a time are left out; one that is older than the entry gets its own value."""
    with_state_store(stream.sparkSession)
    grouped, kind = keyed(stream, key, at, value, late)
    return grouped.transformWithStateInPandas(Cache(ttl_ms), f"key {kind}, at long, value string, hit boolean", "Append", "EventTime")


def running_means(stream: DataFrame, key: str, at: str, value: str, alpha: float = 0.15, idle_ms: int = 30_000, late: str = "1 minute") -> DataFrame:
    """(key, ewma, n, recent) of each key with new rows after a batch: the mean since the key was last idle for longer than
    idle_ms, the number of its values and how many of them lie within idle_ms of the last. Null values are passed over."""
    with_state_store(stream.sparkSession)
    grouped, kind = keyed(stream, key, at, value, late)
    return grouped.transformWithStateInPandas(Means(alpha, idle_ms), f"key {kind}, ewma double, n long, recent long", "Update", "EventTime")


def nearest_match(files: DataFrame, points: DataFrame, tolerance_s: int = 3600, late: str = "2 hours") -> DataFrame:
    """(file, file_ts, ts, latitude, longitude): for each file of a stream the waypoint nearest in time within the
    tolerance, ties to the earlier; it is told once the watermark has passed the file."""
    m = match_in_time(files, points, tolerance_s, late)
    gap = F.abs(F.unix_micros("ts") - F.unix_micros("file_ts"))
    best = m.groupBy("file", "file_ts").agg(F.min(F.struct(gap.alias("gap"), "ts", "latitude", "longitude")).alias("m"))
    return best.select("file", "file_ts", "m.ts", "m.latitude", "m.longitude")
