"""Streaming counterparts: incremental import, known-hash filters, progress and location matching."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """New files of a folder, a bounded number a batch; the checkpoint remembers which were read."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder)


def first_of_each(stream: DataFrame, key: str = "hash", at: str | None = None, within: str = "1 day") -> DataFrame:
    """Each key's first row; with an event time, state is kept only as long as the watermark needs."""
    if at is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def unknown_only(stream: DataFrame, known: DataFrame, key: str = "hash") -> DataFrame:
    """Rows of a stream whose key a table does not hold."""
    return stream.join(known.select(F.col(key).alias("_known")).distinct(), F.col(key) == F.col("_known"), "left_anti")


def import_available(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Appends all that is there to a Parquet table and stops; a later call goes on from there."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", table).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def windowed_counts(stream: DataFrame, at: str, keys: list[str], width: str = "30 seconds", slide: str | None = None, late: str = "1 minute") -> DataFrame:
    """(window_start, window_end, *keys, n) over tumbling or sliding windows of event time."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    g = stream.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def sessions(stream: DataFrame, at: str, keys: list[str], gap: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """(session_start, session_end, *keys, n) of activity without gaps."""
    g = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def ewma_stream(stream: DataFrame, key: str, order: str, value: str, alpha: float = 0.15) -> DataFrame:
    """(key, ewma, n) after each batch: the running exponential mean of each key's values. The state
    is two numbers a key, and stays."""

    def update(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean, n = state.get if state.exists else (None, 0)
        for v in pd.concat(list(frames)).sort_values("o")["v"].dropna():
            mean, n = (float(v) if mean is None else alpha * float(v) + (1 - alpha) * mean), n + 1
        if mean is not None:
            state.update((mean, n))
            yield pd.DataFrame({"key": [k[0]], "ewma": [mean], "n": [n]})

    kind = dict(stream.dtypes)[key]
    rows = stream.select(F.col(key).alias("key"), F.col(order).alias("o"), F.col(value).alias("v"))
    return rows.groupBy("key").applyInPandasWithState(update, f"key {kind}, ewma double, n long", "mean double, n long", "update", GroupStateTimeout.NoTimeout)


def match_in_time(files: DataFrame, points: DataFrame, tolerance_s: int = 3600, late: str = "2 hours") -> DataFrame:
    """Pairs of a stream of files (file, file_ts) and one of waypoints (ts, latitude, longitude) within
    the tolerance. Both meet on buckets of time as wide as the tolerance, since streams join on equal keys
    only: a file asks its own bucket and both beside it. Watermarks bound what either side keeps."""
    width = max(1, int(tolerance_s * 1_000_000))
    bucket = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / width).cast("long")
    near = F.explode(F.array(*[bucket(F.col("file_ts")) + k for k in (-1, 0, 1)]))
    f = files.withWatermark("file_ts", late).withColumn("_bucket", near)
    p = points.withWatermark("ts", late).withColumn("_at", bucket(F.col("ts")))
    span = F.expr(f"ts BETWEEN file_ts - INTERVAL {int(tolerance_s)} SECONDS AND file_ts + INTERVAL {int(tolerance_s)} SECONDS")
    return f.join(p, (F.col("_bucket") == F.col("_at")) & span).select("file", "file_ts", "ts", "latitude", "longitude")


class ProgressLog(StreamingQueryListener):
    """Progress of queries as JSON lines of a file, and of steps reported by hand."""

    def __init__(self, path: str):
        self.path = path

    def write(self, **row) -> None:
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps(row) + "\n")

    def step(self, name: str, percent: float) -> None:
        self.write(type="progress", step=name, percent=percent)

    def onQueryStarted(self, event):
        self.write(type="started", id=str(event.id))

    def onQueryProgress(self, event):
        p = event.progress
        self.write(type="progress", id=str(p.id), batch=p.batchId, rows=p.numInputRows, rate=p.processedRowsPerSecond)

    def onQueryIdle(self, event):
        self.write(type="idle", id=str(event.id))

    def onQueryTerminated(self, event):
        self.write(type="complete" if event.exception is None else "error", id=str(event.id), error=event.exception)
