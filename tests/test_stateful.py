"""State that expires: caches, running means, and the nearest waypoint of a stream."""

import pytest
from pyspark.sql import functions as F

from attestra.operators import gps
from attestra.streaming import stateful, streams


@pytest.fixture
def run(spark, tmp_path):
    """The rows that a stream over batches of rows gives, batch by batch, and the rows of state that are left at the end."""

    def go(make, batches, schema):
        src = str(tmp_path / "in")
        for b in batches:
            spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(src)
        out = []
        q = make(streams.file_stream(spark, src, schema, files_per_batch=1)).writeStream.outputMode(go.mode).option("checkpointLocation", str(tmp_path / "cp"))
        q = q.foreachBatch(lambda d, i: out.extend((i, *r) for r in d.collect())).trigger(availableNow=True).start()
        q.awaitTermination()
        left = [s.numRowsTotal for s in q.lastProgress.stateOperators]
        return out, left

    go.mode = "append"
    return go


SCHEMA = "k string, ms long, v string"
at = lambda: F.timestamp_millis("ms")


def test_a_cache_serves_until_its_time_and_then_starts_anew(run):
    batches = [
        [("a", 1000, "one"), ("a", 3000, "two"), ("b", 1000, "x"), (None, 5, "y"), ("a", None, "z")],
        [("a", 5999, "three"), ("a", 6000, "four"), ("a", 7000, "five")],
        [("b", 300_000, "late")],
        [("b", 600_000, "last"), ("a", 599_000, "again")],
    ]
    out, _ = run(lambda d: stateful.cached(d.withColumn("t", at()), "k", "t", "v", 5000, "10 seconds"), batches, SCHEMA)
    assert {(k, ms): (v, hit) for _, k, ms, v, hit in out} == {
        ("a", 1000): ("one", False), ("a", 3000): ("one", True), ("a", 5999): ("one", True), ("a", 6000): ("four", False), ("a", 7000): ("four", True),
        ("b", 1000): ("x", False), ("b", 300_000): ("late", False), ("b", 600_000): ("last", False), ("a", 599_000): ("again", False),
    }


def test_means_start_anew_after_an_idle_time_and_leave_the_state(run):
    run.mode = "update"
    batches = [
        [("a", 50_000, "10"), ("a", 51_000, "20"), ("b", 50_000, "7"), ("c", 50_500, None)],
        [("a", 81_000, "30"), ("b", 80_001, "9")],
        [("a", 900_000, "1")],
        [("d", 2_000_000, "4")],
        [("d", 4_000_000, "5")],
    ]
    make = lambda d: stateful.running_means(d.withColumn("t", at()).withColumn("x", F.col("v").cast("double")), "k", "t", "x", 0.15, 30_000, "10 seconds")
    out, left = run(make, batches, SCHEMA)
    got = {(i, k): (round(e, 6), n, r) for i, k, e, n, r in out}
    assert got[0, "a"] == (11.5, 2, 2) and got[0, "b"] == (7.0, 1, 1)
    assert got[1, "a"] == (round(0.15 * 30 + 0.85 * 11.5, 6), 3, 1) and got[1, "b"] == (9.0, 1, 1)  # b was idle for 30,001 ms
    assert got[2, "a"] == (1.0, 1, 1) and got[4, "d"] == (5.0, 1, 1) and not any(k == "c" for _, k in got)
    assert left[0] <= 4, "keys that expired are still in the state"


def test_the_nearest_waypoint_of_a_stream(spark, run):
    rows = [("f", 10_000 * k + 50_500, str(k)) for k in range(20)] + [("p", 7000 * k + 50_000, str(k)) for k in range(30)]
    batches = [rows[:10] + rows[20:30], rows[10:20] + rows[30:], [("f", 10_000_000, "98"), ("p", 20_000_000, "98")], [("f", 40_000_000, "99"), ("p", 50_000_000, "99")]]

    def sides(d):
        d = d.withColumn("t", at())
        return d.where("k = 'f'").select(F.col("v").alias("file"), F.col("t").alias("file_ts")), d.where("k = 'p'").select(F.col("t").alias("ts"), F.col("v").try_cast("double").alias("latitude"), F.lit(0.5).alias("longitude"))

    out, _ = run(lambda d: stateful.nearest_match(*sides(d), 3, "10 seconds"), batches, SCHEMA)
    files, points = sides(spark.createDataFrame(rows, SCHEMA))
    still = gps.nearest_in_time(files, points.withColumn("track", F.lit(0)).withColumn("seq", F.lit(0)).withColumn("altitude", F.lit(None).cast("double")), 3)
    want = {(r["file"], r["latitude"]) for r in still.collect()}
    assert {(r[1], r[4]) for r in out} == want and len(out) == len(want) > 5
