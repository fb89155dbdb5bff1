"""Time-based location matching: nearest in time, interpolation, and the whole enrichment.

files: (file, file_ts timestamp); waypoints: (track, seq, ts timestamp, latitude, longitude,
altitude). Both joins put files and waypoints on one timeline in chunks (see ordered), so that neither
pairs files with waypoints and one track or user may hold any share of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Ordered, first_cover, last_value, next_value, row_after, row_number

STRATEGIES = ("timestamp", "interpolate", "nearest")


def micros(c: str | Column) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def nearest_in_time(files: DataFrame, waypoints: DataFrame, tolerance_s: float = 3600, offset_s: float = 0, by: list[str] | None = None, file: str = "file") -> DataFrame:
    """(*by, file, latitude, longitude, altitude, time_delta_s, confidence): for each file the
    waypoint nearest in time within the tolerance, ties to the earlier, of equal times that of the smallest track and
    seq; files without one are left out, of a file's several times the nearest counts.

    confidence is 1 - delta / tolerance; with a tolerance of 0, 1. by: columns that both sides share and that must agree.
    A file meets the last waypoint before it and the first after it on one timeline, and no others.
    """
    by = by or []
    f = files.select(*by, (micros("file_ts") + int(offset_s * 1_000_000)).alias("_t"), F.lit(1).alias("_kind"), F.col(file).alias("file")).where("_t is not null")
    point = F.min(F.struct("track", "seq", "latitude", "longitude", "altitude")).alias("_p")
    w = waypoints.select(*by, micros("ts").alias("_t"), "track", "seq", "latitude", "longitude", "altitude").where("_t is not null").groupBy(*by, "_t").agg(point)
    w = w.select(*by, "_t", F.lit(0).alias("_kind"), F.struct(F.col("_t").alias("w"), "_p.*").alias("_p"))
    line = Ordered(f.unionByName(w, allowMissingColumns=True), by, ["_t", "_kind", "file"])
    met = line.scan(before=last_value("_p"), after=next_value("_p")).where("_kind = 1")
    near = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.w") - F.col("_t")).alias("gap"), F.col(f"{c}.w"), F.col(f"{c}.latitude"), F.col(f"{c}.longitude"), F.col(f"{c}.altitude")))
    m = met.select(*by, "file", F.least(near("before"), near("after")).alias("m")).where(F.col("m.gap") <= int(tolerance_s * 1_000_000))
    m = m.groupBy(*by, "file").agg(F.min("m").alias("m"))
    delta = F.col("m.gap") / F.lit(1e6)
    sure = F.coalesce(1 - F.try_divide(delta, F.lit(float(tolerance_s))), F.lit(1.0))
    return m.select(*by, "file", "m.latitude", "m.longitude", "m.altitude", delta.alias("time_delta_s"), sure.alias("confidence"))


def segments(waypoints: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Consecutive timed points of each track: (*by, track, seg, t1, t2, and both points' places)."""
    by = by or []
    p = waypoints.select(*by, "track", micros("ts").alias("t1"), "seq", "latitude", "longitude", "altitude").where("t1 is not null")
    line = Ordered(p, [*by, "track"], ["t1", "seq"])
    s = line.scan(seg=row_number(), then=row_after(F.struct("t1", "latitude", "longitude", "altitude"))).where("then is not null")
    return s.select(*by, "track", "seq", "seg", "t1", F.col("then.v.t1").alias("t2"), *[c for x in ("latitude", "longitude", "altitude") for c in (F.col(x), F.col(f"then.v.{x}").alias(f"{x}2"))])


def interpolated(files: DataFrame, waypoints: DataFrame, offset_s: float = 0, by: list[str] | None = None, file: str = "file") -> DataFrame:
    """(*by, file, latitude, longitude, altitude, time_delta_s, confidence): for each file the first
    segment (in order of track, then time) that holds its time, and the place on it; altitude only if both ends have one.
    Segments and files are one timeline, on which the open segments are carried along (see first_cover)."""
    by = by or []
    s = segments(waypoints, by)
    places = ("latitude", "latitude2", "longitude", "longitude2", "altitude", "altitude2")
    s = s.select(*by, F.col("t1").alias("low"), F.col("t2").alias("high"), F.struct("track", "seg").alias("rank"), F.struct("track", "seg", "t1", "t2", *places).alias("interval"))
    f = files.select(*by, (micros("file_ts") + int(offset_s * 1_000_000)).alias("at"), F.col(file).alias("point"))
    j = first_cover(f, s, by).select(*by, F.col("at").alias("_t"), F.col("point").alias("file"), "interval.*")
    part = F.coalesce(F.try_divide((F.col("_t") - F.col("t1")).cast("double"), (F.col("t2") - F.col("t1")).cast("double")), F.lit(0.0))
    at = lambda c: (F.col(c) + (F.col(f"{c}2") - F.col(c)) * part).alias(c)
    gap = F.least(F.col("_t") - F.col("t1"), F.col("t2") - F.col("_t")) / F.lit(1e6)
    j = j.select(*by, "file", "track", "seg", at("latitude"), at("longitude"), at("altitude"), gap.alias("time_delta_s"))
    m = j.groupBy(*by, "file").agg(F.min(F.struct("track", "seg", "latitude", "longitude", "altitude", "time_delta_s")).alias("m"))
    return m.select(*by, "file", "m.latitude", "m.longitude", "m.altitude", "m.time_delta_s", F.lit(0.9).alias("confidence"))


def first_waypoint(files: DataFrame, waypoints: DataFrame, file: str = "file") -> DataFrame:
    """Every file at the first waypoint in order of track and seq, whatever its time (confidence 0.5)."""
    one = waypoints.orderBy("track", "seq").limit(1).select("latitude", "longitude", "altitude")
    return files.select(F.col(file).alias("file")).crossJoin(F.broadcast(one)).select("*", F.lit(0.0).alias("time_delta_s"), F.lit(0.5).alias("confidence"))  # one row


def enrich(files: DataFrame, waypoints: DataFrame, strategy: str = "interpolate", tolerance_s: float = 3600, offset_s: float = 0, overwrite: bool = False, file: str = "file") -> DataFrame:
    """Each file once with status (matched, unmatched, existing) and its match. A file with a
    place already (has_gps) keeps it unless overwrite; interpolation is used where no waypoint is near enough."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    has = F.coalesce(F.col("has_gps"), F.lit(False)) if "has_gps" in files.columns else F.lit(False)
    todo = files if overwrite else files.where(~has)
    if strategy == "nearest":
        m = first_waypoint(todo, waypoints, file).withColumn("strategy", F.lit("nearest"))
    else:
        m = nearest_in_time(todo, waypoints, tolerance_s, offset_s, file=file).withColumn("strategy", F.lit("timestamp"))
        if strategy == "interpolate":
            more = interpolated(todo, waypoints, offset_s, file=file).withColumn("strategy", F.lit("interpolate"))
            m = m.unionByName(more.join(m.select("file"), "file", "left_anti"))
    out = files.select(F.col(file).alias("file"), has.alias("_has")).join(m, "file", "left")
    status = F.when(F.col("latitude").isNotNull(), "matched").when(F.col("_has") & F.lit(not overwrite), "existing").otherwise("unmatched")
    return out.withColumn("status", status).drop("_has")


def enrich_counts(enriched: DataFrame) -> DataFrame:
    """One row: processed, matched, existing, skipped."""
    count = lambda s: F.count_if(F.col("status") == s)
    return enriched.agg(F.count("*").alias("processed"), count("matched").alias("matched"), count("existing").alias("existing"), count("unmatched").alias("skipped"))


def bounds(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Number, box, elevations and dates of points (latitude, longitude, altitude, ts)."""
    agg = [F.count("*").alias("points")]
    for c, names in (("latitude", ("south", "north")), ("longitude", ("west", "east")), ("altitude", ("lowest", "highest")), ("ts", ("first_ts", "last_ts"))):
        agg += [F.min(c).alias(names[0]), F.max(c).alias(names[1])]
    return points.groupBy(*(by or [])).agg(*agg)
