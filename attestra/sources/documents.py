"""Interchange documents as expressions over their text: manifests, hash lists, bags, sidecars,
GPS files, subtitles, companion telemetry and calendars. Each takes a DataFrame with a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions.metadata import cue_seconds, flat
from attestra.functions.paths import strip_cue_tags, tag_text, xml_unescape

# --- manifests, hash lists, bags -----------------------------------------------------------------

MANIFEST = "version string, generated string, algorithm string, hashLength int, root string, files array<struct<path string, hash string, size bigint, mtime string>>"


def manifest_entries(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc columns, version, algorithm, hash_length, path, hash, size, mtime) of JSON manifests; no row for an empty or broken one."""
    m = F.from_json(text, MANIFEST).alias("_m")
    return docs.select("*", m).select(*docs.columns, F.col("_m.version").alias("version"), F.col("_m.algorithm").alias("algorithm"), F.col("_m.hashLength").alias("hash_length"), F.inline("_m.files"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return manifest_entries(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")).drop("text")


def blocks(text: str | Column, tag: str) -> Column:
    """The inner texts of all elements of a name."""
    return F.regexp_extract_all(text, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))


def inner(c: Column, tag: str) -> Column:
    return xml_unescape(F.trim(tag_text(c, tag)))


def hash_list_entries(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc columns, list_version, creator, path, size, modified, xxh64, md5) of media hash lists."""
    version = F.coalesce(F.nullif(F.regexp_extract(text, r'<hashlist[^>]*version="([^"]*)"', 1), F.lit("")), F.lit("2.0"))
    creator = F.coalesce(inner(F.regexp_extract(text, "(?is)<creatorinfo>(.*?)</creatorinfo>", 1), "name"), F.lit("unknown"))
    d = docs.withColumn("list_version", version).withColumn("creator", creator).withColumn("_h", F.explode(blocks(text, "hash")))
    h = F.col("_h")
    return d.select(*docs.columns, "list_version", "creator", inner(h, "file").alias("path"), F.coalesce(inner(h, "size").try_cast("long"), F.lit(0)).alias("size"), inner(h, "lastmodificationdate").alias("modified"), F.lower(inner(h, "xxhash64")).alias("xxh64"), F.lower(inner(h, "md5")).alias("md5"))


def bag_manifest_entries(lines: DataFrame, line: str = "value") -> DataFrame:
    """(hash, path) of manifest lines; other lines are passed over."""
    p = r"^([a-f0-9]+)\s{2}(.+)$"
    return lines.where(F.col(line).rlike(p)).select(F.regexp_extract(line, p, 1).alias("hash"), F.regexp_extract(line, p, 2).alias("path"))


def declared_oxum(text: Column) -> Column:
    """struct<bytes, count> of a bag-info text; null if it declares none."""
    p = r"Payload-Oxum:\s*(\d+)\.(\d+)"
    return F.when(text.rlike(p), F.struct(F.regexp_extract(text, p, 1).cast("long").alias("bytes"), F.regexp_extract(text, p, 2).cast("long").alias("count")))


# --- GPS -----------------------------------------------------------------------------------------



def gps_format(path: Column) -> Column:
    e = F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))
    return F.when(e.isin("kml", "kmz"), "kml").when(e == "gpx", "gpx").when(e.isin("geojson", "json"), "geojson")


def number(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def stamp(c: Column) -> Column:
    return F.try_to_timestamp(F.trim(c))


def attribute(c: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(c, rf'{name}="([^"]*)"', 1), F.lit(""))


def gpx_points(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc columns, track, track_name, seq, name, latitude, longitude, altitude, ts): waypoints have
    track -1; tracks, their segments joined, count from 0, then routes, which have no times. Points name lat before lon."""
    point = lambda tag: rf'(?is)(<{tag}\s+lat="[^"]+"\s+lon="[^"]+"[^>]*?(?:/>|>.*?</{tag}>))'
    of = lambda c, tag: F.regexp_extract_all(c, F.lit(point(tag)), F.lit(1))
    tracks = F.transform(blocks(text, "trk"), lambda t: F.struct(F.trim(tag_text(t, "name")).alias("track_name"), of(t, "trkpt").alias("points"), F.lit(True).alias("timed")))
    routes = F.transform(blocks(text, "rte"), lambda t: F.struct(F.trim(tag_text(t, "name")).alias("track_name"), of(t, "rtept").alias("points"), F.lit(False).alias("timed")))
    way = F.array(F.struct(F.lit(None).cast("string").alias("track_name"), of(F.col(text), "wpt").alias("points"), F.lit(True).alias("timed")))
    d = docs.select("*", F.posexplode(F.concat(way, tracks, routes)).alias("track", "_t")).select("*", F.posexplode("_t.points").alias("seq", "_p"))
    p = F.col("_p")
    ts = F.when(F.col("_t.timed"), stamp(tag_text(p, "time")))
    return d.select(*docs.columns, (F.col("track") - 1).alias("track"), F.col("_t.track_name").alias("track_name"), "seq", F.trim(tag_text(p, "name")).alias("name"), number(attribute(p, "lat")).alias("latitude"), number(attribute(p, "lon")).alias("longitude"), number(tag_text(p, "ele")).alias("altitude"), ts.alias("ts"))


def coordinates(c: Column) -> Column:
    """Points of 'lon,lat[,alt]' parts between white space."""
    part = lambda s, i: F.try_element_at(F.split(s, ","), F.lit(i)).try_cast("double")
    pts = F.transform(F.split(F.trim(c), r"\s+"), lambda s: F.struct(part(s, 1).alias("longitude"), part(s, 2).alias("latitude"), part(s, 3).alias("altitude")))
    return F.filter(pts, lambda p: p["longitude"].isNotNull() & p["latitude"].isNotNull())


def kml_points(docs: DataFrame, text: str = "text") -> DataFrame:
    """As gpx_points. A placemark gives a waypoint at its first coordinate; each LineString, also
    one in a placemark, a track; each gx:Track a track whose times go by place."""
    first = lambda b: coordinates(F.regexp_extract(b, r"(?is)<coordinates[^>]*>(.*?)</coordinates>", 1))
    point = lambda name, lat, lon, alt, ts: F.struct(name.alias("name"), lat.alias("latitude"), lon.alias("longitude"), alt.alias("altitude"), ts.alias("ts"))
    no_text, no_time = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    marks = F.filter(
        F.transform(blocks(text, "Placemark"), lambda b: F.struct(b.alias("b"), F.get(first(b), F.lit(0)).alias("p"))),
        lambda x: x["p"].isNotNull(),
    )
    way = F.transform(marks, lambda x: point(F.trim(tag_text(x["b"], "name")), x["p"]["latitude"], x["p"]["longitude"], x["p"]["altitude"], stamp(tag_text(x["b"], "when"))))
    lines = F.transform(blocks(text, "LineString"), lambda b: F.struct(F.lit("Track").alias("track_name"), F.transform(first(b), lambda p: point(no_text, p["latitude"], p["longitude"], p["altitude"], no_time)).alias("points")))

    def gx(b: Column) -> Column:
        whens = F.filter(F.transform(F.regexp_extract_all(b, F.lit("(?i)<when>([^<]+)</when>"), F.lit(1)), stamp), lambda t: t.isNotNull())
        coords = F.regexp_extract_all(b, F.lit("(?i)<gx:coord>([^<]+)</gx:coord>"), F.lit(1))
        part = lambda s, i: F.try_element_at(F.split(F.trim(s), r"\s+"), F.lit(i)).try_cast("double")
        pts = F.transform(coords, lambda s, i: point(no_text, part(s, 2), part(s, 1), part(s, 3), F.get(whens, i)))
        return F.struct(F.lit("gx:Track").alias("track_name"), F.filter(pts, lambda p: p["latitude"].isNotNull() & p["longitude"].isNotNull()).alias("points"))

    every = F.concat(F.array(F.struct(no_text.alias("track_name"), way.alias("points"))), F.filter(F.concat(lines, F.transform(blocks(text, "gx:Track"), gx)), lambda t: F.size(t["points"]) > 0))
    d = docs.select("*", F.posexplode(every).alias("track", "_t")).select("*", F.posexplode("_t.points").alias("seq", "_p"))
    return d.select(*docs.columns, (F.col("track") - 1).alias("track"), F.col("_t.track_name").alias("track_name"), "seq", *[F.col(f"_p.{c}").alias(c) for c in ("name", "latitude", "longitude", "altitude", "ts")])


def geojson_points(docs: DataFrame, text: str = "text") -> DataFrame:
    """As gpx_points, from Points, MultiPoints, LineStrings and MultiLineStrings, collections
    included; other geometries give nothing, and a text that is no JSON gives no row."""
    from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

    more = [("track", IntegerType()), ("track_name", StringType()), ("seq", IntegerType()), ("name", StringType()), ("latitude", DoubleType()), ("longitude", DoubleType()), ("altitude", DoubleType()), ("_ts", StringType())]
    schema = StructType([*docs.schema.fields, *[StructField(n, t) for n, t in more]])
    names = docs.columns

    def run(batches):
        import json

        import pyarrow as pa

        def points(doc):
            way, tracks = [], []

            def geometry(g, props):
                kind, c = (g or {}).get("type"), (g or {}).get("coordinates")
                if kind == "Point":
                    way.append((props.get("name"), c, props.get("timestamp") or props.get("time")))
                elif kind == "MultiPoint":
                    way.extend((props.get("name"), p, None) for p in c)
                elif kind == "LineString":
                    tracks.append((props.get("name"), c))
                elif kind == "MultiLineString":
                    tracks.extend((props.get("name"), line) for line in c)
                elif kind == "GeometryCollection":
                    for sub in g.get("geometries") or []:
                        geometry(sub, props)

            for f in doc.get("features") or [] if doc.get("type") == "FeatureCollection" else [doc]:
                geometry(f.get("geometry") if f.get("type") == "Feature" else f, f.get("properties") or {})
            for i, (name, p, t) in enumerate(way):
                yield -1, None, i, name, p, t
            for k, (name, line) in enumerate(tracks):
                for i, p in enumerate(line):
                    yield k, name, i, None, p, None

        for b in batches:
            rows = []
            for row in b.to_pylist():
                try:
                    found = list(points(json.loads(row[text])))
                    new = [(*(row[n] for n in names), k, tn, i, nm, float(p[1]), float(p[0]), float(p[2]) if len(p) > 2 else None, t if isinstance(t, str) else None) for k, tn, i, nm, p, t in found]
                except (ValueError, TypeError, KeyError, IndexError, AttributeError):
                    continue
                rows += new
            kinds = [*b.schema.types, pa.int32(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [*names, *(n for n, _ in more)])

    return docs.mapInArrow(run, schema).withColumn("ts", stamp(F.col("_ts"))).drop("_ts")


def gps_points(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """The points of GPX, KML and GeoJSON files by their extension."""
    cols = [*docs.columns, "track", "track_name", "seq", "name", "latitude", "longitude", "altitude", "ts"]
    of = lambda kind: docs.where(gps_format(F.col(path)) == kind)
    return gpx_points(of("gpx"), text).select(cols).unionByName(kml_points(of("kml"), text).select(cols)).unionByName(geojson_points(of("geojson"), text).select(cols))


def timed(points: DataFrame) -> DataFrame:
    """The waypoints and track points that have a time."""
    return points.where("ts is not null")


# --- subtitles -----------------------------------------------------------------------------------


def subtitle_format(path: Column, text: Column) -> Column:
    """By the text's head first, then the extension; null if neither tells."""
    e = F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))
    t = F.ltrim(text)
    return F.when(t.startswith("WEBVTT"), "vtt").when(F.contains(t, F.lit("[Script Info]")), "ass").when(t.rlike(r"^\d+\s*\r?\n\d{2}:\d{2}:\d{2},\d{3}"), "srt").when(t.rlike(r"^\d+:\d{2}:\d{2}\.\d{3},\d+:\d{2}:\d{2}\.\d{3}"), "sbv").when(e.isin("srt", "vtt", "sbv"), e).when(e.isin("ass", "ssa"), "ass")


def subtitle_cues(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(doc columns, format, seq, start_s, end_s, cue) of each cue that has a text."""
    d = docs.withColumn("format", subtitle_format(F.col(path), F.col(text)))
    body = F.regexp_replace(F.col(text), r"\r\n?", "\n")
    arrow = r"(?s)(?:^|\n)\s*((?:\d+:)?\d+:\d+[.,]\d+)\s*-->\s*((?:\d+:)?\d+:\d+[.,]\d+)[^\n]*\n?(.*)$"
    comma = r"(?s)^\s*(\d+:\d+:\d+\.\d+),(\d+:\d+:\d+\.\d+)[^\n]*\n?(.*)$"
    line = r"^Dialogue:\s*[^,]*,([^,]*),([^,]*),(?:[^,]*,){6}(.*)$"
    parts = F.when(F.col("format") == "ass", F.split(body, "\n")).otherwise(F.split(body, r"\n\s*\n"))
    d = d.select("*", F.posexplode(parts).alias("seq", "_b"))
    pick = lambda i: F.when(F.col("format") == "ass", F.regexp_extract("_b", line, i)).when(F.col("format") == "sbv", F.regexp_extract("_b", comma, i)).otherwise(F.regexp_extract("_b", arrow, i))
    cue = F.trim(F.regexp_replace(strip_cue_tags(pick(3)), r"\s*\n\s*", " "))
    out = d.select(*docs.columns, "format", "seq", cue_seconds(pick(1)).alias("start_s"), cue_seconds(pick(2)).alias("end_s"), cue.alias("cue"))
    return out.where("format is not null and start_s is not null and cue <> ''")


def subtitle_stats(cues: DataFrame, key: str = "path") -> DataFrame:
    """(key, cues, duration_s, words, chars) of subtitle_cues()."""
    words = F.size(F.filter(F.split("cue", r"\s+"), lambda w: w != ""))
    return cues.groupBy(key).agg(F.count("*").alias("cues"), F.max("end_s").alias("duration_s"), F.sum(words).alias("words"), F.sum(F.length("cue")).alias("chars"))


# --- sidecars ------------------------------------------------------------------------------------

REQUIRED = ("ContentHash", "SourcePath", "ImportTimestamp", "SessionID")
# Tags of the nested parts; a part is null unless one of its first tags is there.
PARTS = {
    "device": (14, (
        "USBVendorID", "USBProductID", "USBSerial", "USBDevicePath", "USBDeviceName", "CardReaderVendor", "CardReaderModel", "CardReaderSerial",
        "MediaType", "MediaSerial", "MediaManufacturer", "MediaCapacity", "CameraBodySerial", "PhoneDeviceID", "USBBusLocation", "CardReaderPort",
        "MediaFirmware", "CameraInternalName", "TetheredConnection",
    )),
    "photo": (10, (
        "CreationDevice", "CreationSoftware", "CaptureDate", "GPSLatitude", "GPSLongitude", "LensModel", "FocalLength", "Aperture", "ShutterSpeed",
        "ISO", "GPSAltitude", "ColorSpace", "BitDepth", "ICCProfile",
    )),
    "video": (6, (
        "VideoContainer", "VideoCodec", "VideoResolution", "VideoWidth", "VideoHeight", "VideoDuration", "VideoFrameRate", "VideoFrameRateMode",
        "VideoBitRate", "VideoFrameCount", "VideoColorSpace", "VideoHDR", "VideoScanType", "AudioCodec", "AudioChannels", "AudioSampleRate",
        "AudioBitRate",
    )),
}
# Tags of the record itself, in the order in which they are written.
CORE = (
    "SchemaVersion", "SidecarCreated", "SidecarUpdated", "ContentHash", "ContentHashFull", "HashAlgorithm", "FileSize", "Verified", "SourceHash",
    "DestHash", "HashMatch", "FileCategory", "FileSubcategory", "DetectedMimeType", "DeclaredExtension", "ExtensionMismatch", "SourcePath",
    "SourceFilename", "SourceHost", "SourceVolume", "SourceVolumeSerial", "SourceType", "ImportTimestamp", "SessionID", "ToolVersion", "ImportUser",
    "ImportHost", "ImportPlatform", "OriginalMtime", "OriginalCtime", "OriginalBtime", "BatchID", "BatchName", "BatchSequence", "DedupStatus",
    "DuplicateOf", "WasRenamed", "OriginalFilename", "DestFilename", "IsLivePhoto", "LivePhotoRole", "RelationType", "IsPrimaryFile", "FirstSeen",
    "EventCount",
)
# Fixed values of the sidecars' wire format: the prefix and name space of their tags.
TAG_PREFIX, NAMESPACE = "wnb", "http://wnb.dev/xmp/1.0/"
HASH_LINE = rf"\n?[ \t]*<{TAG_PREFIX}:SidecarHash>[^<]*</{TAG_PREFIX}:SidecarHash>"


def field(text: str | Column, tag: str) -> Column:
    return xml_unescape(tag_text(F.col(text) if isinstance(text, str) else text, f"{TAG_PREFIX}:{tag}"))


def snake(tag: str) -> str:
    import re

    return re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", tag).lower()


def sidecar_records(docs: DataFrame, text: str = "text") -> DataFrame:
    """Sidecar texts as columns: the core tags, the nested parts, custody events, errors and validity.

    A required tag that is missing and a self-hash that disagrees are errors; a missing self-hash is a warning."""
    from attestra.functions.hashing import blake3_full

    t = F.col(text)
    cols = [field(t, tag).alias(snake(tag)) for tag in CORE]
    for name, (n, tags) in PARTS.items():
        some = F.coalesce(*[field(t, tag) for tag in tags[:n]]).isNotNull()
        cols.append(F.when(some, F.struct(*[field(t, tag).alias(snake(tag)) for tag in tags])).alias(name))
    event = lambda b: F.struct(*[field(b, tag).alias(snake(tag)) for tag in ("EventID", "EventTimestamp", "EventAction", "EventOutcome", "EventLocation", "EventUser", "EventHost", "EventTool", "EventHashValue", "EventNotes")])
    chain = F.regexp_extract(t, rf"(?is)<{TAG_PREFIX}:CustodyChain>(.*?)</{TAG_PREFIX}:CustodyChain>", 1)
    cols.append(F.transform(F.filter(blocks(chain, "rdf:li"), lambda b: F.contains(b, F.lit(f"{TAG_PREFIX}:EventID"))), event).alias("custody"))
    stored, actual = field(t, "SidecarHash"), F.substring(blake3_full(F.regexp_replace(t, HASH_LINE, "")), F.lit(1), F.length(field(t, "SidecarHash")))
    missing = F.filter(F.array(*[F.when(field(t, tag).isNull(), F.lit(f"missing {tag}")) for tag in REQUIRED]), lambda x: x.isNotNull())
    wrong = F.when(stored != actual, F.array(F.lit("self-hash disagrees"))).otherwise(F.array().cast("array<string>"))
    errors = F.concat(F.when(~F.contains(t, F.lit("<x:xmpmeta")), F.array(F.lit("not a sidecar"))).otherwise(F.array().cast("array<string>")), missing, wrong)
    out = docs.select("*", *cols, errors.alias("errors"), F.when(stored.isNull(), F.array(F.lit("no self-hash"))).otherwise(F.array().cast("array<string>")).alias("warnings"))
    return out.withColumn("valid", F.size("errors") == 0)


# --- companion telemetry -------------------------------------------------------------------------


def found(text: str | Column, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))


# What cameras call a thing in telemetry, its tag, and whether it is a number.
TELEMETRY = (
    ("rel_alt", "RelativeAltitude", True), ("abs_alt", "AbsoluteAltitude", True), ("iso", "ISO", False), ("shutter", "ShutterSpeed", False), ("fnum", "FNumber", True),
    ("ev", "ExposureCompensation", True), ("ct", "ColorTemperature", False), ("color_md", "ColorMode", False), ("focal_len", "FocalLength", True),
)
# Tags of a clip's XML, their elements and attributes; items have a name and a value.
CLIP = (
    ("UMID", "TargetMaterial", "umidRef"), ("DurationFrames", "Duration", "value"), ("CreationDate", "CreationDate", "value"), ("Make", "Device", "manufacturer"), ("Model", "Device", "modelName"),
    ("Serial", "Device", "serialNo"), ("VideoCodec", "VideoFrame", "videoCodec"), ("CaptureFps", "VideoFrame", "captureFps"), ("FormatFps", "VideoFrame", "formatFps"), ("Resolution", "VideoLayout", "pixel"),
    ("Lines", "VideoLayout", "numOfVerticalLine"), ("AspectRatio", "VideoLayout", "aspectRatio"), ("AudioCodec", "AudioRecPort", "audioCodec"), ("AudioChannels", "AudioFormat", "numOfChannel"), ("RecordingMode", "RecordingMode", "type"),
)
CLIP_ITEMS = (("Gamma", "CaptureGammaEquation"), ("ColorPrimaries", "CaptureColorPrimaries"), ("CodingEquations", "CodingEquations"))
# Tags of an adjustment list and of a cinema camera's settings, and their keys.
ADJUSTMENT = (("Format", "adjustmentFormatIdentifier"), ("Version", "adjustmentFormatVersion"), ("Editor", "adjustmentEditorBundleID"))
SETTINGS = (("ISO", "iso", False), ("Kelvin", "kelvin", False), ("Tint", "tint", True), ("Exposure", "exposure", True))


def telemetry_pairs(text: str) -> tuple[Column, Column]:
    """The names and values of a telemetry text's `name: value` parts, in order."""
    pair = r"([A-Za-z_]+)\s*:\s*([^\s\[\],]+)"
    return F.regexp_extract_all(text, F.lit(pair), F.lit(1)), F.regexp_extract_all(text, F.lit(pair), F.lit(2))


def drone_tags(text: str) -> Column:
    """The tags of a drone's SRT telemetry: of each name the first value, and the last place if there are several frames with one."""
    names, values = telemetry_pairs(text)
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    every = lambda key: F.transform(F.filter(pairs, lambda p: F.lower(p["k"]) == key), lambda p: p["v"])
    first = lambda key, number: F.get(every(key), F.lit(0)).try_cast("double") if number else F.get(every(key), F.lit(0))
    when = F.nullif(F.regexp_extract(text, r"(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{3})", 1), F.lit(""))
    placed = (F.size(every("latitude")) > 0) & (F.size(every("longitude")) > 0)
    moved = (F.size(every("latitude")) > 1) & (F.size(every("longitude")) > 1)
    place = {f"GPS{n}": F.when(placed, first(n.lower(), True)) for n in ("Latitude", "Longitude")}
    end = {f"GPS{n}End": F.when(moved, F.try_element_at(every(n.lower()), F.lit(-1)).try_cast("double")) for n in ("Latitude", "Longitude")}
    frames = F.size(every("framecnt"))
    a = flat("", DateTimeOriginal=F.replace(when, F.lit(" "), F.lit("T")), **place, GPSAltitude=first("abs_alt", True))
    return F.map_concat(a, flat("DJI:", DateTimeOriginal=when, **place, **{tag: first(key, number) for key, tag, number in TELEMETRY}, **end, FrameCount=F.when(frames > 0, frames), TelemetrySource=F.lit("SRT")))


def sony_tags(text: str) -> Column:
    """The tags of a camera's non-real-time XML, by element and attribute in any order of attributes, and of its items by name."""
    of = {tag: found(text, rf'<{element}\b[^>]*?\b{attribute}="([^"]+)"') for tag, element, attribute in CLIP}
    items = {tag: F.coalesce(found(text, rf'<Item\b[^>]*?\bname="{name}"[^>]*?\bvalue="([^"]+)"'), found(text, rf'\bname="{name}"\s+value="([^"]+)"')) for tag, name in CLIP_ITEMS}
    gyroscope = F.when(F.col(text).rlike("(?i)gyro"), "true")
    return flat("Sony:", **of, **items, HasGyroscope=gyroscope)


def edit_tags(text: str) -> Column:
    """The tags of an iOS adjustment property list."""
    of = {tag: found(text, rf"<key>{key}</key>\s*<string>([^<]+)</string>") for tag, key in ADJUSTMENT}
    return flat("AAE:", HasAdjustments=F.contains(F.col(text), F.lit("adjustmentData")), **of)


def cinema_tags(text: str) -> Column:
    """The tags of a cinema camera's whole settings file: the number behind a name, some letters between."""
    return flat("RED:", **{tag: found(text, rf"(?i){key}[^-\d]{{0,12}}(-?[\d.]+)" if signed else rf"(?i){key}\D{{0,12}}(\d+)") for tag, key, signed in SETTINGS})


def log_exchange_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc columns, clip, tags) of each data line of an Avid log exchange: the columns' names by their tabs."""
    body = F.regexp_replace(F.col(text), r"\r", "")
    head = F.split(F.trim(F.regexp_extract(body, r"(?s)(?:^|\n)Column\n([^\n]*)", 1), F.lit("\n")), "\t")
    lines = F.filter(F.split(F.regexp_extract(body, r"(?s)(?:^|\n)Data\n(.*)$", 1), "\n"), lambda x: F.trim(x) != "")
    d = docs.select("*", head.alias("_h"), F.posexplode(lines).alias("clip", "_l"))
    pairs = F.filter(F.arrays_zip(F.col("_h").alias("k"), F.split("_l", "\t").alias("v")), lambda p: p["k"].isNotNull() & (p["k"] != "") & p["v"].isNotNull())
    return d.select(*docs.columns, "clip", F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["k"], p["v"]))).alias("tags"))


def camera_xml(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc columns, format, make, model, lens, recorded_at, duration_s, frame_rate, width, height, codec, timecode, reel, notes)
    of professional cameras' XML; the format by the root element."""
    t = F.col(text)
    kind = F.when(t.rlike("<NonRealTimeMeta"), "sony_xdcam").when(t.rlike("(?i)<(ClipMetadata|CanonXF)"), "canon_xf").otherwise("generic")
    either = lambda *ps: F.coalesce(*[found(t, p) for p in ps])
    frames = found(t, r'<Duration\s+value="(\d+)"').try_cast("double")
    duration = F.when(kind == "sony_xdcam", frames / 30).otherwise(found(t, r"(?i)<Duration>([\d.]+)</Duration>").try_cast("double"))
    return docs.select(
        "*", kind.alias("format"), either(r'manufacturer="([^"]+)"', r"(?i)<(?:Make|Manufacturer)>([^<]+)<").alias("make"), either(r'modelName="([^"]+)"', r"(?i)<(?:Model|ModelName)>([^<]+)<").alias("model"), either(r"(?i)<Lens(?:Model)?>([^<]+)<", r'(?i)<Lens[^>]*modelName="([^"]+)"').alias("lens"),
        either(r'<CreationDate\s+value="([^"]+)"', r"(?i)<(?:CreationDate|RecordedAt|StartDate)>([^<]+)<").alias("recorded_at"), duration.alias("duration_s"), either(r'captureFps="([\d.]+)', r"(?i)<FrameRate>([\d.]+)").try_cast("double").alias("frame_rate"),
        either(r'pixel="(\d+)"', r"(?i)<Width>(\d+)<").try_cast("int").alias("width"), either(r'numOfVerticalLine="(\d+)"', r"(?i)<Height>(\d+)<").try_cast("int").alias("height"), either(r'videoCodec="([^"]+)"', r"(?i)<Codec>([^<]+)<").alias("codec"),
        either(r'<LtcChange[^>]*value="(\d+)"', r"(?i)<Timecode>([^<]+)<").alias("timecode"), either(r"(?i)<(?:Reel|ReelName|ClipName)>([^<]+)<").alias("reel"), either(r"(?i)<(?:Notes|Memo)>([^<]+)<").alias("notes"),
    )


# --- calendars and contacts ----------------------------------------------------------------------


def unfolded(text: str | Column) -> Column:
    """Content lines, continuation lines joined."""
    return F.split(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n[ \t]", ""), "\n")


def calendar_stats(docs: DataFrame, text: str = "text", summaries: int = 20) -> DataFrame:
    """(doc columns, events, todos, journals, first_start, last_start, recurring, alarms, summaries)."""
    lines = unfolded(text)
    count = lambda s: F.size(F.filter(lines, lambda x: F.upper(F.trim(x)) == s))
    starts = F.transform(F.filter(lines, lambda x: x.rlike(r"^DTSTART[;:]")), lambda x: F.regexp_extract(x, r":(\d{8}(?:T\d{6}Z?)?)", 1))
    return docs.select(
        "*", count("BEGIN:VEVENT").alias("events"), count("BEGIN:VTODO").alias("todos"), count("BEGIN:VJOURNAL").alias("journals"), F.array_min(starts).alias("first_start"), F.array_max(starts).alias("last_start"),
        F.exists(lines, lambda x: x.startswith("RRULE")).alias("recurring"), (count("BEGIN:VALARM") > 0).alias("alarms"), F.slice(F.transform(F.filter(lines, lambda x: x.rlike("^SUMMARY[;:]")), lambda x: F.regexp_extract(x, ":(.*)$", 1)), 1, summaries).alias("summaries"),
    )


def contact_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc columns, contacts, with_email, with_phone, with_address)."""
    cards = F.regexp_extract_all(F.regexp_replace(text, r"\r\n?", "\n"), F.lit(r"(?is)BEGIN:VCARD(.*?)END:VCARD"), F.lit(1))
    having = lambda p: F.size(F.filter(cards, lambda c: c.rlike(rf"(?im)^(?:item\d+\.)?{p}[;:]")))
    return docs.select("*", F.size(cards).alias("contacts"), having("EMAIL").alias("with_email"), having("TEL").alias("with_phone"), having("ADR").alias("with_address"))
