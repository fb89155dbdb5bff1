"""Queries of the document sources, sinks, streams and small functions: each row of a table is written
as a document of a format (or as a path), read back by the operators, and compared with the row by SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions import filetype, metadata, paths, sql
from attestra.operators import dedup, gps, graph, manifest, registry, related, validate
from attestra.sources import documents, sinks
from attestra.streaming import stateful, streams

from .catalog import document_files, query, table


def numbers(spark, sf_dir) -> DataFrame:
    """(i, lang, source) of documents."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), "lang", "source")


def written(spark, sf_dir, form: str, path: str = "'x'") -> DataFrame:
    """(i, path, text): a document for each row, by an SQL expression of i, lang and source."""
    return numbers(spark, sf_dir).select("i", F.expr(path).alias("path"), F.expr(form).alias("text"))


N = "(SELECT doc_id AS i, lang, source FROM documents)"
LAT, LON = "(i % 170 - 85 + 0.25)", "(i % 350 - 175 + 0.5)"
WHEN = "concat('2024-05-0', i % 9 + 1, 'T10:', lpad(i % 60, 2, '0'), ':07Z')"
SECONDS = "CAST(1714557607 + (i % 9) * 86400 + (i % 60) * 60 AS BIGINT)"  # 2024-05-01T10:00:07Z and on

GPX = f"""concat('<?xml version="1.0"?><gpx><wpt lat="', {LAT}, '" lon="', {LON}, '"><ele>', i % 500, '</ele><time>', {WHEN}, '</time><name>', lang, '</name></wpt>',
  '<trk><name> ', source, ' </name><trkseg><trkpt lat="', {LAT}, '" lon="', {LON}, '"/></trkseg><trkseg><trkpt lat="1.5" lon="2.5"><time>', {WHEN}, '</time></trkpt></trkseg></trk>',
  '<rte><rtept lat="3.5" lon="4.5"><time>', {WHEN}, '</time></rtept></rte></gpx>')"""
KML = f"""concat('<kml><Placemark><name>', lang, '</name><TimeStamp><when>', {WHEN}, '</when></TimeStamp><Point><coordinates> ', {LON}, ',', {LAT}, ',', i % 500, ' </coordinates></Point></Placemark>',
  '<Folder><LineString><coordinates>1.5,2.5 3.5,4.5,5</coordinates></LineString></Folder><gx:Track><when>', {WHEN}, '</when><gx:coord>', {LON}, ' ', {LAT}, ' 7</gx:coord></gx:Track></kml>')"""
GEOJSON = f"""concat('{{"type":"FeatureCollection","features":[{{"type":"Feature","properties":{{"name":"', lang, '","time":"', {WHEN}, '"}},"geometry":{{"type":"Point","coordinates":[', {LON}, ',', {LAT}, ',', i % 500, ']}}}},',
  '{{"type":"Feature","properties":{{"name":"', source, '"}},"geometry":{{"type":"LineString","coordinates":[[1.5,2.5],[3.5,4.5]]}}}},{{"type":"Feature","properties":{{}},"geometry":{{"type":"Polygon","coordinates":[]}}}}]}}')"""
POINT = ("i", "track", "track_name", "seq", "name", "latitude", "longitude", "altitude")


def points_sql(*rows: tuple[str, ...]) -> str:
    """Expected points: (track, track_name, seq, name, latitude, longitude, altitude, seconds) as SQL."""
    kinds = ("INT", "VARCHAR", "INT", "VARCHAR", "DOUBLE", "DOUBLE", "DOUBLE", "BIGINT")
    names = (*POINT[1:], "seconds")
    return " UNION ALL ".join("SELECT i, " + ", ".join(f"CAST({v} AS {k}) AS {n}" for v, k, n in zip(r, kinds, names, strict=True)) + f" FROM {N}" for r in rows)


def points_of(found: DataFrame) -> DataFrame:
    return found.select(*POINT, F.unix_seconds("ts").alias("seconds"))


GPX_ROWS = (("-1", "NULL", "0", "lang", LAT, LON, "i % 500", SECONDS), ("0", "source", "0", "NULL", LAT, LON, "NULL", "NULL"), ("0", "source", "1", "NULL", "1.5", "2.5", "NULL", SECONDS), ("1", "NULL", "0", "NULL", "3.5", "4.5", "NULL", "NULL"))
KML_ROWS = (("-1", "NULL", "0", "lang", LAT, LON, "i % 500", SECONDS), ("0", "'Track'", "0", "NULL", "2.5", "1.5", "NULL", "NULL"), ("0", "'Track'", "1", "NULL", "4.5", "3.5", "5", "NULL"), ("1", "'gx:Track'", "0", "NULL", LAT, LON, "7", SECONDS))
GEOJSON_ROWS = (("-1", "NULL", "0", "lang", LAT, LON, "i % 500", SECONDS), ("0", "source", "0", "NULL", "2.5", "1.5", "NULL", "NULL"), ("0", "source", "1", "NULL", "4.5", "3.5", "NULL", "NULL"))


@query(points_sql(*GPX_ROWS))
def gpx_points(spark, sf_dir):
    return points_of(documents.gpx_points(written(spark, sf_dir, GPX)))


@query(points_sql(*KML_ROWS))
def kml_points(spark, sf_dir):
    return points_of(documents.kml_points(written(spark, sf_dir, KML)))


@query(points_sql(*GEOJSON_ROWS))
def geojson_points(spark, sf_dir):
    return points_of(documents.geojson_points(written(spark, sf_dir, GEOJSON)))


@query(f"""SELECT i % 4 AS kind, CAST(sum([1 + 3, 4, 3, 0][CAST(i % 4 AS INT) + 1]) AS BIGINT) AS points, CAST(sum([2, 2, 1, 0][CAST(i % 4 AS INT) + 1]) AS BIGINT) AS timed FROM {N} WHERE i % 4 < 3 GROUP BY 1""")
def gps_by_format(spark, sf_dir):
    d = written(spark, sf_dir, f"CASE WHEN i % 4 = 0 THEN {GPX} WHEN i % 4 = 1 THEN {KML} ELSE {GEOJSON} END", "concat('a/', i, element_at(array('.GPX', '.kml', '.geojson', '.txt'), CAST(i % 4 AS INT) + 1))")
    p = documents.gps_points(d)
    return p.groupBy((F.col("i") % 4).alias("kind")).agg(F.count("*").alias("points"), F.count("ts").alias("timed"))


@query(f"""WITH p AS (SELECT DISTINCT i % 170 - 85 + 0.25 AS latitude FROM {N}), a AS (SELECT i % 7 AS k, {LAT} AS la, {LON} AS lo, i % 500 AS al FROM {N})
           SELECT k, count(*) AS points, CAST(min(la) AS DOUBLE) AS south, CAST(max(la) AS DOUBLE) AS north, CAST(min(lo) AS DOUBLE) AS west, CAST(max(lo) AS DOUBLE) AS east, CAST(min(al) AS DOUBLE) AS lowest, CAST(max(al) AS DOUBLE) AS highest FROM a GROUP BY k""")
def gps_boxes(spark, sf_dir):
    p = documents.gpx_points(written(spark, sf_dir, GPX)).where("track = -1").withColumn("k", F.col("i") % 7)
    return gps.bounds(p, ["k"]).drop("first_ts", "last_ts")


# --- manifests, lists, lines -----------------------------------------------------------------------

FILES = "(SELECT 'd/' || doc_id || '.txt' AS path, sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS size, doc_id AS i FROM documents)"


def files(spark, sf_dir) -> DataFrame:
    return document_files(spark, sf_dir).select(F.concat(F.lit("d/"), "path", F.lit(".txt")).alias("path"), "hash", "size", F.col("path").alias("i"))


@query(f"SELECT '1.0' AS version, 'sha256' AS algorithm, 64 AS hash_length, path, hash, size FROM {FILES}")
def manifest_round_trip(spark, sf_dir):
    text = sinks.manifest_document(files(spark, sf_dir).select("path", "hash", "size"), "/root", "sha256", 64)
    return documents.manifest_entries(text).select("version", "algorithm", "hash_length", "path", "hash", "size")


@query(f"SELECT '2.0' AS list_version, 'A & B' AS creator, path || '&<' AS path, size, substr(hash, 1, 16) AS xxh64, CASE WHEN i % 2 = 0 THEN substr(hash, 1, 32) END AS md5 FROM {FILES}")
def hash_list_round_trip(spark, sf_dir):
    none = F.lit(None).cast("string")
    e = files(spark, sf_dir).select(F.concat("path", F.lit("&<")).alias("path"), "size", none.alias("modified"), F.upper(F.substring("hash", 1, 16)).alias("xxh64"), F.when(F.col("i") % 2 == 0, F.substring("hash", 1, 32)).alias("md5"), none.alias("hashed_at"))
    return documents.hash_list_entries(sinks.hash_list_document(e, "A & B", "h")).select("list_version", "creator", "path", "size", "xxh64", "md5")


@query(f"SELECT hash, path FROM {FILES}")
def bag_manifest_round_trip(spark, sf_dir):
    lines = sinks.bag_lines(files(spark, sf_dir)).union(spark.createDataFrame([("no entry",), ("",)], "line string"))
    return documents.bag_manifest_entries(lines, "line")


@query(f"SELECT i, CASE WHEN i % 3 > 0 THEN size END AS bytes, CASE WHEN i % 3 > 0 THEN i END AS count FROM {FILES}")
def bag_oxum(spark, sf_dir):
    info = F.when(F.col("i") % 3 > 0, F.format_string("Bagging-Date: 2024-01-01\nPayload-Oxum: %d.%d\n", "size", "i")).otherwise("Payload-Oxum: none")
    return files(spark, sf_dir).select("i", documents.declared_oxum(info).alias("o")).select("i", "o.bytes", "o.count")


@query(f"""SELECT hash || '  ' || path AS line FROM {FILES} UNION ALL SELECT 'SHA256 (' || path || ') = ' || hash FROM {FILES} UNION ALL SELECT path || ' ' || hash FROM {FILES}
           UNION ALL SELECT '{{"path":"' || path || '","hash":"' || hash || '","algorithm":"sha256"}}' FROM {FILES}""")
def hash_line_formats(spark, sf_dir):
    f = files(spark, sf_dir)
    lines = [sinks.hash_lines(f, kind, "sha256") for kind in ("text", "bsd", "sfv", "json")]
    return lines[0].union(lines[1]).union(lines[2]).union(lines[3])


@query(f"""SELECT path || CASE WHEN i % 2 = 0 THEN ': OK' ELSE ': FAILED' END AS line FROM {FILES} UNION ALL SELECT '{{"type":"ulid","id":"' || hash || '"}}' FROM {FILES}
           UNION ALL SELECT hash FROM {FILES} UNION ALL SELECT 'Error: ' || path FROM {FILES} UNION ALL SELECT '✓ ' || path FROM {FILES}""")
def message_line_formats(spark, sf_dir):
    f = files(spark, sf_dir)
    out = sinks.verify_lines(f.withColumn("match", F.col("i") % 2 == 0))
    for more in (sinks.id_lines(f, "hash", "ulid", as_json=True), sinks.id_lines(f, "hash", "ulid"), sinks.message_lines(f, "path", error=True), sinks.message_lines(f, "path")):
        out = out.union(more)
    return out


@query(f"SELECT chr(34) || path || repeat(chr(34), 3) || ',' || hash || ',' || size AS line FROM {FILES}")
def manifest_csv(spark, sf_dir):
    return sinks.manifest_csv_lines(files(spark, sf_dir).withColumn("path", F.concat("path", F.lit('"'))))


@query(f"SELECT path, hash, size FROM {FILES} WHERE i % 4 < 2")
def import_manifest(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, ("copied", "validated", "failed", "skipped"))), (F.col("i") % 4 + 1).cast("int"))
    return sinks.import_manifest(files(spark, sf_dir).withColumnRenamed("path", "dest_path").withColumn("status", status))


@query(f"SELECT count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_bytes FROM {FILES}")
def manifest_totals(spark, sf_dir):
    return manifest.totals(files(spark, sf_dir))


# --- subtitles, calendars, contacts, telemetry -------------------------------------------------------

SRT = r"""concat('1\n00:00:0', i % 10, ',500 --> 00:01:0', i % 10, ',250\n<i>', lang, '</i>\n{an8}', source, '\n\n2\n00:02:00,000 --> 00:02:03,500\nlast one\n\n3\n00:03:00,000 --> 00:03:01,000\n<b></b>\n')"""
VTT = r"""concat('WEBVTT\n\n00:0', i % 10, '.500 --> 01:0', i % 10, '.250\n', lang, '\n', source, '\n')"""
SBV = r"""concat('0:00:0', i % 10, '.500,0:01:0', i % 10, '.250\n', lang, '\n', source, '\n')"""
ASS = r"""concat('[Script Info]\n[Events]\nDialogue: 0,0:00:0', i % 10, '.50,0:01:0', i % 10, '.25,Default,,0,0,0,,', lang, '\\N{\\b1}', source, '\n')"""
CUES = f"""SELECT i, ['srt', 'vtt', 'sbv', 'ass'][CAST(i % 4 AS INT) + 1] AS format, CAST(i % 10 + 0.5 AS DOUBLE) AS start_s, CAST(60 + i % 10 + 0.25 AS DOUBLE) AS end_s, lang || ' ' || source AS cue FROM {N}
           UNION ALL SELECT i, 'srt', 120.0, 123.5, 'last one' FROM {N} WHERE i % 4 = 0"""


def cues(spark, sf_dir) -> DataFrame:
    d = written(spark, sf_dir, f"CASE WHEN i % 4 = 0 THEN {SRT} WHEN i % 4 = 1 THEN {VTT} WHEN i % 4 = 2 THEN {SBV} ELSE {ASS} END", "concat(i, '.txt')")
    return documents.subtitle_cues(d)


@query(CUES)
def subtitle_cues(spark, sf_dir):
    return cues(spark, sf_dir).select("i", "format", "start_s", "end_s", "cue")


@query(f"WITH c AS ({CUES}) SELECT i, count(*) AS cues, max(end_s) AS duration_s, CAST(sum(len(regexp_extract_all(cue, '\\S+'))) AS BIGINT) AS words, CAST(sum(len(cue)) AS BIGINT) AS chars FROM c GROUP BY i")
def subtitle_stats(spark, sf_dir):
    return documents.subtitle_stats(cues(spark, sf_dir), "i")


ICS = r"""concat('BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nDTSTART;TZID=X:2024010', i % 9 + 1, 'T100000Z\r\nSUMMARY:', lang, '\r\n  and ', source, '\r\nEND:VEVENT\r\n', CASE WHEN i % 2 = 0 THEN 'BEGIN:VEVENT\nDTSTART:20231231\nRRULE:FREQ=DAILY\nBEGIN:VALARM\nEND:VALARM\nEND:VEVENT\n' ELSE 'BEGIN:VTODO\nEND:VTODO\n' END, 'END:VCALENDAR')"""


@query(f"""SELECT i, CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END AS events, CASE WHEN i % 2 = 0 THEN 0 ELSE 1 END AS todos, 0 AS journals,
                  CASE WHEN i % 2 = 0 THEN '20231231' ELSE '2024010' || (i % 9 + 1) || 'T100000Z' END AS first_start, '2024010' || (i % 9 + 1) || 'T100000Z' AS last_start, i % 2 = 0 AS recurring, i % 2 = 0 AS alarms, lang || ' and ' || source AS summary FROM {N}""")
def calendar_stats(spark, sf_dir):
    s = documents.calendar_stats(written(spark, sf_dir, ICS))
    return s.select("i", "events", "todos", "journals", "first_start", "last_start", "recurring", "alarms", F.array_join("summaries", "|").alias("summary"))


@query(f"SELECT i, CAST(i % 3 + 1 AS INT) AS contacts, CAST(i % 3 + 1 AS INT) AS with_email, CASE WHEN i % 2 = 0 THEN CAST(i % 3 + 1 AS INT) ELSE 0 END AS with_phone, 0 AS with_address FROM {N}")
def contact_stats(spark, sf_dir):
    card = r"concat('BEGIN:VCARD\r\nFN:', source, '\r\nitem1.EMAIL;TYPE=x:a@b\r\n', CASE WHEN i % 2 = 0 THEN 'TEL:1\r\n' ELSE '' END, 'END:VCARD\r\n')"
    return documents.contact_stats(written(spark, sf_dir, f"repeat({card}, CAST(i % 3 AS INT) + 1)")).drop("path", "text")


DRONE = r"""concat('1\n00:00:00,000 --> 00:00:00,033\nFrameCnt: 1, 2024-05-01 10:00:0', i % 10, '.123\n[iso: ', i % 800, '] [shutter: 1/', i % 60 + 1, '] [fnum: 2.8] [latitude: ', i % 80, '.5] [longitude: -', i % 80, '.25] [rel_alt: 1.5 abs_alt: 30.5]\n\n',
  CASE WHEN i % 2 = 0 THEN 'FrameCnt: 2 [latitude: 9.5] [longitude: 8.5]' ELSE '' END)"""


@query(f"""SELECT i, CAST(CAST(i % 80 + 0.5 AS DOUBLE) AS VARCHAR) AS lat, CAST(CAST(-(i % 80 + 0.25) AS DOUBLE) AS VARCHAR) AS lon, '2024-05-01T10:00:0' || i % 10 || '.123' AS taken, CAST(i % 800 AS VARCHAR) AS iso, '1/' || (i % 60 + 1) AS shutter,
                  CASE WHEN i % 2 = 0 THEN '2' ELSE '1' END AS frames, CASE WHEN i % 2 = 0 THEN '9.5' END AS last_lat, '30.5' AS altitude FROM {N}""")
def drone_telemetry(spark, sf_dir):
    t = written(spark, sf_dir, DRONE).select("i", documents.drone_tags("text").alias("t"))
    names = {"lat": "GPSLatitude", "lon": "GPSLongitude", "taken": "DateTimeOriginal", "iso": "DJI:ISO", "shutter": "DJI:ShutterSpeed", "frames": "DJI:FrameCount", "last_lat": "DJI:GPSLatitudeEnd", "altitude": "GPSAltitude"}
    return t.select("i", *[F.try_element_at("t", F.lit(tag)).alias(n) for n, tag in names.items()])


CLIP_XML = """concat('<NonRealTimeMeta><Duration value="', i * 30, '"/><CreationDate value="', lang, '"/><Device manufacturer="Sony" modelName="', source, '" serialNo="', i, '"/><VideoFrame videoCodec="AVC" captureFps="25p"/></NonRealTimeMeta>')"""


@query(f"SELECT i, 'Sony' AS make, source AS model, CAST(i AS VARCHAR) AS serial, CAST(i * 30 AS VARCHAR) AS frames, lang AS created FROM {N}")
def clip_tags(spark, sf_dir):
    t = written(spark, sf_dir, CLIP_XML).select("i", documents.sony_tags("text").alias("t"))
    return t.select("i", *[F.try_element_at("t", F.lit(f"Sony:{tag}")).alias(n) for n, tag in (("make", "Make"), ("model", "Model"), ("serial", "Serial"), ("frames", "DurationFrames"), ("created", "CreationDate"))])


@query(f"""SELECT i, ['sony_xdcam', 'canon_xf', 'generic'][CAST(i % 3 AS INT) + 1] AS format, CASE WHEN i % 3 = 0 THEN 'Sony' ELSE 'Canon' END AS make, source AS model, CAST(i AS DOUBLE) AS duration_s, CAST(25 AS DOUBLE) AS frame_rate FROM {N}""")
def camera_xml(spark, sf_dir):
    other = "concat('<', CASE WHEN i % 3 = 1 THEN 'CanonXF' ELSE 'Clip' END, '><Make>Canon</Make><ModelName>', source, '</ModelName><Duration>', i, '</Duration><FrameRate>25</FrameRate></x>')"
    d = documents.camera_xml(written(spark, sf_dir, f"CASE WHEN i % 3 = 0 THEN {CLIP_XML} ELSE {other} END"))
    return d.select("i", "format", "make", "model", "duration_s", "frame_rate")


@query(f"SELECT i, k AS clip, CASE WHEN k = 0 THEN source ELSE lang END AS name, CAST(i + k AS VARCHAR) AS reel FROM {N}, (VALUES (0), (1)) AS v(k)")
def log_exchange(spark, sf_dir):
    ale = r"concat('Heading\nFIELD_DELIM\tTABS\n\nColumn\nName\tReel\n\nData\n', source, '\t', i, '\n', lang, '\t', i + 1, '\n')"
    return documents.log_exchange_rows(written(spark, sf_dir, ale)).select("i", "clip", F.col("tags.Name").alias("name"), F.col("tags.Reel").alias("reel"))


@query(f"SELECT i, 'true' AS adjusted, source AS format, '1.' || i AS version, CAST(i % 3200 AS VARCHAR) AS iso, CAST(i % 9000 AS VARCHAR) AS kelvin FROM {N}")
def edit_and_cinema_tags(spark, sf_dir):
    plist = "concat('<key>adjustmentData</key><key>adjustmentFormatIdentifier</key> <string>', source, '</string><key>adjustmentFormatVersion</key><string>1.', i, '</string> ISO = ', i % 3200, ' Kelvin: ', i % 9000)"
    t = written(spark, sf_dir, plist).select("i", F.map_concat(documents.edit_tags("text"), documents.cinema_tags("text")).alias("t"))
    return t.select("i", *[F.try_element_at("t", F.lit(tag)).alias(n) for n, tag in (("adjusted", "AAE:HasAdjustments"), ("format", "AAE:Format"), ("version", "AAE:Version"), ("iso", "RED:ISO"), ("kelvin", "RED:Kelvin"))])


@query("""SELECT doc_id AS i, sha256(text) AS content_hash, '/in/' || doc_id || '/<a&b>.jpg' AS source_path, 's' || doc_id % 7 AS session_id, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 90 AS VARCHAR) END AS latitude, doc_id % 3 AS events,
                 doc_id % 5 > 0 AS valid, CASE WHEN doc_id % 5 = 0 THEN 'self-hash disagrees' ELSE '' END AS errors FROM documents""")
def sidecar_round_trip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), F.sha2("text", 256).alias("content_hash"), F.format_string("/in/%d/<a&b>.jpg", "doc_id").alias("source_path"), F.lit("2024-01-01T00:00:00Z").alias("import_timestamp"), F.format_string("s%d", F.col("doc_id") % 7).alias("session_id"))
    photo = F.when(F.col("i") % 2 == 0, F.struct(*[(F.col("i") % 90).cast("string").alias(c) if c == "gps_latitude" else F.lit(None).cast("string").alias(c) for c in map(documents.snake, documents.PARTS["photo"][1])]))
    event = F.struct(*[F.lit(t).alias(documents.snake(t)) for t in sinks.EVENT_TAGS])
    d = d.withColumn("photo", photo).withColumn("custody", F.array_repeat(event, (F.col("i") % 3).cast("int")))
    text = sinks.sidecar_text(d.columns)
    broken = d.select("i", F.when(F.col("i") % 5 == 0, F.replace(text, F.lit("s"), F.lit("S"))).otherwise(text).alias("whole"), text.alias("text"))
    broken = broken.select("i", F.when(F.col("i") % 5 == 0, F.replace("text", F.lit("2024-01-01"), F.lit("2024-01-02"))).otherwise(F.col("text")).alias("text"))
    r = documents.sidecar_records(broken)
    return r.select("i", "content_hash", "source_path", "session_id", F.col("photo.gps_latitude").alias("latitude"), F.size("custody").cast("long").alias("events"), "valid", F.array_join("errors", "|").alias("errors"))


# --- related files -----------------------------------------------------------------------------------

MEDIA = """concat('d', CAST(floor(i / 8) AS BIGINT) % 50, '/', CASE i % 8 WHEN 0 THEN 'A.MP4' WHEN 1 THEN 'a.srt' WHEN 2 THEN 'AM01.XML' WHEN 3 THEN 'b.jpg' WHEN 4 THEN 'b.aae' WHEN 5 THEN 'A_meta.xml' WHEN 6 THEN 'c_SDR.jpg' ELSE 'c.jpg' END)"""
MEDIA_SQL = "(SELECT DISTINCT replace(path, '@', '') AS path, regexp_extract(path, '^[^/]*') AS dir, split_part(path, '/', 2) AS base FROM (SELECT 'd' || (doc_id // 8) % 50 || '/' || ['A.MP4', 'a.srt', 'AM01.XML', 'b.jpg', 'b.aae', 'A_meta.xml', 'c_SDR.jpg', 'c.jpg'][CAST(doc_id % 8 AS INT) + 1] AS path FROM documents))"


def media(spark, sf_dir) -> DataFrame:
    return numbers(spark, sf_dir).select(F.expr(MEDIA).alias("path")).distinct()


@query(f"SELECT a.path, b.path AS companion FROM {MEDIA_SQL} a JOIN {MEDIA_SQL} b ON a.dir = b.dir AND ((a.base = 'A.MP4' AND b.base IN ('a.srt', 'AM01.XML')) OR (a.base = 'b.jpg' AND b.base = 'b.aae'))")
def companion_files(spark, sf_dir):
    return related.companions(media(spark, sf_dir))


@query(f"SELECT a.path AS xml, b.path AS video FROM {MEDIA_SQL} a JOIN {MEDIA_SQL} b ON a.dir = b.dir AND a.base IN ('AM01.XML', 'A_meta.xml') AND b.base = 'A.MP4'")
def xml_videos(spark, sf_dir):
    return related.linked_videos(media(spark, sf_dir))


@query(f"""SELECT a.path, CASE WHEN p.path IS NOT NULL THEN 'sdr_hdr_pair' END AS type, coalesce(a.base = 'c.jpg' OR p.path IS NULL, true) AS is_primary, p.path IS NOT NULL AND a.base = 'c_SDR.jpg' AS hidden
           FROM {MEDIA_SQL} a LEFT JOIN {MEDIA_SQL} p ON a.dir = p.dir AND ((a.base = 'c.jpg' AND p.base = 'c_SDR.jpg') OR (a.base = 'c_SDR.jpg' AND p.base = 'c.jpg'))""")
def grouped_files(spark, sf_dir):
    m = media(spark, sf_dir)
    return related.with_group(m, related.related_files(m)).select("path", "type", "is_primary", F.coalesce("hidden", F.lit(False)).alias("hidden"))


# --- paths, types, values ----------------------------------------------------------------------------


@query(f"""SELECT i, lower(source || '.txt') LIKE 's%.tx_' AS wild, false AS partial_name, i % 3 = 0 AS hashed, CASE WHEN i % 3 = 0 THEN NULL ELSE 'd/' || source || '.' || substr(md5(CAST(i AS VARCHAR)), 1, 16) || '.txt' END AS renamed FROM {N}""")
def name_patterns(spark, sf_dir):
    h = F.md5(F.col("i").cast("string"))
    name = F.concat("source", F.when(F.col("i") % 3 == 0, F.concat(F.lit("."), F.substring(h, 1, 16))).otherwise(""), F.lit(".txt"))
    d = numbers(spark, sf_dir).select("i", "source", name.alias("name"), h.alias("h"))
    return d.select("i", paths.wildcard(F.concat("source", F.lit(".txt")), "S*.TX?").alias("wild"), paths.wildcard(F.concat("source", F.lit(".txt")), "?.tx").alias("partial_name"), paths.already_hashed(F.col("name")).alias("hashed"), paths.renamed(F.concat(F.lit("d/"), "name"), F.col("h")).alias("renamed"))


@query(f"""SELECT i, CASE WHEN len(p) <= 30 THEN p WHEN 26 - len(n) > 0 THEN '...' || right(d, 26 - len(n)) || '/' || n ELSE '...' || right(n, 27) END AS short
           FROM (SELECT i, repeat('ab', CAST(i % 20 AS INT)) || '/' || n AS p, repeat('ab', CAST(i % 20 AS INT)) AS d, n FROM (SELECT i, source || repeat('x', CAST(i % 31 AS INT)) || '.txt' AS n FROM {N}))""")
def short_paths(spark, sf_dir):
    p = F.concat(F.repeat(F.lit("ab"), (F.col("i") % 20).cast("int")), F.lit("/"), "source", F.repeat(F.lit("x"), (F.col("i") % 31).cast("int")), F.lit(".txt"))
    return numbers(spark, sf_dir).select("i", paths.truncated_path(p, 30).alias("short"))


@query(f"""SELECT i, CAST(i % 65536 AS INT) AS vendor, CASE WHEN i % 4 = 0 THEN NULL ELSE 'SN' || i END AS serial, 'A b c' AS cue, source || ',x' AS words, 'https://api.acoustid.org/v2/lookup?client=k&duration=' || i || '&fingerprint=' || md5(CAST(i AS VARCHAR)) AS url FROM {N}""")
def text_helpers(spark, sf_dir):
    i = F.col("i")
    d = numbers(spark, sf_dir)
    return d.select(
        "i", paths.hex_id(F.concat(F.lit("0x"), F.hex(i % 65536), F.lit(" (Maker)"))).alias("vendor"), paths.normal_serial(F.when(i % 4 == 0, "N/A").otherwise(F.concat(F.lit(" SN"), i))).alias("serial"), paths.strip_cue_tags(F.lit(r"<i>A</i>{\an8} b\Nc")).alias("cue"),
        F.array_join(metadata.keywords(F.concat("source", F.lit(" ; ,x"))), ",").alias("words"), paths.acoustid_url(F.lit("k"), i.cast("double"), F.md5(i.cast("string"))).alias("url"),
    )


@query(f"""SELECT i, i % 6 IN (0, 1) AS hidden, i % 6 = 2 AS skipped, i % 6 = 3 AS xml, i % 6 <> 1 AND i % 2 = 0 AS embeds, CASE WHEN i % 3 = 0 THEN 'image' WHEN i % 3 = 1 THEN 'video' ELSE 'other' END AS category,
                  CASE WHEN i * 1000 < 1000 THEN 'simple' WHEN i * 1000 < 50000 THEN 'moderate' WHEN i * 1000 < 500000 THEN 'complex' ELSE 'very_complex' END AS mesh,
                  CASE WHEN i % 5 = 0 THEN 'unknown' WHEN i % 5 = 1 THEN 'network_share' WHEN i % 5 = 2 THEN 'memory_card' WHEN i % 5 = 3 THEN 'cloud_sync' ELSE 'local_disk' END AS source_kind,
                  [65536, 262144, 1048576, 131072][CAST(i % 4 AS INT) + 1] AS buffer, [8, 2, 1, 2][CAST(i % 4 AS INT) + 1] AS parallel FROM {N}""")
def file_rules(spark, sf_dir):
    i = F.col("i")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (i % len(v) + 1).cast("int"))
    path = F.concat(F.lit("d/"), pick("a.aae", "b.THM", "._x", "c.XML", "e.jpg", "f.mov"))
    ext, five = pick("." + "aae", ".THM", ".x", ".XML", ".jpg", ".mov"), i % 5
    config = filetype.storage_config(pick("local", "camera_media", "network", "other"))
    return numbers(spark, sf_dir).select(
        "i", filetype.is_hidden(path).alias("hidden"), filetype.is_skipped(path).alias("skipped"), filetype.is_xml_sidecar(path).alias("xml"), filetype.embeds(ext, F.when(i % 2 == 0, 10).otherwise(1 << 30)).alias("embeds"),
        filetype.import_category(pick("photo", "video", "strange")).alias("category"), filetype.mesh_complexity(i * 1000).alias("mesh"),
        filetype.source_type(five > 0, five == 1, F.lit(False), F.lit(None).cast("boolean"), five == 2, five == 3, F.lit("/Volumes/Dropbox")).alias("source_kind"), config["buffer"].alias("buffer"), config["parallel"].alias("parallel"),
    )


MAGIC = {"ffd8ffe000104a464946": ("image", "image/jpeg"), "89504e470d0a1a0a": ("image", "image/png"), "255044462d312e37": ("document", "application/pdf"), "504b0304": ("archive", "application/zip"), "494433030000": ("audio", "audio/mpeg")}


@query(f"SELECT i, {[c for c, _ in MAGIC.values()]}[CAST(i % 5 AS INT) + 1] AS category, {[m for _, m in MAGIC.values()]}[CAST(i % 5 AS INT) + 1] AS mime, i % 5 > 0 AS mismatch FROM {N}")
def magic_types(spark, sf_dir):
    content = F.unhex(F.element_at(F.array(*[F.lit(h + "00" * 300) for h in MAGIC]), (F.col("i") % len(MAGIC) + 1).cast("int")))
    t = numbers(spark, sf_dir).select("i", filetype.detect_type(F.lit("d/a.jpg"), content).alias("t"))
    return t.select("i", "t.category", "t.mime", "t.mismatch")


@query(f"SELECT i, CAST(64 - bit_count(xor(i, i * 3)) AS DOUBLE) / 64 * 100 AS percent, CASE WHEN i % 2 = 0 THEN 'a' ELSE 'b' END AS kept, '(Binary data 5 bytes)' AS bytes FROM {N}")
def similarity_and_maps(spark, sf_dir):
    i = F.col("i")
    first = F.create_map(F.lit("k"), F.when(i % 2 == 0, "a").otherwise(""))
    d = numbers(spark, sf_dir).select("i", graph.similarity_percent(graph.hamming(i, i * 3)).alias("percent"), metadata.filled(first, F.create_map(F.lit("k"), F.lit("b")))["k"].alias("kept"), sinks.metadata_json(F.create_map(F.lit("a"), F.lit("x")), F.create_map(F.lit("b"), F.encode(F.lit("12345"), "utf-8"))).alias("json"))
    return d.select("i", "percent", "kept", F.get_json_object("json", "$.b").alias("bytes"))


# --- events ------------------------------------------------------------------------------------------


@query("SELECT to_timestamp(epoch_us(ts) // 600000000 * 600)::TIMESTAMP AS window_start, to_timestamp(epoch_us(ts) // 600000000 * 600 + 600)::TIMESTAMP AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return streams.windowed_counts(table(spark, sf_dir, "events"), "ts", ["event_type"], "10 minutes")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
               s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
          SELECT min(ts)::TIMESTAMP AS session_start, (max(ts) + INTERVAL 30 MINUTE)::TIMESTAMP AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    return streams.sessions(table(spark, sf_dir, "events"), "ts", ["user_id"], "30 minutes")


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND event_id % 10 = 0)")
def unknown_only(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return streams.unknown_only(e, e.where("event_type = 'error' AND event_id % 10 = 0"), "user_id").select("event_id")


MATCH = "INTERVAL 5 SECOND"


@query(f"""SELECT f.event_id AS file, p.event_id AS point FROM events f JOIN events p ON p.ts BETWEEN f.ts - {MATCH} AND f.ts + {MATCH} WHERE f.event_type = 'error' AND p.event_type <> 'error'""")
def match_in_time(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    f = e.where("event_type = 'error'").select(F.col("event_id").alias("file"), F.col("ts").alias("file_ts"))
    p = e.where("event_type <> 'error'").select("ts", F.lit(1.5).alias("latitude"), F.col("event_id").cast("double").alias("longitude"))
    return streams.match_in_time(f, p, 5).select("file", F.col("longitude").cast("long").alias("point"))


@query("""WITH f AS (SELECT event_id, ts, event_type FROM events), w AS (SELECT ts, event_id FROM events WHERE event_type = 'error'),
               n AS (SELECT f.event_id, min(abs(epoch_us(f.ts) - epoch_us(w.ts))) AS gap FROM f JOIN w ON abs(epoch_us(f.ts) - epoch_us(w.ts)) <= 20000000 GROUP BY 1)
          SELECT count(*) AS processed, count(*) FILTER (f.event_id % 9 > 0 AND n.gap IS NOT NULL) AS matched, count(*) FILTER (f.event_id % 9 = 0) AS existing, count(*) FILTER (f.event_id % 9 > 0 AND n.gap IS NULL) AS skipped FROM f LEFT JOIN n ON f.event_id = n.event_id""")
def gps_enrich_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    f = e.select(F.col("event_id").alias("file"), F.col("ts").alias("file_ts"), (F.col("event_id") % 9 == 0).alias("has_gps"))
    w = e.where("event_type = 'error'").select(F.lit(0).alias("track"), F.col("event_id").alias("seq"), "ts", F.lit(1.5).alias("latitude"), F.lit(2.5).alias("longitude"), F.lit(None).cast("double").alias("altitude"))
    return gps.enrich_counts(gps.enrich(f, w, "timestamp", 20))


@query("SELECT event_id AS file, 0.25 AS latitude, 0.5 AS longitude, 0.0::DOUBLE AS time_delta_s, 0.5::DOUBLE AS confidence FROM events".replace("0.25 AS", "0.25::DOUBLE AS").replace("0.5 AS longitude", "0.5::DOUBLE AS longitude"))
def gps_first_waypoint(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    w = e.select((F.col("event_id") % 5).alias("track"), F.col("event_id").alias("seq"), (F.col("event_id") + 0.25).alias("latitude"), (F.col("event_id") + 0.5).alias("longitude"), F.lit(None).cast("double").alias("altitude"))
    return gps.first_waypoint(e.select(F.col("event_id").alias("file")), w).drop("altitude")


# --- orders of results -------------------------------------------------------------------------------


@query("""WITH g AS (SELECT sha256(text) AS hash, CAST((count(*) - 1) * min(strlen(text)) AS BIGINT) AS wasted FROM documents WHERE strlen(text) >= 1 GROUP BY 1 HAVING count(*) > 1)
          SELECT hash, wasted, row_number() OVER (ORDER BY wasted DESC, hash) AS place FROM g""")
def groups_by_waste(spark, sf_dir):
    g = dedup.by_waste(dedup.duplicate_groups(document_files(spark, sf_dir)))
    return related.number_in_order(g.select("hash", "wasted", (-F.col("wasted")).alias("_w")).withColumn("_o", F.struct("_w", "hash")), "_o", "place").select("hash", "wasted", "place")


@query("SELECT count(*) AS devices, count(DISTINCT source) AS makers, CAST(sum(n_chars) AS BIGINT) AS seen FROM documents")
def registry_totals(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("device"), F.col("source").alias("maker"), F.col("n_chars").alias("files"))
    return registry.totals(d, "device", "maker", "files").select(F.col("device").alias("devices"), F.col("maker").alias("makers"), F.col("files").alias("seen"))


PLIST = "concat('<key>adjustmentData</key><key>adjustmentFormatVersion</key> <string>1.', i, '</string>')"
SIDES = "concat('d', CAST(floor(i / 6) AS BIGINT), '/', CASE i % 6 WHEN 0 THEN 'A.MP4' WHEN 1 THEN 'a.srt' WHEN 2 THEN 'AM01.XML' WHEN 3 THEN 'a.aae' WHEN 4 THEN 'a.LRV' ELSE 'A.MP4.xmp' END)"


@query(f"""SELECT 'd' || i // 6 || '/A.MP4' AS path, 'd' || i // 6 || ['/a.srt', '/AM01.XML', '/a.aae', '/a.LRV'][CAST(i % 6 AS INT)] AS companion,
                  CASE i % 6 WHEN 1 THEN CAST(i % 800 AS VARCHAR) WHEN 2 THEN CAST(i AS VARCHAR) WHEN 3 THEN '1.' || i ELSE 'true' END AS told FROM {N} WHERE i % 6 BETWEEN 1 AND 4 AND i // 6 IN (SELECT i // 6 FROM {N} WHERE i % 6 = 0)""")
def companion_tags(spark, sf_dir):
    """Telemetry, clip XML, adjustments and a proxy beside each sixth document, a video."""
    d = written(spark, sf_dir, f"CASE i % 6 WHEN 1 THEN {DRONE} WHEN 2 THEN {CLIP_XML} WHEN 3 THEN {PLIST} ELSE '' END", SIDES)
    t = related.companion_tags(d)
    told = F.coalesce(*[F.try_element_at("tags", F.lit(k)) for k in ("DJI:ISO", "Sony:Serial", "AAE:Version", "LRV:Present")])
    return t.select("path", "companion", told.alias("told"))


@query(f"SELECT i, i % 6 = 0 AND i + 5 IN (SELECT doc_id FROM documents) AS has_sidecar FROM {N}")
def sidecar_there(spark, sf_dir):
    return related.with_sidecar(written(spark, sf_dir, "''", SIDES)).select("i", "has_sidecar")


@query("""SELECT doc_id AS path, unnest(['SHA256     ' || sha256(text) || '  ' || doc_id, 'MD5        ' || md5(text) || '  ' || doc_id]) AS line FROM documents""")
def all_hash_lines(spark, sf_dir):
    """Those lines of all digests that SQL can tell."""
    from attestra.functions import hashing

    h = hashing.all_hashes(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text", F.octet_length("text").alias("size")), "text")
    lines = sinks.all_hash_lines(h)
    return lines.where("line LIKE 'SHA256 %' OR line LIKE 'MD5 %'")


@query(f"""SELECT i, concat_ws(chr(10), CASE WHEN i % 2 = 0 THEN 'Card Reader: ' || lang || ' R' END, CASE WHEN i % 2 = 0 AND i % 4 > 0 THEN '  Serial: ' || i END, CASE WHEN i % 3 = 0 THEN 'USB: ' || source || chr(10) || '  VID:PID: 1:2' END,
                  CASE WHEN i % 5 > 0 THEN 'Media: ' || CASE WHEN i % 5 = 1 THEN 'UNKNOWN' ELSE 'SD' END || CASE WHEN i > 0 THEN chr(10) || '  Capacity: ' || i || '.0 GB' ELSE '' END END, 'Camera Body: ' || i) AS text FROM {N}""")
def device_text(spark, sf_dir):
    d = numbers(spark, sf_dir)
    i, none = F.col("i"), F.lit(None).cast("string")
    reader = F.when(i % 2 == 0, F.struct(F.col("lang").alias("vendor"), F.lit("R").alias("model"), F.when(i % 4 > 0, i.cast("string")).otherwise("").alias("serial")))
    usb = F.when(i % 3 == 0, F.struct(F.col("source").alias("device_name"), F.lit("1").alias("vendor_id"), F.lit("2").alias("product_id"), none.alias("serial")))
    media = F.when(i % 5 > 0, F.struct(F.when(i % 5 > 1, "sd").alias("type"), none.alias("manufacturer"), none.alias("serial"), (i * F.lit(1 << 30)).alias("capacity")))
    return d.select("i", sinks.device_text(reader, usb, media, i, none).alias("text"))


@query(f"SELECT doc_id AS i, {[m for *_, m, _ in filetype.MAGIC]}[CAST(doc_id % {len(filetype.MAGIC)} AS INT) + 1] AS mime, {[e for *_, e in filetype.MAGIC]}[CAST(doc_id % {len(filetype.MAGIC)} AS INT) + 1] AS ext FROM documents")
def every_magic(spark, sf_dir):
    """Each document's text behind one of all leading bytes, at their place."""
    heads = F.array(*[F.lit("00" * at + magic) for at, magic, *_ in filetype.MAGIC])
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), F.concat(F.unhex(F.element_at(heads, (F.col("doc_id") % len(filetype.MAGIC) + 1).cast("int"))), F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("content"))
    mime, ext = filetype.magic_mime(F.col("content"))
    return d.select("i", mime.alias("mime"), ext.alias("ext"))


@query(f"""SELECT file, point FROM (SELECT f.event_id AS file, p.event_id AS point, row_number() OVER (PARTITION BY f.event_id ORDER BY abs(epoch_us(p.ts) - epoch_us(f.ts)), p.ts, p.event_id) AS k
             FROM events f JOIN events p ON p.ts BETWEEN f.ts - {MATCH} AND f.ts + {MATCH} WHERE f.event_type = 'error' AND p.event_type <> 'error') WHERE k = 1""")
def nearest_match(spark, sf_dir):
    """The stream's nearest match over the table at rest."""
    e = table(spark, sf_dir, "events")
    f = e.where("event_type = 'error'").select(F.col("event_id").alias("file"), F.col("ts").cast("timestamp").alias("file_ts"))
    p = e.where("event_type <> 'error'").select(F.col("ts").cast("timestamp").alias("ts"), F.lit(1.5).alias("latitude"), F.col("event_id").cast("double").alias("longitude"))
    return stateful.nearest_match(f, p, 5).select("file", F.col("longitude").cast("long").alias("point"))


# --- functions by name, schemas ------------------------------------------------------------------------


GPX_FORMS = f"""CASE i % 6 WHEN 0 THEN {GPX} WHEN 1 THEN '' WHEN 2 THEN concat('<gpx><wpt lat="', i, '"/><wpt lon="1" lat="2"/><wpt lat="x" lon="', i % 90, '"></wpt></gpx>')
  WHEN 3 THEN concat('<trk><trkseg>', repeat(concat('<trkpt lat="', i % 80, '" lon="2"><time>not a time</time></trkpt>'), CAST(i % 4 AS INT)), '</trkseg></trk>') WHEN 4 THEN {KML} END"""


@query(f"""SELECT * FROM ({points_sql(*GPX_ROWS)}) WHERE i % 6 = 0
           UNION ALL SELECT i, -1, NULL, 0, NULL, NULL, CAST(i % 90 AS DOUBLE), NULL, NULL FROM {N} WHERE i % 6 = 2
           UNION ALL SELECT i, 0, NULL, CAST(unnest(range(0, i % 4)) AS INT), NULL, CAST(i % 80 AS DOUBLE), 2.0, NULL, NULL FROM {N} WHERE i % 6 = 3""")
def sql_gpx(spark, sf_dir):
    """Whole, empty, broken, reordered and foreign documents, by a table function."""
    sql.register(spark)
    return spark.sql("SELECT i, p.* EXCEPT (ts), unix_seconds(p.ts) AS seconds FROM {d} AS d, LATERAL parse_gpx(d.text) AS p", d=written(spark, sf_dir, GPX_FORMS))


@query(f"""SELECT i, 'event' AS kind, 0 AS seq, lang || ' and ' || source AS summary, '2024010' || (i % 9 + 1) || 'T100000Z' AS starts, false AS recurring, 0 AS alarms FROM {N} WHERE i % 3 > 0
           UNION ALL SELECT i, CASE WHEN i % 2 = 0 THEN 'event' ELSE 'todo' END, 1, NULL, CASE WHEN i % 2 = 0 THEN '20231231' END, i % 2 = 0, CASE WHEN i % 2 = 0 THEN 1 ELSE 0 END FROM {N} WHERE i % 3 > 0""")
def sql_calendar(spark, sf_dir):
    """Entries of calendars, of which a third are empty or not closed, by a table function with chosen columns."""
    sql.register(spark)
    forms = f"CASE WHEN i % 3 > 0 THEN {ICS} WHEN i % 2 = 0 THEN 'BEGIN:VEVENT\\nSUMMARY:never closed' ELSE '' END"
    return spark.sql("SELECT i, p.* FROM {d} AS d, LATERAL parse_ics(d.text, 'kind,seq,summary,starts,recurring,alarms') AS p", d=written(spark, sf_dir, forms))


@query(CUES)
def sql_cues(spark, sf_dir):
    sql.register(spark)
    d = written(spark, sf_dir, f"CASE WHEN i % 4 = 0 THEN {SRT} WHEN i % 4 = 1 THEN {VTT} WHEN i % 4 = 2 THEN {SBV} ELSE {ASS} END")
    return spark.sql("SELECT i, p.* EXCEPT (seq) FROM {d} AS d, LATERAL parse_subtitle(d.text) AS p", d=d)


RULES = [
    validate.Field("event_type", among=("view", "click", "purchase")), validate.Field("value", "number", least=0.1, most=0.9), validate.Field("user_id", "int", least=10),
    validate.Field("tag", pattern=validate.HASH16), validate.Field("tag", longest=16), validate.Field("text_value", "int", required=False), validate.Field("ts", "datetime"), validate.Field("nothing"),
]


@query("""WITH e AS (SELECT *, substr(md5(CAST(event_id AS VARCHAR)), 1, 16 + event_id % 2) AS tag, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) WHEN event_id % 3 = 1 THEN event_type END AS text_value FROM events)
          SELECT event_id, 'event_type' AS field, CASE WHEN event_type IS NULL THEN 'required' ELSE 'among' END AS rule FROM e WHERE event_type IS NULL OR event_type NOT IN ('view', 'click', 'purchase')
          UNION ALL SELECT event_id, 'value', CASE WHEN value IS NULL THEN 'required' ELSE 'range' END FROM e WHERE value IS NULL OR value < 0.1 OR value > 0.9
          UNION ALL SELECT event_id, 'user_id', 'range' FROM e WHERE user_id < 10
          UNION ALL SELECT event_id, 'tag', unnest(['pattern', 'length']) FROM e WHERE event_id % 2 = 1
          UNION ALL SELECT event_id, 'text_value', 'type' FROM e WHERE event_id % 3 = 1
          UNION ALL SELECT event_id, 'nothing', 'required' FROM e""")
def schema_violations(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withColumn("tag", F.substring(F.md5(F.col("event_id").cast("string")), F.lit(1), (16 + F.col("event_id") % 2).cast("int")))
    e = e.withColumn("text_value", F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).when(F.col("event_id") % 3 == 1, F.col("event_type")))
    return validate.violations(e, RULES, "event_id").drop("value")
