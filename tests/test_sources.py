"""Scans, interchange documents, sinks, extractors, import and streaming."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from attestra.functions.hashing import blake3_digests, hash_of
from attestra.plans import importer
from attestra.sources import documents, extractors, sinks
from attestra.sources.fsscan import copy_pairs, listing, scan
from attestra.streaming import streams


@pytest.fixture
def tree(tmp_path):
    for name, data in {"z.txt": "1", "a.txt": "22", "m.log": "x", ".hidden": "h", "_under.txt": "", "sub/deep.txt": "d", "node_modules/n.txt": "n", "t.tmp": "t"}.items():
        p = tmp_path / "src" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(data)
    os.symlink(tmp_path / "src" / "a.txt", tmp_path / "src" / "link.txt")
    return str(tmp_path / "src")


def names(df):
    return sorted(r.rel_path for r in df.collect())


def test_scan(spark, tree):
    assert names(scan(spark, tree)) == ["_under.txt", "a.txt", "m.log", "sub/deep.txt", "z.txt"]
    assert names(scan(spark, tree, includeHidden=True, recursive=False, exclude=["*.log"])) == [".hidden", "_under.txt", "a.txt", "t.tmp", "z.txt"]
    assert names(scan(spark, tree, minSize=2)) == ["a.txt"] and "_under.txt" in names(scan(spark, tree, maxSize=0))
    assert "link.txt" in names(scan(spark, tree, followSymlinks=True)) and "node_modules/n.txt" in names(listing(spark, tree))
    assert scan(spark, tree + "/none").collect()[0].error
    r = scan(spark, tree, content=True).where("rel_path = 'a.txt'").first()
    assert bytes(r.content) == b"22" and r.size == 2 and r.base == "a.txt" and r.ext == ".txt"


def test_manifest_round_trip(spark, tree, tmp_path):
    f = scan(spark, tree, content=True).select(F.col("rel_path").alias("path"), hash_of(F.col("content")).alias("hash"), "size")
    doc = sinks.manifest_document(f, tree)
    back = documents.manifest_entries(doc.select("text"))
    assert {(r.path, r.hash, r.size) for r in back.collect()} == {(r.path, r.hash, r.size) for r in f.collect()}
    assert back.first().hash_length == 16
    assert documents.manifest_entries(spark.createDataFrame([("broken",)], "text string")).count() == 0
    lines = [r.line for r in sinks.hash_lines(f, "bsd").collect()]
    assert any(x.startswith("BLAKE3 (a.txt) = ") for x in lines)
    assert sinks.manifest_csv_lines(f).first().line.startswith('"')


def test_hash_list_round_trip(spark):
    e = spark.createDataFrame([("a&b.mov", 100, "t", "abc123def4567890", None, "h")], "path string, size long, modified string, xxh64 string, md5 string, hashed_at string")
    r = documents.hash_list_entries(sinks.hash_list_document(e, "n<x", "h")).first()
    assert (r.path, r.size, r.xxh64, r.md5, r.list_version, r.creator) == ("a&b.mov", 100, "abc123def4567890", None, "2.0", "n<x")


def test_bag(spark, tree):
    assert sinks.verify_bag(spark, tree).first().error == "no bagit.txt"
    sinks.make_bag(spark, tree, info={"Source": "x"})
    ok = sinks.verify_bag(spark, tree).first()
    assert ok.valid and ok.oxum_matches and ok.missing == 0
    with open(tree + "/data/new.txt", "w") as f:
        f.write("n")
    assert (sinks.verify_bag(spark, tree).first().extra, sinks.verify_bag(spark, tree).first().valid) == (1, True)
    os.unlink(tree + "/data/a.txt")
    r = sinks.verify_bag(spark, tree).first()
    assert (r.missing, r.valid) == (1, False)


GPX = '<gpx><wpt lat="1.5" lon="2.5"><ele>10</ele><time>2024-01-01T00:00:00Z</time><name>W</name></wpt><trk><name>My Track</name><trkseg><trkpt lat="1" lon="2"><time>2024-01-01T00:00:01Z</time></trkpt></trkseg><trkseg><trkpt lat="3" lon="4"/></trkseg></trk><rte><rtept lat="5" lon="6"/></rte></gpx>'
KML = "<kml><Document><name>D</name><Placemark><name>P</name><Point><coordinates>-122.4194,37.7749,10</coordinates></Point></Placemark><Placemark><LineString><coordinates>1,2 3,4 5,6</coordinates></LineString></Placemark><gx:Track><when>2024-01-01T00:00:00Z</when><gx:coord>7 8 9</gx:coord><gx:coord>1 1</gx:coord></gx:Track></Document></kml>"
GEO = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"x","time":"2024-01-01T00:00:00Z"},"geometry":{"type":"Point","coordinates":[1,2,3]}},{"type":"Feature","geometry":{"type":"LineString","coordinates":[[1,2],[3,4],[5,6]]}},{"type":"Feature","geometry":{"type":"Polygon","coordinates":[]}}]}'


def test_gps_documents(spark):
    d = spark.createDataFrame([("a.gpx", GPX), ("b.KML", KML), ("c.geojson", GEO), ("d.json", "no"), ("e.txt", "")], "path string, text string")
    p = documents.gps_points(d)
    count = {(r.path, r.track): r.n for r in p.groupBy("path", "track").agg(F.count("*").alias("n")).collect()}
    assert count == {("a.gpx", -1): 1, ("a.gpx", 0): 2, ("a.gpx", 1): 1, ("b.KML", -1): 2, ("b.KML", 0): 3, ("b.KML", 1): 2, ("c.geojson", -1): 1, ("c.geojson", 0): 3}
    w = p.where("path = 'b.KML' and track = -1 and name = 'P'").first()
    assert (w.latitude, w.longitude, w.altitude) == (37.7749, -122.4194, 10.0)
    assert documents.timed(p).groupBy("path").count().count() == 3
    assert p.where("path = 'a.gpx' and track = 0").first().track_name == "My Track"


def test_subtitles(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,500\n<i>Hello</i> there\n\n2\n00:01:30,000 --> 00:01:31,000\nBye\n"
    vtt = "WEBVTT\n\n00:01.000 --> 00:02.000\nHi\n\n00:03.000 --> 00:04.000\n\n"
    ass = "[Script Info]\n[Events]\nDialogue: 0,0:00:01.00,0:00:02.00,D,,0,0,0,,A, b\\Nc\n"
    sbv = "0:00:01.000,0:00:02.000\nq w\n"
    d = spark.createDataFrame([("a.srt", srt), ("b.x", vtt), ("c.ass", ass), ("d.sbv", sbv), ("e.txt", "none")], "path string, text string")
    c = documents.subtitle_cues(d)
    s = {r.path: (r.cues, r.duration_s, r.words) for r in documents.subtitle_stats(c).collect()}
    assert s == {"a.srt": (2, 91.0, 3), "b.x": (1, 2.0, 1), "c.ass": (1, 2.0, 3), "d.sbv": (1, 2.0, 2)}
    assert {r.cue for r in c.where("path = 'a.srt'").collect()} == {"Hello there", "Bye"}


def test_sidecar_round_trip(spark):
    event = sinks.new_custody_event("ingestion", "success", F.lit("2024-01-01").cast("timestamp"), "h", "u", "t", F.lit("0" * 64), F.lit("e1"))
    r = spark.range(1).select(*[F.lit(v).alias(k) for k, v in {"content_hash": "c" * 64, "source_path": "/a&b", "import_timestamp": "t", "session_id": "s"}.items()], F.struct(*[F.lit("Canon" if t == "CreationDevice" else None).cast("string").alias(documents.snake(t)) for t in documents.PARTS["photo"][1]]).alias("photo"), F.array(event).alias("custody"))
    kept = lambda df: spark.createDataFrame(df.collect(), df.schema)  # noqa: E731  as if written and read again
    doc = kept(r.select(sinks.sidecar_text(r.columns).alias("text")))
    back = kept(documents.sidecar_records(doc))
    x = back.first()
    assert x.valid and x.warnings == [] and x.source_path == "/a&b" and x.photo.creation_device == "Canon" and x.video is None and len(x.custody) == 1
    bad = documents.sidecar_records(doc.select(F.replace("text", F.lit("/a&amp;b"), F.lit("/other")).alias("text"))).first()
    assert bad.errors == ["self-hash disagrees"]
    assert not documents.sidecar_records(spark.createDataFrame([("hello",)], "text string")).first().valid
    more = sinks.with_event(back, event, F.lit("later"))
    again = documents.sidecar_records(kept(more.select(sinks.sidecar_text([c for c in more.columns if c not in ("text", "errors", "warnings", "valid")]).alias("text")))).first()
    assert again.valid and len(again.custody) == 2 and again.event_count == "2"


def test_telemetry(spark):
    srt = "FrameCnt: 1\n2024-01-01 10:00:00.123\n[iso: 100] [shutter: 1/640.0] [fnum: 2.8] [latitude: 41.98172] [longitude: -76.24034] [rel_alt: 5.000 abs_alt: 228.8]\n\nFrameCnt: 2\n[latitude: 42.0] [longitude: -76.0]"
    xml = '<NonRealTimeMeta><Duration value="60"/><Device manufacturer="Sony" modelName="ILME-FX6" serialNo="1"/><Item name="CaptureGammaEquation" value="s-log3"/></NonRealTimeMeta>'
    d = spark.createDataFrame([(srt, xml, "<key>adjustmentFormatVersion</key><string>1</string>adjustmentData")], "s string, x string, a string")
    r = d.select(documents.drone_tags("s").alias("s"), documents.sony_tags("x").alias("x"), documents.edit_tags("a").alias("a")).first()
    assert (float(r.s["GPSLatitude"]), r.s["DJI:ISO"], float(r.s["DJI:GPSLatitudeEnd"]), r.s["DJI:FrameCount"]) == (41.98172, "100", 42.0, "2")
    assert (r.x["Sony:Model"], r.x["Sony:Gamma"], r.a["AAE:Version"]) == ("ILME-FX6", "s-log3", "1")
    c = documents.camera_xml(d, "x").first()
    assert (c.format, c.duration_s, c.make) == ("sony_xdcam", 2.0, "Sony")
    ale = documents.log_exchange_rows(spark.createDataFrame([("Heading\n\nColumn\nName\tFPS\n\nData\nA001\t24\nA002\t25\n",)], "text string")).collect()
    assert [x.tags for x in ale] == [{"Name": "A001", "FPS": "24"}, {"Name": "A002", "FPS": "25"}]


def test_calendar_and_contacts(spark):
    ics = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nDTSTART:20240102T030405Z\r\nSUMMARY:A lon\r\n g one\r\nRRULE:FREQ=DAILY\r\nEND:VEVENT\r\nEND:VCALENDAR"
    r = documents.calendar_stats(spark.createDataFrame([(ics,)], "text string")).first()
    assert (r.events, r.first_start, r.recurring, r.alarms, r.summaries) == (1, "20240102T030405Z", True, False, ["A long one"])
    v = documents.contact_stats(spark.createDataFrame([("BEGIN:VCARD\nEMAIL:a@b\nEND:VCARD\nBEGIN:VCARD\nTEL:1\nEND:VCARD",)], "text string")).first()
    assert (v.contacts, v.with_email, v.with_phone, v.with_address) == (2, 1, 1, 0)


def zipped(**files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return b.getvalue()


def test_extractors(spark):
    docx = zipped(**{"word/document.xml": "<d><p>one two</p><p>three</p></d>"})
    rows = [("a.docx", docx), ("b.zip", zipped(**{"x.exe": "1", "y.txt": "22"})), ("c.eml", b"Subject: Hi\nFrom: a@b\n\nBody"), ("d.obj", b"v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1 2 3\n"), ("e.pdf", b"broken"), ("f.unknown", b"?"), ("g.docx", None)]
    got = {r.path: r for r in extractors.extract(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.docx"].tags["Office_words"] == "3" and got["b.zip"].tags["Archive_executables"] == '["x.exe"]'
    assert got["c.eml"].tags["Email_subject"] == "Hi" and got["d.obj"].tags["Mesh_faces"] == "1"
    assert got["e.pdf"].tags is None and got["e.pdf"].error and got["f.unknown"].extractor is None and got["g.docx"].error


def test_dumps(spark):
    p = '{"format":{"format_name":"mov","duration":"2.5"},"streams":[{"codec_type":"video","codec_name":"hevc","width":10,"height":20,"r_frame_rate":"30/1","avg_frame_rate":"24/1","color_transfer":"smpte2084","color_primaries":"bt2020"},{"codec_type":"audio","codec_name":"aac"}],"chapters":[{"id":1}]}'
    m = '{"media":{"track":[{"@type":"General","Format":"MOV"},{"@type":"Video","Format":"HEVC","ScanType":"Interlaced","Width":"10"}]}}'
    d = spark.createDataFrame([(p, m), ("bad", "bad")], "p string, m string")
    rows = extractors.mediainfo(extractors.ffprobe(d, "p"), "m").collect()
    assert (rows[0].ffprobe.frame_rate_mode, rows[0].ffprobe.hdr, rows[0].ffprobe.chapters, rows[0].mediainfo.scan_type) == ("variable", "HDR10", 1, "interlaced")
    assert rows[1].ffprobe is None and rows[1].mediainfo is None
    g = spark.range(1).select(extractors.guess_name(F.lit("The.Show.S02E05.1080p.mkv")), extractors.guess_name(F.lit("A Film (1999) 720p.mp4"))).first()
    assert (g[0].title, g[0].season, g[0].episode, g[0].resolution) == ("The Show", 2, 5, "1080p") and (g[1].title, g[1].year) == ("A Film", 1999)


def test_actions_are_dry_unless_told(spark, tree, tmp_path):
    plan = copy_pairs(scan(spark, tree), str(tmp_path / "out"))
    assert {r.status for r in sinks.copy_files(plan).collect()} == {"planned"} and not (tmp_path / "out").exists()
    done = sinks.copy_files(plan, dry_run=False).collect()
    assert {r.status for r in done} == {"copied"} and (tmp_path / "out/sub/deep.txt").read_text() == "d"
    assert {r.hash for r in done if r.source.endswith("a.txt")} == {blake3_digests([b"22"])[0][:16]}
    assert {r.status for r in sinks.copy_files(plan, dry_run=False).collect()} == {"error"}
    one = spark.createDataFrame([(tree + "/z.txt", tree + "/a.txt", "delete", 1)], "path string, keep string, action string, freed long")
    assert sinks.execute(one).first().status == "planned" and os.path.exists(tree + "/z.txt")
    assert sinks.execute(one, dry_run=False).first().status == "done" and not os.path.exists(tree + "/z.txt")
    assert [sinks.backoff_ms(n) for n in (1, 2, 5)] == [1000, 2000, 10000]


def test_import(spark, tree, tmp_path):
    with open(tree + "/copy.txt", "w") as f:
        f.write("22")
    out, state = str(tmp_path / "dst"), str(tmp_path / "state")
    os.makedirs(out)
    f = importer.run_import(spark, tree, out, state, session_id="s", rename=True, sidecar=True, manifest=True)
    status = {r.rel_path: r.status for r in f.collect()}
    assert status == {"a.txt": "validated", "copy.txt": "skipped", "m.log": "validated", "sub/deep.txt": "validated", "z.txt": "validated", "_under.txt": "validated"}
    got = sorted(os.listdir(out))
    assert blake3_digests([b"1"])[0][:16] + ".txt" in got and sum(n.endswith(".xmp") for n in got) == 4 and "manifest.json" in got
    side = spark.read.text(out, wholetext=True, pathGlobFilter="*.xmp").withColumnRenamed("value", "text")
    assert all(r.valid for r in documents.sidecar_records(side).select("valid").collect())
    again = importer.run_import(spark, tree, out, state, session_id="s")
    assert {r.rel_path for r in again.where("status = 'validated'").collect()} == {n for n, v in status.items() if v == "validated"}
    assert importer.Session(spark, state + "/s").status()["copied"]


def test_import_of_nothing(spark, tmp_path):
    assert importer.run_import(spark, str(tmp_path / "none"), str(tmp_path / "out"), str(tmp_path / "state"), dry_run=True).count() == 0


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "hash string, n long").coalesce(1)
    rows.write.parquet(src)
    known = spark.createDataFrame([("b",)], "hash string")
    s = streams.first_of_each(streams.unknown_only(streams.file_stream(spark, src, "hash string, n long"), known))
    streams.import_available(s, out, str(tmp_path / "cp"))
    assert [r.hash for r in spark.read.parquet(out).collect()] == ["a"]
    rows.write.mode("append").parquet(src)
    streams.import_available(s, out, str(tmp_path / "cp"))
    assert spark.read.parquet(out).count() == 1
    e = streams.ewma_stream(streams.file_stream(spark, src, "hash string, n long"), "hash", "n", "n")
    q = e.writeStream.format("memory").queryName("ewma").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination()
    assert {r.key for r in spark.table("ewma").collect()} == {"a", "b"}


def batch_of(query):
    return query.outputMode("append").trigger(availableNow=True)


def test_streams_match_windows_and_sessions(spark, tmp_path):
    """Each stream's rows equal those of the same operator over the table at rest."""
    from pyspark.sql import functions as F

    rows = spark.range(200).select(F.col("id").alias("n"), F.timestamp_seconds(1_000_000 + F.col("id") * 7 + F.col("id") % 5).alias("ts"), (F.col("id") % 3).alias("k"))
    last = spark.createDataFrame([(1000, 1_900_000, 9), (1001, 2_800_000, 9)], "n long, s long, k long").select("n", F.timestamp_seconds("s").alias("ts"), "k")
    src = str(tmp_path / "in")
    for part in (rows.where("n < 100"), rows.where("n >= 100"), last.where("n = 1000"), last.where("n = 1001")):
        part.coalesce(1).write.mode("append").parquet(src)
    schema = "n long, ts timestamp, k long"
    still = rows.unionByName(last)
    ask = lambda d: d.where("k in (0, 9)").select(F.col("n").alias("file"), F.col("ts").alias("file_ts"))
    points = lambda d: d.where("k in (1, 9)").select("ts", F.lit(1.5).alias("latitude"), F.col("n").cast("double").alias("longitude"))
    cases = {
        "match": lambda d: streams.match_in_time(ask(d), points(d), 20, "1 minute"),
        "windows": lambda d: streams.windowed_counts(d, "ts", ["k"], "1 minute", late="1 minute"),
        "sliding": lambda d: streams.windowed_counts(d, "ts", ["k"], "1 minute", "30 seconds", late="1 minute"),
        "sessions": lambda d: streams.sessions(d, "ts", ["k"], "10 seconds", late="1 minute"),
    }
    for name, make in cases.items():
        out = str(tmp_path / name)
        streams.import_available(make(streams.file_stream(spark, src, schema, files_per_batch=1)), out, str(tmp_path / f"{name}-cp"))
        got = {tuple(r) for r in spark.read.parquet(out).collect()}
        want = {tuple(r) for r in make(still).collect()}
        open_still = {r for r in want - got if any(getattr(v, "year", 0) and v.timestamp() >= 1_890_000 for v in r)}
        assert got and got <= want and want - got == open_still, name


def test_latest_of_ties_is_one_and_the_same(spark):
    from attestra.operators import dedup

    d = spark.createDataFrame([("a", 1, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", None, "q")], "k string, o long, v string")
    assert {tuple(r) for r in dedup.keep_latest(d, ["k"], "o").collect()} == {("a", 1, "z"), ("b", None, "q")}


def test_metadata_json_gives_binary_values_by_size(spark):
    from pyspark.sql import functions as F

    from attestra.sources import sinks

    d = spark.range(1).select(sinks.metadata_json(F.create_map(F.lit("a"), F.lit("x")), F.create_map(F.lit("b"), F.encode(F.lit("12345"), "utf-8"))).alias("j"))
    assert d.first().j == '{"a":"x","b":"(Binary data 5 bytes)"}'


# --- scans of deep trees ---------------------------------------------------------------------------------


@pytest.fixture
def deep(tmp_path):
    """One folder holds everything, some levels down."""
    for k in range(12):
        at = tmp_path / "only" / "one" / f"d{k % 4}" / f"e{k}"
        at.mkdir(parents=True)
        for n in range(5):
            (at / f"f{n}.{'txt' if n % 2 else 'jpg'}").write_bytes(b"x" * (n * 10))
    (tmp_path / "top.txt").write_bytes(b"abc")
    (tmp_path / ".hidden").write_bytes(b"abc")
    (tmp_path / "only" / "loop").symlink_to(tmp_path / "only")
    return tmp_path


def test_a_deep_folder_is_split(spark, deep):
    from attestra.sources import fsscan

    files = fsscan.scan(spark, str(deep))
    assert files.rdd.getNumPartitions() >= 12
    assert files.count() == 61 and files.select("path").distinct().count() == 61
    assert fsscan.scan(spark, str(deep), tasks=1).rdd.getNumPartitions() == 1
    assert fsscan.scan(spark, str(deep), tasks=1).count() == 61
    assert fsscan.scan(spark, str(deep), followSymlinks=True).count() == 61  # a link to a folder above is not walked
    assert fsscan.scan(spark, str(deep / "nothing")).first()["error"] == "cannot be read"


def test_filters_are_pushed_into_the_scan(spark, deep):
    from attestra.sources import fsscan

    files = fsscan.scan(spark, str(deep), content=True).where("size >= 20 and size < 40 and ext = '.txt' and path is not null")
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "size >= 20" not in plan.split("BatchScan")[0] and "ext = .txt" not in plan.split("BatchScan")[0]
    rows = files.collect()
    assert len(rows) == 12 and {(r["size"], bytes(r["content"])) for r in rows} == {(30, b"x" * 30)}
    assert fsscan.scan(spark, str(deep)).where("ext in ('.jpg', '.gif') or size = 3").count() == 37


def test_levels_find_what_a_walk_finds(spark, deep):
    from attestra.sources import fsscan

    for options in ({}, {"includeHidden": True}, {"recursive": False}, {"exclude": ["e3", "*.jpg"]}, {"minSize": 20}, {"followSymlinks": True}):
        walked = fsscan.scan(spark, str(deep), **options).drop("content")
        levels = fsscan.scan_levels(spark, str(deep), **options)
        assert sorted(map(tuple, walked.collect())) == sorted(map(tuple, levels.collect()))
    assert fsscan.scan_levels(spark, str(deep / "nothing")).first()["error"] == "cannot be read"
