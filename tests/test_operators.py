"""Manifests, duplicates, similarity, GPS, related files, registries."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from attestra.operators import dedup, gps, graph, manifest, registry, related


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


F3 = "path string, hash string, size long"


def test_duplicates(spark):
    f = frame(spark, [("c", "A", 1000), ("a", "A", 1000), ("b", "A", 1000), ("d", "B", 1), ("e", "B", 1), ("f", "C", 5), ("g", None, 9)], F3)
    g = {r.hash: r for r in dedup.duplicate_groups(f).collect()}
    assert g["A"].files == ["a", "b", "c"] and g["A"].wasted == 2000 and set(g) == {"A", "B"}
    assert tuple(dedup.duplicate_rollup(f).first()) == (7, 3, 2, 3, 2001)
    assert set(r.hash for r in dedup.duplicate_groups(f, min_size=50).collect()) == {"A"}
    assert sorted(r.path for r in dedup.duplicate_actions(f).collect()) == ["b", "c", "e"]
    status = {r.path: r.status for r in dedup.import_dedup(f, frame(spark, [("B",)], "hash string")).collect()}
    assert status == {"a": "hashed", "b": "skipped", "c": "skipped", "d": "skipped", "e": "skipped", "f": "hashed", "g": "error"}
    assert {r.status for r in dedup.import_dedup(f, None, False).collect()} == {"hashed", "error"}


def test_manifest_algebra(spark):
    old = frame(spark, [("a", "1" * 16, 1), ("b", "2" * 16, 1), ("c", "3" * 16, 1)], F3)
    new = frame(spark, [("a", "1" * 16, 1), ("b", "9" * 16, 1), ("d", "4" * 16, 1)], F3)
    assert {r.path: r.status for r in manifest.diff(old, new).collect()} == {"a": "unchanged", "b": "modified", "c": "removed", "d": "added"}
    assert {r.status for r in manifest.diff(old, old).collect()} == {"unchanged"}
    audited = manifest.audit(old, new)
    assert {r.path: r.status for r in audited.collect()} == {"a": "matched", "b": "mismatched", "c": "missing", "d": "extra"}
    r = manifest.audit_rollup(audited).first()
    assert (r.total, r.extra, r.valid, r.severity) == (3, 1, False, 10)
    assert {x.path: x.hash for x in manifest.update(new, old).collect()}["b"] == "2" * 16
    empty = old.limit(0)
    assert {r.status for r in manifest.diff(empty, new).collect()} == {"added"}
    assert manifest.audit_rollup(manifest.audit(empty, empty)).first().valid


def test_unreadable_is_invalid_and_short_form_matches(spark):
    m = frame(spark, [("a", "a" * 64, 1), ("b", "b" * 16, 1)], F3)
    f = frame(spark, [("a", "a" * 16, 1, None), ("b", None, 1, "EACCES")], F3 + ", error string")
    v = manifest.verify(m, f)
    assert {r.path: r.status for r in v.collect()} == {"a": "matched", "b": "unreadable"}
    assert not manifest.audit_rollup(v).first().valid


def test_hash_list(spark):
    listed = frame(spark, [("a", "x1", None), ("b", None, "m2"), ("c", None, None), ("d", "x", "m")], "path string, xxh64 string, md5 string")
    files = frame(spark, [("a", "X1", "?"), ("b", "?", "m2"), ("c", "x", "m")], "path string, xxh64 string, md5 string")
    assert {r.path: r.status for r in manifest.hash_list_verify(listed, files).collect()} == {"a": "valid", "b": "valid", "c": "mismatched", "d": "missing"}


def test_hamming_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, 60)
    h = [int(x) for x in base] + [int(x) ^ 5 for x in base[:20]] + [int(base[0]), -1, 0]
    d = frame(spark, list(enumerate(h)), "id long, h long")
    got = {(r.a, r.b): r.distance for r in graph.hamming_pairs(d, "id", "h", 10).collect()}
    u = np.array(h, dtype=np.int64).view(np.uint64)
    want = {(i, j): int(np.bitwise_count(u[i] ^ u[j])) for i in range(len(h)) for j in range(i + 1, len(h)) if np.bitwise_count(u[i] ^ u[j]) <= 10}
    assert got == want
    r = spark.range(1).select(graph.hamming(graph.hash_long(F.lit("0" * 16)), graph.hash_long(F.lit("f" * 16))), graph.hash_long(F.lit("xyz")), graph.similarity_percent(F.lit(32))).first()
    assert list(r) == [64, None, 50.0]


def test_components_on_paths(spark):
    e = frame(spark, [(1, 5), (5, 2), (9, 8), (8, 7), (7, 30), (30, 6), (4, 4)], "a long, b long")
    assert {r.node: r.root for r in graph.components(e).collect()} == {1: 1, 5: 1, 2: 1, 9: 6, 8: 6, 7: 6, 30: 6, 6: 6}
    p = frame(spark, [(1, 2, 3), (2, 3, 1)], "a long, b long, distance int")
    g = {r.member: (r.group_id, r.distance, r.size) for r in graph.similarity_groups(p, 10).collect()}
    assert g == {1: (1, 0, 3), 2: (1, 3, 3), 3: (1, 10, 3)}


T = dt.datetime(2024, 1, 1, 12, 0, 0)


def at(s):
    return T + dt.timedelta(seconds=s)


def test_gps(spark):
    w = frame(spark, [(0, 0, at(0), 0.0, 0.0, None), (0, 1, at(100), 10.0, 20.0, 5.0), (1, 0, at(50), 7.0, 7.0, 7.0)], "track int, seq int, ts timestamp, latitude double, longitude double, altitude double")
    f = frame(spark, [("near", at(40)), ("tie", at(75)), ("far", at(5000)), ("none", None)], "file string, file_ts timestamp")
    n = {r.file: r for r in gps.nearest_in_time(f, w, 60).collect()}
    assert (n["near"].latitude, n["near"].time_delta_s, round(n["near"].confidence, 6)) == (7.0, 10.0, round(1 - 10 / 60, 6))
    assert n["tie"].latitude == 7.0 and "far" not in n and "none" not in n
    off = {r.file: r.latitude for r in gps.nearest_in_time(f, w, 60, offset_s=-4900).collect()}
    assert off["far"] == 10.0
    i = {r.file: r for r in gps.interpolated(f, w).collect()}
    assert (i["tie"].latitude, i["tie"].longitude, i["tie"].altitude, i["tie"].time_delta_s) == (7.5, 15.0, None, 25.0) and set(i) == {"near", "tie"}
    e = {r.file: (r.status, r.strategy) for r in gps.enrich(f.withColumn("has_gps", F.col("file") == "far"), w, "interpolate", 5).collect()}
    assert e == {"near": ("matched", "interpolate"), "tie": ("matched", "interpolate"), "far": ("existing", None), "none": ("unmatched", None)}
    assert {r.confidence for r in gps.enrich(f, w, "nearest").collect()} == {0.5}
    assert tuple(gps.enrich_counts(gps.enrich(f, w, "timestamp", 5)).first()) == (4, 0, 0, 4)


def paths_of(spark, *names):
    return frame(spark, [(n,) for n in names], "path string")


def kinds(spark, *names):
    return sorted((r.type, r.primary, r.member) for r in related.related_files(paths_of(spark, *names)).collect() if r.seq)


def test_related_pairs(spark):
    assert kinds(spark, "/d/IMG_001.CR2", "/d/img_001.jpg", "/d/x_002.NEF", "/e/x_002.JPG") == [("raw_jpeg_pair", "/d/IMG_001.CR2", "/d/img_001.jpg")]
    assert kinds(spark, "/d/IMG_1234.HEIC", "/d/IMG_1234.MOV") == [("live_photo", "/d/IMG_1234.HEIC", "/d/IMG_1234.MOV")]
    assert kinds(spark, "/d/p.CR2", "/d/p.xmp", "/d/p.thm") == [("raw_sidecar", "/d/p.CR2", "/d/p.thm"), ("raw_sidecar", "/d/p.CR2", "/d/p.xmp")]
    assert kinds(spark, "/d/a_SDR.jpg", "/d/a.jpg") == [("sdr_hdr_pair", "/d/a.jpg", "/d/a_SDR.jpg")]


def test_bursts(spark):
    assert [m for _, _, m in kinds(spark, "/d/S_1.jpg", "/d/S_3.jpg", "/d/S_4.jpg", "/d/T(1).jpg", "/d/T(2).jpg")] == ["/d/S_3.jpg", "/d/S_4.jpg"]
    assert kinds(spark, "/d/S_1.jpg", "/d/S_2.jpg", "/d/S_9.jpg") == []


def test_companions_and_links(spark):
    f = paths_of(spark, "/d/C1.MP4", "/d/c1.srt", "/d/C1M01.XML", "/d/other.xmp", "/d/V_meta.xml", "/d/V.mov")
    assert {(r.path, r.companion) for r in related.companions(f).collect()} == {("/d/C1.MP4", "/d/c1.srt"), ("/d/C1.MP4", "/d/C1M01.XML")}
    assert {(r.xml, r.video) for r in related.linked_videos(f).collect()} == {("/d/C1M01.XML", "/d/C1.MP4"), ("/d/V_meta.xml", "/d/V.mov")}


def test_numbering(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert [(r.k, r.seq) for r in related.number_in_order(d, "k").orderBy("k").collect()] == [(i, i + 1) for i in range(1000)]


def test_cameras(spark):
    cams = frame(spark, [(0, "z9", "Nikon", "Z 9", ["NIKON Z9"], ["DSC_*"], ["DCIM/100NCZ_9"]), (1, "fx6", "Sony", "ILME-FX6", [], ["C????.MP4"], []), (2, "fx6b", "Sony", "ILME-FX6", [], [], [])], "ord int, id string, make string, model string, variants array<string>, filename_patterns array<string>, folder_patterns array<string>")
    f = frame(spark, [("/a", "SONY", "ilme-fx6", None, None), ("/b", "NIKON CORP", "NIKON Z9", None, None), ("/x/dsc_1", None, None, None, None), ("/dcim/100ncz_9/q", None, None, None, None), ("/q", None, None, 640, 480), ("/r", None, None, None, None)], "path string, make string, model string, width int, height int")
    got = {r.path: (r.camera_id, r.confidence) for r in registry.camera_match(f, cams).collect()}
    assert got == {"/a": ("fx6b", 0.95), "/b": ("z9", 0.95), "/x/dsc_1": ("z9", 0.8), "/dcim/100ncz_9/q": ("z9", 0.7), "/q": ("unknown:dadcam", 0.3), "/r": (None, None)}
    r = spark.range(1).select(registry.camera_of_folder(F.lit("/v/PRIVATE/AVCHD/x")), registry.expected_sidecars(F.lit("Sony"), F.lit("HDR-1"), F.lit("cinema")), registry.quality_tier(F.lit("super8"), F.lit("cinema"))).first()
    assert list(r) == ["canon", [".xmp", ".xml", ".moi", ".mpl"], "legacy"]


def test_extension_learner(spark):
    e = frame(spark, [(".BBB", f"p{i}", T) for i in range(10)] + [(".ccc", "x", T)], "extension string, path string, seen_at timestamp")
    u = {r.extension: r for r in registry.unknown_extensions(e).collect()}
    assert u[".bbb"].n == 10 and len(u[".bbb"].samples) == 5
    rows = "extension string, category string, learned_by string, confidence double, learned_at long"
    l = registry.learn(frame(spark, [(".x", "video", "user", 1.0, 1)], rows), frame(spark, [(".X", "audio", "auto", 1.0, 2), (".y", "image", "auto", 1.0, 2)], rows))
    assert {r.extension: (r.category, r.confidence) for r in l.collect()} == {".x": ("video", 1.0), ".y": ("image", 0.9)}
    g = [registry.guess_category(F.lit(x)) for x in (".vidx", ".1080p", ".sndx", ".imgx", ".part3", ".a.bak", ".q")]
    assert list(spark.range(1).select(*g).first()) == ["video", "video", "audio", "image", "archive", "document", None]


def test_progress(spark):
    s = frame(spark, [("r", 0, 0), ("r", 1000, 10), ("r", 1050, 11), ("r", 2000, 30)], "run string, at_ms long, bytes long")
    r = registry.throughput(s, ["run"]).first()
    assert r.last_done == 30 and round(r.ewma, 4) == round(0.15 * (30 - 11) / 1000 * 1000 + 0.85 * 10, 4)
    w = registry.ewma(frame(spark, [("r", 1, 10.0), ("r", 2, 20.0)], "run string, o int, v double"), ["run"], "o", "v").first()
    assert w.ewma == 11.5
    p = spark.range(1).select(registry.overall_percent(F.lit("hashing"), F.lit(50.0)), registry.overall_percent(F.lit("renaming"), F.lit(1.0)), registry.eta_ms(F.lit(100), F.lit(10.0), F.lit(0), F.lit(0.0), F.lit(2), F.lit(10**6))).first()
    assert list(p) == [22.5, 100.0, None]


def test_hamming_bands_of_every_threshold(spark, monkeypatch):
    """Pairs at each distance, at both ends of the word, are found whatever bands are chosen."""
    import random

    from attestra.operators import graph

    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(12)]
    words = base + [b ^ sum(1 << i for i in r.sample(range(64), d)) for b in base for d in (1, 3, 8, 10, 11, 20)] + [0, 1 << 63, (1 << 64) - 1]
    rows = [(i, w - (1 << 64) if w >> 63 else w) for i, w in enumerate(words)]
    d = spark.createDataFrame(rows, "k long, h long")
    for threshold, n in ((0, 10), (3, 10), (10, 10), (10, 10**7), (20, 10)):
        plan = graph.band_plan(threshold, n)
        monkeypatch.setattr(graph, "band_plan", lambda *_, plan=plan: plan)
        want = {(i, j, bin(words[i] ^ words[j]).count("1")) for j in range(len(words)) for i in range(j) if bin(words[i] ^ words[j]).count("1") <= threshold}
        assert {tuple(x) for x in graph.hamming_pairs(d, "k", "h", threshold).collect()} == want, (threshold, plan)
        monkeypatch.undo()
    assert graph.band_plan(10, 10**6)[1] == 2  # 4 bands of 16 bits and two flips: under 1 % of all pairs meet
