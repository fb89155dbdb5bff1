"""Known answers for hashes, ids, paths, types and metadata values."""

import pytest
from pyspark.sql import functions as F

from attestra.functions import filetype, hashing, ids, imagehash, metadata, paths


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_blake3_known_answers():
    empty, abc = hashing.blake3_digests([b"", b"abc"])
    assert empty == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert abc == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"


def test_blake3_batch_equals_single():
    items = [bytes(i % 251 for i in range(n)) for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3073, 9000)]
    assert hashing.blake3_digests(items) == [hashing.blake3_digests([x])[0] for x in items]


def test_hash_columns(spark):
    text = F.lit("Hello, World!")
    r = one(spark, hashing.hash_of(text, "blake3").alias("b"), hashing.hash_of(text, "blake3-full").alias("f"), hashing.hash_of(text, "xxhash64").alias("x"), hashing.hash_of(F.lit(None).cast("string")).alias("n"))
    assert r.x == "c49aacf8080fe47f"
    assert r.f.startswith(r.b) and len(r.b) == 16 and r.n is None
    with pytest.raises(ValueError):
        hashing.hash_of(text, "crc")


def test_detect_and_verify(spark):
    r = one(
        spark, hashing.detect_algorithm(F.lit("a" * 64)), hashing.detect_algorithm(F.lit("A" * 64)), hashing.verify(F.lit("ab" * 16), F.lit("AB" * 16)), hashing.verify(F.lit("x"), F.lit("x")),
        hashing.matches_prefix(F.lit("a" * 64), F.lit("A" * 16)),
    )
    assert list(r) == ["sha256", None, True, None, True]


def test_sampled_regions():
    m = 100
    assert hashing.sampled_regions(999, 1000, m) == [(0, 999)]
    assert hashing.sampled_regions(1000, 1000, m) == [(0, 100), (450, 100), (900, 100)]
    assert hashing.sampled_regions(300, 200, m) == [(0, 100)]  # touching regions are skipped


def test_sampled_hash_rows(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 5000)
    f = spark.createDataFrame([(str(tmp_path / "a"),), (str(tmp_path / "none"),)], "path string")
    rows = {r.path.rsplit("/", 1)[1]: r for r in hashing.sampled_hashes(f, threshold=1000, region=100).collect()}
    assert rows["a"].sampled and len(rows["a"].hash) == 16 and rows["none"].hash is None and rows["none"].error
    s = hashing.sampling_summary(hashing.sampled_hashes(f)).first()
    assert tuple(s) == (2, 0, 1, 1)


def test_ids(spark):
    import uuid

    r = one(spark, ids.uuid5(F.lit("example.org")), ids.ulid_millis(F.lit("01ARZ3NDEKTSV4RRFFQ69G5FAV")), ids.is_ulid(F.lit("01ARZ3NDEKTSV4RRFFQ69G5FAV")))
    assert list(r) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, "example.org")), 1469922850259, True]
    d = spark.range(50).select(ids.uuid7(F.timestamp_millis(F.lit(1469922850259))).alias("v7"), ids.monotonic_ulid(F.lit(5).cast("long") + F.col("id") * 0).alias("m"), ids.make_uuid(1).alias("v1"), ids.ulid(F.col("id") + 7).alias("u"))
    rows = d.select("*", ids.ulid_millis(F.col("u")).alias("t"), ids.uuid_version(F.col("v7")).alias("k")).collect()
    assert {r.k for r in rows} == {7} and all(r.v7.replace("-", "")[:12] == f"{1469922850259:012x}" for r in rows)
    assert [r.t for r in rows] == list(range(7, 57)) and len({r.v1 for r in rows}) == 50
    assert len({r.m for r in rows}) == 50
    with pytest.raises(ValueError):
        ids.make_uuid(5)


@pytest.mark.parametrize(
    ("path", "rel", "expected"),
    [("*.tmp", "a/b.tmp", True), ("*.tmp", "a/b.tmpx", False), ("build/", "build/x", True), ("build/", "build", False), ("/top", "top", True), ("/top", "a/top", False), ("a/**/z", "a/b/c/z", True), ("a/**/z", "a/z", True), ("x?z", "xyz", True), ("[ab].c", "a.c", True)],
)
def test_ignore_patterns(spark, path, rel, expected):
    assert one(spark, paths.ignored(F.lit(rel), [path]))[0] is expected


def test_last_ignore_pattern_decides(spark):
    assert list(one(spark, paths.ignored(F.lit("keep.log"), ["*.log", "!keep.log"]), paths.ignored(F.lit("x.log"), ["# note", "", "*.log", "!keep.log"]))) == [False, True]


def test_paths(spark):
    p = lambda s: paths.parse_path(F.lit(s))
    a, b, c = one(spark, p("/x/A.b.JPG"), p(".hidden"), p("noext"))
    assert (a.dir, a.base, a.name, a.ext, a.ext_lower) == ("/x", "A.b.JPG", "A.b", ".JPG", ".jpg")
    assert (b.ext, b.name) == ("", "") and (c.ext, c.name) == ("", "")
    r = one(spark, paths.renamed(F.lit("/a/p.jpg"), F.lit("0" * 64)), paths.renamed(F.lit("/a/p.0123456789abcdef.jpg"), F.lit("0" * 64)), paths.wildcard(F.lit("IMG_1.JPG"), "img_?.jpg"), paths.simple_glob(F.lit("a/b.txt"), "*.txt"), paths.truncated_path(F.lit("/very/long/path/to/a/file.txt"), 20))
    assert list(r)[:4] == ["/a/p.0000000000000000.jpg", None, True, True] and len(r[4]) <= 20 and r[4].endswith("/file.txt")


def test_formats(spark):
    r = one(spark, *[paths.format_bytes(F.lit(n)) for n in (0, 1, 1536, -2048, 5 * 1024**4)], paths.format_duration(F.lit(7_500_000)), paths.format_duration(F.lit(900)), paths.format_duration(F.lit(None).cast("long")), paths.format_throughput(F.lit(0)), paths.progress_bar(F.lit(40.0)))
    assert list(r) == ["0 B", "1.0 B", "1.5 KB", "-2.0 KB", "5.0 TB", "2h5m0s", "<1s", "--", "--", "[" + "█" * 8 + "░" * 12 + "] 40%"]


def test_types(spark):
    png = F.unhex(F.lit("89504e470d0a1a0a00"))
    r = one(spark, filetype.detect_type(F.lit("a.jpeg"), F.unhex(F.lit("ffd8ffe0"))), filetype.detect_type(F.lit("a.txt"), png), filetype.detect_type(F.lit("a.nef"), F.unhex(F.lit("00"))), filetype.detect_type(F.lit("a.srt"), F.lit("x").cast("binary")))
    assert [(x.category, x.subcategory, x.mismatch) for x in r] == [("image", "photo", True), ("image", "photo", True), ("image", "raw", False), ("subtitle", None, False)]
    m = one(spark, *[filetype.media_category(F.lit(p)) for p in ("a.DNG", "a.gif", "a.mp4", "a.xyz")])
    assert list(m) == ["raw", "image", "video", "other"]
    s = one(spark, *[filetype.storage_type(F.lit(p)) for p in ("/Volumes/SSD1/x", "/Volumes/EOS_DIGITAL/x", "/Volumes/nas/x", "/mnt/gopro/x", "/mnt/x", "/home", "", "\\\\srv\\x")])
    assert list(s) == ["local", "camera_media", "network", "camera_media", "network", "local", "unknown", "network"]
    q = one(spark, filetype.audio_quality(F.lit(".flac"), F.lit("flac"), F.lit(16), F.lit(16000)), filetype.audio_quality(F.lit(".m4a"), F.lit("alac"), F.lit(16), F.lit(None).cast("int")), filetype.is_hidden(F.lit("a_SDR.jpg")), filetype.is_skipped(F.lit("x/THUMBS.db")), filetype.hdr_format(F.lit(None), F.lit(""), F.lit("PQ")))
    assert list(q) == ["transcode_suspected", "lossy", True, True, "HDR10"]


def test_values(spark):
    r = one(
        spark, metadata.exif_iso(F.lit("2024:01:02 03:04:05")), metadata.seconds(F.lit("1:02:03")), metadata.seconds(F.lit("4.5 s")), metadata.cue_seconds(F.lit("00:01:02,500")), metadata.keywords(F.lit("a, b;c,")), metadata.shutter(F.lit(0.0015625)), metadata.leading_number(F.lit("x")),
        filetype.frame_rate(F.lit("25/1")), filetype.frame_rate(F.lit("25/0")), metadata.timecode(F.lit("01020304")),
    )
    assert list(r) == ["2024-01-02T03:04:05", 3723.0, 4.5, 62.5, ["a", "b", "c"], "1/640", None, 25.0, None, "01:02:03:04"]


def test_companion_merge_order(spark):
    m = lambda **kv: F.create_map(*[F.lit(x) for p in kv.items() for x in p])
    sides = F.array(F.struct(F.lit(".xmp").alias("ext"), m(A="2", B="2").alias("tags")), F.struct(F.lit(".moi").alias("ext"), m(DateTimeOriginal="moi", B="3").alias("tags")), F.struct(F.lit(".srt").alias("ext"), F.create_map(F.lit("GPSLatitude"), F.lit("9"), F.lit("DJI:ISO"), F.lit("100")).alias("tags")))
    r = one(spark, metadata.merged_companions(m(A="1", B="", GPSLatitude="1", DateTimeOriginal="p"), sides))[0]
    assert r == {"A": "1", "B": "2", "GPSLatitude": "9", "DateTimeOriginal": "moi", "DJI:ISO": "100"}


def test_image_hashes(spark):
    import numpy as np

    def pgm(a):
        return b"P5 %d %d 255\n" % (a.shape[1], a.shape[0]) + a.astype(np.uint8).tobytes()

    ramp = np.tile(np.arange(64) * 4, (64, 1))
    rows = [("up", pgm(ramp)), ("up2", pgm(ramp + 1)), ("down", pgm(ramp[:, ::-1])), ("bad", b"nothing")]
    d = spark.createDataFrame(rows, "path string, content binary")
    h = {r.path: r for r in imagehash.image_hashes(d).collect()}
    assert h["up"].hash == h["up2"].hash == "f" * 16 and h["down"].hash == "0" * 16 and h["bad"].error and h["up"].format == "pgm"
    noise = np.random.default_rng(0).integers(0, 200, (64, 64))
    d = spark.createDataFrame([("a", pgm(noise)), ("brighter", pgm(noise + 20)), ("other", pgm(noise[::-1]))], "path string, content binary")
    for method in imagehash.METHODS:
        got = {r.path: r.hash for r in imagehash.image_hashes(d, method).collect()}
        assert got["a"] == got["brighter"] != got["other"] and len(got["a"]) == 16


def test_extensions_beyond_the_table(spark):
    """The standard library's MIME registry and families by rule go on where the table ends."""
    from attestra.functions import filetype

    names = {"a.3GPP": "video", "a.asf": "video", "a.aifc": "audio", "a.adoc": "document", "a.r07": "archive", "a.part12": "archive", "a.pbm": "image", "a.latex": "document", "a.shar": "archive", "a.zzz": "other", "noext": "other"}
    got = one(spark, *[filetype.media_category(F.lit(n)).alias(f"c{i}") for i, n in enumerate(names)])
    assert dict(zip(names, got, strict=True)) == names
    rows = filetype.extension_rows()
    assert len({r[0] for r in rows if r[0] in {"." + x for x in filetype.CATEGORIES[2][1]}}) == len(filetype.CATEGORIES[2][1]) and len(rows) > 290
