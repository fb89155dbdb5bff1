"""Versions, schemas, functions by name, camera documents and places of sidecars."""

import json

import pytest
from pyspark.sql import functions as F

from attestra.functions import sql
from attestra.operators import registry, validate, versioned
from attestra.sources import documents, sinks


def test_versions_are_there_as_a_whole_or_not_at_all(spark, tmp_path):
    t = versioned.Versioned(spark, str(tmp_path / "t"), ["k"], "k int, v string")
    assert t.versions() == [] and t.read().count() == 0
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v string, o int")
    assert t.upsert(rows((1, "a", 1), (2, "b", 1), (None, "n", 1), (2, "bb", 2)), "o") == 1
    assert t.upsert(rows((2, "c", 1), (3, "d", 1), (None, "m", 1))) == 2
    assert t.add(rows((3, "z", 1), (4, "e", 1), (4, "f", 1)).drop("o")) == 3
    assert t.remove(spark.createDataFrame([(1,), (None,), (99,)], "k int")) == 4
    got = lambda v=None: sorted(map(tuple, t.read(v).collect()), key=repr)
    assert got(1) == [(1, "a"), (2, "bb"), (None, "n")]
    assert got(2) == [(1, "a"), (2, "c"), (3, "d"), (None, "m")]
    assert got(3) == [(1, "a"), (2, "c"), (3, "d"), (4, "e"), (4, "f"), (None, "m")]
    assert got() == [(2, "c"), (3, "d"), (4, "e"), (4, "f")]
    assert sorted(map(tuple, t.changes(1, 2).collect()), key=repr) == [(2, "modified"), (3, "added"), (None, "modified")]
    with pytest.raises(versioned.Conflict):
        t.commit(t.read(), base=2)
    assert t.versions() == [1, 2, 3, 4] and not [p for p in (tmp_path / "t").iterdir() if p.name.startswith("_new")]
    with pytest.raises(ValueError):
        t.read(9)
    t.export(str(tmp_path / "out"), 1)
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_a_version_that_is_not_whole_is_not_seen(spark, tmp_path):
    t = versioned.Versioned(spark, str(tmp_path / "t"), ["k"], "k int, v string")
    t.upsert(spark.createDataFrame([(1, "a")], "k int, v string"))
    spark.conf.set("spark.sql.ansi.enabled", "true")
    with pytest.raises(Exception, match=r"(?i)divide|assert|zero"):
        t.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").withColumn("v", F.raise_error(F.lit("assert")).cast("string")))
    assert t.versions() == [1]


def test_cameras_of_documents(spark, tmp_path):
    cam = lambda i, **x: {"id": i, "make": "M", "model": f"X{i}", "filename_patterns": [f"{i}_*.jpg"], "more": 1} | x
    (tmp_path / "a.json").write_text(json.dumps({"camera_count": 2, "cameras": [cam("a"), cam("b")]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps([cam("b", make="N"), cam("c")]))
    (tmp_path / "c.json").write_text("no json")
    c = versioned.load_cameras(spark, {"bundled": str(tmp_path / "a.json"), "user": str(tmp_path / "b.json"), "broken": str(tmp_path / "c.json"), "none": str(tmp_path / "d.json")})
    assert [(r["source"], r["id"], r["make"]) for r in c.orderBy("ord").collect()] == [("bundled", "a", "M"), ("bundled", "b", "M"), ("user", "b", "N"), ("user", "c", "M")]
    f = spark.createDataFrame([("/p/c_1.jpg", None, None, None, None), ("/p/x.jpg", "N", "Xb", None, None)], "path string, make string, model string, width int, height int")
    assert {r["path"]: r["camera_id"] for r in registry.camera_match(f, c).collect()} == {"/p/c_1.jpg": "c", "/p/x.jpg": "b"}
    assert versioned.load_cameras(spark, {}).count() == 0


def test_rules_of_a_schema(spark):
    f = validate.Field
    rules = [f("s", shortest=1, longest=3), f("n", "int", least=0, most=10), f("x", "number", required=False), f("b", "boolean", required=False), f("d", "datetime", required=False), f("a", "array", required=False, longest=1), f("p.q", pattern="^z"), f("hi", "number", required=False, above="n"), f("gone")]
    schema = "k int, s string, n string, x double, b string, d string, a array<int>, p struct<q: string>, hi double, id int, field string"
    rows = [
        (1, "ok", "3", 1.5, "true", "2024-01-02T03:04:05Z", [1], ("zz",), 3.0, 1, "x"),
        (2, "", "3.5", float("nan"), "yes", "2024-01-02", [1, 2], ("a",), 2.0, 1, "x"),
        (3, None, None, None, None, None, None, None, None, 1, "x"),
        (4, "long", "11", 1.0, "FALSE", "2024-01-02T03:04:05.123+01:00", [], ("z",), 1.0, 1, "x"),
        (5, "abc", "9007199254740993", 1.0, None, "yesterday", None, ("z",), None, 1, "x"),
    ]
    got = {(r["k"], r["field"], r["rule"]) for r in validate.violations(spark.createDataFrame(rows, schema), rules, "k").collect()}
    assert got == {(k, "gone", "required") for k in range(1, 6)} | {
        (2, "s", "length"), (2, "n", "type"), (2, "x", "type"), (2, "b", "type"), (2, "d", "type"), (2, "a", "length"), (2, "p.q", "pattern"), (2, "hi", "above"), (3, "s", "required"), (3, "n", "required"), (3, "p.q", "required"),
        (4, "s", "length"), (4, "n", "range"), (4, "hi", "above"), (5, "n", "type"), (5, "d", "type"),
    }
    df = spark.createDataFrame(rows, schema)
    assert [r["k"] for r in validate.valid(df, rules[:8], "k").where("valid").collect()] == [1]
    assert validate.violations(df.limit(0), rules, "k").count() == 0 and validate.violations(df, [], "k").count() == 0
    with pytest.raises(ValueError):
        f("x", "decimal")


def test_schemas_of_the_package(spark):
    good = spark.createDataFrame([("a", "0" * 16, 5, "2024-01-01T00:00:00Z"), ("", "x", -1, "now")], "path string, hash string, size long, mtime string")
    got = {(r["path"], r["field"], r["rule"]) for r in validate.violations(good, validate.SCHEMAS["manifest_entry"], "path").collect()}
    assert got == {("", "path", "length"), ("", "hash", "pattern"), ("", "size", "range"), ("", "mtime", "type")}


def test_functions_by_name(spark):
    sql.register(spark)
    assert spark.sql("SELECT blake3('abc'), blake3_16('abc'), xxh64(''), length(ulid(5L)), ulid_millis('0000000005ZZZZZZZZZZZZZZZZ')").first() == ("6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85", "6437b3ac38465133", "ef46db3751d8e999", 26, 5)
    d = "VALUES (1, '<gpx><wpt lat=\"1\" lon=\"2\"><ele>3</ele><time>2024-01-01T00:00:00Z</time></wpt></gpx>'), (2, NULL), (3, ''), (4, 'no document') AS d(i, text)"
    assert [tuple(r) for r in spark.sql(f"SELECT i, p.* FROM {d}, LATERAL parse_gpx(text, 'latitude, altitude') p").collect()] == [(1, 1.0, 3.0)]
    assert spark.sql(f"SELECT * FROM {d}, LATERAL parse_gpx(text)").columns == ["i", "text", *sql.GPX]
    assert spark.sql(f"SELECT * FROM {d}, LATERAL parse_subtitle(text)").count() == 0 == spark.sql(f"SELECT * FROM {d}, LATERAL parse_ics(text)").count()
    with pytest.raises(Exception, match="parse_gpx has no column nothing"):
        spark.sql(f"SELECT * FROM {d}, LATERAL parse_gpx(text, 'nothing')").collect()


def test_places_go_into_sidecars(spark):
    empty = f"array<struct<{', '.join(f'{documents.snake(t)}: string' for t in sinks.EVENT_TAGS)}>>"
    records = spark.createDataFrame([("a", "ha", "9"), ("b", "hb", None), ("z", "hz", None)], "path string, content_hash string, alt string")
    records = records.withColumn("photo", F.when(F.col("alt").isNotNull(), F.struct(F.col("alt").alias("gps_altitude"), F.lit("Cam").alias("make")))).withColumn("custody", F.lit(None).cast(empty)).drop("alt")
    places = spark.createDataFrame([("a", 1.5, 2.5, None), ("b", 3.0, 4.0, 5.0), ("b", 3.0, 4.0, 6.0), ("new", 7.0, 8.0, 9.0), ("unknown", 1.0, 1.0, 1.0)], "path string, latitude double, longitude double, altitude double")
    files = spark.createDataFrame([("new", "hn", 12), ("other", "ho", 1)], "path string, content_hash string, file_size int")
    out = {r["path"]: r for r in sinks.with_places(records, places, F.timestamp_seconds(F.lit(0)), "h", "u", "t", "map", files).collect()}
    assert set(out) == {"a", "b", "z", "new"}
    a = out["a"]
    assert (a["photo"]["gps_latitude"], a["photo"]["gps_altitude"], a["event_count"], a["custody"][0]["event_action"]) == ("1.5", "9", "1", "metadata_modification")
    assert out["b"]["photo"]["gps_altitude"] == "5.0" and out["new"]["content_hash"] == "hn" and out["new"]["file_size"] == "12"
    assert out["z"]["photo"] is None and out["z"]["custody"] is None
    back = documents.sidecar_records(spark.createDataFrame([(1,)], "one int").crossJoin(sinks.with_places(records, places, F.timestamp_seconds(F.lit(0)), "h", "u", "t", "map", files).where("path = 'new'")).select(sinks.sidecar_text(["content_hash", "source_path", "import_timestamp", "session_id", "photo", "custody"]).alias("text"))).first()
    assert back["valid"] and back["photo"]["gps_longitude"] == "8.0" and back["custody"][0]["event_notes"] == "map"
