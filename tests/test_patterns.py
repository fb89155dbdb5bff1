"""Prefixes, substrings and shell patterns of many rows at once, against plain loops."""

import fnmatch
import random

from pyspark.sql import functions as F

from attestra.operators import patterns, registry


def words(n, seed, letters="abAB/._", longest=12):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randrange(longest))) for _ in range(n)]


def test_substrings_of_all_lengths(spark):
    texts, literals = [*words(150, 1, longest=30), "", None, "İstanbul日本"], sorted({*words(60, 2, longest=6), "", "日", "本", "zzz"})
    t = spark.createDataFrame([(x,) for x in texts], "text string")
    p = spark.createDataFrame([(i, x) for i, x in enumerate(literals)] + [(-1, None)], "i int, lit string")
    got = {(r["text"], r["i"]) for r in patterns.containing(t, p, "text", "lit").collect()}
    assert got == {(x, i) for x in texts if x is not None for i, l in enumerate(literals) if l.lower() in x.lower()}
    assert patterns.containing(t, p.limit(0), "text", "lit").count() == 0


def test_shell_patterns(spark):
    texts = [x for x in words(200, 3) if x]
    globs = sorted({"*", "?", "a*", "*B", "*a?b*", "a.b", "**", "[a]", "+(", *("".join(random.Random(k).choice("ab*?._") for _ in range(4)) for k in range(40))})
    t, p = spark.createDataFrame([(x,) for x in texts], "text string"), spark.createDataFrame([(g,) for g in globs], "glob string")
    got = {(r["text"], r["glob"]) for r in patterns.matching(t, p, "text", "glob").collect()}
    assert got == {(x, g) for x in texts for g in globs if fnmatch.fnmatchcase(x.lower(), g.lower().replace("[", "[[]"))}


def test_a_hundred_thousand_mounts(spark):
    mounts = spark.range(100_000).select(F.concat(F.lit("/m"), F.col("id") % 100, F.lit("/"), F.col("id")).alias("mount"), F.col("id").cast("string").alias("fs_type"))
    mounts = mounts.union(spark.createDataFrame([("/", "root"), ("/m7", "seven"), (None, "none")], "mount string, fs_type string"))
    paths = spark.createDataFrame([("/m7/107/x",), ("/m7/1075",), ("/m7",), ("/m8/9",), ("relative",), ("",)], "path string")
    out = registry.longest_prefix(paths, mounts)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r["path"]: r["mount"] for r in out.collect()} == {"/m7/107/x": "/m7/107", "/m7/1075": "/m7/107", "/m7": "/m7", "/m8/9": "/", "relative": None, "": None}
    assert registry.longest_prefix(paths, mounts.limit(0)).where("mount is null").count() == 6


def test_no_pattern_meets_all_files(spark):
    cameras = spark.createDataFrame([(1, "a", "Maker", "One", ["Uno"], ["IMG_*.jpg"], ["DCIM/100*"])], "ord int, id string, make string, model string, variants array<string>, filename_patterns array<string>, folder_patterns array<string>")
    files = spark.createDataFrame([("/x/IMG_1.JPG", None, None, None, None), ("/dcim/100A/y", None, None, None, None), ("/z", "maker inc", "the uno 2", 1, 1)], "path string, make string, model string, width int, height int")
    out = registry.camera_match(files, cameras)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r["path"], r["matched_by"], r["camera_id"]) for r in out.collect()} == {("/x/IMG_1.JPG", "filename", "a"), ("/dcim/100A/y", "folder", "a"), ("/z", "exif", "a")}
