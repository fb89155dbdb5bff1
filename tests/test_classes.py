"""Class rows and memberships in place of arrays and of all pairs."""

import random

from pyspark.sql import functions as F

from attestra.operators import dedup, graph, manifest


def test_a_content_with_a_million_copies(spark):
    """Classes and members are rows; only the array of the large group is left out."""
    files = spark.range(1_000_000, numPartitions=8).select(F.col("id").alias("path"), F.when(F.col("id") % 1000 > 2, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 7)).alias("hash"), F.lit(5).cast("long").alias("size"))
    found = dedup.duplicate_classes(files)
    rows = {r["hash"]: r for r in found.collect()}
    assert (rows["hot"]["n"], rows["hot"]["representative"], rows["hot"]["wasted"]) == (997_000, 3, 996_999 * 5) and len(rows) == 8
    assert dedup.members(files, found).groupBy("hash").count().where("hash = 'hot'").first()["count"] == 997_000
    groups = {r["hash"]: r for r in dedup.duplicate_groups(files).collect()}
    assert groups["hot"]["files"] is None and groups["hot"]["n"] == 997_000
    assert all(len(r["files"]) == r["n"] and r["files"] == sorted(r["files"]) for h, r in groups.items() if h != "hot")


def test_audit_classes(spark):
    a = spark.createDataFrame([(p, "matched", "x", h) for p, h in (("a", "1"), ("b", "1"), ("c", "2"))] + [("d", "mismatched", "x", "2"), ("e", "missing", "x", None), ("f", "unreadable", "x", "1"), ("g", "extra", None, "2")], "path string, status string, expected string, actual string")
    assert sorted(map(tuple, manifest.audit_classes(a).collect())) == [("1", "a", 2), ("2", "c", 2)]
    assert {r["hash"]: r["files"] for r in manifest.audit_duplicates(a).collect()} == {"1": ["a", "b"], "2": ["c", "d"]}
    assert {r["files"] for r in manifest.audit_duplicates(a, most=1).collect()} == {None}


def all_pairs(rows, threshold):
    k = [(i, h) for i, h in rows if h is not None]
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    return {(a, b): near(x, y) for a, x in k for b, y in k if a < b and near(x, y) <= threshold}


def test_similar_rows_equal_those_of_all_pairs(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) - 2**63 for _ in range(6)]
    rows = [(i, b ^ (1 << r.randrange(63)) if r.random() < 0.5 else b) for i in range(120) for b in [base[r.randrange(6)]]]
    rows = [(r.randrange(10**6), h) for _, h in rows] + [(5_000_001, 12345), (5_000_002, None), (5_000_003, -1)]
    df = spark.createDataFrame(rows, "id long, h long")
    s = graph.Similar(df, "id", "h", 4)
    pairs = all_pairs(rows, 4)
    assert tuple(s.counts().first()) == (len(rows) - 1, len(pairs), len(rows) - 1 - len({x for p in pairs for x in p}))
    plain = graph.similarity_groups(spark.createDataFrame([(*p, d) for p, d in pairs.items()], "a long, b long, distance int"), 4)
    assert sorted(map(tuple, s.groups().collect())) == sorted(map(tuple, plain.collect()))
    near = {r["representative"]: (r["n"], r["links"], r["copies"]) for r in s.summary().collect()}
    kinds = {}
    for i, h in rows:
        if h is not None:
            kinds.setdefault(h, []).append(i)
    for h, ids in kinds.items():
        met = [v for g, v in kinds.items() if g != h and ((g ^ h) & (2**64 - 1)).bit_count() <= 4]
        assert near[min(ids)] == (len(ids), len(met), sum(map(len, met)))


def test_a_hash_that_most_rows_share(spark):
    """Half a million rows of one hash: more than 10^11 pairs, counted without making them."""
    n = 500_000
    df = spark.range(n, numPartitions=8).select("id", F.when(F.col("id") < 10, F.col("id")).otherwise(F.lit(1 << 40)).cast("long").alias("h"))
    s = graph.Similar(df, "id", "h", 3)
    hot = n - 10
    small = all_pairs([(i, i) for i in range(10)], 3)
    across = sum(1 for i in range(10) if (i ^ (1 << 40)).bit_count() <= 3)
    assert s.counts().first()["pairs"] == hot * (hot - 1) // 2 + len(small) + across * hot
    assert s.groups().where("member >= 10").count() == hot
    assert graph.Similar(df.limit(0), "id", "h").counts().first() == (0, 0, 0)
