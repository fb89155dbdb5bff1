"""Functions of order over one hot key that lies in many chunks, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from attestra.operators import gps, ordered, registry, related


@pytest.fixture
def chunks(spark):
    """Small tables in many partitions."""
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    was = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v)


def hot(n=900, seed=1):
    """Key 1 holds nearly all rows; a null key and small keys too; orders with ties; null values."""
    r = random.Random(seed)
    rows = [(1, r.randrange(400), i, None if r.random() < 0.5 else r.random()) for i in range(n)]
    return rows + [(k, r.randrange(9), i, r.random()) for i, k in enumerate([2, 2, 3, None, None, None])]


def by_key(rows):
    out = {}
    for x in sorted(rows, key=lambda x: (x[1], x[2])):
        out.setdefault(x[0], []).append(x)
    return out


def test_scans_of_a_hot_key(chunks):
    rows = hot()
    line = ordered.Ordered(chunks.createDataFrame(rows, "k int, t int, i int, v double"), ["k"], ["t", "i"])
    assert line.rows.where("k = 1").select("_chunk").distinct().count() >= 4
    out = line.scan(
        last=ordered.last_value("v"), next=ordered.next_value("v"), n=ordered.row_number(), before=ordered.row_before(F.col("v")),
        after=ordered.row_after(F.col("v")), most=ordered.whole(F.max, F.col("v")), every=ordered.whole(F.count, F.lit(1), F.sum),
    )
    got = {(x["k"], x["i"]): x for x in out.collect()}
    assert len(got) == len(rows)
    for k, xs in by_key(rows).items():
        known = [x[3] for x in xs]
        for j, x in enumerate(xs):
            g = got[k, x[2]]
            assert g["last"] == next((v for v in reversed(known[: j + 1]) if v is not None), None)
            assert g["next"] == next((v for v in known[j:] if v is not None), None)
            assert (g["n"], g["every"]) == (j + 1, len(xs))
            assert g["before"] == ((known[j - 1],) if j else None) and g["after"] == ((known[j + 1],) if j + 1 < len(xs) else None)
            assert g["most"] == max((v for v in known if v is not None), default=None)


def test_ordered_without_keys_and_without_rows(chunks):
    line = ordered.Ordered(chunks.range(100).select((F.col("id") * 7 % 100).alias("x")), [], ["x"])
    assert all(r["n"] == r["x"] + 1 for r in line.scan(n=ordered.row_number()).collect())
    assert ordered.Ordered(chunks.range(0), ["id"], ["id"]).scan(n=ordered.row_number()).count() == 0


def test_mean_of_a_hot_key(chunks):
    rows = [(x[0], x[1] * 1000 + x[2], float(x[2] % 17)) for x in hot(3000)]
    got = {r["k"]: (r["ewma"], r["n"]) for r in registry.ewma(chunks.createDataFrame(rows, "k int, o int, v double"), ["k"], "o", "v").collect()}
    for k in {x[0] for x in rows}:
        e, xs = None, sorted((x[1], x[2]) for x in rows if x[0] == k)
        for _, v in xs:
            e = v if e is None else 0.15 * v + 0.85 * e
        assert got[k] == (pytest.approx(e, rel=1e-9), len(xs))


def test_bursts_of_a_hot_key(chunks):
    ok = [("a", i, f"a{i}") for i in range(500)] + [("b", i * 3, f"b{i}") for i in range(300)] + [("c", 1, "c1"), ("c", 2, "c2")] + [("d", i * 2, f"d{i}") for i in range(3)]
    got = related.sequences(chunks.createDataFrame(ok, "k string, no int, m string"), ["k"], "no", "m").collect()
    assert sorted((r["k"], r["no"], r["place"], r["first"]) for r in got) == sorted([("a", i, i, "a0") for i in range(500)] + [("d", i * 2, i, "d0") for i in range(3)])


def tables(spark, tracks=6, points=150, files=700, seed=3):
    r = random.Random(seed)
    w = [(1, t, q, r.randrange(t * 500, t * 500 + 9000), r.random(), r.random(), r.random() if r.random() < 0.8 else None) for t in range(tracks) for q in range(points)]
    w += [(1, 99, q, x, 1.0 * q, 2.0, 3.0) for q, x in enumerate((0, 20_000))]  # one segment over all of the time
    w += [(2, 0, 0, 50, 1.0, 1.0, 1.0), (2, 0, 1, 50, 2.0, 2.0, None), (2, 0, 2, 90, 3.0, 3.0, 3.0), (3, 1, 0, 5, 0.0, 0.0, 0.0)]
    f = [(1, i, r.randrange(-500, 21_000)) for i in range(files)] + [(2, 10_000 + i, x) for i, x in enumerate((49, 50, 51, 70, 90, 91))] + [(3, 10_100, 5), (4, 10_200, 5)]
    point, file = "u int, track int, seq int, s long, latitude double, longitude double, altitude double", "u int, file int, s long"
    at = lambda d, n: d.withColumn(n, F.timestamp_seconds("s")).drop("s")
    return f, w, at(spark.createDataFrame(f, file), "file_ts"), at(spark.createDataFrame(w, point), "ts")


def test_nearest_of_a_hot_user(chunks):
    f, w, files, points = tables(chunks)
    got = {r["file"]: r for r in gps.nearest_in_time(files, points, 20, 3, by=["u"]).collect()}
    for u, i, t in f:
        near = min(((abs(t + 3 - x[3]), x[3], x[1], x[2], x[4]) for x in w if x[0] == u), default=None)
        if near is None or near[0] > 20:
            assert i not in got
        else:
            assert (got[i]["time_delta_s"], got[i]["latitude"]) == (near[0], near[4])


def test_nearest_meets_two_waypoints_a_file_and_no_bucket(chunks):
    _, _, files, points = tables(chunks)
    plan = gps.nearest_in_time(files, points, by=["u"])._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan and "Generate" not in plan


def test_interpolation_over_a_long_segment_and_a_hot_user(chunks):
    f, w, files, points = tables(chunks)
    got = {r["file"]: r for r in gps.interpolated(files, points, by=["u"]).collect()}
    seen = 0
    for u, i, t in f:
        best = None
        for track in sorted({x[1] for x in w if x[0] == u}):
            xs = sorted((x for x in w if (x[0], x[1]) == (u, track)), key=lambda x: (x[3], x[2]))
            best = best or next(((a, b) for a, b in zip(xs, xs[1:], strict=False) if a[3] <= t <= b[3]), None)
        if best is None:
            assert i not in got
            continue
        a, b = best
        p = (t - a[3]) / (b[3] - a[3]) if b[3] > a[3] else 0.0
        seen += 1
        assert got[i]["latitude"] == pytest.approx(a[4] + (b[4] - a[4]) * p)
        assert got[i]["time_delta_s"] == min(t - a[3], b[3] - t)
        assert (got[i]["altitude"] is None) == (a[6] is None or b[6] is None)
    assert seen == len(got) > 500


def test_covering_intervals_are_not_copied(chunks):
    """Intervals over all chunks: the least rank is found for every point, and no chunk but those at the ends holds them."""
    pts = [(1, i, f"p{i}") for i in range(2000)]
    iv = [(1, 0, 1999, 5, "long"), (1, 500, 1500, 3, "middle"), (1, 700, 701, 1, "short"), (2, 0, 9, 1, "other")]
    points = chunks.createDataFrame(pts, "u int, at long, point string")
    spans = chunks.createDataFrame(iv, "u int, low long, high long, r int, interval string").withColumn("rank", F.struct("r")).drop("r")
    got = {r["point"]: r["interval"] for r in ordered.first_cover(points, spans, ["u"]).collect()}
    assert got == {f"p{i}": "short" if i in (700, 701) else "middle" if 500 <= i <= 1500 else "long" for i in range(2000)}
    assert ordered.first_cover(points, spans.limit(0), ["u"]).count() == 0


def test_keys_of_several_chunks_are_told_apart(chunks):
    rows = hot() + [(k, t, 0, 0.0) for k in range(10, 300) for t in range(3)]
    line = ordered.Ordered(chunks.createDataFrame(rows, "k int, t int, i int, v double"), ["k"], ["t", "i"])
    where = {}
    for r in line.rows.collect():
        where.setdefault(r["k"], set()).add(r["_chunk"])
    several = {k for k, c in where.items() if len(c) > 1}
    assert {r["k"] for r in line.shared.collect()} == several and 1 in several
    inner, others = line.apart()
    assert {r["k"] for r in inner.select("k").distinct().collect()} == set(where) - several
    assert inner.count() + others.rows.count() == len(rows)
    scans = {"n": ordered.row_number(), "before": ordered.row_before(F.col("v"))}
    got = line.within(inner, **scans).unionByName(others.scan(**scans))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, line.scan(**scans).collect()))


def test_bursts_of_odd_names(chunks):
    paths = [f"/d/{n}" for n in ("a_1.jpg", "a_02.jpg", "a_3.jpg", "b(1).x", "b(2).x", "b(4).x", "c_1_1.j", "c_1_2.j", "c_1_3.j", "_1.q", "_2.q", "_3.q", "e.e_1.p", "e.e_2.p", "e.e_3.p", "x_1.", "x_2.", "x_3.", "日_1.é", "日_2.é", "日_3.é", "z_1(1).k", "z_1(2).k", "z_1(3).k")]
    got = related.bursts(related.parsed(chunks.createDataFrame([(p,) for p in paths], "path string"))).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["primary"], []).append((r["seq"], r["member"]))
    assert {k: [m for _, m in sorted(v)] for k, v in groups.items()} == {paths[k]: paths[k : k + 3] for k in (0, 3, 6, 12, 18, 21)}
