"""Contents in parts: tree digests against whole ones, across chunk, part and group edges."""

import os
import random

import pytest

from attestra.functions import hashing
from attestra.operators import content
from attestra.sources import sinks

SIZES = (0, 1, 1023, 1024, 1025, 2047, 2048, 2049, 3072, 4096, 5000, 8192, 8193, 20_000, 33_000)


def data(n, seed=1):
    return random.Random(seed * 100_003 + n).randbytes(n)


def whole(x):
    return hashing.blake3_nodes([x])[0].hex()


@pytest.mark.parametrize("fan", [2, 8, 1024])
def test_tree_over_parts_equals_the_whole(spark, monkeypatch, fan):
    monkeypatch.setattr(content, "FAN", fan)
    rows = spark.createDataFrame([(n, bytearray(data(n))) for n in SIZES] + [(-1, None)], "n int, b binary")
    for part in (1024, 2048, 4096, 1 << 20):
        parts = content.parts_of(rows, "n", "b", part)
        got = {r["n"]: r["blake3"] for r in content.tree_digests(parts.repartition(5), "n", part).collect()}
        assert got == {n: whole(data(n)) for n in SIZES}


def test_known_answer_over_parts(spark):
    """31,744 bytes of 0 to 250 in turn, from the published test vectors."""
    x = bytes(i % 251 for i in range(31_744))
    parts = content.parts_of(spark.createDataFrame([(1, bytearray(x))], "n int, b binary"), "n", "b", 4096)
    assert content.tree_digests(parts, "n", 4096).first()["blake3"] == whole(x)
    assert whole(bytes(i % 251 for i in range(1024))) == "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"


def test_incomplete_contents_have_no_digest(spark):
    rows = spark.createDataFrame([(n, bytearray(data(n))) for n in (500, 5000, 9000, 9001, 9002)], "n int, b binary")
    parts = content.parts_of(rows, "n", "b", 1024)
    broken = parts.where("not (n = 9000 and part = 3)").union(parts.where("n = 9001 and part = 2")).union(parts.where("n = 500"))
    short = broken.selectExpr("n", "size", "part", "CASE WHEN n = 9002 AND part = 1 THEN substring(bytes, 1, 5) ELSE bytes END AS bytes")
    got = {r["n"]: r["blake3"] for r in content.tree_digests(short, "n", 1024).collect()}
    assert got == {500: None, 5000: whole(data(5000)), 9000: None, 9001: None, 9002: None}
    assert content.tree_digests(parts.limit(0), "n", 1024).count() == 0
    with pytest.raises(ValueError):
        content.parts_of(rows, "n", "b", 1000)


def test_files_in_parts(spark, tmp_path):
    paths = []
    for n in SIZES:
        (tmp_path / f"f{n}").write_bytes(data(n))
        paths.append((str(tmp_path / f"f{n}"), n))
    files = spark.createDataFrame([*paths, (str(tmp_path / "none"), 5), (str(tmp_path / "f4096"), 9999)], "path string, size long")
    got = {r["path"]: r for r in content.file_digests(files.where("not (path like '%f4096' and size = 4096)"), 2048).collect()}
    for p, n in paths:
        if n != 4096:
            assert (got[p]["blake3"], got[p]["error"]) == (whole(data(n)), None)
    assert got[str(tmp_path / "none")]["error"].startswith("FileNotFoundError") and got[str(tmp_path / "none")]["blake3"] is None
    assert got[str(tmp_path / "f4096")]["error"] == "shorter than its size"
    assert content.file_parts(files, 1024).where("path like '%f33000'").count() == 33


def test_sampled_contents_are_their_regions_and_size(spark, tmp_path):
    cases = (100, 999, 1000, 2500, 9000, 30_000)
    for n in cases:
        (tmp_path / f"s{n}").write_bytes(data(n))
    files = spark.createDataFrame([(str(tmp_path / f"s{n}"), n) for n in cases], "path string, size long")
    got = {r["path"]: r for r in content.file_digests(files, 1024, True, 1000, 3000).collect()}
    for n in cases:
        parts = [data(n)[a : a + k] for a, k in hashing.sampled_regions(n, 1000, 3000)]
        expected = whole(b"".join(parts) + (n.to_bytes(8, "big") if n >= 1000 else b""))
        r = got[str(tmp_path / f"s{n}")]
        assert (r["blake3"], r["sampled"]) == (expected, n >= 1000)


def test_running_digest_and_copies_in_pieces(tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "PIECE", 1000)
    for n in SIZES:
        h = content.Running(2048)
        for k in range(0, n, 700):
            h.update(data(n)[k : k + 700])
        assert h.hexdigest() == whole(data(n))
        src = tmp_path / f"c{n}"
        src.write_bytes(data(n))
        size, digest, verified = sinks.copy_file(str(src), f"{src}.to", "blake3-full")
        assert (size, digest, verified) == (n, whole(data(n)), True)
        assert (tmp_path / f"c{n}.to").read_bytes() == data(n)
    assert not [x for x in os.listdir(tmp_path) if x.endswith(".part")]


def test_memory_of_a_running_digest_does_not_follow_the_size():
    h = content.Running(1 << 16)
    piece = bytes(1 << 18)
    for _ in range(40):
        h.update(piece)
        assert len(h.waiting) <= (1 << 16)
    assert len(h.nodes) == 40 * 4 - 1 and len(h.hexdigest()) == 64


def test_parts_of_a_large_batch_are_hashed_a_few_at_a_time(spark, monkeypatch):
    seen, nodes_of = spark.sparkContext.accumulator(0), content.nodes_of

    def counted(sizes, numbers, data, part):
        seen.add(len(data) > 4)
        return nodes_of(sizes, numbers, data, part)

    monkeypatch.setattr(content, "TOGETHER", 4096)
    monkeypatch.setattr(content, "nodes_of", counted)
    text = "".join(map(str, range(6000)))
    d = spark.createDataFrame([(1, text), (2, "x"), (3, "")], "k int, t string").coalesce(1)
    got = {r["k"]: r["blake3"] for r in content.tree_digests(content.parts_of(d, "k", "t", 1024), "k", 1024).collect()}
    assert got == {k: hashing.blake3_digests([t.encode()])[0] for k, t in ((1, text), (2, "x"), (3, ""))}
    assert seen.value == 0


def test_whole_digests_are_those_of_the_column(spark):
    rows = [(k, "é" * k if k % 7 else None) for k in range(1, 2300, 2)]
    d = spark.createDataFrame(rows, "k int, t string").coalesce(1)
    got = {r["k"]: r["whole"] for r in content.whole_digests(d, "k", "t").collect()}
    expected = hashing.blake3_digests([(t or "").encode() for _, t in rows])
    assert got == {k: None if t is None else x for (k, t), x in zip(rows, expected, strict=True)}
