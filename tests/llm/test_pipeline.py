"""The pipeline over a small folder of tables."""

import random

import pytest

import corpus_pipeline
from attestra.llm import nearcopies, queries
from attestra.llm.common import gapless_rank

pytest.importorskip("public_tokenizers")


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    good = [(i, " ".join(f"w{(i * 31 + k * k) % 997}" for k in range(90)) + ".", "en", f"s{i % 3}", 1) for i in range(120)]
    junk = [(500 + i, " ".join(f"x{(i * 7 + k) % 300}$$#" for k in range(90)), "en", "s1", 1) for i in range(60)]
    copies = [(900 + i, good[5][1], "en", "s2", 1) for i in range(20)]
    good[9] = (9, good[9][1] + " token = 0123456789abcdef0123456789abcdef", *good[9][2:])
    docs = spark.createDataFrame(good + junk + copies, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 500), 0) for r in good + junk], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = spark.createDataFrame(stage(spark, d, str(tmp_path)).collect(), docs.schema)
        assert d.columns == docs.columns
        kept[name] = d.collect()
    ids = {n: {r.doc_id for r in rows} for n, rows in kept.items()}
    assert not ids["quality"] & set(range(500, 560)) and ids["quality"] >= set(range(120))
    assert 5 in ids["near_duplicates"] and not ids["near_duplicates"] & set(range(900, 920))
    assert "[SECRET]" in next(r.text for r in kept["secrets"] if r.doc_id == 9)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == len(kept["mixing"]) and {r.doc_id for r in out} == ids["mixing"]


def test_every_operator_has_its_query():
    names = list(queries.QUERIES)
    assert [n for n in range(1, 11) if not any(k.startswith(f"op{n}_") for k in names)] == [] and "pipeline" in names


def test_gapless_rank(spark):
    d = spark.range(1000).selectExpr("id", "if(id % 3 = 0, null, id % 2) as k")
    for chunk in (7, 100_000):
        rows = gapless_rank(d, ["k"], ["id"], "r", 1000, chunk).collect()
        for k in (None, 0, 1):
            assert sorted(x.r for x in rows if x.k == k) == list(range(sum(x.k == k for x in rows)))


def jaccard(a, b):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("block", [None, 500])
def test_near_duplicate_stage_finds_edited_copies_and_verifies_them(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(nearcopies, "BLOCK", block)
    rng = random.Random(3)
    rows, want = [], set()
    boiler = [f"licence{k}" for k in range(40)]
    for i in range(120):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 100, 300]))] + boiler * (i % 2)
        copy = list(base)
        for k in rng.sample(range(len(base)), max(1, len(base) // rng.choice([20, 50, 100]))):
            copy[k] = "edited"
        rows += [(i, " ".join(base), i), (1000 + i, " ".join(copy), i)]
        want |= {i} if jaccard(rows[-1][1], rows[-2][1]) >= 0.8 else {i, 1000 + i}
    assert 150 < len(want) < 220  # copies on both sides of the threshold
    rows += [(2000, None, 0), (2001, "", 0), (2002, "a few words", 0), (2003, "A few  words", 0), (2004, "few words", 0), (None, rows[0][1], 0)]
    want = want - {0} | {2000, 2002, 2004, None}
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    out = nearcopies.keep_one_of_each(docs)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    assert len(kept) == len(set(kept)) and set(kept) == want
    assert nearcopies.keep_one_of_each(docs.limit(0)).count() == 0


CLASHES = ("_id", "_s", "_key", "_th", "times", "copy", "h", "h_id", "k", "w", "by", "_base", "_tokens", "_spans", "id", "fp", "below", "c0", "c1", "first")


def test_stages_keep_extra_columns_and_nulls(spark, tmp_path):
    """Every stage carries columns named as its own inside names, null texts, ids and sources, empty texts, and empty tables."""
    text = lambda i: " ".join(f"w{(i * 31 + k * k) % 997}" for k in range(60)) + "."
    base = [(i, text(i), "s0") for i in range(40)] + [(50, None, "s1"), (51, "", None), (None, text(50), None), (52, text(52) + " secret: 0123456789abcdef", "s1"), (3, text(3), "s0")]
    rows = [(*r, {"m": i}, *[f"{c}{i}" for c in CLASHES]) for i, r in enumerate(base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, maps map<string,long>, " + ", ".join(f"{c} string" for c in CLASHES))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    whole = {r.c0: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(r.asDict() | {"text": 0} == whole[r.c0].asDict() | {"text": 0} for r in got), name
        if name == "secrets":
            assert len(got) == len(rows) and {r.doc_id: r.text for r in got}[50] is None
            assert next(r.text for r in got if r.doc_id == 52).endswith("[SECRET]")
        if name == "near_duplicates":
            ids = [r.doc_id for r in got]
            assert sorted(ids, key=str) == sorted([*range(40), 50, 52, None], key=str)  # 51 is empty as 50 is; 3 came twice
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.columns == docs.columns and none.count() == 0, name
    packed = corpus_pipeline.STAGES[-1][1]
    assert {r.doc_id for r in packed(spark, docs, str(tmp_path)).collect()} == {r.doc_id for r in docs.collect()}
    assert packed(spark, docs.limit(0), str(tmp_path)).count() == 0
