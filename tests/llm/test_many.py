"""Texts with very many matches, and what must not grow with the table."""

import random
import re

from attestra.llm import secrets


def many(n, seed):
    r = random.Random(seed)
    kinds = [lambda: "token=" + "".join(r.choices("abcdefXYZ012", k=r.randrange(4, 14))), lambda: "AKIA" + "".join(r.choices("ABC123", k=r.randrange(8, 20))), lambda: "".join(r.choices("0123456789abcdef", k=r.randrange(28, 40))), lambda: r.choice(["é", "日本", "word", "", "\n"]), lambda: "secret: AKIA" + "Q" * 16 + "0123456789abcdef" * 2]
    return " ".join(r.choice(kinds)() for _ in range(n))


def expected(text):
    out = []
    for kind, p, least in ((0, secrets.ASSIGN, 8), (1, "AKIA[A-Z0-9]+", 16), (2, "[0-9a-f]+", 32)):
        for m in re.finditer(p, text):
            if len(m[2] if kind == 0 else m[0]) >= least:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_spans_and_redaction_of_any_number(spark):
    texts = [many(n, n) for n in (0, 1, 2, 3, 5, 17, 100, 1000, 9000)] + ["token=abcdefgh", "", None, "token=abcdefgh" * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [(x["start"], x["kind"], x["end"]) for x in r["base_spans"]] for r in secrets.scan(df).collect()}
    assert all(found[i] == expected(t or "") for i, t in enumerate(texts))
    every = {r["doc_id"]: [(x["start"], x["end"]) for x in r["spans"]] for r in secrets.scan(df).collect()}
    for r in secrets.redact(df).collect():
        t, at, out = texts[r["doc_id"]], 0, ""
        for a, z in sorted(every[r["doc_id"]]):
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, z)
        assert r["text"] == (None if t is None else out + t[at:])


def test_the_first_guess_takes_a_bounded_number_of_stretches(spark, monkeypatch):
    """The driver gets some FIRST stretches of any number of blocks."""
    from attestra.llm import hmm

    monkeypatch.setattr(hmm, "FIRST", 6)
    monkeypatch.setattr(hmm, "BLOCK", 40)
    sizes = []
    expected = hmm.Model.expected
    monkeypatch.setattr(hmm.Model, "expected", lambda self, x, n: sizes.append(len(n)) or expected(self, x, n))
    r = random.Random(1)
    df = spark.createDataFrame([(i, " ".join(f"w{r.randrange(30)}" for _ in range(60))) for i in range(400)], "doc_id long, text string").repartition(12)
    out = hmm.score(df).collect()
    assert len(out) == 400 and all(x["score"] < 0 for x in out)
    assert sizes and max(sizes) <= 12  # the driver's own rounds are over these alone


def test_hmm_score_is_the_forward_recursion_over_classes_and_words(spark):
    """Scores against a plain recursion over the model that the fit ends with."""
    import zlib
    from collections import Counter

    import numpy as np
    import xxhash  # noqa: F401

    from attestra.llm import hmm

    r = random.Random(2)
    texts = [" ".join(f"w{min(r.randrange(25), r.randrange(25))}" for _ in range(r.randrange(30))) for _ in range(120)] + [None, "zz unseen words", "W1 w2"]
    kept = {}
    of_counts = hmm.Model.of_counts

    def keep(*a):
        kept["model"] = of_counts(*a)
        return kept["model"]

    old, hmm.Model.of_counts = hmm.Model.of_counts, staticmethod(keep)
    try:
        out = {x["doc_id"]: x for x in hmm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    finally:
        hmm.Model.of_counts = old
    m = kept["model"]
    words = lambda t: [*(t or "").lower().split(), ""]
    count = Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10 for w in words(t))
    n, v = sum(count.values()), len(count)
    base = {i: sum(np.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)) for i, t in enumerate(texts)}
    assert all(abs(out[i]["base_score"] - base[i]) < 1e-9 for i in base)
    own = [w for _, w in sorted((-c, w) for w, c in count.items())[: hmm.OWN]]
    place = {w: i for i, w in enumerate(own)}
    for i, t in enumerate(texts):
        if all(w in place for w in words(t)):  # words with a class of their own are certain within it
            seq = np.array([place[w] for w in words(t)], np.uint16)
            a = m.start * m.emit[seq[0]]
            total = np.log10(a.sum())
            for x in seq[1:]:
                a = (a / a.sum()) @ m.move * m.emit[x]
                total += np.log10(a.sum())
            assert abs(out[i]["score"] - total) < 1e-6, (i, out[i]["score"], total)


def test_quality_scores_are_sums_of_table_entries(spark):
    """Additive scores recomputed entry by entry from the model's own tables."""
    import numpy as np

    from attestra.llm import quality

    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["good", "words", "here.", "The", "x1$", "||", "a"]) if i % 2 else r.choice(["#", "9", "x$x", "zz"]) for _ in range(r.randrange(1, 80)))) for i in range(300)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(250)], "doc_id long, quality int, toxic int")
    model = quality.fitted(quality.with_features(docs).cache(), labels, 2, 1000)
    assert model.pairs
    got = {x["doc_id"]: x["score"] for x in quality.classify(docs, labels).collect()}
    for i, t in rows:
        x = np.array(quality.features(t or ""), np.float32).astype(float)
        z = model.intercept
        for f, (edges, values) in enumerate(zip(model.edges, model.tables, strict=True)):
            z += values[sum(e <= x[f] for e in edges)]
        for (a, b), values in model.pairs:
            z += values[sum(e <= x[a] for e in model.pair_edges[a]), sum(e <= x[b] for e in model.pair_edges[b])]
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9
    twice = docs.union(spark.createDataFrame([(1, "# 9 # 9"), (2, "good words here. The good")], docs.schema))
    kept = sorted((x["doc_id"], x["text"]) for x in quality.keep_good(twice.where("text is not null"), labels).collect())
    scores = {}
    for x in quality.classify(twice, labels).collect():
        scores.setdefault(x["doc_id"], []).append(x["score"])
    assert kept == sorted((i, t) for i, t in [*rows, (1, "# 9 # 9"), (2, "good words here. The good")] if t is not None and max(scores[i]) >= 0.7)


def test_fingerprint_likeness_is_that_of_the_sketches(spark):
    """near_edited and near_next against sketches made anew from the texts."""
    from attestra.llm import fingerprint

    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(60)}" for _ in range(r.randrange(3, 200))) for _ in range(40)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t and t.split() else set()
    out = {x["doc_id"]: x for x in fingerprint.with_neighbours(docs).collect()}
    for i, t in enumerate(texts):
        a, b = sets(t or ""), sets(texts[(i + 1) % len(texts)] or "")
        if a and b:  # sketches of fewer than 256 shingles are whole
            assert abs(out[i]["near_next"] - len(a & b) / len(a | b)) < 1e-9
