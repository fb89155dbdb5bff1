"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins; cyclic boosting fits shallow trees to one feature at a
time, and the sum of a feature's trees is a lookup table over its bins. The pairs of features
that explain most of the rest get tables over two bins. A score is the logistic function of a
sum of table entries.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from .common import cut, doc_columns, id_key, numbered, real_id

#: Labelled rows that the fit uses at most, those of the smallest hash of doc_id.
SAMPLE = 20_000
#: Ids with rows on either side of the threshold that are broadcast.
FEW = 100_000
#: Hashes of doc_id are taken modulo this.
SPAN = 1_000_000_007
BINS, PAIR_BINS, PAIRS, ROUNDS, RATE, LEAST = 32, 12, 6, 200, 0.15, 10
FEATURES = (
    "words", "word_length", "distinct", "top_word", "distinct_pairs", "upper", "digits", "marks", "symbols", "pipes",
    "not_ascii", "line_words", "distinct_lines", "sentence_words", "longest_word", "spaces",
)
UPPER, DIGITS = bytes(range(65, 91)), b"0123456789"
SYMBOLS, MARKS = b"#$%&*@^~+=<>{}[]\\_", b".,;:!?"


def features(text: str) -> list[float]:
    """FEATURES of a whole text; an empty one has zeros."""
    data = text.encode()
    words = data.split()
    n, w = len(data), len(words)
    if not w:
        return [0.0] * len(FEATURES)
    kinds = Counter(words)
    part = lambda chars: (n - len(data.translate(None, chars))) / n
    lines = [x for x in data.split(b"\n") if x.strip()]
    ends = data.count(b".") + data.count(b"!") + data.count(b"?")
    letters = sum(map(len, words))
    return [
        np.log1p(w), letters / w, len(kinds) / w, max(kinds.values()) / w, len(set(zip(words, words[1:], strict=False))) / max(1, w - 1), part(UPPER), part(DIGITS), part(MARKS), part(SYMBOLS), part(b"|"),
        (n - len(text)) / n, w / len(lines), len(set(lines)) / len(lines), w / (ends + 1), np.log1p(max(map(len, kinds))), 1 - letters / n,
    ]


def with_features(docs: DataFrame) -> DataFrame:
    """(id, x array<float>) of each row of docs (doc_id, text)."""

    def run(batches):
        for b in batches:
            x = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(x, pa.list_(pa.float32()))], ["id", "x"])

    return doc_columns(docs).mapInArrow(run, "id long, x array<float>")


@dataclass
class Model:
    """Intercept, the bins' edges and table of each feature, and ((i, j), table) of each pair."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[tuple[int, int], np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of features."""
        z = np.full(len(x), self.intercept)
        for f, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, f], side="right")]
        coarse = {f: np.searchsorted(self.pair_edges[f], x[:, f], side="right") for p, _ in self.pairs for f in p}
        for (i, j), t in self.pairs:
            z += t[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def cut_points(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values by bin of a shallow tree, from sums of gradients and Hessians by bin."""
    gain = lambda a, b: a * a / (b + 1.0)
    out = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth and len(g) > 1:
        gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
        score = np.where((nl >= LEAST) & (n.sum() - nl >= LEAST), gain(gl, hl) + gain(g.sum() - gl, h.sum() - hl), -np.inf)
        k = int(np.argmax(score))
        if score[k] > gain(g.sum(), h.sum()) + 1e-9:
            out[: k + 1], out[k + 1 :] = tree(g[: k + 1], h[: k + 1], n[: k + 1], depth - 1), tree(g[k + 1 :], h[k + 1 :], n[k + 1 :], depth - 1)
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best tree that cuts both features of a pair once: leaf values by bins, and its gain."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def four(s):
        a = s[:-1, :-1]
        b, c = s[:-1, -1:] - a, s[-1:, :-1] - a
        return np.stack([a, b, c, s[-1, -1] - a - b - c])

    if min(g.shape) < 2:
        return np.zeros(g.shape), 0.0
    gs, hs = four(G), four(H)
    gain = (gs**2 / (hs + 1.0)).sum(0)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    leaf = gs[:, i, j] / (hs[:, i, j] + 1.0)
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return out, float(gain[i, j])


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of features x and labels y (0 or 1). One class alone gives a constant score; no rows, 1/2."""
    mean = (y.sum() + 0.5) / (len(y) + 1)
    edges, pair_edges = ([cut_points(x[:, f], b) if len(x) else np.zeros(0) for f in range(x.shape[1])] for b in (BINS, PAIR_BINS))
    m = Model(float(np.log(mean / (1 - mean))), edges, [np.zeros(len(e) + 1) for e in edges], pair_edges, [])
    if not 0 < y.sum() < len(y):
        return m
    fine = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(pair_edges)]
    z = np.full(len(y), m.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, b in enumerate(fine):
            k = len(m.tables[f])
            g, h = slopes()
            step = RATE * tree(np.bincount(b, g, k), np.bincount(b, h, k), np.bincount(b, minlength=k))
            m.tables[f] += step
            z += step[b]
    size = [len(e) + 1 for e in pair_edges]
    grid = lambda i, j, v: np.bincount(coarse[i] * size[j] + coarse[j], v, size[i] * size[j]).reshape(size[i], size[j])
    g, h = slopes()
    ranked = sorted(((quadrants(grid(i, j, g), grid(i, j, h))[1], i, j) for i in range(len(size)) for j in range(i)), reverse=True)
    m.pairs = [((i, j), np.zeros((size[i], size[j]))) for _, i, j in ranked[:PAIRS]]
    for _ in range(ROUNDS // 4):
        for (i, j), t in m.pairs:
            g, h = slopes()
            step = RATE * quadrants(grid(i, j, g), grid(i, j, h))[0]
            t += step
            z += step[coarse[i], coarse[j]]
    return m


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.7, held_out: int | None = 2, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs (doc_id, text), from labels (doc_id, quality).

    Rows whose crc32 of doc_id modulo 4 is held_out never take part in the fit, which uses at most
    sample labelled rows; scores are functions of the text alone. A document with several labels
    counts as its lowest; null labels and those of unknown documents are passed over. Null and empty texts are scored
    as texts of no words; a null doc_id stays null and is held in; repeated rows each come back;
    an empty table gives an empty result; other columns are not looked at.
    """
    x = cut(with_features(docs))
    model = fitted(x, labels, held_out, sample)
    return scored(x, model).select(real_id("id").alias("doc_id"), fold("id", held_out).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def fold(c: str, held_out: int | None) -> Column:
    """Whether a row is held out of the fit by its id."""
    return F.coalesce(F.pmod(F.crc32(real_id(c).cast("string").cast("binary")), F.lit(4)) == (-1 if held_out is None else held_out), F.lit(False))


def fitted(x: DataFrame, labels: DataFrame, held_out: int | None, sample: int) -> Model:
    """The model of features x (id, x) and labels (doc_id, quality), of which at most sample rows come to the driver."""
    truth = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").cast("int").alias("quality"))
    known = x.join(truth.where(~fold("id", held_out)), "id").select("x", "quality", F.pmod(F.xxhash64("id"), F.lit(SPAN)).alias("h"))
    part = min(1.0, 1.5 * sample / max(1, known.count()))  # so that a task sends the driver its share, not a whole sample
    known = known.where(F.col("h") < int(SPAN * part)).orderBy("h", "quality", "x").limit(sample).collect()
    return train(np.array([r[0] for r in known], dtype=float).reshape(-1, len(FEATURES)), np.array([r[1] for r in known], dtype=float))


def scored(x: DataFrame, model: Model) -> DataFrame:
    """(id, score) of features (id, x)."""

    def run(batches):
        for b in batches:
            v = np.asarray(b.column("x").flatten()).reshape(-1, len(FEATURES)).astype(float)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(model.score(v))], ["id", "score"])

    return x.mapInArrow(run, "id long, score double")


def score_of(model: Model):
    """The score as a function of a column of texts."""

    @pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        v = np.array([features(t or "") for t in texts], dtype=np.float32).reshape(-1, len(FEATURES))
        return pd.Series(model.score(v.astype(float)))

    return score


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """docs without those that the classifier rejects, all columns unchanged, whatever they are called.

    Null and empty texts are scored as texts of no words; of rows that share a doc_id all stay if one is
    good, null ids being one id; repeated rows stay or go together; an empty table gives an empty result.
    """
    x = cut(with_features(docs.select("doc_id", "text")))
    model = fitted(x, labels, 2, SAMPLE)
    good = F.col("score") >= least
    mixed = scored(x, model).groupBy("id").agg(F.max(good).alias("some"), F.min(good).alias("all")).where("some and not all").select("id")
    d, at = numbered(docs)
    key, keep = id_key(at["doc_id"]), score_of(model)(F.coalesce(F.col(at["text"]), F.lit(""))) >= least
    # Only ids whose rows differ need to be looked up: texts stay where they are unless there are very many of these.
    if not (n := mixed.count()):
        return d.where(keep).toDF(*docs.columns)
    some = (F.broadcast(mixed) if n <= FEW else mixed).select(F.col("id").alias("k"), F.lit(True).alias("stays"))
    marked = d.select("*", keep.alias("own")).join(some, key == F.col("k"), "left")
    return marked.where(F.col("own") | F.coalesce("stays", F.lit(False))).select(*d.columns).toDF(*docs.columns)
