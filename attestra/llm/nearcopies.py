"""Near duplicates by SimHash balls, verified by the Jaccard index of whole texts' 5-word shingle sets.

Rows are linked where the index is at least LEAST. Candidates are what the ball hashing of simhash.py links,
over SimHashes of the sets. Its three bits hold few of the pairs at 0.8, whose SimHashes differ in some ten bits, so
MinHash bands add the rest: two sets at 0.8 share none of the BANDS bands with a chance of 3 in a million.
Candidates, directly or by a chain, make a component; a task gets the texts of its members once and joins them exactly, by
prefixes of the rarest shingles. So every link is verified, and a pair is missed only if no chain
of candidates joins it. Components of more than BLOCK bytes are dealt over pairs of blocks, which
together hold each pair of members.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, cut, id_key, in_order, numbered
from .fingerprint import SHINGLE, hashes, tokens

#: The least index of near duplicates, as a fraction.
LEAST = (4, 5)
#: MinHash bands and their rows; band keys of a bucket (about); text bytes of a block; text bytes of a group of tasks (about).
BANDS, ROWS = 32, 5
PER_BUCKET, BLOCK, GROUP = 2_000_000, 8 << 20, 32 << 20


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of text's shingles in order; none if text has no words."""
    return np.unique(np.array(hashes(tokens(text), shingle), dtype=np.uint64))


@functools.cache
def permutations() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and masks of the MinHash functions."""
    rng = np.random.default_rng(0)
    a, c = (rng.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64) for _ in range(2))
    return a | np.uint64(1), c


def band_keys(s: np.ndarray) -> np.ndarray:
    """A key for each band of a set that is not empty."""
    a, c = permutations()
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(s), 4096):
        least = np.minimum(least, ((s[i : i + 4096] ^ c) * a).min(1))
    key = np.arange(BANDS, dtype=np.uint64)
    for m in least.reshape(BANDS, ROWS).T:
        key = (key ^ m) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def similar(sets: list[np.ndarray], side: list[int]) -> list[tuple[int, int]]:
    """Pairs of sets at LEAST or above that join the same sets as all such pairs do; where side has
    two values, only pairs across them. A set's least frequent hashes, as many as it may lack and
    one more, have one in common with any set so near."""
    num, den = LEAST
    size = [len(s) for s in sets]
    _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    once = int((count == 1).sum())
    ranked = [np.sort(r) for r in np.split(rank[inverse], np.cumsum(size)[:-1])]
    across = len(set(side)) > 1
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    index: dict[int, list[int]] = {}
    out = []
    for i in sorted(range(len(sets)), key=size.__getitem__):
        head = ranked[i][: size[i] - -(-num * size[i] // den) + 1]
        head = head[head >= once].tolist()
        for j in dict.fromkeys(j for h in head for j in index.get(h, ())):
            if den * size[j] < num * size[i] or (across and side[i] == side[j]) or find(i) == find(j):
                continue
            both = len(np.intersect1d(ranked[i], ranked[j], assume_unique=True))
            if den * both >= num * (size[i] + size[j] - both):
                root[find(i)] = find(j)
                out.append((i, j))
        for h in head:
            index.setdefault(h, []).append(i)
    return out


def band_links(sets: DataFrame, n: int) -> DataFrame:
    """(a, b): of each band key of sets (fp, bands; about n rows) links from its smallest fp to its others."""
    buckets = max(16, -(-n * BANDS // PER_BUCKET))

    def emit(batches):
        for b in batches:
            keys = np.frombuffer(b"".join(b.column("bands").to_pylist()), np.uint64)
            own = np.repeat(b.column("fp").to_numpy(), BANDS)
            to = (keys >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(to, kind="stable")
            keys, own, to = keys[order], own[order], to[order]
            edges = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True]) if len(to) else [0]
            data = [keys[s:e].tobytes() + own[s:e].tobytes() for s, e in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(to[edges[:-1]].astype(np.int64)), pa.array(data, pa.binary())], ["bucket", "packed"])

    def meet(t: pa.Table) -> pa.Table:
        parts = [p.as_buffer() for p in t.column("packed")]
        key = np.concatenate([np.frombuffer(p, np.uint64, p.size // 16) for p in parts])
        fp = np.concatenate([np.frombuffer(p, np.int64, p.size // 16, p.size // 2) for p in parts])
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order]
        lead = fp[np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], np.arange(len(key)), 0))]
        links = np.unique(np.stack([lead, fp])[:, lead != fp], axis=1)
        return pa.table({"a": links[0], "b": links[1]})

    packed = sets.mapInArrow(emit, "bucket long, packed binary")
    return packed.groupBy("bucket").applyInArrow(meet, "a long, b long")


def ball_links(sets: DataFrame) -> DataFrame:
    """(a, b): links between sets (fp, sim) by the ball hashing of their SimHashes; sets of one SimHash are linked to the smallest."""
    sims = cut(sets.groupBy("sim").agg(F.min("fp").alias("rep")))
    same = sets.join(sims, "sim").where("fp <> rep").select(F.col("rep").alias("a"), F.col("fp").alias("b"))
    near = simhash.ball_links(sims.select(F.col("sim").alias("fp")), sims.count())
    end = lambda c: sims.select(F.col("sim").alias(c), F.col("rep").alias(f"{c}_rep"))
    return same.union(near.join(end("a"), "a").join(end("b"), "b").select("a_rep", "b_rep"))


def verified_links(texts: DataFrame, groups: int, shingle: int = SHINGLE) -> DataFrame:
    """(a, b): links between the members (fp, text) of each candidate component (root) of blocks blocks."""

    def verify(t: pa.Table) -> pa.Table:
        a, b = [], []
        part: dict[tuple, dict[int, tuple]] = {}
        made: dict[int, np.ndarray] = {}
        for root, lo, hi, at, fp, text in zip(*(t.column(c).to_pylist() for c in ("root", "lo", "hi", "at", "fp", "text")), strict=True):
            if fp not in made:
                made[fp] = shingle_set(text, shingle)
            part.setdefault((root, lo, hi), {})[fp] = (made[fp], at if lo != hi else 0)
        for of in part.values():
            fps = list(of)
            for i, j in similar([s for s, _ in of.values()], [side for _, side in of.values()]) if len(fps) > 1 else ():
                a.append(fps[i])
                b.append(fps[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    at = F.pmod(F.xxhash64("fp", F.lit(3)), F.col("blocks"))
    dealt = texts.select("root", "fp", "text", at.alias("at"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("root", "fp", "text", "at", F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi"))
    return dealt.withColumn("task", F.pmod(F.xxhash64("root", "lo", "hi"), F.lit(groups))).groupBy("task").applyInArrow(verify, "a long, b long")


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs without near duplicates: of each component of linked rows the row of the smallest doc_id
    stays, all columns unchanged. Of its rows that share this doc_id, one stays. Null and
    empty texts have no shingles and are near duplicates of each other only; a null doc_id
    sorts first; an empty table gives an empty result."""

    def run(batches):
        import xxhash

        for b in batches:
            fps, sims, bands, sizes = [], [], [], []
            for t in b.column("text").to_pylist():
                s = shingle_set(t, shingle)
                fps.append(xxhash.xxh64_intdigest(s.tobytes(), 9) if len(s) else 0)
                sims.append(simhash.majority(s) if len(s) else 0)
                bands.append(band_keys(s).tobytes() if len(s) else b"")
                sizes.append(len(t))
            fp, sim = (pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (fps, sims))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), fp, sim, pa.array(sizes, pa.int64()), pa.array(bands, pa.binary())], ["id", "th", "fp", "sim", "size", "bands"])

    text = F.coalesce(F.col("text"), F.lit(""))
    key, th = id_key("doc_id"), F.xxhash64(text)
    own = cut(docs.select(key.alias("id"), th.alias("th"), text.alias("text")).mapInArrow(run, "id long, th long, fp long, sim long, size long, bands binary"))
    fps = cut(own.groupBy("fp").agg(F.min(F.struct("id", "th")).alias("first"), F.max("size").alias("size")))
    sets = own.join(fps.select("first.id", "first.th"), ["id", "th"], "left_semi").where("fp <> 0").select("fp", "sim", "bands")
    near = components(band_links(sets.select("fp", "bands"), fps.count()).union(ball_links(sets.select("fp", "sim"))))
    members = cut(near.join(fps, near.node == fps.fp).select("root", "fp", "size", "first.id", "first.th"))
    blocks = members.groupBy("root").agg(F.sum("size").alias("all")).select("root", F.ceil(F.greatest(F.lit(1), F.col("all")) / BLOCK).cast("long").alias("blocks"), "all")
    volume = blocks.agg(F.coalesce(F.sum(F.col("all") * F.col("blocks")), F.lit(0))).first()[0]
    member = members.join(blocks.select("root", "blocks"), "root").select("id", "th", "root", "fp", "blocks")
    texts = docs.select(key.alias("id"), th.alias("th"), text.alias("text")).join(member, ["id", "th"])
    labels = cut(components(verified_links(texts, max(16, -(-volume // GROUP)), shingle)))
    least = labels.join(fps, labels.node == fps.fp).groupBy("root").agg(F.min("first").alias("first")).select("first")
    alone = fps.join(labels, fps.fp == labels.node, "left_anti").select("first")
    first = alone.union(least).select(F.col("first.id").alias("_key"), F.col("first.th").alias("_th"))
    d, at = numbered(docs)
    kept = d.select(id_key(at["doc_id"]).alias("_key"), F.xxhash64(F.coalesce(F.col(at["text"]), F.lit(""))).alias("_th"), F.struct(*d.columns).alias("w"), in_order(d).alias("by")).join(first, ["_key", "_th"], "left_semi")
    one = kept.groupBy("_key", "_th").agg(F.min_by("w", "by").alias("w"))  # keeps the join's partitioning
    return one.select(*[F.col(f"w.{c}").alias(c) for c in d.columns]).toDF(*docs.columns)
