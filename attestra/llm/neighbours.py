"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. Each block of vectors holds pivot
inverted files: for each pivot, at which place it stands in each vector's order. A query walks
the files of its nearest and furthest pivots, sums the differences of places (the induced
footrule distance), and the nearest part of the block by it is reranked by exact inner products
in double precision. Blocks and packs of queries have a bounded size, so no task outgrows its memory
whatever the number of vectors; a block gives a query its k best at most.

A query visits every block: where vectors have no clusters, files cut to a vector's nearest pivots lose
true neighbours unless most of them are walked (see the README), so the work is a fixed share of rows
times queries. Rows are copied once a pack and queries once a block, both of which are large.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Pivots (a bounded sample: the distinct vectors of the smallest hash), files that a query walks
#: from either end of its order, part of a block that is reranked and the least number of it.
PIVOTS, NEAR, FAR, PART, LEAST = 255, 24, 24, 0.05, 400
#: Vectors of a block at most and, if there are so many, at least; blocks wanted; queries of a pack.
BLOCK, SMALL, WANTED, PACK = 65_536, 4096, 16, 8192


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v): rows with an id and a vector of the commonest length, neither zero nor with null or non-finite
    components; v is of doubles, or of floats if the column is."""
    floats = vectors.schema[embedding].dataType.simpleString() == "array<float>"
    v = F.col(embedding).cast("array<float>" if floats else "array<double>")
    d = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    d = d.where(~F.exists("v", bad)).where(F.exists("v", lambda x: x != 0))
    lengths = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return d.where(F.size("v") == (lengths[0][0] if lengths else 0))


def block_index(x: np.ndarray, pivots: np.ndarray, longest: float) -> np.ndarray:
    """The pivot inverted files of a block: row p has pivot p's place in each vector's order.
    With one more component all vectors get the length `longest`, so the order of inner products is one of nearness."""
    more = np.sqrt(np.maximum(0, longest**2 - (x * x).sum(1)))
    order = np.argsort(-(np.c_[x, more] @ pivots.T), axis=1, kind="stable")
    place = np.empty(order.shape, np.uint8)
    np.put_along_axis(place, order, np.arange(order.shape[1], dtype=np.uint8)[None].repeat(len(x), 0), 1)
    return np.ascontiguousarray(place.T)


def search_block(ids, x, files, qids, q, pivots, k):
    """(query, id, score): each query's k best of the block that the footrule distance finds."""
    count = len(pivots)
    orders = np.argsort(-(np.c_[q, np.zeros(len(q))] @ pivots.T), axis=1, kind="stable")
    ends = [*range(min(NEAR, count)), *range(max(NEAR, count - FAR), count)]
    keep = min(len(ids), max(LEAST, int(PART * len(ids)), 4 * k))
    out = []
    for i, order in enumerate(orders):
        far = np.zeros(len(ids), np.uint16)
        for j in ends:
            row = files[order[j]]
            far += np.maximum(row, np.uint8(j)) - np.minimum(row, np.uint8(j))
        if keep < len(ids):
            limit = np.partition(far, keep - 1)[keep - 1]
            near = np.flatnonzero(far < limit)
            near = np.concatenate([near, np.flatnonzero(far == limit)[: keep - len(near)]])  # rows are in order of id
        else:
            near = np.arange(len(ids))
        near = near[ids[near] != qids[i]]
        score = x[near] @ q[i]
        best = np.lexsort((ids[near], -score))[:k]
        out.append((np.full(len(best), qids[i]), ids[near[best]], score[best]))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def pivot_sample(v: DataFrame, n: int) -> list:
    """The PIVOTS distinct vectors of the smallest hash, or all if there are fewer."""
    h = v.select("v", F.xxhash64("v").alias("h"))
    span = 1 << 40
    part = min(span, 8 * PIVOTS * span // max(1, n))  # some 8 times as many; a task sorts these few alone
    for most in (part, span):
        sample = h.where(F.pmod("h", F.lit(span)) < most).dropDuplicates(["h"]).orderBy("h").limit(PIVOTS).collect()
        if len(sample) == PIVOTS:
            break
    return sample


def search(vectors: DataFrame, every: int = 20, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by every, the k rows
    other than its own with the largest inner product that the index finds, ties to the smaller id.

    Null ids and vectors that are null, empty, zero, of another length than most, or that hold null or
    non-finite components take no part. Rows that repeat an id are candidates of their own for others, and of
    a repeated query the first copy's neighbours come back once. An empty table gives an empty result.
    """
    v = cut(usable(vectors, vec_id, embedding))
    n, longest = v.agg(F.count("*"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))).first()
    queries = v.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    m = queries.count()
    blocks, packs = max(1, -(-n // min(BLOCK, max(SMALL, n // WANTED)))), max(1, -(-m // PACK))
    sample = pivot_sample(v, n)
    pivots = np.array([r[0] for r in sample], dtype=float)
    if len(pivots):
        pivots = np.c_[pivots, np.sqrt(np.maximum(0, longest**2 - (pivots * pivots).sum(1)))]
    place = lambda c, parts: F.pmod(F.xxhash64(c, F.lit(3)), F.lit(parts)).cast("int")
    rows = v.select(place("vec_id", blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(packs - 1))).alias("pack"), F.lit(0).alias("asks"), "vec_id", "v")
    asks = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), place("vec_id", packs).alias("pack"), F.lit(1).alias("asks"), "vec_id", "v")

    def meet(t: pa.Table) -> pa.Table:
        t = t.sort_by([("asks", "ascending"), ("vec_id", "ascending")])
        ids, asks = t.column("vec_id").to_numpy(), t.column("asks").to_numpy()
        x = np.asarray(t.column("v").combine_chunks().flatten()).reshape(len(ids), -1).astype(float)
        a = int(np.searchsorted(asks, 1))
        q, i, s = search_block(ids[:a], x[:a], block_index(x[:a], pivots, longest), ids[a:], x[a:], pivots, k) if 0 < a < len(ids) else search_block(ids[:0], x[:0], None, ids[:0], x[:0], pivots, k)
        return pa.table({"query_id": q.astype(np.int64), "vec_id": i.astype(np.int64), "score": s.astype(float)})

    met = rows.union(asks).groupBy("block", "pack").applyInArrow(meet, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
