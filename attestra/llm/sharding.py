"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups of equal texts stay together. What is placed are units, whose number is bounded whatever
the input: each group of at least 1/LOTS of all bytes is a unit of its own, and the others are
dealt by hash over LOTS lots. A group larger than a shard is split into pieces of
whole documents, since no placement could balance it otherwise. Units go to the shard with the
highest dot product of their vector with the residual capacity, largest first.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, gapless_rank, real_id

WORD = r"[^\x20\x09-\x0D]+"
LOTS = 4096
#: How much the balance of bytes, tokens and rows counts, and how much for the smaller units, which have half of the bytes:
#: where the three conflict, these settle it for the bytes.
WEIGHT, LAST_WEIGHT = np.array([8.0, 2.0, 1.0]), np.array([1000.0, 2.0, 1.0])


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unit (rows: bytes, tokens, rows), by the highest dot product with the residual capacity."""
    x = vectors / (np.maximum(vectors.sum(0), 1) / shards)
    left = np.ones((shards, x.shape[1]))
    to = np.zeros(len(x), np.int64)
    done = 0.0
    for i in np.argsort(-x[:, 0], kind="stable"):
        to[i] = int(np.argmax(left @ (x[i] * (WEIGHT if done < shards / 2 else LAST_WEIGHT))))
        left[to[i]] -= x[i]
        done += x[i, 0]
    return to


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, tokens, text_crc32, shard, slot) for each row of docs (doc_id, text).

    size is the text's UTF-8 bytes plus 1 and is what is balanced most closely ("bytes"); slot is
    the row's place in its shard, gapless from 0. A null text counts as the empty one (size 1); a
    null doc_id stays null; repeated rows are rows like any other; an empty table gives an empty
    result. Other columns of docs are not looked at.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = cut(
        docs.select(
            F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        )
    )
    total = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    heavy_from, piece = max(1, total[0] // LOTS), max(1, total[0] // shards)
    # at most LOTS groups have heavy_from bytes
    groups = base.groupBy("h").agg(F.sum("size").alias("b")).where(F.col("b") >= heavy_from).select("h", F.ceil(F.col("b") / piece).cast("int").alias("pieces"))
    heavy = base.sparkSession.createDataFrame(groups.collect(), "h long, pieces int")
    unit = base.join(F.broadcast(heavy), "h", "left").select(
        *base.columns,
        F.when(F.col("pieces").isNull(), F.pmod("h", F.lit(LOTS))).otherwise(F.col("h")).alias("unit"),
        F.coalesce(F.pmod(F.xxhash64("id", F.lit(7)), F.col("pieces")).cast("int"), F.lit(-1)).alias("part"),
    )
    sums = unit.groupBy("unit", "part").agg(F.sum("size"), F.sum("tokens"), F.count("*")).orderBy("unit", "part").collect()
    vectors = np.array([[r[2], r[3], r[4]] for r in sums], dtype=float).reshape(-1, 3)
    to = place(vectors, shards)
    plan = base.sparkSession.createDataFrame([(r[0], r[1], int(s)) for r, s in zip(sums, to, strict=True)], "unit long, part int, shard int")
    placed = unit.join(F.broadcast(plan), ["unit", "part"])
    ranked = gapless_rank(placed.select("id", "size", "tokens", "text_crc32", "shard"), ["shard"], ["id", "text_crc32", "size"], "slot", math.ceil(total[1] / shards))
    return ranked.select(real_id("id").alias("doc_id"), "size", "tokens", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
