"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at 3 or fewer differing bits meet in a variant that lies at most 2 flips from
one and 1 flip from the other. Which of the two flips twice is settled by parity: fingerprints
at an odd distance differ in the parity of their bit count, so only the even ones emit two-flip
variants; those at distance 2 meet through one flip each. Of three differing bits two fall into
the same half of the word, so two-flip variants are emitted within a half only (the least number
that meets every triple). Each fingerprint thus emits 65 or 1,057 variants, not 2,081.

Variants travel packed, a fingerprint once and two bytes for each set of flips, to the bucket of their leading bits' hash. There, all that meet in
a variant in which one of them flips at most once are within the radius of that one, so a star
around it holds their component; a bucket gives a spanning forest of verified links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, doc_columns, id_key, in_order, numbered, real_id

RADIUS = 3
#: Fingerprints whose variants are made at once, variants of a bucket (about).
FLUSH, PER_BUCKET = 4096, 2_000_000
MEAN_VARIANTS = 561
SPREAD = 0x9E3779B97F4A7C15
#: A bucket is a hash of a variant's leading bits, of which there are at least KEY_BITS, so that variants of other bits travel as one
#: fingerprint and many flips; the more buckets, the more bits, SPARE beyond those that tell the buckets apart.
KEY_BITS, SPARE = 20, 6
#: A fingerprint shared by this part of all rows is joined by a broadcast; there are at most as many such.
HOT = 1000


def flip_masks() -> tuple[np.ndarray, int]:
    """Masks of the flips, those of at most one bit first, and how many these are."""
    one = [0] + [1 << i for i in range(64)]
    two = [(1 << i) | (1 << j) for h in (0, 32) for i in range(h, h + 32) for j in range(i + 1, h + 32)]
    return np.array(one + two, dtype=np.uint64), len(one)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The 64-bit SimHash of whole lower-cased text."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        v = [h(b" ".join(words), 42)]
    else:
        v = [h(b" ".join(g), 42) for g in zip(*(words[i:] for i in range(shingle)), strict=False)]
    return majority(np.array(v, dtype="<u8"))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes h."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        part = np.ascontiguousarray(h[i : i + 65_536], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(id, fp long) of each row of docs (doc_id, text); null text counts as empty, which gives 0."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.encode(), shingle) for t in b.column("text").to_pylist()]
            fp = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("id"), fp], ["id", "fp"])

    return doc_columns(docs).mapInArrow(run, "id long, fp long")


def ball_links(fps: DataFrame, n: int) -> DataFrame:
    """(a, b): links within the radius between fingerprints (fp long, distinct, about n of them);
    they join the same fingerprints as all links do. Each emits its variants once; the number of
    buckets grows with n, so that no bucket outgrows a task."""
    buckets = max(16, -(-n * MEAN_VARIANTS // PER_BUCKET))
    key_bits = min(62, max(KEY_BITS, buckets.bit_length() + SPARE))

    def emit(batches):
        masks, near = flip_masks()
        for b in batches:
            all_fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(all_fps), FLUSH):
                x = all_fps[i : i + FLUSH]
                even = x[np.bitwise_count(x) % 2 == 0]
                own = np.concatenate([np.repeat(x, near), np.repeat(even, len(masks) - near)])
                code = np.concatenate([np.tile(np.arange(near, dtype=np.uint16), len(x)), np.tile(np.arange(near, len(masks), dtype=np.uint16), len(even))])
                to = (((own ^ masks[code]) >> np.uint64(64 - key_bits)) * np.uint64(SPREAD) >> np.uint64(24)) % np.uint64(buckets)
                order = np.argsort(to, kind="stable")
                own, code, to = own[order], code[order], to[order]
                edges = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True]) if len(to) else [0]
                data = []
                for s, e in zip(edges[:-1], edges[1:], strict=True):
                    f = own[s:e]
                    cuts = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
                    counts = np.diff(np.r_[cuts, len(f)]).astype(np.uint16)
                    data.append(len(cuts).to_bytes(8, "little") + f[cuts].tobytes() + counts.tobytes() + code[s:e].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(to[edges[:-1]].astype(np.int64)), pa.array(data, pa.binary())], ["bucket", "packed"])

    def meet(t: pa.Table) -> pa.Table:
        masks, near = flip_masks()
        owns, codes = [], []
        for p in t.column("packed"):
            p = p.as_buffer()
            k = int.from_bytes(p[:8], "little")
            owns.append(np.repeat(np.frombuffer(p, np.uint64, k, 8), np.frombuffer(p, np.uint16, k, 8 + 8 * k)))
            codes.append(np.frombuffer(p, np.uint16, -1, 8 + 10 * k))
        code = np.concatenate(codes)
        v = np.concatenate(owns) ^ masks[code]
        del owns, codes
        order = np.argsort(v)
        s = v[order]
        same = s[1:] == s[:-1]
        some = order[np.r_[same, False] | np.r_[False, same]]
        some = some[np.lexsort((code[some], v[some]))]  # in each variant, one-flip rows come first
        v, code = v[some], code[some].astype(np.int64)
        fp = v ^ masks[code]
        lead = np.maximum.accumulate(np.where(np.r_[True, v[1:] != v[:-1]], np.arange(len(v)), 0)) if len(v) else np.zeros(0, int)
        a, b = fp[lead], fp
        good = (code[lead] < near) & (a != b) & (np.bitwise_count(a ^ b) <= RADIUS)
        return forest(a[good], b[good])

    def forest(a, b):
        nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        u, w = ends[: len(a)], ends[len(a) :]
        root = np.arange(len(nodes))
        keep = np.zeros(len(a), bool)

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        pairs = np.unique(np.stack([u, w]), axis=1, return_index=True)[1] if len(a) else []
        for i in pairs:
            x, y = find(u[i]), find(w[i])
            if x != y:
                root[max(x, y)] = min(x, y)
                keep[i] = True
        return pa.table({"a": a[keep].view(np.int64), "b": b[keep].view(np.int64)})

    packed = fps.mapInArrow(emit, "bucket long, packed binary")
    return packed.groupBy("bucket").applyInArrow(meet, "a long, b long").distinct()


def near_components(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, copies) for each row of docs.

    Rows of equal fingerprints are one node; component_id is the smallest doc_id of the component,
    copies how many rows share the fingerprint. Null and empty texts have fingerprint zero and link like any
    other; a null doc_id comes back null and sorts before all others; repeated rows each come
    back; an empty table gives an empty result; other columns of docs are not looked at.
    """
    own = cut(fingerprints(docs, shingle))
    fps = cut(own.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    labels = cut(components(ball_links(fps.select("fp"), fps.count())))
    least = labels.join(fps, labels.node == fps.fp).groupBy("root").agg(F.min("rep").alias("least"))
    named = labels.join(least, "root").select(F.col("node").alias("fp"), "least")
    by_fp = cut(fps.join(named, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component"), "copies"))
    hot = max(1, fps.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0] // HOT)
    few = F.broadcast(by_fp.where(F.col("copies") > hot))  # fewer than HOT rows
    both = own.join(few, "fp").union(own.join(few.select("fp"), "fp", "left_anti").join(by_fp, "fp").select("fp", "id", "component", "copies"))
    return both.select(
        real_id("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        real_id("component").alias("component_id"),
        "copies",
    )


def keep_one_of_each(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs without near duplicates: of each component the row of the smallest doc_id stays, all columns
    unchanged, whatever they are called. Of rows that share this doc_id, one stays: the one of the smallest text."""
    comp = near_components(docs.select("doc_id", "text"), shingle)
    first = comp.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(id_key("doc_id").alias("_key")).distinct()
    d, at = numbered(docs)
    kept = d.select(id_key(at["doc_id"]).alias("_key"), F.struct(*d.columns).alias("w"), F.struct(F.col(at["text"]).alias("t"), in_order(d)).alias("by")).join(first, "_key", "left_semi")
    one = kept.groupBy("_key").agg(F.min_by("w", "by").alias("w"))  # keeps the join's partitioning
    return one.select(*[F.col(f"w.{c}").alias(c) for c in d.columns]).toDF(*docs.columns)
