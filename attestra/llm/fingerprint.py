"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the sorted k smallest distinct hashes of a text's word shingles. Sketches of parts
merge into the sketch of the whole; two sketches estimate resemblance and containment, one
estimates the number of distinct shingles. A sketch of fewer than k hashes is complete, and its
estimates are exact.
"""

from __future__ import annotations

import base64
import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, doc_columns, real_id

K, SHINGLE = 256, 5
#: Documents of a run of neighbours (about); rows sampled of each run to find where runs open; runs are longer beyond RUNS of them, since a task streams its run.
RUN, SAMPLED, RUNS = 4000, 16, 100_000


def hashes(words: list[bytes], shingle: int = SHINGLE) -> list[int]:
    """The hash of each shingle in order; fewer words than a shingle has are one; no words, none."""
    import xxhash

    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [h(b" ".join(words))] if words else []
    return [h(b" ".join(g)) for g in zip(*(words[i:] for i in range(shingle)), strict=False)]


def bottom(values, k: int = K) -> np.ndarray:
    """The sketch of hashes: distinct, the k smallest in order."""
    return np.unique(np.array(values, dtype=np.uint64))[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated Jaccard index of the shingle sets; 1 if both are empty."""
    least = merge(a, b, k)
    if not len(least):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float((both <= least[-1]).sum() / len(least))


def distinct(a: np.ndarray, k: int = K) -> float:
    """The estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / (float(a[-1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated part of a's shingles that b has too; 1 if a is empty."""
    if not len(a):
        return 1.0
    union = distinct(merge(a, b, k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct(a, k))


def to_text(a: np.ndarray) -> str:
    """The sketch as text: base64 of big-endian hashes in order."""
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), ">u8").astype(np.uint64)


def tokens(text: str) -> list[bytes]:
    return text.encode().lower().split()


def sketches(docs: DataFrame, *keys: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """(*keys, fingerprint) of each row's text; null counts as empty, whose fingerprint is empty."""
    schema = docs.select(*keys).schema.add("fingerprint", "string")

    def run(batches):
        for b in batches:
            fp = [to_text(bottom(hashes(tokens(t or ""), shingle), k)) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), pa.array(fp, pa.string())], [*keys, "fingerprint"])

    return docs.select(*keys, F.col("text").alias("_text")).mapInArrow(run, schema)


def merged(fps: DataFrame, *keys: str, k: int = K) -> DataFrame:
    """(*keys, fingerprint) of the union of each key's texts, from (*keys, fingerprint). Each
    task merges what it has of a key before the shuffle, so a key with most rows is no burden."""
    schema = fps.select(*keys, "fingerprint").schema

    def rows(found: dict) -> pa.Table:
        data = [(*key, to_text(a)) for key, a in found.items()]
        return pa.table({c: [r[i] for r in data] for i, c in enumerate([*keys, "fingerprint"])}) if data else None

    def part(batches):
        names = [*keys, "fingerprint"]
        found: dict = {}
        first = None
        for b in batches:
            first = b
            for *key, fp in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                key = tuple(key)
                found[key] = merge(found.get(key, np.zeros(0, np.uint64)), from_text(fp), k)
            if len(found) > 10_000:
                yield from rows(found).cast(b.schema).to_batches()
                found = {}
        if found:
            yield from rows(found).cast(first.schema).to_batches()

    def whole(t: pa.Table) -> pa.Table:
        a = np.zeros(0, np.uint64)
        for fp in t.column("fingerprint").to_pylist():
            a = merge(a, from_text(fp), k)
        return t.slice(0, 1).set_column(t.schema.get_field_index("fingerprint"), "fingerprint", pa.array([to_text(a)], pa.string()))

    return fps.select(*keys, "fingerprint").mapInArrow(part, schema).groupBy(*keys).applyInArrow(whole, schema)


def text_hash(data: bytes) -> int:
    """What orders rows of equal ids."""
    import xxhash

    return xxhash.xxh64_intdigest(data) >> 1


def run_bounds(d: DataFrame, runs: int) -> tuple[tuple[int, int] | None, list[tuple[int, int]]]:
    """The first row's place (id, hash), and the places of real rows that open the runs after the
    first: evenly spread ones of a sample by hash, about SAMPLED a run, without equal ones."""
    span = 1_000_000
    part = min(span, -(-runs * SAMPLED * span // max(1, d.count())))

    def places(batches):
        for b in batches:
            h = [text_hash(t.encode()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(h, pa.int64())], ["id", "h"])

    low = d.agg(F.min("id")).first()[0]
    if low is None:
        return None, []
    first = d.where(F.col("id") == F.lit(low)).mapInArrow(places, "id long, h long").agg(F.min("h")).first()[0]
    if runs < 2:
        return (low, first), []
    some = sorted(map(tuple, d.where(F.pmod(F.xxhash64("id", "text"), F.lit(span)) < part).mapInArrow(places, "id long, h long").collect()))
    return (low, first), sorted({some[len(some) * i // runs] for i in range(1, runs)} - {(low, first)}) if some else []


def with_neighbours(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of
    each row of docs (doc_id, text), rows in order of doc_id, the first following the last.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many of
    the next row's text. Rows are dealt over runs, each a partition of its own, and a run also gets the row
    that opens the next one; within a run, a task streams sorted rows and holds two at a time. Texts travel
    once, compressed. A null text counts as empty; a null doc_id sorts first and stays null; rows
    of equal doc_id follow each other by a hash of the text; a single row is its own next; an
    empty table gives an empty result; other columns of docs are not looked at.
    """
    d = doc_columns(docs)
    low, bounds = run_bounds(d, max(1, min(RUNS, -(-docs.count() // RUN))))

    def deal(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            rows = []
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                data = t.encode()
                h, z = text_hash(data), press.compress(data)
                at = bisect.bisect_right(bounds, (i, h))
                rows.append((at, 0, i, h, z))
                if at and bounds[at - 1] == (i, h):
                    rows.append((at - 1, 1, i, h, z))
                if (i, h) == low:
                    rows.append((len(bounds), 1, i, h, z))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)] if rows else [pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())], ["run", "tail", "id", "h", "z"])

    def result(i, text, words, hs, fp, nxt, nxt_fp):
        n = len(text)
        cut_at = n - n // 4
        edited = text[:cut_at] + nxt[: n // 4]
        new = tokens(edited)
        same = max(0, len(tokens(text[:cut_at])) - 1)  # the last of these words may have grown
        keep = same - shingle + 1
        if keep > 0 and len(words) > shingle and len(new) > shingle:
            fp_e = bottom(hs[:keep] + hashes(new[keep:], shingle), k) if len(new) - keep >= shingle else bottom(hashes(new, shingle), k)
        else:
            fp_e = bottom(hashes(new, shingle), k)
        return i, n, hashlib.sha256(edited.encode()).hexdigest(), to_text(fp), to_text(fp_e), resemblance(fp, fp_e, k), resemblance(fp, nxt_fp, k)

    def walk(batches):
        import zstandard

        open_up = zstandard.ZstdDecompressor()
        last = None
        for b in batches:
            out = []
            for run, tail, i, z in zip(*(b.column(c).to_pylist() for c in ("run", "tail", "id", "z")), strict=True):
                if tail and last is None:
                    continue
                text = open_up.decompress(z).decode() if z else ""
                words = tokens(text)
                hs = hashes(words, shingle)
                fp = bottom(hs, k)
                if last is not None:
                    out.append(result(*last, text, fp))
                last = None if tail else (i, text, words, hs, fp)
            names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names)

    dealt = d.mapInArrow(deal, "run int, tail int, id long, h long, z binary")
    walked = dealt.repartitionById(len(bounds) + 1, F.col("run")).sortWithinPartitions("tail", "id", "h")
    out = walked.mapInArrow(walk, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.select(real_id("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
