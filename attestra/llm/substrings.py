"""Exact substring dedup by super-k-mers.

A window is 20 consecutive words. Consecutive windows that share a minimiser (the least hash of
the runs of M words in them) travel together, as one packed string, to the minimiser's bucket;
equal windows have equal minimisers, so they meet there, and sorting them by a hash, compared
word by word, tells exactly which of them start later than an equal one.

A map task settles first what it sees itself: windows that occur earlier in the same flush of
documents are found there, and only the others travel. However often a passage repeats, a flush
sends each of its windows once. Minimisers that a bounded sample of the documents shows to be common
are chosen only where a window has no other, and windows of common ones alone go to a bucket by
their own hash, so no bucket grows with a common phrase. The sample steers where windows go, not what is found.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, doc_columns, real_id

WINDOW, M = 20, 3
#: Words of a flush; bytes of a bucket (about); bytes that travel for a byte of text (about).
FLUSH, PER_BUCKET, SPREAD = 1_200_000, 9_000_000, 3.1
#: Bytes of text of the sample (about); a minimiser of more than one in COMMON super-k-mers of the sample is common.
SAMPLE, COMMON = 32 << 20, 2000
LAST = np.uint64(1 << 63)
ODD = 0x9E3779B97F4A7C15


def rolled(h: np.ndarray, w: int) -> np.ndarray:
    """A polynomial hash of each w consecutive entries, from pieces of doubling length."""
    power = lambda n: np.uint64(pow(ODD, n, 1 << 64))
    if len(h) < w:
        return h[:0]
    out, done, piece, size = None, 0, h, 1
    while True:
        if w & size:
            n = len(h) - done - size + 1
            out = piece.copy() if out is None else out[:n] + power(done) * piece[done : done + n]
            done += size
        if 2 * size > w:
            return out
        piece = piece[: len(piece) - size] + power(size) * piece[size:]
        size *= 2


def least(h: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive entries."""
    if len(h) < w:
        return h[:0]
    size = 1
    while 2 * size <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (w - size)], h[w - size :])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes, hashes) of words: a number for each distinct word, and each word's 64-bit hash."""
    import xxhash

    d = words.dictionary_encode()
    codes = d.indices.to_numpy(zero_copy_only=False)
    kinds = np.array([xxhash.xxh64_intdigest(x) for x in d.dictionary.cast(pa.binary()).to_pylist()], dtype=np.uint64)
    return codes, kinds[codes] if len(kinds) else np.zeros(0, np.uint64)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, number of words of each)."""
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    counts = np.diff(np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[parts.offsets.to_numpy() - parts.offsets[0].as_py()])
    return flat.filter(real), counts


def repeats(codes: np.ndarray, key: np.ndarray, at: np.ndarray, order: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of windows (key: their hashes, at: their first word): j equals i word by word,
    and i is the first in order of its equals. Windows whose hashes collide are told apart."""
    by = np.argsort(key)
    s = key[by]
    same = s[1:] == s[:-1]
    some = by[np.r_[same, False] | np.r_[False, same]] if len(by) else by
    some = some[np.lexsort((order[some], key[some]))]
    out = []
    while len(some):
        k = key[some]
        first = some[np.maximum.accumulate(np.where(np.r_[True, k[1:] != k[:-1]], np.arange(len(k)), 0))]
        rest = first != some
        i, j = first[rest], some[rest]
        equal = np.ones(len(i), bool)
        for n in range(w):
            equal &= codes[at[i] + n] == codes[at[j] + n]
        out.append((i[equal], j[equal]))
        some = j[~equal]
    return (np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])) if out else (by[:0], by[:0])


def minimisers(h: np.ndarray, at: np.ndarray, key: np.ndarray, window: int, common: np.ndarray) -> np.ndarray:
    """What the windows at `at` (key: their hashes) go by: the least hash of their runs of M words, common ones
    after all others; a window that has only common ones goes by its own hash."""
    runs = mixed(rolled(h, M)) >> np.uint64(1)
    if len(common):
        runs[common[np.minimum(np.searchsorted(common, runs), len(common) - 1)] == runs] |= LAST
    low = least(runs, window - M + 1)[at]
    return np.where(low >= LAST, key | LAST, low)


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + n[0] - 1, start[1] .. and so on."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n, n) + np.repeat(start, n)


def spaced(words: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The words joined by spaces, and where each begins, with the end of all and one more."""
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset)
    sized = offsets - offsets[0] + np.arange(len(words) + 1)
    out = np.full(int(sized[-1]), 32, np.uint8)
    letter = np.ones(len(out), bool)
    letter[sized[1:] - 1] = False
    out[letter] = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return memoryview(out), sized


def unspaced(data: bytes) -> pa.Array:
    """The words of data, in which single spaces part them."""
    raw = np.frombuffer(data, np.uint8)
    space = raw == 32
    ends = np.concatenate([np.flatnonzero(space), [len(raw)]])
    offsets = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw[~space])])


def common_minimisers(docs: DataFrame, size: int, window: int) -> np.ndarray:
    """The common minimisers, fewer than COMMON, of a sample of docs (id, text, tie) by hash, SAMPLE bytes of all size."""
    span = 1_000_000
    part = min(span, -(-SAMPLE * span // max(1, size)))

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                words, counts = split_words(b.column("text").slice(k, 1000))
                if len(words) < window:
                    continue
                _, h = word_codes(words)
                doc = np.repeat(np.arange(len(counts)), counts)
                at = np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1 :])
                low = minimisers(h, at, rolled(h, window)[at], window, np.zeros(0, np.uint64))
                low, n = np.unique(low[np.r_[True, low[1:] != low[:-1]]] if len(low) else low, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), pa.array(n)], ["low", "n"])

    sample = docs.where(F.pmod(F.xxhash64("id", "tie"), F.lit(span)) < part).select("text")
    counts = cut(sample.mapInArrow(run, "low long, n long").groupBy("low").agg(F.sum("n").alias("n")).where("n > 1"))
    limit = (counts.agg(F.sum("n")).first()[0] or 0) / COMMON
    return np.array(sorted(r[0] for r in counts.where(F.col("n") > max(8, limit)).collect()), dtype=np.uint64)


def travel(docs: DataFrame, buckets: int, window: int, common: np.ndarray) -> DataFrame:
    """(bucket, settled, packed): super-k-mers by bucket; with settled, windows known to repeat."""

    def flush(ids, ties, texts):
        import zstandard

        press = zstandard.ZstdCompressor(level=6)
        text = pa.chunked_array(texts).combine_chunks() if len(texts) > 1 else texts[0]
        by = np.lexsort((ties, ids))
        by = by[np.r_[True, (np.diff(ids[by]) != 0) | (np.diff(ties[by]) != 0)]]  # repeated rows once
        ids, ties, text = ids[by], ties[by], text.take(pa.array(by))
        words, counts = split_words(text)
        codes, h = word_codes(words)
        doc = np.repeat(np.arange(len(ids)), counts)
        first = np.repeat(np.cumsum(counts) - counts, counts)
        n = len(codes)
        if n < window:
            return
        at = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
        key = rolled(h, window)[at]
        low = minimisers(h, at, key, window, common)
        _, again = repeats(codes, key, at, at, window)
        known = np.zeros(len(at), bool)
        known[again] = True
        rows = []
        if len(again):
            p = at[known]
            cuts = np.flatnonzero(np.r_[True, np.diff(p) != 1] | np.r_[True, doc[p[1:]] != doc[p[:-1]]])
            runs = np.diff(np.r_[cuts, len(p)])
            d = doc[p[cuts]]
            to = (mixed(ids[d].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            for b in np.unique(to):
                m = to == b
                rows.append((int(b), True, press.compress(b"".join(x.tobytes() for x in (ids[d[m]], ties[d[m]], (p[cuts] - first[p[cuts]])[m].astype(np.int32), runs[m].astype(np.int32)))), int(m.sum())))
        p, low = at[~known], low[~known]
        if len(p):
            new = np.r_[True, (np.diff(p) != 1) | (low[1:] != low[:-1]) | (doc[p[1:]] != doc[p[:-1]])]
            cuts = np.flatnonzero(new)
            runs = np.diff(np.r_[cuts, len(p)])
            s = p[cuts]
            to = (mixed(low[cuts] * np.uint64(ODD)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            s, runs, to = s[order], runs[order], to[order]
            data, starts = spaced(words)
            begin, end = starts[s].tolist(), (starts[s + runs + window - 1] - 1).tolist()
            edges = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True])
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                ss, rr = s[a:z], runs[a:z]
                head = (ids[doc[ss]], ties[doc[ss]], (ss - first[ss]).astype(np.int32), rr.astype(np.int32))
                rows.append((int(to[a]), False, press.compress(b"".join(x.tobytes() for x in head) + b" ".join(data[x:y] for x, y in zip(begin[a:z], end[a:z], strict=True))), int(z - a)))
        for k in range(0, len(rows), 1000):
            part = rows[k : k + 1000]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.int64(), pa.bool_(), pa.binary(), pa.int32()), strict=True)], ["bucket", "settled", "packed", "n"])

    def run(batches):
        ids, ties, texts, size = [], [], [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                b = batch.slice(k, 1000)
                ids.append(b.column("id").to_numpy())
                ties.append(b.column("tie").to_numpy())
                texts.append(b.column("text"))
                size += b.column("text").nbytes // 6
                if size >= FLUSH:
                    yield from flush(np.concatenate(ids), np.concatenate(ties), texts)
                    ids, ties, texts, size = [], [], [], 0
        if ids:
            yield from flush(np.concatenate(ids), np.concatenate(ties), texts)

    return docs.mapInArrow(run, "bucket long, settled boolean, packed binary, n int")


def resolve(packed: DataFrame, window: int) -> DataFrame:
    """(id, tie, start, n): runs of windows that an equal one precedes."""

    def settle(t: pa.Table) -> pa.Table:
        import zstandard

        open_up = zstandard.ZstdDecompressor()
        done, heads, data = [], [], []
        for settled, z, n in zip(*(t.column(c).to_pylist() for c in ("settled", "packed", "n")), strict=True):
            raw = open_up.decompress(z)
            head = [np.frombuffer(raw, d, n, o * n) for d, o in ((np.int64, 0), (np.int64, 8), (np.int32, 16), (np.int32, 20))]
            if settled:
                done.append(head)
                continue
            heads.append(head)
            data.append(memoryview(raw)[24 * n :])
        del t
        if heads:
            ids, ties, start, runs = (np.concatenate(c) for c in zip(*heads, strict=True))
            codes, h = word_codes(unspaced(b" ".join(data)))
            del data
            words = runs + window - 1
            first = np.cumsum(words) - words
            run = np.repeat(np.arange(len(runs)), runs)
            at = ranges(first, runs)
            pos = ranges(start, runs)
            rank = np.empty(len(runs), np.int64)
            rank[np.lexsort((start, ties, ids))] = np.arange(len(runs))
            order = rank[run] * (int(runs.max()) + 1) + at - first[run]
            i, j = repeats(codes, rolled(h, window)[at], at, order, window)
            twice = (ids[run[i]] == ids[run[j]]) & (ties[run[i]] == ties[run[j]]) & (pos[i] == pos[j])  # the same row again
            hit = np.sort(j[~twice])
            if len(hit):
                cuts = np.flatnonzero(np.r_[True, (np.diff(hit) != 1) | (run[hit[1:]] != run[hit[:-1]])])
                r = run[hit[cuts]]
                done.append([ids[r], ties[r], pos[hit[cuts]].astype(np.int32), np.diff(np.r_[cuts, len(hit)]).astype(np.int32)])
        cols = [np.concatenate(c) for c in zip(*done, strict=True)] if done else [np.zeros(0, d) for d in (np.int64, np.int64, np.int32, np.int32)]
        return pa.table(dict(zip(("id", "tie", "start", "n"), cols, strict=True)))

    return packed.groupBy("bucket").applyInArrow(settle, "id long, tie long, start int, n int")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of docs (doc_id, text): kept is the text's
    words without those that a window covers whose words also start earlier, joined by a space.

    Earlier is: in a document of smaller doc_id, or further to the front of the same. A null doc_id
    is the smallest and stays null. Rows of equal doc_id and equal text count as one document, and
    each comes back alike; of rows of equal doc_id and different texts one (by a hash) is the earlier.
    Null and empty texts have no words; an empty table gives an empty result; other columns of docs are not looked at.
    """
    d = doc_columns(docs).withColumn("tie", F.xxhash64("text"))
    size = d.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = int(max(16, -(-size * SPREAD // PER_BUCKET)))
    found = resolve(travel(d, buckets, window, common_minimisers(d, size, window)), window)
    spans = found.groupBy("id", "tie").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"))

    def small(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            z = pa.array([press.compress(t.encode()) for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("tie"), z], ["id", "tie", "z"])

    def apply(batches):
        import zstandard

        open_up = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for z, starts, ns in zip(*(b.column(c).to_pylist() for c in ("z", "starts", "ns")), strict=True):
                words = open_up.decompress(z).split() if z else []
                n = len(words)
                if starts:
                    gone = np.zeros(n + 1, np.int64)
                    s, e = np.array(starts), np.array(starts) + np.array(ns) + window - 1
                    np.add.at(gone, s, 1)
                    np.add.at(gone, e, -1)
                    left = np.flatnonzero(np.cumsum(gone)[:n] == 0)
                    words = [words[i] for i in left]
                rows.append((n, n - len(words), b" ".join(words).decode()))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True))], ["id", "n_words", "n_removed", "kept"])

    texts = d.select("id", "tie", "text").mapInArrow(small, "id long, tie long, z binary")
    out = texts.join(spans, ["id", "tie"], "left").select("id", "z", "starts", "ns").mapInArrow(apply, "id long, n_words long, n_removed long, kept string")
    return out.select(real_id("id").alias("doc_id"), "n_words", "n_removed", "kept")
