"""Content hashes, their detection and verification. Contents in parts, larger than a cell, are in operators.content.

MD5, SHA-1 and SHA-2 are built into Spark. BLAKE3 and XXH64 with seed 0 are not; they are Arrow
functions here, BLAKE3 by vectors over the 1 KiB chunks of a whole batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Fixed values of the BLAKE3 specification: initial words, message order, flags.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK = 1024, 64
MIX = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _compress(cv: np.ndarray, m: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The compression of n blocks at once: cv (8, n), m (16, n) -> the first eight output words (8, n)."""
    n = cv.shape[1]
    s = [*cv, *(np.full(n, v, np.uint32) for v in IV[:4]), (counter & 0xFFFFFFFF).astype(np.uint32), (counter >> 32).astype(np.uint32), length.astype(np.uint32), flags.astype(np.uint32)]
    w = list(m)
    for r in range(7):
        for i, (a, b, c, d) in enumerate(MIX):
            s[a] = s[a] + s[b] + w[2 * i]
            s[d] = _turn(s[d] ^ s[a], 16)
            s[c] = s[c] + s[d]
            s[b] = _turn(s[b] ^ s[c], 12)
            s[a] = s[a] + s[b] + w[2 * i + 1]
            s[d] = _turn(s[d] ^ s[a], 8)
            s[c] = s[c] + s[d]
            s[b] = _turn(s[b] ^ s[c], 7)
        if r < 6:
            w = [w[k] for k in ORDER]
    return np.stack([s[i] ^ s[i + 8] for i in range(8)])


def _merged(cv: np.ndarray, count: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The chaining values (8, n) of trees over nodes cv (8, all), count of them in each: neighbours in pairs, an odd one
    out goes up as it is; the last pair of a tree that is a root is its digest."""
    owner = np.repeat(np.arange(len(count)), count)
    left = count.copy()
    while len(left) and left.max() > 1:
        place = np.arange(len(owner)) - np.repeat(np.cumsum(left) - left, left)
        first = np.flatnonzero((place % 2 == 0) & (place + 1 < left[owner]))
        m = np.concatenate([cv[:, first], cv[:, first + 1]])
        start = np.repeat(np.array(IV, np.uint32)[:, None], len(first), 1)
        flags = PARENT + np.where((left[owner[first]] == 2) & root[owner[first]], ROOT, 0)
        cv[:, first] = _compress(start, m, np.zeros(len(first), np.int64), np.full(len(first), BLOCK), flags)
        keep = place % 2 == 0
        cv, owner = cv[:, keep], owner[keep]
        left = -(-left // 2)
    return cv


def _bytes_of(cv: np.ndarray) -> list[bytes]:
    out = np.ascontiguousarray(cv.T).astype("<u4").view(np.uint8).reshape(cv.shape[1], 32)
    return [row.tobytes() for row in out]


def blake3_nodes(items: list[bytes], first_chunk: np.ndarray | None = None, root: np.ndarray | None = None) -> list[bytes]:
    """The 32 bytes of the tree over each item; all chunks of all items go through each step together.

    first_chunk: how many chunks of its content come before an item (0); root: whether an item is a whole content
    (it is), for which the bytes are the digest, else the chaining value of a part."""
    if not items:
        return []
    sizes = np.array([len(x) for x in items])
    first_chunk = np.zeros(len(items), np.int64) if first_chunk is None else first_chunk
    root = np.ones(len(items), bool) if root is None else root
    chunks = np.maximum(1, -(-sizes // CHUNK))
    owner = np.repeat(np.arange(len(items)), chunks)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    length = np.minimum(CHUNK, sizes[owner] - index * CHUNK)
    buf = np.zeros((len(owner), CHUNK), np.uint8)
    at = 0
    for x, k in zip(items, chunks, strict=True):
        buf[at : at + k].reshape(-1)[: len(x)] = np.frombuffer(x, np.uint8)
        at += k
    words = buf.view("<u4").reshape(len(owner), 16, 16)
    blocks = np.maximum(1, -(-length // BLOCK))
    cv = np.repeat(np.array(IV, np.uint32)[:, None], len(owner), 1)
    alone = (chunks[owner] == 1) & root[owner]
    for b in range(int(blocks.max())):
        on = np.flatnonzero(blocks > b)
        last = blocks[on] == b + 1
        flags = (CHUNK_START if b == 0 else 0) + np.where(last, CHUNK_END + np.where(alone[on], ROOT, 0), 0)
        cv[:, on] = _compress(cv[:, on], words[on, b].T, first_chunk[owner[on]] + index[on], np.where(last, length[on] - b * BLOCK, BLOCK), flags)
    return _bytes_of(_merged(cv, chunks, root))


def blake3_joined(nodes: list[list[bytes]], root: np.ndarray) -> list[bytes]:
    """The 32 bytes of the tree over each list of chaining values, each of a part of equal size but the last."""
    if not nodes:
        return []
    flat = np.frombuffer(b"".join(x for n in nodes for x in n), "<u4").reshape(-1, 8).T.astype(np.uint32)
    return _bytes_of(_merged(flat.copy(), np.array([len(n) for n in nodes]), root))


try:  # the native binding, where it is installed
    from blake3 import blake3 as _native
except ImportError:
    _native = None
#: Which implementation digests whole contents: the binding or the vectors of this module.
BLAKE3_BY = "vectors" if _native is None else "binding"


def blake3_digests(items: list[bytes]) -> list[str]:
    """The 256-bit BLAKE3 digest of each item, in hex."""
    if _native is not None:
        return [_native(x).hexdigest() for x in items]
    return [x.hex() for x in blake3_nodes(items)]


def _as_bytes(x) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


def _batched(values: pd.Series, digest) -> pd.Series:
    """digest over the non-null values, some 4 MB at a time."""
    out: list = [None] * len(values)
    group, ids, size = [], [], 0
    for i, v in enumerate(values):
        if v is None:
            continue
        b = _as_bytes(v)
        group.append(b)
        ids.append(i)
        size += len(b)
        if size > 4_000_000:
            for j, h in zip(ids, digest(group), strict=True):
                out[j] = h
            group, ids, size = [], [], 0
    for j, h in zip(ids, digest(group), strict=True):
        out[j] = h
    return pd.Series(out, dtype=object)


@pandas_udf(StringType())
def blake3_full(content: pd.Series) -> pd.Series:
    """The 64-digit BLAKE3 digest of a string's UTF-8 or of binary content."""
    return _batched(content, blake3_digests)


def blake3(content: Column) -> Column:
    """The short form: the first 16 hex digits."""
    return F.substring(blake3_full(content), 1, 16)


@pandas_udf(StringType())
def xxh64(content: pd.Series) -> pd.Series:
    """XXH64 with seed 0, 16 hex digits."""
    import xxhash

    return _batched(content, lambda xs: [xxhash.xxh64_hexdigest(x) for x in xs])


ALGORITHMS = ("blake3", "blake3-full", "sha256", "sha512", "md5", "xxhash64")


def hash_of(content: Column, algorithm: str = "blake3") -> Column:
    """The hash of content by name; an unknown name raises."""
    built = {"sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512), "md5": F.md5, "blake3": blake3, "blake3-full": blake3_full, "xxhash64": xxh64}
    if algorithm not in built:
        raise ValueError(f"unknown algorithm {algorithm!r}; known: {', '.join(ALGORITHMS)}")
    return built[algorithm](content)


def all_hashes(df: DataFrame, content: str) -> DataFrame:
    """df with a column for each algorithm; the content is read once."""
    return df.select("*", *[hash_of(F.col(content), a).alias(a.replace("-", "_")) for a in ALGORITHMS])


def detect_algorithm(h: Column) -> Column:
    """The algorithm of a lower-case hex digest by its length; null if it is none."""
    by = F.when(F.length(h) == 16, "blake3").when(F.length(h) == 32, "md5").when(F.length(h) == 64, "sha256").when(F.length(h) == 128, "sha512")
    return F.when(h.rlike("^[0-9a-f]+$"), by)


def verify(actual: Column, expected: Column) -> Column:
    """Whether two digests agree, whatever their case; null for a digest of unknown length."""
    known = F.length(expected).isin(16, 32, 64, 128)
    return F.when(known, F.lower(actual) == F.lower(expected))


def matches_prefix(actual: Column, expected: Column) -> Column:
    """Whether the shorter digest is a prefix of the other, so that short and full forms compare."""
    n = F.least(F.length(actual), F.length(expected))
    return F.lower(F.substring(actual, F.lit(1), n)) == F.lower(F.substring(expected, F.lit(1), n))


SAMPLED_FROM, REGION = 1 << 30, 300 << 20


def sampled_regions(size: int, threshold: int = SAMPLED_FROM, region: int = REGION) -> list[tuple[int, int]]:
    """(start, length) of what a sampled hash reads: everything below the threshold; else the first
    region, the middle one if it starts beyond the first's end, the last if it starts beyond the middle's end."""
    if size < threshold:
        return [(0, size)]
    out = [(0, min(region, size))]
    middle, last = max(0, size // 2 - region // 2), max(0, size - region)
    if middle > region:
        out.append((middle, region))
    if last > middle + region:
        out.append((last, size - last))
    return out


def sampled_hashes(files: DataFrame, path: str = "path", threshold: int = SAMPLED_FROM, region: int = REGION) -> DataFrame:
    """(path, hash, sampled, error) for paths that every executor can open, in parts (see operators.content); a file
    that cannot be read is a row with an error."""
    from attestra.operators.content import sampled_hashes as in_parts

    def sizes(batches):
        import os

        import pyarrow as pa

        for b in batches:
            paths = b.column("path").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([os.path.getsize(p) if p is not None and os.path.isfile(p) else None for p in paths], pa.int64())], ["path", "size"])

    return in_parts(files.select(F.col(path).alias("path")).mapInArrow(sizes, "path string, size long"), threshold, region)


def sampling_summary(hashed: DataFrame) -> DataFrame:
    """One row: files, sampled, full, errors."""
    return hashed.agg(F.count("*").alias("files"), F.count_if("sampled").alias("sampled"), F.count_if(~F.col("sampled")).alias("full"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def device_fingerprint(vendor_id: Column, product_id: Column, usb_serial: Column, reader_serial: Column, media_serial: Column, camera_serial: Column) -> Column:
    """The parts of a device that are known, joined by a bar; 'unknown' if none is."""
    part = lambda name, c: F.when(c != "", F.concat(F.lit(name), c))
    usb = F.when((vendor_id != "") & (product_id != ""), F.concat(F.lit("usb:"), vendor_id, F.lit(":"), product_id))
    parts = F.concat_ws("|", usb, part("usb-sn:", usb_serial), part("reader-sn:", reader_serial), part("media-sn:", media_serial), part("camera:", camera_serial))
    return F.when(parts == "", "unknown").otherwise(parts)
