"""Contents in parts: a file is rows of (content, part, bytes), hashed by a tree, so that its size bounds no cell or task.

BLAKE3 is a binary tree over chunks of 1 KiB, and a part of a power of two of them is a subtree. Parts are read and hashed
wherever they are; chaining values of 32 bytes are then merged in groups of FAN, level by level. A sampled hash
is that of a shorter content, made of regions of the file and its size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from attestra.functions.hashing import CHUNK, REGION, SAMPLED_FROM, _batched, blake3_digests, blake3_joined, blake3_nodes

from .graph import cut

#: Bytes of a part (a power of two of chunks), and nodes of a tree that are merged together (a power of two).
PART, FAN = 1 << 20, 1 << 10
#: Bytes that are hashed at once.
TOGETHER = 4 << 20


def checked(part: int) -> int:
    """part, if it can be the size of parts."""
    if part < CHUNK or part & (part - 1):
        raise ValueError("a part is a power of two of bytes, 1024 at least")
    return part


def parts_of(rows: DataFrame, key: str, content: str, part: int = PART) -> DataFrame:
    """(key, size, part, bytes) of a column of text (its UTF-8) or bytes; an empty content has one empty part, a null one none."""
    checked(part)
    d = rows.select(F.col(key), F.col(content).cast("binary").alias("_b")).where("_b is not null")
    n = F.octet_length("_b").cast("long")
    d = d.select(key, n.alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((n - 1) / part)))).alias("part"), "_b")
    return d.select(key, "size", "part", F.substring("_b", (F.col("part") * part + 1).cast("int"), F.lit(part)).alias("bytes"))


def nodes_of(sizes: list, numbers: list, data: list, part: int) -> list[bytes | None]:
    """The chaining values of parts, or digests of contents of one part; None for a part of a wrong length."""
    out: list = []
    a = 0
    while a < len(data):
        z, held = a, 0
        while z < len(data) and (z == a or held + len(data[z] or b"") <= TOGETHER):
            held += len(data[z] or b"")
            z += 1
        whole = np.array([s is not None and s <= part for s in sizes[a:z]])
        made = blake3_nodes([x or b"" for x in data[a:z]], np.array(numbers[a:z], np.int64) * (part // CHUNK), whole)
        right = [x is not None and s is not None and len(x) == max(0, min(part, s - n * part)) for x, s, n in zip(data[a:z], sizes[a:z], numbers[a:z], strict=True)]
        out += [x if ok else None for x, ok in zip(made, right, strict=True)]
        a = z
    return out


@pandas_udf(BinaryType())
def joined(cvs: pd.Series, root: pd.Series) -> pd.Series:
    return pd.Series(blake3_joined([[bytes(x) for x in c] for c in cvs], root.to_numpy(bool)), dtype=object)


def joined_up(nodes: DataFrame, key: str, part: int) -> DataFrame:
    """(key, blake3) of nodes (key, size, part, cv): each round merges groups of FAN nodes of a content, and there are
    as many rounds as the largest content needs."""
    level = nodes.select(F.col(key).alias("k"), "size", F.col("part").alias("node"), "cv")
    level = level.withColumn("count", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("size") / part)))
    most = level.agg(F.max("count")).first()[0] or 1
    finished = lambda d: d.where("count = 1").groupBy("k").agg(F.when(F.count("*") == 1, F.max("cv")).alias("cv"))
    done, level = finished(level), level.where("count > 1")
    while most > 1:
        group = level.groupBy("k", "size", "count", F.floor(F.col("node") / FAN).alias("group"))
        g = group.agg(F.collect_set("node").alias("kinds"), F.sort_array(F.collect_list(F.struct("node", "cv"))).alias("ns"), F.count("cv").alias("known"))
        due = F.least(F.lit(FAN).cast("long"), F.col("count") - F.col("group") * FAN)
        whole = (F.size("kinds") == due) & (F.size("ns") == due) & (F.col("known") == due)
        g = g.withColumn("cvs", F.when(whole, F.transform("ns", lambda x: x["cv"])).otherwise(F.array(F.lit(b"\0" * 32)))).withColumn("whole", whole)
        up = F.when(F.col("whole"), joined("cvs", F.col("count") <= FAN)).alias("cv")
        level = g.select("k", "size", F.col("group").alias("node"), F.ceil(F.col("count") / FAN).alias("count"), up)
        done, level = done.unionByName(finished(level)), level.where("count > 1")
        most = -(-most // FAN)
    return done.select(F.col("k").alias(key), F.lower(F.hex("cv")).alias("blake3"))


def tree_digests(parts: DataFrame, key: str, part: int = PART) -> DataFrame:
    """(key, blake3): the 64-digit BLAKE3 digest of each content of parts (key, size, part, bytes), part from 0, each of
    `part` bytes but the last. A content of which a part is missing, repeated or of another length has a null digest."""
    checked(part)

    def run(batches):
        few = max(1, TOGETHER // part)  # a batch may hold very many parts
        for b in (batch.slice(k, few) for batch in batches for k in range(0, batch.num_rows, few)):
            cvs = nodes_of(*(b.column(c).to_pylist() for c in ("size", "part", "bytes")), part)
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("size"), b.column("part"), pa.array(cvs, pa.binary())], ["k", "size", "part", "cv"])

    kind = parts.schema[key].dataType.simpleString()
    nodes = parts.select(F.col(key).alias("k"), "size", "part", "bytes").mapInArrow(run, f"k {kind}, size long, part long, cv binary")
    return joined_up(cut(nodes), "k", part).withColumnRenamed("k", key)


def whole_digests(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, whole): the 64-digit BLAKE3 digest of a column of text (its UTF-8) or bytes, a thousand rows of a batch at a time."""

    def run(batches):
        for b in (batch.slice(k, 1000) for batch in batches for k in range(0, batch.num_rows, 1000)):
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(_batched(b.column("c").to_pylist(), blake3_digests), pa.string())], ["k", "whole"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("k"), F.col(content).alias("c")).mapInArrow(run, f"k {kind}, whole string").withColumnRenamed("k", key)


# --- files -----------------------------------------------------------------------------------------


def regions(size: Column, threshold: int = SAMPLED_FROM, region: int = REGION) -> Column:
    """What a sampled hash reads of a file, as an array of (start, length): all below the threshold; else the first region,
    the middle one if it starts beyond the first's end, the last if it starts beyond the middle's end."""
    at = lambda a, n: F.struct(a.cast("long").alias("start"), n.cast("long").alias("length"))
    one = F.lit(region).cast("long")
    middle = F.greatest(F.lit(0).cast("long"), F.floor(size / 2) - region // 2)
    last = F.greatest(F.lit(0).cast("long"), size - region)
    three = F.array(at(F.lit(0), F.least(one, size)), F.when(middle > region, at(middle, one)), F.when(last > middle + region, at(last, size - last)))
    return F.when(size < threshold, F.array(at(F.lit(0), size))).otherwise(F.filter(three, lambda x: x.isNotNull()))


def planned(files: DataFrame, part: int, sampled: bool, threshold: int, region: int) -> DataFrame:
    """(path, file_size, ranges, size, part) of each part, dealt over tasks by path and part."""
    size = F.coalesce(F.col("size").cast("long"), F.lit(0).cast("long"))
    f = files.select("path", size.alias("file_size"), (regions(size, threshold, region) if sampled else regions(size, 1 << 62)).alias("ranges"))
    tail = F.when(F.lit(sampled) & (F.col("file_size") >= threshold), F.lit(8)).otherwise(F.lit(0)).cast("long")
    f = f.withColumn("size", F.aggregate("ranges", tail, lambda acc, r: acc + r["length"]))
    last = F.greatest(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / part))
    return f.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition("path", "part")


def read_part(row: dict, part: int) -> tuple[bytes | None, str | None]:
    """(bytes, error) of a planned part: its stretch of the ranges, end to end, and of the eight bytes behind them."""
    data, at = b"", 0
    a, z = row["part"] * part, min(row["size"], (row["part"] + 1) * part)
    try:
        with open(row["path"], "rb") as file:
            for r in row["ranges"]:
                lo, hi = max(a, at), min(z, at + r["length"])
                if lo < hi:
                    file.seek(r["start"] + lo - at)
                    data += file.read(hi - lo)
                at += r["length"]
    except (OSError, TypeError) as e:
        return None, f"{type(e).__name__}: {e}"
    data += row["file_size"].to_bytes(8, "big")[max(0, a - at) : max(0, z - at)]
    return (data, None) if len(data) == z - a else (None, "shorter than its size")


def file_parts(files: DataFrame, part: int = PART, sampled: bool = False, threshold: int = SAMPLED_FROM, region: int = REGION) -> DataFrame:
    """(path, size, part, bytes, error) of files (path, size) that every executor can open; size is that of the content,
    for a sampled one its regions and eight bytes of the file's size. A part that cannot be read in full is a row with an error."""
    checked(part)

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                data, error = read_part(row, part)
                cols = (row["path"], pa.string()), (row["size"], pa.int64()), (row["part"], pa.int64()), (data, pa.binary()), (error, pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in cols], ["path", "size", "part", "bytes", "error"])

    return planned(files, part, sampled, threshold, region).mapInArrow(run, "path string, size long, part long, bytes binary, error string")


def file_digests(files: DataFrame, part: int = PART, sampled: bool = False, threshold: int = SAMPLED_FROM, region: int = REGION) -> DataFrame:
    """(path, blake3, sampled, error) of files (path, size): the 64-digit digest of the whole or the sampled content. A
    file that cannot be read is a row with an error. Bytes are hashed where they are read; a task holds a few parts."""
    checked(part)

    def run(batches):
        def settle(held):
            rows, data, errors = zip(*held, strict=True)
            cvs = nodes_of([r["size"] for r in rows], [r["part"] for r in rows], list(data), part)
            cols = ([r["path"] for r in rows], pa.string()), ([r["size"] for r in rows], pa.int64()), ([r["part"] for r in rows], pa.int64()), (cvs, pa.binary()), (list(errors), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in cols], ["path", "size", "part", "cv", "error"])

        for b in batches:
            held, size = [], 0
            for row in b.to_pylist():
                data, error = read_part(row, part)
                held.append((row, data, error))
                size += len(data or b"")
                if size >= TOGETHER:
                    yield settle(held)
                    held, size = [], 0
            if held:
                yield settle(held)

    nodes = cut(planned(files, part, sampled, threshold, region).mapInArrow(run, "path string, size long, part long, cv binary, error string"))
    errors = nodes.where("error is not null").groupBy("path").agg(F.min("error").alias("error"))
    out = joined_up(nodes, "path", part).join(errors, "path", "left")
    flag = files.select("path", (F.lit(sampled) & (F.coalesce(F.col("size"), F.lit(0)) >= threshold)).alias("sampled")).dropDuplicates(["path"])
    return flag.join(out, "path").select("path", "blake3", F.when(F.col("error").isNull(), F.col("sampled")).alias("sampled"), "error")


def sampled_hashes(files: DataFrame, threshold: int = SAMPLED_FROM, region: int = REGION, part: int = PART) -> DataFrame:
    """(path, hash, sampled, error): short sampled hashes of files (path, size)."""
    d = file_digests(files, part, True, threshold, region)
    return d.select("path", F.substring("blake3", 1, 16).alias("hash"), "sampled", "error")


class Running:
    """A BLAKE3 digest of what comes in pieces, held in parts of `part` bytes: 32 bytes a part are kept."""

    def __init__(self, part: int = PART):
        self.part, self.waiting, self.nodes, self.size = checked(part), bytearray(), [], 0

    def update(self, data: bytes) -> None:
        self.waiting += data
        self.size += len(data)
        while len(self.waiting) > self.part:  # the last part waits: it may be the only one
            self._take(self.part, False)

    def _take(self, n: int, root: bool) -> None:
        done, self.waiting = bytes(self.waiting[:n]), self.waiting[n:]
        self.nodes += blake3_nodes([done], np.array([len(self.nodes) * (self.part // CHUNK)]), np.array([root]))

    def hexdigest(self) -> str:
        self._take(len(self.waiting), not self.nodes)
        return (self.nodes[0] if len(self.nodes) == 1 else blake3_joined([self.nodes], np.array([True]))[0]).hex()
