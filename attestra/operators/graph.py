"""Connected components and similarity joins."""

from __future__ import annotations

import itertools
import math
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dedup


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, as in tests, a new temporary one, but only if
    driver and executors are one process. On a cluster the setting must name a folder that all of them see."""
    sc = spark.sparkContext
    if (at := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()) is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="attestra-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so that neither a later
    action nor a lost executor computes it again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of edges (a long, b long) can reach.

    Alternating large-star and small-star rounds; each is a grouped minimum with partial
    aggregation and an equi-join, and is cut by a checkpoint. Edges never come to the driver.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        near = e.join(least, "u")
        if large:
            return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    was, now = None, mark(e)
    while now != was and now[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        e = cut(star(both, True).where("u <> v").distinct())
        e = cut(star(e, False).where("u > v").distinct())
        was, now = now, mark(e)
    pairs = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.union(pairs.select(F.col("root").alias("node"), "root").distinct())


def hash_long(hex16: Column) -> Column:
    """The 64 bits of 16 hex digits as a long (two's complement); null if they are not that."""
    half = lambda a: F.conv(F.substring(hex16, a, 8), 16, 10).cast("long")
    return F.when(hex16.rlike("^[0-9a-fA-F]{16}$"), F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two longs."""
    return F.bit_count(a.bitwiseXOR(b))


def similarity_percent(distance: Column, bits: int = 64) -> Column:
    return (F.lit(float(bits)) - distance) / bits * 100


def band_plan(threshold: int, n: int, most: int = 20_000) -> tuple[list[int], int]:
    """(edges of the bands, flips within one) for hashes within threshold bits, n of them: of two such hashes, m bands
    have one with at most threshold // m differing bits. Chosen is the m of the least work for a hash: the
    variants that it emits, at most `most`, and the hashes that it meets by chance."""
    best = None
    for m in range(1, min(64, threshold + 1) + 1):
        edges, flips = [64 * i // m for i in range(m + 1)], threshold // m
        widths = [edges[i + 1] - edges[i] for i in range(m)]
        emitted = [sum(math.comb(w, k) for k in range(flips + 1)) for w in widths]
        if sum(emitted) <= most:
            work = sum(emitted) + n / 2 * sum(v / 2.0**w for v, w in zip(emitted, widths, strict=True))
            best = min(best or (work, edges, flips), (work, edges, flips))
    return best[1], best[2]


def near_hashes(rows: DataFrame, bits: str, threshold: int) -> DataFrame:
    """(x, y, distance): pairs of different 64-bit hashes of rows, x < y, that differ in at most threshold bits.

    The word is cut into bands, in one of which two such hashes differ by a few bits at most. One side emits its
    bands with all such flips, the other its bands as they are, and they meet on equal ones. The join runs over distinct hashes,
    so equal ones do not meet band by band; a pair is kept at the first band that brings it together.
    """
    h = cut(rows.where(F.col(bits).isNotNull()).select(F.col(bits).cast("long").alias("x")).distinct())
    edges, flips = band_plan(threshold, h.count())
    widths = [edges[i + 1] - edges[i] for i in range(len(edges) - 1)]
    part = lambda c, i: F.shiftrightunsigned(c, edges[i]).bitwiseAND(F.lit((1 << widths[i]) - 1)) if widths[i] < 64 else c
    banded = h.select("x", F.posexplode(F.array(*[part(F.col("x"), i) for i in range(len(widths))])).alias("band", "value"))
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = [(i, signed(sum(1 << j for j in c))) for i, w in enumerate(widths) for k in range(flips + 1) for c in itertools.combinations(range(w), k)]
    asks = banded
    if flips:
        table = h.sparkSession.createDataFrame(masks, "band int, mask long")  # band_plan() bounds its rows
        asks = banded.join(F.broadcast(table), "band").select("x", "band", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
    near = asks.join(banded.select(F.col("x").alias("y"), "band", "value"), ["band", "value"]).where("x < y")
    both = F.col("x").bitwiseXOR(F.col("y"))
    first = F.coalesce(*[F.when(F.bit_count(part(both, i)) <= flips, i) for i in range(len(widths))])
    return near.where(F.bit_count(both) <= threshold).where(F.col("band") == first).select("x", "y", F.bit_count(both).alias("distance"))


class Similar:
    """Rows by near hashes, without a pair of copies: a class row for each hash, and links between classes.

    classes (h, representative, n): the smallest key and the number of rows of a hash. links (x, y, distance) of near_hashes().
    A hash that most rows share is one class row, whatever their number."""

    def __init__(self, rows: DataFrame, key: str, bits: str, threshold: int = 10):
        self.key, self.threshold = key, threshold
        self.rows = rows.where(F.col(bits).isNotNull()).select(F.col(key).alias("k"), F.col(bits).cast("long").alias("h"))
        self.classes = cut(dedup.classes(self.rows, "h", "k"))
        self.links = cut(near_hashes(self.classes, "h", threshold))

    def summary(self) -> DataFrame:
        """(representative, hash, n, links, copies): each class with the number of classes near it and of rows in these."""
        both = self.links.select("x", "y").union(self.links.select("y", "x"))
        met = both.join(self.classes.select(F.col("h").alias("y"), F.col("n").alias("m")), "y").groupBy(F.col("x").alias("h")).agg(F.count("*").alias("links"), F.sum("m").alias("copies"))
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        return self.classes.join(met, "h", "left").select("representative", F.col("h").alias("hash"), "n", zero("links"), zero("copies"))

    def groups(self) -> DataFrame:
        """(group_id, representative, member, distance, size) as similarity_groups() gives of all pairs: rows in no pair are left out."""
        name = lambda c, a: self.classes.select(F.col("h").alias(c), F.col("representative").alias(a))
        edges = self.links.join(name("x", "a"), "x").join(name("y", "b"), "y").select("a", "b", "distance")
        lone = self.classes.select(F.col("representative").alias("node"), "n")
        c = lone.join(components(edges.select("a", "b")), "node", "left").withColumn("root", F.coalesce("root", "node"))
        size = c.groupBy("root").agg(F.sum("n").alias("size")).where("size > 1")
        direct = edges.select(F.least("a", "b").alias("root"), F.greatest("a", "b").alias("node"), F.col("distance").alias("d"))
        d = F.when(F.col("node") == F.col("root"), 0).otherwise(F.coalesce("d", F.lit(self.threshold))).cast("int")
        known = cut(c.join(size, "root").join(direct, ["root", "node"], "left").select("root", F.col("node").alias("representative"), d.alias("distance"), "size"))
        m = self.rows.join(self.classes.select("h", "representative"), "h").join(known, "representative")
        return m.select(F.col("root").alias("group_id"), F.col("root").alias("representative"), F.col("k").alias("member"), "distance", "size")

    def counts(self) -> DataFrame:
        """One row: processed, pairs, unique (rows that no pair holds), by arithmetic over class rows."""
        s = self.summary()
        n = F.col("n").cast("decimal(38,0)")
        pairs = F.sum(n * (n - 1) / 2 + n * F.col("copies") / 2)  # a link counts at either end
        total = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        return s.agg(total(F.sum("n")).alias("processed"), total(pairs).alias("pairs"), total(F.sum(F.when((F.col("n") == 1) & (F.col("links") == 0), 1))).alias("unique"))


def hamming_pairs(rows: DataFrame, key: str, bits: str, threshold: int = 10) -> DataFrame:
    """(a, b, distance): pairs of different keys, a < b, whose 64-bit hashes differ in at most threshold bits. All pairs
    of rows, equal hashes too: as many as the square of the copies of a hash. Similar has classes and links instead."""
    near = near_hashes(rows, bits, threshold)
    k = rows.where(F.col(bits).isNotNull()).select(F.col(key).alias("k"), F.col(bits).alias("h"))
    across = near.join(k.select(F.col("k").alias("k1"), F.col("h").alias("x")), "x").join(k.select(F.col("k").alias("k2"), F.col("h").alias("y")), "y")
    across = across.select(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b"), "distance")
    same = k.alias("p").join(k.alias("q"), F.expr("p.h = q.h AND p.k < q.k")).select(F.col("p.k").alias("a"), F.col("q.k").alias("b"), F.lit(0).alias("distance"))
    return across.unionByName(same)


def similarity_groups(pairs: DataFrame, threshold: int) -> DataFrame:
    """(group_id, representative, member, distance, size): components of pairs (a, b, distance);
    the representative is the smallest member, a member's distance that of its direct pair with it, else threshold."""
    c = components(pairs.select("a", "b"))
    size = c.groupBy("root").agg(F.count("*").alias("size"))
    direct = pairs.select(F.col("a").alias("root"), F.col("b").alias("node"), "distance")
    d = F.when(F.col("node") == F.col("root"), 0).otherwise(F.coalesce("distance", F.lit(threshold))).cast("int")
    return c.join(size, "root").join(direct, ["root", "node"], "left").select(F.col("root").alias("group_id"), F.col("root").alias("representative"), F.col("node").alias("member"), d.alias("distance"), "size")


def by_size(groups: DataFrame) -> DataFrame:
    """similarity_groups(), the largest first, ties by group and member."""
    return groups.orderBy(F.desc("size"), "group_id", "member")


def similarity_counts(rows: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """One row: processed, pairs, unique (rows that no pair holds)."""
    inside = pairs.select("a").union(pairs.select("b")).distinct().agg(F.count("*").alias("_in"))
    return rows.agg(F.count(key).alias("processed")).crossJoin(pairs.agg(F.count("*").alias("pairs"))).crossJoin(inside).select("processed", "pairs", (F.col("processed") - F.col("_in")).alias("unique"))  # one row each


def char_jaccard(a: Column, b: Column) -> Column:
    """Shared distinct characters over all; null if either is empty."""
    s = lambda c: F.array_distinct(F.split(c, ""))
    return F.when((a != "") & (b != ""), F.size(F.array_intersect(s(a), s(b))) / F.size(F.array_union(s(a), s(b))))
