"""Functions of order (the row before, the last known value, places, means, covering intervals) split over tasks.

A window over a key is one task however many rows the key has. Here rows are sorted over range partitions by key and
order, and a partition is a chunk. A function is computed within each key's rows of a chunk; what such a part hands on
to the parts after (or before) it is one row; a window over these rows tells what each part is handed, and both are
combined. Only keys that lie in several chunks are handed anything: at most two of these rows a chunk, which are broadcast.
Such a key is that of a chunk's first or last row, so only these keys' rows are gone over for what they hand on.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from copy import copy
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .graph import cut


@dataclass(frozen=True)
class Scan:
    """A function of order: local over a part's window, what the part hands on (an aggregate), what a part is
    handed (over the window of these, in order of chunks) and both together."""

    local: Callable[[WindowSpec, WindowSpec], Column]
    hands_on: Callable[[Column], Column]
    handed: Callable[[str, WindowSpec, WindowSpec], Column]
    both: Callable[[Column, Column], Column]


BEFORE = (Window.unboundedPreceding, -1)
UPTO = (Window.unboundedPreceding, Window.currentRow)


def last_value(c: str) -> Scan:
    """The last value of c that is not null, of this row and those before it."""
    return Scan(
        lambda up, down: F.last(c, True).over(up.rowsBetween(*UPTO)), lambda o: F.max_by(c, F.when(F.col(c).isNotNull(), o)),
        lambda n, up, down: F.last(n, True).over(up.rowsBetween(*BEFORE)), lambda a, b: F.coalesce(a, b),
    )


def next_value(c: str) -> Scan:
    """The first value of c that is not null, of this row and those after it (from the end, so that no frame is walked twice)."""
    return Scan(
        lambda up, down: F.last(c, True).over(down.rowsBetween(*UPTO)), lambda o: F.min_by(c, F.when(F.col(c).isNotNull(), o)),
        lambda n, up, down: F.last(n, True).over(down.rowsBetween(*BEFORE)), lambda a, b: F.coalesce(a, b),
    )


def row_before(c: Column) -> Scan:
    """A struct (v) of c in the row before; null in the first row."""
    one = F.struct(c.alias("v"))
    return Scan(lambda up, down: F.lag(one).over(up), lambda o: F.max_by(one, o), lambda n, up, down: F.lag(n).over(up), lambda a, b: F.coalesce(a, b))


def row_after(c: Column) -> Scan:
    """A struct (v) of c in the row after; null in the last row."""
    one = F.struct(c.alias("v"))
    return Scan(lambda up, down: F.lead(one).over(up), lambda o: F.min_by(one, o), lambda n, up, down: F.lead(n).over(up), lambda a, b: F.coalesce(a, b))


def row_number() -> Scan:
    """1, 2, ... in order."""
    return Scan(lambda up, down: F.row_number().over(up), lambda o: F.count("*"), lambda n, up, down: F.sum(n).over(up.rowsBetween(*BEFORE)), lambda a, b: a + F.coalesce(b, F.lit(0)))


def whole(f: Callable[[Column], Column], c: Column, again: Callable[[str], Column] | None = None) -> Scan:
    """f of c over all rows of the key; again: f of partial results, f itself unless given."""
    every = (Window.unboundedPreceding, Window.unboundedFollowing)
    return Scan(
        lambda up, down: f(c).over(up.rowsBetween(*every)), lambda o: f(c),
        lambda n, up, down: (again or f)(n).over(up.rowsBetween(*every)), lambda a, b: F.coalesce(b, a),
    )


def join_same(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner", small: bool = False) -> DataFrame:
    """left and right joined where they agree in names, nulls agreeing with nulls; small: right has a proven bound and is broadcast."""
    right = right.withColumnsRenamed({n: f"_on{i}" for i, n in enumerate(names)})
    on = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_on{i}")) for i, n in enumerate(names)] or [F.lit(True)])
    return left.join(F.broadcast(right) if small else right, on, how).drop(*[f"_on{i}" for i in range(len(names))])


class Ordered:
    """rows of df with their chunk, by keys and order (names of columns). Rows that agree in all of these lie in one chunk.
    shared: the keys that lie in several chunks, fewer than there are chunks."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str]):
        self.keys, self.order = keys, order
        by = [*keys, *order]
        if not order:
            raise ValueError("rows are ordered by one column at least")
        rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_chunk", F.spark_partition_id())
        rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
        ends = rows.groupBy("_chunk").agg(F.min("_row").alias("a"), F.max("_row").alias("z"))
        ends = ends.select(F.explode(F.array_distinct(F.array("a", "z"))).alias("_row"))
        self.shared = cut(rows.join(F.broadcast(ends), "_row").groupBy(*keys).agg(F.count_distinct("_chunk").alias("_n")).where("_n > 1"))
        self.rows = rows.drop("_row")

    def apart(self) -> tuple[DataFrame, Ordered]:
        """(rows of the keys that lie in one chunk, the rows of the others): of the former, each chunk knows all."""
        others = copy(self)
        others.rows = join_same(self.rows, self.shared, self.keys, "left_semi", small=True)
        return join_same(self.rows, self.shared, self.keys, "left_anti", small=True), others

    def within(self, rows: DataFrame, **scans: Scan) -> DataFrame:
        """What scan gives, for rows of keys that lie in one chunk."""
        up = Window.partitionBy(*self.keys, "_chunk").orderBy(*self.order)
        down = Window.partitionBy(*self.keys, "_chunk").orderBy(*[F.desc(c) for c in self.order])
        return rows.select("*", *[s.local(up, down).alias(n) for n, s in scans.items()])

    def scan(self, rows: DataFrame | None = None, **scans: Scan) -> DataFrame:
        """rows (these, or what was derived from them row by row) with a column for each scan."""
        rows = self.rows if rows is None else rows
        o = F.struct(*self.order)
        up = Window.partitionBy(*self.keys, "_chunk").orderBy(*self.order)
        down = Window.partitionBy(*self.keys, "_chunk").orderBy(*[F.desc(c) for c in self.order])
        here = rows.select("*", *[s.local(up, down).alias(f"_l_{n}") for n, s in scans.items()])
        parts = join_same(rows, self.shared, self.keys, "left_semi", small=True).groupBy(*self.keys, "_chunk").agg(*[s.hands_on(o).alias(f"_h_{n}") for n, s in scans.items()])
        up, down = Window.partitionBy(*self.keys).orderBy("_chunk"), Window.partitionBy(*self.keys).orderBy(F.desc("_chunk"))
        handed = parts.withColumn("_parts", F.count("*").over(Window.partitionBy(*self.keys))).where("_parts > 1")
        handed = handed.select(*self.keys, "_chunk", *[s.handed(f"_h_{n}", up, down).alias(f"_g_{n}") for n, s in scans.items()])
        j = join_same(here, handed, [*self.keys, "_chunk"], "left", small=True)
        return j.select(*rows.columns, *[s.both(F.col(f"_l_{n}"), F.col(f"_g_{n}")).alias(n) for n, s in scans.items()])


def exponential_mean(df: DataFrame, keys: list[str], order: str, value: str, alpha: float) -> DataFrame:
    """(*keys, ewma, n): the exponentially weighted mean of each key's values in order, begun with the first, and their
    number. A part of a key is the map e -> (1 - alpha)^n e + b; a key's parts are applied in order."""
    rows = Ordered(df.select(*keys, F.col(order).alias("_o"), F.col(value).cast("double").alias("_v")), keys, ["_o", "_v"]).rows
    parts = rows.groupBy(*keys, "_chunk").agg(F.sort_array(F.collect_list(F.struct("_o", "_v"))).alias("s"))
    step = lambda acc, x: alpha * x["_v"] + (1 - alpha) * acc
    b = F.aggregate("s", F.lit(0.0), step)
    begun = F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(1))), F.element_at("s", 1)["_v"], step)
    parts = parts.select(*keys, F.struct("_chunk", F.size("s").alias("n"), b.alias("b"), begun.alias("begun")).alias("p"))
    every = parts.groupBy(*keys).agg(F.sort_array(F.collect_list("p")).alias("ps"))  # one row a chunk
    on = F.aggregate("ps", F.lit(None).cast("double"), lambda acc, p: F.when(acc.isNull(), p["begun"]).otherwise(F.pow(F.lit(1 - alpha), p["n"]) * acc + p["b"]))
    n = F.aggregate("ps", F.lit(0).cast("long"), lambda acc, p: acc + p["n"])
    return every.select(*keys, on.alias("ewma"), n.cast("int").alias("n"))


def first_cover(points: DataFrame, intervals: DataFrame, by: list[str]) -> DataFrame:
    """(*by, at, point, interval): for each of points (*by, at long, point) that one of intervals (*by, low long, high long,
    rank, interval) with equal by covers, ends included, the one of least rank; rank is a struct, distinct within by.

    Points, beginnings and ends of intervals are one timeline in chunks. A chunk is swept with a heap of the open intervals. Of
    those that were opened before it, it knows those that end in it by their ends; of those that go on beyond it only the least can
    matter, and is found by cutting each interval's inner chunks into aligned stretches (some two for each doubling of their number) and
    taking the least of the stretches in which a chunk lies. So no interval is copied to all that it covers.
    """
    kinds = {f.name: f.dataType for f in intervals.schema.fields}
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    point = points.schema["point"].dataType
    part = lambda at, kind: intervals.select(*by, F.col(at).alias("at"), F.lit(kind).alias("_kind"), F.lit(None).cast(point).alias("point"), "low", "high", "rank", "interval")
    asked = points.where("at is not null").select(*by, "at", F.lit(1).alias("_kind"), "point", *map(none, ("low", "high", "rank", "interval")))
    line = Ordered(part("low", 0).union(part("high", 2)).union(asked), by, ["at", "_kind", "rank", "point"]).rows

    span = line.where("_kind <> 1").groupBy(*by, "rank").agg(F.min("_chunk").alias("a"), F.max("_chunk").alias("z"), F.first("interval").alias("interval")).where("z - a >= 2")
    span = span.select(*by, "rank", "interval", F.col("a") + 1, F.col("z").alias("past"), F.explode(F.sequence(F.lit(0), F.lit(30))).alias("level")).toDF(*by, "rank", "interval", "a", "past", "level")
    side = F.pow(F.lit(2.0), F.col("level"))
    span = span.withColumn("l", F.ceil(F.col("a") / side).cast("long")).withColumn("r", F.floor(F.col("past") / side).cast("long") - 1).where("l <= r")
    ends = F.array(F.when(F.col("l") % 2 == 1, F.col("l")), F.when(F.col("r") % 2 == 0, F.col("r")))
    nodes = span.select(*by, "level", "rank", "interval", F.explode(F.filter(ends, lambda x: x.isNotNull())).alias("node")).groupBy(*by, "level", "node").agg(F.min(F.struct("rank", "interval")).alias("least"))
    lies = line.select(*by, "_chunk").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("level"))
    lies = lies.withColumn("node", F.floor(F.col("_chunk") / side).cast("long"))
    over = join_same(lies, nodes, [*by, "level", "node"]).groupBy(*by, "_chunk").agg(F.min("least").alias("_over"))
    rows = join_same(line, over, [*by, "_chunk"], "left", small=True)  # keys in three chunks or more: one row a chunk at most
    rows = rows.select(*by, "at", "_kind", "point", "low", "high", "rank", "interval", "_over")

    names = [*by, "at", "point", "interval"]
    types = {f.name: f.dataType.simpleString() for f in line.schema.fields}
    key = lambda rank: tuple((v is not None, v) for v in rank.values())

    def sweep(batches):
        def settle(held: list[pa.RecordBatch]):
            t = pa.Table.from_batches(held)
            at, kind, high, rank = (t.column(c).to_pylist() for c in ("at", "_kind", "high", "rank"))
            ranks = [None if r is None else key(r) for r in rank]
            begun = {ranks[k] for k in range(len(at)) if kind[k] == 0}
            over = t.column("_over")[0].as_py()
            over = over and (key(over["rank"]), over["interval"])
            heap = [(ranks[k], high[k], k) for k in range(len(at)) if kind[k] == 2 and ranks[k] not in begun]
            heapq.heapify(heap)
            asks, found, beyond = [], [], []
            for k in range(len(at)):
                if kind[k] == 0:
                    heapq.heappush(heap, (ranks[k], high[k], k))
                elif kind[k] == 1:
                    while heap and heap[0][1] < at[k]:
                        heapq.heappop(heap)
                    if over and (not heap or over[0] < heap[0][0]):
                        beyond.append(k)
                    elif heap:
                        asks.append(k)
                        found.append(heap[0][2])
            for ks, hits in ((asks, t.column("interval").take(pa.array(found, pa.int64()))), (beyond, pa.array([over and over[1]] * len(beyond), t.schema.field("interval").type))):
                if ks:
                    some = t.select([*by, "at", "point"]).take(pa.array(ks))
                    yield from some.append_column("interval", hits).to_batches(max_chunksize=10_000)

        now, held = None, []
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in by), strict=True)) if by else [()] * b.num_rows
            a = 0
            for z in range(1, b.num_rows + 1):
                if z == b.num_rows or keys[z] != keys[a]:
                    if held and keys[a] != now:
                        yield from settle(held)
                        held = []
                    now = keys[a]
                    held.append(b.slice(a, z - a))
                    a = z
        if held:
            yield from settle(held)

    return rows.mapInArrow(sweep, ", ".join(f"`{c}` {types[c]}" for c in names))
