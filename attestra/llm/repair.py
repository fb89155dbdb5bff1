"""Least-cost repair of conversations, by a weighted automaton that is determinised as it is needed.

The roles of a repaired conversation read `(s?(ua)+)?`. Four states tell what came before: nothing, the system,
the user, the assistant. The costs of reaching the end from each of them, less the least of these, are a vector
that takes few values: each becomes a state of a deterministic automaton, whose transitions by a row's symbol
(role initial and fault) are computed once and cached. A conversation is scanned by this table from its last row to its
first, which gives its cost; the trace goes back over the scan, so that it meets the edits in their order and takes, of the
arcs that are tight, the one whose letter is least.

Rows are sorted over range partitions, and a conversation that spans several of them is scanned in pieces: a piece is first
summed up as the costs between its four states at either end, which are combined in order; then each piece is traced from each
state, the ways through are chained, and every piece emits its own edits. Only these small summaries of a piece leave it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_key, real_id

RETAG, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
ROLE = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: The symbol of a row that must go; others are 1 + 2 * role + truncated, with role 0 for any other initial.
GONE = 0
INF = 1 << 40
WHITE = "\t\n\x0b\f\r "
LEGAL = {"su", "ua", "au"}


def needed(p: int) -> int:
    """The state after the role that may follow state p by an insertion or a changed role."""
    return ASSISTANT if p == USER else USER


def arcs(p: int, symbol: int):
    """(letter, cost, next state) of what can be done in state p with a row, least letter first; I leaves the row."""
    yield "D", DELETE, p
    yield "I", INSERT, needed(p)
    if symbol != GONE:
        role, truncated = divmod(symbol - 1, 2)
        if role == needed(p) or (role == SYSTEM and p == NOTHING):
            yield "K", TRUNCATED * truncated, role
        yield "R", RETAG + TRUNCATED * truncated, needed(p)


def closed(c: list[int]) -> list[int]:
    """Costs to the end from each state, where roles may be inserted first."""
    for _ in range(3):
        c = [min(c[p], INSERT + c[needed(p)]) for p in range(4)]
    return c


class Automaton:
    """The states met so far (vectors of costs to the end, the least 0), the transitions and the tight arcs between them."""

    def __init__(self):
        self.vectors, self.ids, self.table, self.tight = [], {}, {}, {}

    def state(self, costs: list[int]) -> tuple[int, int]:
        """(state, least cost) of a vector."""
        low = min(costs)
        v = tuple(min(x - low, INF) for x in costs)
        if v not in self.ids:
            self.ids[v] = len(self.vectors)
            self.vectors.append(v)
        return self.ids[v], low

    def step(self, after: int, symbol: int) -> tuple[int, int]:
        """(state before a row, what is added to the cost) by the state after it."""
        key = (after, symbol)
        if key not in self.table:
            v = self.vectors[after]
            self.table[key] = self.state(closed([min(w + v[q] for x, w, q in arcs(p, symbol) if x != "I") for p in range(4)]))
        return self.table[key]

    def scan(self, symbols: list[int], copies: list[int], end: list[int]) -> tuple[list[int], list[int]]:
        """(states at 0 to n, costs from each of the four states at 0) of rows, copies of which beyond the first must go."""
        at, cost = self.state(end)
        states = [at]
        for symbol, n in zip(reversed(symbols), reversed(copies), strict=True):
            at, more = self.step(at, symbol)
            cost += more + DELETE * (n - 1)
            states.append(at)
        states.reverse()
        return states, [min(x + cost, INF) for x in self.vectors[at]]

    def move(self, after: int, symbol: int, p: int) -> tuple[str, int]:
        """(letter, next state): the least tight arc from p with a row before state after."""
        key = (after, symbol, p)
        if key not in self.tight:
            before, more = self.step(after, symbol)
            now, then = self.vectors[before], self.vectors[after]
            self.tight[key] = next((x, q) for x, w, q in arcs(p, symbol) if now[p] + more == w + (now[q] + more if x == "I" else then[q]))
        return self.tight[key]

    def trace(self, symbols: list[int], states: list[int], p: int, last: bool) -> tuple[list[tuple[str, int, int]], int]:
        """(edits, state at the end) from state p: edits are (letter, row or -1, state after it)."""
        out = []
        for k, symbol in enumerate(symbols):
            while True:
                x, p = self.move(states[k + 1], symbol, p)
                out.append((x, -1 if x == "I" else k, p))
                if x != "I":
                    break
        while last and p not in ENDS:
            p = needed(p)
            out.append(("I", -1, p))
        return out, p


AUTOMATON = Automaton()
END = closed([0 if p in ENDS else INF for p in range(4)])


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of conversations as the check damages them: by crc32 of `conv_id:turn`, rows are
    dropped (0 of 20), emptied (1), freed of `.!?` (2), doubled (3) or given to the user (4). A null role or text is one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def in_order(rows: DataFrame) -> DataFrame:
    """(id, part, turn, role, text, copies, fault, symbol): the distinct rows of each conversation by turn, role and text,
    over range partitions in order. fault is 0 for none, 1 blank, 2 duplicate, 3 truncated."""
    d = rows.select(
        id_key("conv_id").alias("id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    d = d.groupBy("id", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("digest", F.sha2("text", 256))
    first = d.groupBy("id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select("id", "role", "digest", F.lit(True).alias("again"), F.col("first.turn").alias("first"))
    d = d.join(first, ["id", "role", "digest"], "left")
    bare = F.rtrim("text", F.lit(WHITE))
    fault = F.when(bare == "", 1).when(F.col("again") & ~F.col("turn").eqNullSafe(F.col("first")), 2).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0)
    d = d.select("id", "turn", "role", "text", "copies", fault.alias("fault"))
    symbol = F.when(F.col("fault").isin(1, 2), GONE).otherwise(1 + 2 * role + (F.col("fault") == 3).cast("int"))
    order = [F.col("id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    d = d.withColumn("symbol", symbol).repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(d.withColumn("part", F.spark_partition_id()))


def runs(batches, *names):
    """(id, part, columns) of each conversation's consecutive rows, as lists."""
    now, held = None, []
    for b in batches:
        cols = [b.column(n).to_pylist() for n in names]
        ids, parts = b.column("id").to_pylist(), b.column("part").to_pylist()
        a = 0
        for z in range(1, len(ids) + 1):
            if z < len(ids) and ids[z] == ids[a]:
                continue
            if now is not None and now[0] != ids[a]:
                yield *now, held
                held = []
            now = (ids[a], parts[a])
            held = [h + c[a:z] for h, c in zip(held, cols, strict=True)] if held else [c[a:z] for c in cols]
            a = z
    if now is not None:
        yield *now, held


def batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def emitted(rows, schema: pa.Schema, size: int = 5000):
    """Arrow batches of rows."""
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield batch(held, schema)
            held = []
    if held:
        yield batch(held, schema)


COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
PIECE = pa.schema([("id", pa.int64()), ("part", pa.int32()), *[(c, pa.int64()) for c in COUNTS], ("low", pa.int64()), ("high", pa.int64()), ("front", pa.string()), ("back", pa.string()), ("costs", pa.list_(pa.int64()))])
PIECE_DDL = f"id long, part int, {', '.join(f'{c} long' for c in COUNTS)}, low long, high long, front string, back string, costs array<long>"


def summed_up(batches):
    """A piece's counts, what it has at its edges, and the costs from each state before it to each after it."""

    def rows():
        for i, part, (turn, role, symbol, copies, fault) in runs(batches, "turn", "role", "symbol", "copies", "fault"):
            counts = [sum(n for f, n in zip(fault, copies, strict=True) if f == k) for k in (1, 2, 3)]
            again = sum(n - 1 for f, n in zip(fault, copies, strict=True) if f in (0, 3))  # further copies are duplicates
            counts[1] += again
            counts[2] -= sum(n - 1 for f, n in zip(fault, copies, strict=True) if f == 3)
            first = [r[:1] for r in role]
            illegal = sum(n - 1 for n in copies) + sum(a + b not in LEGAL for a, b in zip(first, first[1:], strict=False))
            known = [t for t in turn if t is not None]
            ends = [AUTOMATON.scan(symbol, copies, [0 if p == q else INF for p in range(4)])[1] for q in range(4)]
            costs = [ends[q][p] for p in range(4) for q in range(4)]
            yield i, part, *counts, illegal, len(set(known)), known[0] if known else None, known[-1] if known else None, first[0], first[-1], costs

    return emitted(rows(), PIECE)


REPORT = pa.schema([("id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", *COUNTS[:4], "cost")], ("ends", pa.list_(pa.struct([("part", pa.int32()), ("last", pa.bool_()), ("end", pa.list_(pa.int64()))])))])
REPORT_DDL = f"id long, gaps long, {', '.join(f'{c} long' for c in COUNTS[:4])}, cost long, ends array<struct<part: int, last: boolean, end: array<long>>>"


def combined(batches):
    """A conversation's counts and cost from its pieces in order; with several pieces, the costs to the end after each."""

    def rows():
        for b in batches:
            for i, pieces in zip(b.column("id").to_pylist(), b.column("pieces").to_pylist(), strict=True):
                total = {c: sum(p[c] for p in pieces) for c in COUNTS}
                total["illegal"] += sum(a["back"] + b["front"] not in LEGAL for a, b in zip(pieces, pieces[1:], strict=False))
                known = [p for p in pieces if p["low"] is not None]
                total["turns"] -= sum(a["high"] == b["low"] for a, b in zip(known, known[1:], strict=False))
                gaps = known[-1]["high"] - known[0]["low"] + 1 - total["turns"] if known else 0
                end, ends = END, []
                for p in reversed(pieces):
                    ends.append({"part": p["part"], "last": p is pieces[-1], "end": end})
                    end = closed([min(p["costs"][4 * s + q] + end[q] for q in range(4)) for s in range(4)])
                yield i, gaps, *[total[c] for c in COUNTS[:4]], end[NOTHING], ends[::-1] if len(ends) > 1 else None

    return emitted(rows(), REPORT)


WAYS = pa.schema([("id", pa.int64()), ("part", pa.int32()), ("ways", pa.list_(pa.int32()))])
ENTRIES = pa.schema([("id", pa.int64()), ("part", pa.int32()), ("entry", pa.int32())])


def ways(batches):
    """Where the trace of a piece leaves it, for each state in which it may come to it."""

    def rows():
        for i, part, (symbol, copies, end, last) in runs(batches, "symbol", "copies", "end", "last"):
            states, _ = AUTOMATON.scan(symbol, copies, end[0])
            yield i, part, [AUTOMATON.trace(symbol, states, p, last[0])[1] for p in range(4)]

    return emitted(rows(), WAYS)


def chained(batches):
    """The state in which the trace comes to each piece of a conversation."""

    def rows():
        for b in batches:
            for i, pieces in zip(b.column("id").to_pylist(), b.column("pieces").to_pylist(), strict=True):
                p = NOTHING
                for piece in pieces:
                    yield i, piece["part"], p
                    p = piece["ways"][p]

    return emitted(rows(), ENTRIES)


EDITS = pa.schema([("id", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("edit", pa.string()), ("times", pa.int64()), ("role", pa.string()), ("text", pa.string())])
EDITS_DDL = "id long, part int, place long, edit string, times long, role string, text string"


def edited(spans: bool):
    """The edits of conversations, or of the pieces of those that span partitions."""

    def run(batches):
        def rows():
            for i, part, (role, text, symbol, copies, *more) in runs(batches, "role", "text", "symbol", "copies", *(("entry", "end", "last") if spans else ())):
                entry, end, last = (c[0] for c in more) if spans else (NOTHING, END, True)
                states, _ = AUTOMATON.scan(symbol, copies, end)
                place = 0
                for x, k, p in AUTOMATON.trace(symbol, states, entry, last)[0]:
                    kept = {"K": lambda: (role[k], text[k]), "R": lambda: (ROLE[p], text[k]), "I": lambda: (ROLE[p], ""), "D": lambda: (None, None)}[x]()  # noqa: B023
                    for letter, n, both in ((x, 1, kept), ("D", copies[k] - 1 if k >= 0 else 0, (None, None))):
                        if n:
                            yield i, part, place, letter, n, *both
                            place += 1

        return emitted(rows(), EDITS, 1000)

    return run


class Repair:
    """The repair of rows (conv_id, turn, role, text), those of equal conv_id being a conversation, by turn (nulls first),
    then role and text. A null role or text is one space, a null conv_id a conversation of its own. Equal rows of equal turn are
    counted as copies before rows are sorted. An empty table has no conversations; other columns are not looked at.

    A conversation has at most two partitions that it shares with others, and only what these few are is broadcast (two
    rows for each partition at most), so that one conversation may hold any share of all rows."""

    def __init__(self, rows: DataFrame):
        self.rows = in_order(rows)
        pieces = self.rows.select("id", "part", "turn", "role", "symbol", "copies", "fault").mapInArrow(summed_up, PIECE_DDL)
        grouped = pieces.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(*[n for n in PIECE.names[1:]]))).alias("pieces"))
        self._report = cut(grouped.mapInArrow(combined, REPORT_DDL))
        ends = self._report.where("ends is not null").select("id", F.explode("ends").alias("e")).select("id", "e.part", "e.last", "e.end")
        narrow = self.rows.select("id", "part", "symbol", "copies").join(F.broadcast(ends), ["id", "part"])
        found = narrow.mapInArrow(ways, "id long, part int, ways array<int>").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("part", "ways"))).alias("pieces"))
        self.spans = cut(found.mapInArrow(chained, "id long, part int, entry int").join(ends, ["id", "part"]))

    def report(self) -> DataFrame:
        """(id, gaps, blank, duplicate, truncated, illegal, cost) of each conversation."""
        return self._report.drop("ends")

    def edits(self, whole: bool | None = None) -> DataFrame:
        """(id, part, place, edit, times, role, text): what is done, in order of part and place, with the row that comes of it
        (none of D). whole: only conversations within a partition, in the order of their partition, or only the others."""
        rows = self.rows.select("id", "part", "role", "text", "symbol", "copies")
        within = rows.join(F.broadcast(self.spans.select("id").distinct()), "id", "left_anti").mapInArrow(edited(False), EDITS_DDL)
        over = rows.join(F.broadcast(self.spans), ["id", "part"]).mapInArrow(edited(True), EDITS_DDL)
        return within.union(over) if whole is None else within if whole else over

    def repaired(self) -> DataFrame:
        """(conv_id, part, place, role, text): the repaired conversations, in order of part and place."""
        return self.edits().where("edit <> 'D'").select(real_id("id").alias("conv_id"), "part", "place", "role", "text")

    def digests(self) -> DataFrame:
        """(id, audit, repaired_sha256) of each conversation that has rows. SHA-256 reads a conversation from front to
        back: one that spans partitions streams through one task, which holds a batch of its rows and its audit."""

        def run(batches):
            def rows():
                now = letters = digest = None
                for b in batches:
                    for i, x, n, role, text in zip(*(b.column(c).to_pylist() for c in ("id", "edit", "times", "role", "text")), strict=True):
                        if letters is None or i != now:
                            if letters is not None:
                                yield now, "".join(letters), digest.hexdigest()
                            now, letters, digest, any_row = i, [], hashlib.sha256(), False
                        letters.append(x * n)
                        if x != "D":
                            digest.update(f"{chr(10) * any_row}{role}:{text}".encode())
                            any_row = True
                if letters is not None:
                    yield now, "".join(letters), digest.hexdigest()

            return emitted(rows(), pa.schema([("id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]))

        ddl = "id long, audit string, repaired_sha256 string"
        over = self.edits(False).repartition("id").sortWithinPartitions("id", "part", "place")
        return self.edits(True).mapInArrow(run, ddl).union(over.mapInArrow(run, ddl))


def with_reports(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conv_id of conversations,
    by the repair of rows; one without rows has zeros, an empty audit and the digest of nothing."""
    r = Repair(rows)
    ids = conversations.select(id_key("conv_id").alias("id")).distinct()
    out = ids.join(r.report(), "id", "left").join(r.digests(), "id", "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *COUNTS[:4], "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(real_id("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
