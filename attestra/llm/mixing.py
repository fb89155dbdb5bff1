"""Mixing sources to target weights by hash-threshold histograms.

Each document has a fixed hash. A source that is to give a part of its words gives the documents
up to a hash threshold, so budgets nest: a larger one takes all that a smaller one takes. The
threshold comes from sums by source and hash bucket; only the bucket in which the budget ends is
refined, level by level, and documents are filtered without a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_key, numbered, real_id

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: The hash has HASH_BITS bits; each level tells LEVEL_BITS more of them apart.
HASH_BITS, LEVEL_BITS = 60, 12


#: Sources up to which their table is broadcast to the documents; more are joined by a shuffle.
FEW_SOURCES = 10_000


def if_few(sources: DataFrame, n: int) -> DataFrame:
    """sources, of n rows, marked for a broadcast if n is within FEW_SOURCES; a hot source then needs no shuffle."""
    return F.broadcast(sources) if n <= FEW_SOURCES else sources


def document_hash(c: str):
    """The leading 60 bits of the MD5 digest of an integer column's decimal digits."""
    return F.conv(F.substring(F.md5(F.col(c).cast("string").cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sums: DataFrame, weights=WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """sums (source, source_size) with target: share of all sizes by weight, the sources in
    order of code points, null last; none above most times its size, and what is over is shared
    again by weight. One row a source, so the windows here see the sources only."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sums.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    s = s.withColumn("cap", F.col("source_size").cast("double") * most).withColumn("total", F.sum("source_size").over(every) * F.lit(share))
    # a source is capped if its cap is below its weight times the level; the level is settled in order of cap by weight
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    s = s.withColumn("at", level).withColumn("level", F.min(F.when(F.col("at") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "at"))).over(every)["at"])
    return s.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame, sources: int) -> DataFrame:
    """(source, below) for budgets (source, budget double): the documents whose hash is below
    `below` are a run in order of hash whose sizes sum to the budget as nearly as a run can.

    sized: (source, h, size), checkpointed; sources: how many there are. A level sums sizes by source and by the next
    LEVEL_BITS bits of those rows alone that fall into the source's boundary bucket.
    """
    state = budgets.select("source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("below"))
    shift = HASH_BITS
    for done in range(0, HASH_BITS, LEVEL_BITS):
        shift = HASH_BITS - done - LEVEL_BITS
        inside = sized if not done else sized.join(if_few(state.select(F.col("source").alias("_s"), "below"), sources), F.col("source").eqNullSafe(F.col("_s"))).where(F.shiftright("h", shift + LEVEL_BITS) == F.shiftright("below", shift + LEVEL_BITS)).select(*sized.columns)
        sums = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
        running = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")))
        j = running.withColumnRenamed("source", "_s").join(state.select("source", "left", "below"), F.col("_s").eqNullSafe(F.col("source")), "right")
        # the first bucket whose running sum is over what is left holds the boundary; if there is none, all below fits
        edge = F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"), "rows", "n")))
        found = j.groupBy("source", "left", "below").agg(edge.alias("e"))
        top = F.shiftleft(F.shiftright("below", shift + LEVEL_BITS) + 1, shift + LEVEL_BITS)
        state = cut(
            found.select(
                "source",
                F.when(F.col("e").isNull(), F.lit(-1.0)).otherwise(F.col("left") - F.col("e.before")).alias("left"),
                F.when(F.col("e").isNull() & (F.col("left") >= 0), top if done else F.lit(1 << HASH_BITS)).when(F.col("e").isNull(), F.col("below")).otherwise(F.shiftleft(F.col("e.bucket"), shift)).alias("below"),
                F.coalesce(F.col("e.rows"), F.lit(0)).alias("rows"),
                F.coalesce(F.col("e.n"), F.lit(0)).alias("n"),
            )
        )
        if state.agg(F.max("rows")).first()[0] in (None, 0, 1):
            break
    # the document at the boundary comes in if that is nearer
    return state.select("source", F.when(F.col("n") - F.col("left") < F.col("left"), F.col("below") + (1 << shift)).otherwise(F.col("below")).alias("below"))


def sizes(docs: DataFrame) -> DataFrame:
    """(id, source, size, h) of docs: words of the text, hash of the id."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(id_key("doc_id").alias("id"), "source", size.alias("size")).withColumn("h", document_hash("id"))


def rules(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """(_s, source_size, target, whole, below): how often each source takes all its documents, and below
    which hash once more; marked for a broadcast while the sources are few."""
    goal = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    sources = goal.count()
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    limit = thresholds(sized.select("source", "h", "size"), goal.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")), sources)
    limit = limit.select(F.col("source").alias("_s"), "below")
    rule = goal.join(limit, F.col("source").eqNullSafe(F.col("_s"))).select("_s", "source_size", "target", "whole", "below")
    return if_few(rule, sources)


def times(most: int) -> Column:
    """How often a row is taken, from its hash h and its source's rule."""
    return F.col("whole") + F.when((F.col("h") < F.col("below")) & (F.col("whole") < most), 1).otherwise(0)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """(doc_id, size, source, source_size, target, times, taken) for each row of docs (doc_id, text, source).

    size counts words; taken = times * size is what the mix takes of the row. A source takes each
    document floor(target / source_size) times, and those below its hash threshold once more. A
    null or empty text has size 0 (and is taken as often as its hash says); a null source is a
    source of its own, the last; rows that share a doc_id are taken alike; a null doc_id stays
    null; an empty table gives an empty result. A rerun takes the same documents.
    """
    sized = cut(sizes(docs))
    both = sized.join(rules(sized, weights, share, most), F.col("source").eqNullSafe(F.col("_s"))).withColumn("times", times(most))
    return both.select(real_id("id").alias("doc_id"), "size", "source", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """docs as mixed: each row as often as mix() takes it (rows may repeat), all columns unchanged, whatever they are
    called; nulls, empty texts, repeated rows and empty tables as there. A row's own id and source tell how often, so texts are not shuffled."""
    rule = rules(cut(sizes(docs)), weights, share, most)
    d, at = numbered(docs)
    both = d.withColumn("h_id", id_key(at["doc_id"])).withColumn("h", document_hash("h_id")).join(rule, F.col(at["source"]).eqNullSafe(F.col("_s")))
    often = both.withColumn("times", times(most)).where("times > 0")
    return often.select(*d.columns, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select(*d.columns).toDF(*docs.columns)
