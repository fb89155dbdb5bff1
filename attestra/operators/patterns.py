"""Many patterns at once: texts meet patterns by equal keys (prefixes, pieces of three letters), never all by all.

Any table of patterns may be large: it is joined by key, and broadcast only where the optimiser knows it to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of the piece by which a text meets a pattern.
GRAM = 3


def longest_prefix(texts: DataFrame, prefixes: DataFrame, text: str, prefix: str, *more: str) -> DataFrame:
    """(text, prefix, *more) for each distinct text: its longest prefix in the table and that row's further columns, null
    if there is none. A text is cut at the lengths that occur among the prefixes (as many as the longest has letters at most);
    of equal prefixes the row of the largest further columns counts."""
    best = prefixes.where(F.col(prefix).isNotNull()).groupBy(prefix).agg(F.max(F.struct(*more)).alias("_more") if more else F.lit(1).alias("_more"))
    lengths = [r[0] for r in best.select(F.length(prefix).alias("n")).distinct().orderBy("n").collect()]
    t = texts.select(F.col(text).alias("_t")).distinct()
    tries = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("_t"))
    cut = t.select("_t", F.explode(tries).alias("_n")).select("_t", "_n", F.substring("_t", F.lit(1), F.col("_n")).alias("_p"))
    met = cut.join(best.withColumnRenamed(prefix, "_p"), "_p").groupBy("_t").agg(F.max(F.struct("_n", "_p", "_more")).alias("_m"))
    out = t.join(met, "_t", "left")
    return out.select(F.col("_t").alias(text), F.col("_m._p").alias(prefix), *[F.col(f"_m._more.{c}").alias(c) for c in more])


def grams(c: Column, width: int) -> Column:
    """The pieces of width letters of a text, each once; '' for a width of 0."""
    if width == 0:
        return F.array(F.lit(""))
    places = F.when(F.length(c) >= width, F.sequence(F.lit(1), F.length(c) - width + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(c, i, F.lit(width))))


def containing(texts: DataFrame, patterns: DataFrame, text: str, literal: str) -> DataFrame:
    """(text, *columns of patterns) where a distinct text contains the pattern's literal, whatever the case; an empty
    literal is in every text.

    A literal is posted under that of its pieces which fewest literals have, a text asks for all of its pieces, and who meets
    is compared in full."""
    p = patterns.where(F.col(literal).isNotNull()).withColumn("_l", F.lower(literal))
    kinds = p.select("_l").distinct().withColumn("_w", F.least(F.lit(GRAM), F.length("_l")))
    widths = [r[0] for r in kinds.select("_w").distinct().orderBy("_w").collect()]  # of 0 to GRAM
    pieces = F.coalesce(*[F.when(F.col("_w") == w, grams(F.col("_l"), w)) for w in widths]) if widths else F.array().cast("array<string>")
    pieces = kinds.select("_l", F.explode(pieces).alias("_g"))
    rare = pieces.groupBy("_g").agg(F.count("*").alias("_n"))
    posted = pieces.join(rare, "_g").groupBy("_l").agg(F.min(F.struct("_n", "_g")).alias("_m")).select("_l", F.col("_m._g").alias("_g"))
    t = texts.select(F.col(text).alias("_t")).where("_t is not null").distinct().withColumn("_tl", F.lower("_t"))
    asked = F.array_distinct(F.flatten(F.array(*[grams(F.col("_tl"), w) for w in widths]))) if widths else F.array().cast("array<string>")
    met = t.select("_t", "_tl", F.explode(asked).alias("_g")).join(posted, "_g").where(F.contains("_tl", F.col("_l"))).select("_t", "_l")
    return met.join(p, "_l").select(F.col("_t").alias(text), *patterns.columns)


def glob_regex(c: Column) -> Column:
    """A shell pattern as a regular expression over a whole name, whatever the case."""
    quoted = F.regexp_replace(c, r"([.\\+^$(){}|\[\]])", r"\\$1")
    return F.concat(F.lit("(?is)^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\?", "."), F.lit("$"))


def matching(texts: DataFrame, patterns: DataFrame, text: str, glob: str) -> DataFrame:
    """(text, *columns of patterns) where a distinct text as a whole matches a shell pattern (* and ?), whatever the
    case: who contains the pattern's longest literal piece is tried by its regular expression."""
    piece = F.array_max(F.transform(F.split(glob, r"[*?]+"), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    met = containing(texts, patterns.withColumn("_piece", piece), text, "_piece")
    return met.where(F.regexp_like(F.col(text), glob_regex(F.col(glob)))).drop("_piece")
