"""Duplicate detection over any relation with a content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Members of a group that are listed in one row.
MOST_LISTED = 100_000


def classes(rows: DataFrame, by: str, key: str, *more) -> DataFrame:
    """(by, representative, n, *more): a row for each value of by that is not null, whatever the number of its rows;
    representative is the smallest key; more: further aggregates."""
    return rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.min(key).alias("representative"), F.count("*").alias("n"), *more)


def listed(rows: DataFrame, found: DataFrame, by: str, key: str, out: str, most: int = MOST_LISTED) -> DataFrame:
    """Classes found (by, n, ...) with out: the sorted keys of their rows, null for a class of more than most; members() has these."""
    small = rows.join(found.where(F.col("n") <= most).select(by), by, "left_semi")
    return found.join(small.groupBy(by).agg(F.sort_array(F.collect_list(key)).alias(out)), by, "left")


def duplicate_classes(files: DataFrame, key: str = "path", hash_col: str = "hash", size: str = "size", min_size: int = 1) -> DataFrame:
    """(hash, representative, n, size, wasted) of each content that occurs more than once: a row of fixed width for any
    number of copies. Rows below min_size or without a hash take no part; the size is that of the representative, the first by key."""
    rows = files.where(F.col(size) >= min_size).select(F.col(hash_col).alias("hash"), key, F.col(size).alias("_size"))
    found = classes(rows, "hash", key, F.min_by("_size", key).cast("long").alias("size")).where("n > 1")
    return found.withColumn("wasted", (F.col("n") - 1) * F.col("size"))


def members(files: DataFrame, found: DataFrame, key: str = "path", hash_col: str = "hash", size: str = "size", min_size: int = 1) -> DataFrame:
    """(key, hash, representative) of every row of the classes found: a row a copy. The classes side of the join has
    one row a hash, so that a content with most rows is split like any skewed side, or meets them by broadcast."""
    rows = files.where(F.col(size) >= min_size).select(key, F.col(hash_col).alias("hash"))
    return rows.join(found.select("hash", "representative"), "hash").select(key, "hash", "representative")


def duplicate_groups(files: DataFrame, key: str = "path", hash_col: str = "hash", size: str = "size", min_size: int = 1, most: int = MOST_LISTED) -> DataFrame:
    """duplicate_classes() as (hash, size, n, files, wasted) with the members in order of key; files is null for a
    content of more than most copies, of which members() gives the rows."""
    found = duplicate_classes(files, key, hash_col, size, min_size)
    rows = files.where(F.col(size) >= min_size).select(F.col(hash_col).alias("hash"), key)
    return listed(rows, found, "hash", key, "files", most).select("hash", "size", "n", "files", "wasted")


def duplicate_rollup(files: DataFrame, key: str = "path", hash_col: str = "hash", size: str = "size", min_size: int = 1) -> DataFrame:
    """One row: total_files, unique_files, duplicate_groups, duplicate_count, wasted_bytes. A row
    without a hash counts in total_files alone."""
    rows = files.where(F.col(size) >= min_size)
    by_hash = rows.groupBy(hash_col).agg(F.count("*").alias("n"), F.min_by(F.col(size), F.col(key)).cast("long").alias("s"))
    real = F.col(hash_col).isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return by_hash.agg(
        zero(F.sum("n")).alias("total_files"),
        F.count_if(real).alias("unique_files"),
        F.count_if(real & (F.col("n") > 1)).alias("duplicate_groups"),
        zero(F.sum(F.when(real, F.col("n") - 1))).alias("duplicate_count"),
        zero(F.sum(F.when(real, (F.col("n") - 1) * F.col("s")))).alias("wasted_bytes"),
    )


def duplicate_actions(files: DataFrame, action: str = "delete", key: str = "path", hash_col: str = "hash", size: str = "size", min_size: int = 1) -> DataFrame:
    """The plan of a hardlink or delete run: each member of a group but the first in order of key,
    with what it is a copy of and the bytes that its removal frees. The hash's first key is a
    grouped minimum, so a content with most rows is never gathered in one window."""
    rows = files.where(F.col(hash_col).isNotNull() & (F.col(size) >= min_size))
    keep = rows.groupBy(hash_col).agg(F.min(key).alias("keep"))
    j = rows.join(keep, hash_col).where(F.col(key) > F.col("keep"))
    return j.select(F.col(key), "keep", F.col(hash_col).alias("hash"), F.lit(action).alias("action"), F.col(size).cast("long").alias("freed"))


def import_dedup(files: DataFrame, known: DataFrame | None = None, dedup: bool = True, key: str = "path", hash_col: str = "hash") -> DataFrame:
    """files with status: 'skipped' where the hash is among known (hash) or, within the source, not
    the first in order of key; 'hashed' otherwise, 'error' without a hash. With neither option
    nothing is skipped; known is used even when dedup is off, and within-source copies are then
    skipped as well."""
    out = files
    seen = F.lit(False)
    if known is not None:
        out = out.join(known.select(F.col("hash").alias("_known")).where("_known is not null").distinct(), F.col(hash_col) == F.col("_known"), "left")
        seen = F.col("_known").isNotNull()
    if known is not None or dedup:
        first = files.where(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("_h")).agg(F.min(key).alias("_first"))
        out = out.join(first, F.col(hash_col) == F.col("_h"), "left")
        seen = seen | (F.col(key) > F.col("_first"))
    status = F.when(F.col(hash_col).isNull(), "error").when(seen, "skipped").otherwise("hashed")
    return out.withColumn("status", status).drop("_known", "_h", "_first")


def keep_latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row of each key: that of the largest order value; of equal ones the largest in the order of all columns."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("_o"), *others)).alias("_b"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_b.{c}").alias(c) for c in rows.columns])


def by_waste(groups: DataFrame) -> DataFrame:
    """Duplicate groups, those that waste most first, ties by hash."""
    return groups.orderBy(F.desc("wasted"), "hash")
