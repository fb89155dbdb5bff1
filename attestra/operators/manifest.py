"""Manifest algebra: relations of (path, hash, size) compared, verified, audited and updated.

Two digests may have different lengths (a short and a full form of one hash); verification
compares as many digits as the shorter has. A path that a manifest lists twice counts once, with
its greatest hash, since a relation has no last row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions.hashing import matches_prefix

from . import dedup


def entries(manifest: DataFrame, path: str = "path", hash_col: str = "hash") -> DataFrame:
    """(path, hash), one row a path."""
    return manifest.groupBy(F.col(path).alias("path")).agg(F.max(hash_col).alias("hash"))


def diff(old: DataFrame, new: DataFrame, keep_unchanged: bool = True) -> DataFrame:
    """(path, status, old_hash, new_hash): added, removed, modified or unchanged; size and time play no part."""
    a = entries(old).select("path", F.col("hash").alias("old_hash"), F.lit(True).alias("_old"))
    b = entries(new).select("path", F.col("hash").alias("new_hash"), F.lit(True).alias("_new"))
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "unchanged").otherwise("modified")
    out = a.join(b, "path", "full_outer").select("path", status.alias("status"), "old_hash", "new_hash")
    return out if keep_unchanged else out.where("status <> 'unchanged'")


def diff_counts(changes: DataFrame) -> DataFrame:
    """One row: added, removed, modified, unchanged."""
    return changes.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "modified", "unchanged")])


def verify(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, status, expected, actual) of each manifest entry against files (path, hash, and error
    where a file could not be read): matched, mismatched, missing or unreadable."""
    error = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    actual = files.select("path", F.col("hash").alias("actual"), error.alias("_error"), F.lit(True).alias("_there"))
    j = entries(manifest).withColumnRenamed("hash", "expected").join(actual, "path", "left")
    status = (
        F.when(F.col("_there").isNull(), "missing")
        .when(F.col("_error").isNotNull() | F.col("actual").isNull(), "unreadable")
        .when(F.coalesce(matches_prefix(F.col("actual"), F.col("expected")), F.lit(False)), "matched")
        .otherwise("mismatched")
    )
    return j.select("path", status.alias("status"), "expected", "actual")


def extra_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """The files that no entry lists."""
    return files.join(manifest.select("path").distinct(), "path", "left_anti")


def audit(manifest: DataFrame, files: DataFrame, strict: bool = True) -> DataFrame:
    """verify(), and with strict a row of status extra for each file that no entry lists."""
    out = verify(manifest, files)
    if strict:
        more = extra_files(manifest, files).select("path", F.lit("extra").alias("status"), F.lit(None).cast("string").alias("expected"), F.col("hash").alias("actual"))
        out = out.unionByName(more)
    return out


def audit_classes(audited: DataFrame) -> DataFrame:
    """(hash, representative, n) of actual contents that several readable entries share, mismatched ones included: a row
    of fixed width for any number of entries."""
    rows = audited.where(F.col("status").isin("matched", "mismatched"))
    return dedup.classes(rows.select(F.col("actual").alias("hash"), "path"), "hash", "path").where("n > 1")


def audit_duplicates(audited: DataFrame, most: int = dedup.MOST_LISTED) -> DataFrame:
    """audit_classes() as (hash, n, files) with their entries in order; files is null beyond most entries."""
    rows = audited.where(F.col("status").isin("matched", "mismatched")).select(F.col("actual").alias("hash"), "path")
    return dedup.listed(rows, audit_classes(audited), "hash", "path", "files", most).select("hash", "n", "files")


def audit_rollup(audited: DataFrame) -> DataFrame:
    """One row: total, matched, mismatched, missing, extra, unreadable, duplicate_groups, valid, severity.

    valid: no entry is mismatched, missing or unreadable. severity is the exit code of an audit:
    10 mismatched, 11 missing, 12 extra, 13 duplicates, 14 unreadable, 0 otherwise, the first that holds.
    """
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    twice = audited.where(F.col("status").isin("matched", "mismatched")).groupBy("actual").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_groups"))
    one = audited.agg(F.count_if(F.col("status") != "extra").alias("total"), *map(count, ("matched", "mismatched", "missing", "extra", "unreadable"))).crossJoin(twice)  # one row each
    severity = F.lit(0)
    for code, c in reversed([(10, "mismatched"), (11, "missing"), (12, "extra"), (13, "duplicate_groups"), (14, "unreadable")]):
        severity = F.when(F.col(c) > 0, code).otherwise(severity)
    return one.withColumn("valid", (F.col("mismatched") + F.col("missing") + F.col("unreadable")) == 0).withColumn("severity", severity)


def check_code(rollup: DataFrame) -> DataFrame:
    """The rollup with exit_code of a plain check: 2 missing, else 1 mismatched, else 0."""
    return rollup.withColumn("exit_code", F.when(F.col("missing") > 0, 2).when(F.col("mismatched") + F.col("unreadable") > 0, 1).otherwise(0))


def update(files: DataFrame, old: DataFrame) -> DataFrame:
    """(path, hash, size) of an incremental manifest: a path that old lists keeps its entry as it
    is; others get the file's own; entries whose file is gone drop out."""
    o = old.groupBy("path").agg(F.max(F.struct("hash", "size")).alias("_old"))
    return files.join(o, "path", "left").select("path", F.coalesce("_old.hash", files["hash"]).alias("hash"), F.when(F.col("_old").isNotNull(), F.col("_old.size")).otherwise(files["size"]).alias("size"))


def totals(manifest: DataFrame) -> DataFrame:
    """One row: file_count, total_bytes."""
    return manifest.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes"))


def oxum(payload: DataFrame) -> DataFrame:
    """One row: oxum, 'bytes.count' of (size)."""
    return totals(payload).select(F.concat_ws(".", "total_bytes", "file_count").alias("oxum"))


def bag_verify(manifest: DataFrame, payload: DataFrame, tag_manifest: DataFrame | None = None, tag_files: DataFrame | None = None) -> DataFrame:
    """(scope, path, status, expected, actual): payload entries verified, payload files that no
    entry lists (extra), and tag entries verified."""
    out = audit(manifest, payload).withColumn("scope", F.lit("payload"))
    if tag_manifest is not None and tag_files is not None:
        out = out.unionByName(verify(tag_manifest, tag_files).withColumn("scope", F.lit("tag")))
    return out.select("scope", "path", "status", "expected", "actual")


def bag_rollup(verified: DataFrame, payload: DataFrame, declared_oxum: str | None = None) -> DataFrame:
    """One row: matched, mismatched, missing, extra, oxum_matches (null if none is declared), valid.
    Extra files do not make a bag invalid; the Oxum counts manifest entries and bytes of readable ones."""
    size = payload.select("path", "size")
    j = verified.join(size, "path", "left")
    pay = F.col("scope") == "payload"
    listed = pay & (F.col("status") != "extra")
    r = j.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("matched", "mismatched", "missing", "unreadable", "extra")],
        F.concat_ws(".", F.coalesce(F.sum(F.when(listed & F.col("status").isin("matched", "mismatched"), F.col("size"))), F.lit(0)).cast("long"), F.count_if(listed)).alias("oxum"),
    )
    same = F.lit(None).cast("boolean") if declared_oxum is None else F.col("oxum") == declared_oxum
    r = r.withColumn("oxum_matches", same)
    return r.withColumn("valid", (F.col("mismatched") + F.col("missing") + F.col("unreadable") == 0) & F.coalesce("oxum_matches", F.lit(True)))


def hash_list_verify(listed: DataFrame, files: DataFrame) -> DataFrame:
    """(path, status) of a media hash list (path, xxh64, md5) against files (path, xxh64, md5):
    the first of the two that the list has is compared; an entry with neither is mismatched."""
    f = files.select("path", F.col("xxh64").alias("_x"), F.col("md5").alias("_m"), F.lit(True).alias("_there"))
    expected = F.coalesce(F.nullif(F.col("xxh64"), F.lit("")), F.nullif(F.col("md5"), F.lit("")))
    actual = F.when(F.nullif(F.col("xxh64"), F.lit("")).isNotNull(), F.col("_x")).otherwise(F.col("_m"))
    status = F.when(F.col("_there").isNull(), "missing").when(F.coalesce(F.lower(expected) == F.lower(actual), F.lit(False)), "valid").otherwise("mismatched")
    return listed.join(f, "path", "left").select("path", status.alias("status"))
