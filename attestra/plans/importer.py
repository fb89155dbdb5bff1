"""The import pipeline: scan, type, relate, hash and dedup, copy, validate, rename, metadata,
sidecars, manifest. Each stage with effects ends in a stage table (Parquet) below the session's
folder; a resumed session reads the tables that are there and goes on after them."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions.filetype import detect_type, import_category, is_sidecar, is_skipped
from attestra.functions.hashing import hash_of
from attestra.functions.paths import renamed
from attestra.operators import dedup, registry, related
from attestra.sources import extractors, sinks
from attestra.sources.fsscan import scan

VERSION = "1.0"


class Session:
    """A folder of stage tables: the state of one import."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def has(self, stage: str) -> bool:
        return os.path.exists(os.path.join(self.folder, stage, "_SUCCESS"))

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of a stage, made if it is not there yet."""
        at = os.path.join(self.folder, name)
        if not self.has(name):
            make().write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)

    def status(self) -> dict[str, bool]:
        return {s: self.has(s) for s in ("scanned", "hashed", "copied", "validated", "named", "metadata", "sidecars")}


def existing_hashes(spark: SparkSession, destination: str) -> DataFrame:
    """(hash) of what the destination holds already."""
    return scan(spark, destination, content=True).select(hash_of(F.col("content"), "blake3-full").alias("hash")).where("hash is not null")


def run_import(
    spark: SparkSession, source: str, destination: str, session_dir: str, *, session_id: str | None = None, exclude: list[str] | None = None, dedup_files: bool = True, existing: DataFrame | None = None,
    path_builder: Callable[[Column, Column], Column] | None = None, verify: bool = True, rename: bool = False, sidecar: bool = False, manifest: bool = False, host: str = "spark", user: str = "spark", dry_run: bool = False,
) -> DataFrame:
    """The files of an import with their final status: skipped, error, planned, copied or validated.

    existing (hash): known contents; if given, the destination is not scanned for them. path_builder makes a file's
    place below the destination from its relative path and hash. A missing source is an import of no files.
    """
    session_id = session_id or uuid.uuid4().hex
    s = Session(spark, os.path.join(session_dir, session_id))

    def scanned() -> DataFrame:
        f = scan(spark, source, includeHidden=False, content=True, **({"exclude": exclude} if exclude is not None else {})).where("rel_path <> ''")
        kind = detect_type(F.col("path"), F.col("content"))
        f = f.select("path", "rel_path", "size", "mtime", "error", kind.alias("found"), hash_of(F.col("content"), "blake3-full").alias("hash"))
        groups = related.related_files(f)
        f = related.with_group(f, groups)
        status = F.when(F.col("error").isNotNull(), "error").when(is_skipped(F.col("path")) | is_sidecar(F.col("path")), "skipped").otherwise("pending")
        return f.select("path", "rel_path", "size", "mtime", "error", "hash", F.col("found.mime").alias("mime"), import_category(F.col("found.category")).alias("category"), F.col("found.subcategory").alias("subcategory"), F.col("found.mismatch").alias("mismatch"), F.col("found.ext").alias("ext"), F.col("group_id"), "is_primary", status.alias("status"))

    files = s.stage("scanned", scanned)

    def hashed() -> DataFrame:
        todo = files.where("status = 'pending'").drop("status")
        known = existing
        if known is None and dedup_files:
            known = existing_hashes(spark, destination) if os.path.isdir(destination) else None
        return dedup.import_dedup(todo, known, dedup_files).unionByName(files.where("status <> 'pending'"))

    h = s.stage("hashed", hashed)
    short = F.substring("hash", 1, 16)
    place = path_builder(F.col("rel_path"), F.col("hash")) if path_builder else F.col("rel_path")
    h = h.withColumn("hash_short", short).withColumn("dest_path", F.concat_ws("/", F.lit(destination.rstrip("/")), place))
    if dry_run:
        return h.withColumn("status", F.when(F.col("status") == "hashed", "planned").otherwise(F.col("status")))
    side = related.companions(files.select("path")).join(h.where("status = 'hashed'").select("path", "dest_path"), "path")
    extra = side.select(F.col("companion").alias("source"), F.concat(F.regexp_replace("dest_path", r"/[^/]*$", "/"), F.regexp_extract("companion", r"([^/]*)$", 1)).alias("destination"))
    mine = h.where("status = 'hashed'").select(F.col("path").alias("source"), F.col("dest_path").alias("destination"))
    extra = extra.join(mine, "destination", "left_anti").select("source", "destination").dropDuplicates(["destination"])
    copied = s.stage("copied", lambda: sinks.copy_files(mine.withColumn("own", F.lit(True)).unionByName(extra.withColumn("own", F.lit(False))).select("source", "destination"), "blake3-full", verify, dry_run=False))
    done = copied.select(F.col("source").alias("path"), F.col("hash").alias("dest_hash"), F.col("status").alias("_copy"), F.col("error").alias("_error"))
    status = F.when(F.col("status") != "hashed", F.col("status")).when(F.col("_copy") != "copied", "error").when(F.lit(verify) & (F.col("dest_hash") != F.col("hash")), "error").otherwise("validated" if verify else "copied")
    out = s.stage("validated", lambda: h.join(done, "path", "left").withColumn("status", status).withColumn("error", F.coalesce("error", "_error")).drop("_copy", "_error"))
    good = F.col("status").isin("copied", "validated")
    if rename:

        def named() -> DataFrame:
            new = renamed(F.col("dest_path"), F.col("hash"), "{hash}{ext}")
            plan = out.where(good).select(F.col("dest_path").alias("path"), new.alias("keep"), F.lit("rename").alias("action"), F.col("size").alias("freed")).where("keep is not null")
            r = sinks.execute(plan, dry_run=False).where("status = 'done'").select(F.col("path").alias("dest_path"), F.lit(True).alias("_ok"))
            j = out.join(r, "dest_path", "left").withColumn("_new", new)
            return j.withColumn("dest_path", F.when(F.coalesce("_ok", F.lit(False)), F.col("_new")).otherwise(F.col("dest_path"))).drop("_ok", "_new")

        out = s.stage("named", named)
    if sidecar:

        def metadata() -> DataFrame:
            content = scan(spark, destination, includeHidden=True, exclude="", content=True).select(F.col("path").alias("dest_path"), "content")
            return extractors.extract(out.where(good).select("dest_path").join(content, "dest_path"), key="dest_path")

        tags = s.stage("metadata", metadata)
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        numbered = related.number_in_order(out.where(good).select("path"), "path", "batch_sequence")
        r = out.where(good).join(numbered, "path").join(tags.select("dest_path", "tags"), "dest_path", "left")
        event = sinks.new_custody_event("ingestion", "success", F.current_timestamp(), host, user, f"attestra {VERSION}", F.col("hash"), F.uuid())
        fields = {
            "schema_version": F.lit("3"), "sidecar_created": now, "sidecar_updated": now, "content_hash": short, "content_hash_full": F.col("hash"), "hash_algorithm": F.lit("blake3"), "file_size": F.col("size"), "verified": F.lit(verify), "source_hash": F.col("hash"), "dest_hash": F.col("dest_hash"),
            "hash_match": F.col("hash") == F.col("dest_hash"), "file_category": F.col("category"), "file_subcategory": F.col("subcategory"), "detected_mime_type": F.col("mime"), "declared_extension": F.col("ext"), "extension_mismatch": F.col("mismatch"), "source_path": F.col("path"),
            "source_filename": F.regexp_extract("path", r"([^/]*)$", 1), "source_host": F.lit(host), "source_type": F.lit("local_disk"), "import_timestamp": now, "session_id": F.lit(session_id), "tool_version": F.lit(VERSION), "import_user": F.lit(user), "batch_sequence": F.col("batch_sequence"),
            "dedup_status": F.lit("unique"), "is_primary_file": F.col("is_primary"), "first_seen": now, "event_count": F.lit("1"), "custody": F.array(event),
        }
        rec = r.select(F.concat(F.col("dest_path"), F.lit(".xmp")).alias("path"), *[(v if k == "custody" else v.cast("string")).alias(k) for k, v in fields.items()])
        s.stage("sidecars", lambda: sinks.write_documents(rec.select("path", sinks.sidecar_text(rec.columns).alias("text"))))
    if manifest:
        text = sinks.manifest_document(sinks.import_manifest(out), destination, "blake3", 64).first()[0]
        with open(os.path.join(destination, "manifest.json"), "w", encoding="utf-8") as f:
            f.write(text)
    return out


def counters(files: DataFrame) -> DataFrame:
    return registry.import_counters(files)
