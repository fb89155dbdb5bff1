"""The registered queries of the reference operators over the given tables, and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import filetype, hashing, ids, imagehash, metadata, paths
from attestra.operators import content, dedup, gps, graph, manifest, registry, related, versioned
from attestra.sources import documents, sinks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents seen as files: path (doc_id), hash (SHA-256 of the text), size (bytes)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2(F.col("text"), 256).alias("hash"), F.octet_length("text").cast("long").alias("size"))


# --- duplicates ----------------------------------------------------------------------------------


@query("""SELECT sha256(text) AS hash, CAST(min(strlen(text)) AS BIGINT) AS size, count(*) AS n, CAST((count(*) - 1) * min(strlen(text)) AS BIGINT) AS wasted,
                 array_to_string(list_sort(list(doc_id)), ',') AS files
          FROM documents WHERE strlen(text) >= 1 GROUP BY 1 HAVING count(*) > 1""")
def dedup_groups(spark, sf_dir):
    g = dedup.duplicate_groups(document_files(spark, sf_dir))
    return g.select("hash", "size", "n", "wasted", F.array_join(F.col("files").cast("array<string>"), ",").alias("files"))


@query("""SELECT sha256(text) AS hash, min(doc_id) AS representative, count(*) AS n, CAST(min(strlen(text)) AS BIGINT) AS size, CAST((count(*) - 1) * min(strlen(text)) AS BIGINT) AS wasted
          FROM documents WHERE strlen(text) >= 1 GROUP BY 1 HAVING count(*) > 1""")
def duplicate_classes(spark, sf_dir):
    return dedup.duplicate_classes(document_files(spark, sf_dir))


@query("""SELECT path, hash, representative FROM (SELECT doc_id AS path, sha256(text) AS hash, min(doc_id) OVER (PARTITION BY sha256(text)) AS representative, count(*) OVER (PARTITION BY sha256(text)) AS n
          FROM documents WHERE strlen(text) >= 1) WHERE n > 1""")
def duplicate_members(spark, sf_dir):
    f = document_files(spark, sf_dir)
    return dedup.members(f, dedup.duplicate_classes(f))


@query("""WITH g AS (SELECT sha256(text) AS h, count(*) AS n, min(strlen(text)) AS s FROM documents WHERE strlen(text) >= 1 GROUP BY 1)
          SELECT CAST(sum(n) AS BIGINT) AS total_files, count(*) AS unique_files, count(*) FILTER (n > 1) AS duplicate_groups,
                 CAST(sum(n - 1) AS BIGINT) AS duplicate_count, CAST(sum((n - 1) * s) AS BIGINT) AS wasted_bytes FROM g""")
def dedup_rollup(spark, sf_dir):
    return dedup.duplicate_rollup(document_files(spark, sf_dir))


@query("""WITH f AS (SELECT doc_id AS path, sha256(text) AS hash, strlen(text) AS size FROM documents WHERE strlen(text) >= 1),
               k AS (SELECT *, min(path) OVER (PARTITION BY hash) AS keep FROM f)
          SELECT path, keep, hash, 'delete' AS action, CAST(size AS BIGINT) AS freed FROM k WHERE path > keep""")
def duplicate_actions(spark, sf_dir):
    return dedup.duplicate_actions(document_files(spark, sf_dir))


@query("""WITH f AS (SELECT doc_id AS path, sha256(text) AS hash, strlen(text) AS size FROM documents),
               k AS (SELECT DISTINCT hash FROM f WHERE path % 10 = 0), n AS (SELECT * FROM f WHERE path % 10 <> 0)
          SELECT path, hash, CAST(size AS BIGINT) AS size, CASE WHEN hash IN (SELECT hash FROM k) OR row_number() OVER (PARTITION BY hash ORDER BY path) > 1 THEN 'skipped' ELSE 'hashed' END AS status FROM n""")
def import_dedup(spark, sf_dir):
    f = document_files(spark, sf_dir)
    return dedup.import_dedup(f.where("path % 10 <> 0"), f.where("path % 10 = 0").select("hash"))


@query("""WITH f AS (SELECT doc_id AS path, sha256(text) AS hash FROM documents),
               s AS (SELECT CASE WHEN row_number() OVER (PARTITION BY hash ORDER BY path) > 1 THEN 'skipped' ELSE 'hashed' END AS status FROM f)
          SELECT count(*) AS total, 0::BIGINT AS processed, count(*) FILTER (status = 'skipped') AS duplicates, 0::BIGINT AS errors, count(*) FILTER (status = 'hashed') AS waiting FROM s""")
def import_counters(spark, sf_dir):
    return registry.import_counters(dedup.import_dedup(document_files(spark, sf_dir)))


# --- hashes and ids ------------------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def multi_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


@query()
def content_hashes(spark, sf_dir):
    return hashing.all_hashes(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text")


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def content_digests(spark, sf_dir):
    """What SQL can tell of content_hashes."""
    h = hashing.all_hashes(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return h.select("doc_id", "md5", "sha256")


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, CAST(greatest(1, ceil(strlen(text) / 2048.0)) AS BIGINT) AS parts, md5(text) AS md5, true AS agrees FROM documents")
def content_in_parts(spark, sf_dir):
    """Documents cut into parts of 2 KiB: their number, the MD5 of the parts joined again, and whether the tree over them has the digest of the whole text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = content.parts_of(d, "doc_id", "text", 2048)
    joined = parts.groupBy("doc_id").agg(F.max("size").alias("size"), F.count("*").alias("parts"), F.array_sort(F.collect_list(F.struct("part", F.hex("bytes").alias("x")))).alias("xs"))
    whole = content.whole_digests(d, "doc_id", "text")
    j = joined.join(content.tree_digests(parts, "doc_id", 2048), "doc_id").join(whole, "doc_id")
    md5 = F.md5(F.unhex(F.array_join(F.transform("xs", lambda x: x["x"]), "")))
    return j.select("doc_id", "size", "parts", md5.alias("md5"), (F.col("blake3") == F.col("whole")).alias("agrees"))


HASHES = "SELECT doc_id, md5(text) AS h FROM documents UNION ALL SELECT doc_id, sha256(text) FROM documents UNION ALL SELECT doc_id, upper(sha1(text)) FROM documents UNION ALL SELECT doc_id, substr(sha256(text), 1, 16) FROM documents"


@query(f"SELECT doc_id, h, CASE WHEN NOT regexp_full_match(h, '[0-9a-f]+') THEN NULL WHEN length(h) = 16 THEN 'blake3' WHEN length(h) = 32 THEN 'md5' WHEN length(h) = 64 THEN 'sha256' WHEN length(h) = 128 THEN 'sha512' END AS algorithm FROM ({HASHES})")
def detect_algorithm(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    every = F.array(F.md5("text"), F.sha2("text", 256), F.upper(F.sha1("text")), F.substring(F.sha2("text", 256), 1, 16))
    return d.select("doc_id", F.explode(every).alias("h")).select("doc_id", "h", hashing.detect_algorithm(F.col("h")).alias("algorithm"))


@query("SELECT doc_id, lower(sha256(text)) = lower(CASE WHEN doc_id % 7 = 0 THEN sha256(text || 'x') ELSE upper(sha256(text)) END) AS match FROM documents")
def verify_hashes(spark, sf_dir):
    expected = F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.upper(F.sha2("text", 256)))
    return table(spark, sf_dir, "documents").select("doc_id", hashing.verify(F.sha2("text", 256), expected).alias("match"))


@query("""WITH s AS (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(CAST(doc_id AS VARCHAR))) AS h FROM documents),
               v AS (SELECT doc_id, substr(h, 1, 12) || '5' || substr(h, 14, 3) || substr('89ab89ab89ab89ab', ('0x' || substr(h, 17, 1))::INT + 1, 1) || substr(h, 18, 15) AS u FROM s)
          SELECT doc_id, substr(u, 1, 8) || '-' || substr(u, 9, 4) || '-' || substr(u, 13, 4) || '-' || substr(u, 17, 4) || '-' || substr(u, 21, 12) AS uuid, 5 AS version, true AS valid FROM v""")
def uuid5(spark, sf_dir):
    u = table(spark, sf_dir, "documents").select("doc_id", ids.uuid5(F.col("doc_id").cast("string")).alias("uuid"))
    return u.select("doc_id", "uuid", ids.uuid_version(F.col("uuid")).alias("version"), ids.is_uuid(F.col("uuid")).alias("valid"))


@query("""WITH u AS (SELECT doc_id, upper(translate(substr(md5(CAST(doc_id AS VARCHAR)), 1, 26), 'abcdef', 'ABCDEF')) AS u FROM documents)
          SELECT doc_id, u AS ulid, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 11), lambda i: CAST(instr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', substr(u, i, 1)) - 1 AS BIGINT))), lambda a, x: a * 32 + x) AS BIGINT) AS millis, true AS valid FROM u""")
def ulid_time(spark, sf_dir):
    u = table(spark, sf_dir, "documents").select("doc_id", F.upper(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 26)).alias("ulid"))
    return u.select("doc_id", "ulid", ids.ulid_millis(F.col("ulid")).alias("millis"), ids.is_ulid(F.col("ulid")).alias("valid"))


@query()
def new_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    row = F.col("doc_id")
    return d.select("doc_id", ids.uuid4().alias("uuid4"), ids.uuid7(F.current_timestamp()).alias("uuid7"), ids.uuid1(row).alias("uuid1"), ids.ulid(row + 1).alias("ulid"), ids.monotonic_ulid(row + 1).alias("monotonic"), ids.random_ids(row).alias("random"), ids.id_of(row.cast("string")).alias("named"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'unknown' ELSE concat_ws('|', CASE WHEN doc_id % 2 = 0 THEN 'usb:054c:' || source END, CASE WHEN doc_id % 3 = 0 THEN 'media-sn:' || lang END, CASE WHEN doc_id % 2 = 1 AND doc_id % 3 > 0 THEN 'camera:x' END) END AS fingerprint FROM documents""")
def device_fingerprint(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    on = F.col("doc_id") % 5 != 4
    two, three = F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0
    none = F.lit(None).cast("string")
    return d.select("doc_id", hashing.device_fingerprint(F.when(on & two, "054c"), F.when(on & two, F.col("source")), none, none, F.when(on & three, F.col("lang")), F.when(on & ~two & ~three, "x")).alias("fingerprint"))


# --- manifests -----------------------------------------------------------------------------------

SPLIT = """old AS (SELECT doc_id AS path, sha256(text) AS hash, strlen(text) AS size FROM documents WHERE doc_id % 10 <> 1),
           new AS (SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS hash, strlen(text) AS size FROM documents WHERE doc_id % 10 <> 2)"""


def split(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two manifests of documents: one without ids ending in 1, one without those ending in 2 and with every seventh changed."""
    f = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text", F.octet_length("text").cast("long").alias("size"))
    changed = F.when(F.col("path") % 7 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256))
    return f.where("path % 10 <> 1").select("path", F.sha2("text", 256).alias("hash"), "size"), f.where("path % 10 <> 2").select("path", changed.alias("hash"), "size")


DIFF = "coalesce(old.path, new.path) AS path, CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'removed' WHEN old.hash = new.hash THEN 'unchanged' ELSE 'modified' END AS status"


@query(f"WITH {SPLIT} SELECT {DIFF}, old.hash AS old_hash, new.hash AS new_hash FROM old FULL JOIN new ON old.path = new.path")
def manifest_diff(spark, sf_dir):
    return manifest.diff(*split(spark, sf_dir))


@query(f"WITH {SPLIT}, d AS (SELECT {DIFF} FROM old FULL JOIN new ON old.path = new.path) SELECT " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("added", "removed", "modified", "unchanged")) + " FROM d")
def manifest_diff_counts(spark, sf_dir):
    return manifest.diff_counts(manifest.diff(*split(spark, sf_dir)))


VERIFY = "CASE WHEN new.path IS NULL THEN 'missing' WHEN old.hash = new.hash THEN 'matched' ELSE 'mismatched' END AS status, old.hash AS expected, new.hash AS actual FROM old LEFT JOIN new ON old.path = new.path"


@query(f"WITH {SPLIT} SELECT old.path, {VERIFY}")
def manifest_verify(spark, sf_dir):
    return manifest.verify(*split(spark, sf_dir))


@query(f"WITH {SPLIT} SELECT path, hash, CAST(size AS BIGINT) AS size FROM new WHERE path NOT IN (SELECT path FROM old)")
def extra_files(spark, sf_dir):
    return manifest.extra_files(*split(spark, sf_dir))


@query(f"""WITH {SPLIT}, v AS (SELECT {VERIFY}), e AS (SELECT count(*) AS n FROM new WHERE path NOT IN (SELECT path FROM old)),
                t AS (SELECT count(*) AS n FROM (SELECT actual FROM v WHERE status IN ('matched', 'mismatched') GROUP BY 1 HAVING count(*) > 1))
           SELECT count(*) AS total, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'mismatched') AS mismatched, count(*) FILTER (status = 'missing') AS missing,
                  (SELECT n FROM e) AS extra, 0::BIGINT AS unreadable, (SELECT n FROM t) AS duplicate_groups, false AS valid, 10 AS severity FROM v""")
def audit_rollup(spark, sf_dir):
    return manifest.audit_rollup(manifest.audit(*split(spark, sf_dir)))


@query(f"""WITH {SPLIT}, v AS (SELECT old.path, {VERIFY}) SELECT actual AS hash, count(*) AS n, array_to_string(list_sort(list(path)), ',') AS files FROM v WHERE status IN ('matched', 'mismatched') GROUP BY 1 HAVING count(*) > 1""")
def audit_duplicates(spark, sf_dir):
    d = manifest.audit_duplicates(manifest.audit(*split(spark, sf_dir)))
    return d.withColumn("files", F.array_join(F.col("files").cast("array<string>"), ","))


@query(f"WITH {SPLIT} SELECT new.path, coalesce(old.hash, new.hash) AS hash, CAST(coalesce(old.size, new.size) AS BIGINT) AS size FROM new LEFT JOIN old ON old.path = new.path")
def manifest_update(spark, sf_dir):
    old, new = split(spark, sf_dir)
    return manifest.update(new, old)


@query("SELECT CAST(sum(strlen(text)) AS VARCHAR) || '.' || CAST(count(*) AS VARCHAR) AS oxum FROM documents")
def oxum(spark, sf_dir):
    return manifest.oxum(document_files(spark, sf_dir))


@query(f"""WITH {SPLIT}, v AS (SELECT old.path, new.size, {VERIFY}), e AS (SELECT count(*) AS n FROM new WHERE path NOT IN (SELECT path FROM old))
           SELECT count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'mismatched') AS mismatched, count(*) FILTER (status = 'missing') AS missing, 0::BIGINT AS unreadable,
                  (SELECT n FROM e) AS extra, CAST(coalesce(sum(size) FILTER (status <> 'missing'), 0) AS VARCHAR) || '.' || CAST(count(*) AS VARCHAR) AS oxum, false AS oxum_matches, false AS valid FROM v""")
def bag_verify(spark, sf_dir):
    old, new = split(spark, sf_dir)
    return manifest.bag_rollup(manifest.bag_verify(old, new), new, "0.0")


@query(f"""WITH {SPLIT}, l AS (SELECT path, CASE WHEN path % 3 = 0 THEN hash END AS x, CASE WHEN path % 4 <> 0 THEN substr(hash, 1, 32) END AS m FROM old)
           SELECT l.path, CASE WHEN new.path IS NULL THEN 'missing' WHEN x IS NOT NULL AND x = new.hash THEN 'valid' WHEN x IS NULL AND m = substr(new.hash, 1, 32) THEN 'valid' ELSE 'mismatched' END AS status FROM l LEFT JOIN new ON l.path = new.path""")
def hash_list_verify(spark, sf_dir):
    old, new = split(spark, sf_dir)
    listed = old.select("path", F.when(F.col("path") % 3 == 0, F.col("hash")).alias("xxh64"), F.when(F.col("path") % 4 != 0, F.substring("hash", 1, 32)).alias("md5"))
    return manifest.hash_list_verify(listed, new.select("path", F.col("hash").alias("xxh64"), F.substring("hash", 1, 32).alias("md5")))


# --- GPS: views are files, clicks are waypoints, a user's clicks are a track ------------------------

EVENTS = "v AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'view'), w AS (SELECT user_id, event_id, epoch_us(ts) AS t, value AS lat, user_id / 7.0::DOUBLE AS lon FROM events WHERE event_type = 'click')"


def gps_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    files = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("file"), F.col("ts").alias("file_ts"))
    points = e.where("event_type = 'click'").select("user_id", F.lit(0).alias("track"), F.col("event_id").alias("seq"), "ts", F.col("value").alias("latitude"), (F.col("user_id") / F.lit(7.0)).alias("longitude"), F.lit(None).cast("double").alias("altitude"))
    return files, points


@query(f"""WITH {EVENTS}, j AS (SELECT v.user_id, v.event_id AS file, lat, lon, abs(w.t - v.t) AS d, row_number() OVER (PARTITION BY v.user_id, v.event_id ORDER BY abs(w.t - v.t), w.t, w.event_id) AS k
                                FROM v JOIN w ON v.user_id = w.user_id AND abs(w.t - v.t) <= 3600000000)
           SELECT user_id, file, lat AS latitude, lon AS longitude, CAST(NULL AS DOUBLE) AS altitude, d / 1e6::DOUBLE AS time_delta_s, 1 - d / 1e6::DOUBLE / 3600 AS confidence FROM j WHERE k = 1""")
def gps_nearest(spark, sf_dir):
    return gps.nearest_in_time(*gps_tables(spark, sf_dir), by=["user_id"])


@query(f"""WITH {EVENTS}, s AS (SELECT user_id, t AS t1, lead(t) OVER k AS t2, lat, lead(lat) OVER k AS lat2, lon, row_number() OVER k AS seg FROM w WINDOW k AS (PARTITION BY user_id ORDER BY t, event_id)),
                j AS (SELECT v.user_id, v.event_id AS file, lat + (lat2 - lat) * coalesce((v.t - t1)::DOUBLE / nullif((t2 - t1)::DOUBLE, 0), 0) AS latitude, lon AS longitude, least(v.t - t1, t2 - v.t) / 1e6::DOUBLE AS time_delta_s,
                             row_number() OVER (PARTITION BY v.user_id, v.event_id ORDER BY seg) AS k FROM v JOIN s ON v.user_id = s.user_id AND v.t BETWEEN t1 AND t2)
           SELECT user_id, file, round(latitude, 6) AS latitude, longitude, CAST(NULL AS DOUBLE) AS altitude, time_delta_s, 0.9::DOUBLE AS confidence FROM j WHERE k = 1""")
def gps_interpolate(spark, sf_dir):
    return gps.interpolated(*gps_tables(spark, sf_dir), by=["user_id"]).withColumn("latitude", F.round("latitude", 6))


@query("""SELECT user_id, count(*) AS points, min(value) AS south, max(value) AS north, min(user_id / 7.0::DOUBLE) AS west, max(user_id / 7.0::DOUBLE) AS east, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us
          FROM events WHERE event_type = 'click' GROUP BY 1""")
def gps_bounds(spark, sf_dir):
    b = gps.bounds(gps_tables(spark, sf_dir)[1], ["user_id"])
    return b.select("user_id", "points", "south", "north", "west", "east", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


@query(f"""WITH {EVENTS}, j AS (SELECT v.user_id, v.event_id AS path, lat, lon, row_number() OVER (PARTITION BY v.user_id, v.event_id ORDER BY abs(w.t - v.t), w.t, w.event_id) AS k FROM v JOIN w ON v.user_id = w.user_id AND abs(w.t - v.t) <= 3600000000),
                m AS (SELECT * FROM j WHERE k = 1)
           SELECT v.event_id AS path, CASE WHEN m.path IS NOT NULL THEN round(lat, 6) WHEN v.event_id % 2 = 0 THEN 7.0 END AS latitude, CASE WHEN m.path IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN v.event_id % 2 = 0 THEN 1 ELSE 0 END AS events,
                  CASE WHEN m.path IS NOT NULL THEN 'metadata_modification' ELSE 'ingestion' END AS last_action, v.event_id % 2 = 1 AS made FROM v LEFT JOIN m ON v.event_id = m.path WHERE v.event_id % 2 = 0 OR m.path IS NOT NULL""")
def gps_sidecars(spark, sf_dir):
    """Views with even ids have a sidecar with a place and an event; the waypoints that match go into these, or into new ones."""
    files, points = gps_tables(spark, sf_dir)
    m = gps.nearest_in_time(files, points, by=["user_id"]).withColumnRenamed("file", "path")
    event = F.struct(*[F.lit("ingestion" if t == "EventAction" else t).alias(documents.snake(t)) for t in sinks.EVENT_TAGS])
    photo = F.struct(F.lit("7.0").alias("gps_latitude"))
    records = files.where("file % 2 = 0").select(F.col("file").alias("path"), F.lit("h").alias("content_hash"), F.array(event).alias("custody"), photo.alias("photo"))
    known = files.select(F.col("file").alias("path"), F.sha2(F.col("file").cast("string"), 256).alias("content_hash"), F.lit(5).alias("file_size"))
    out = sinks.with_places(records, m, F.timestamp_seconds(F.lit(1_700_000_000)), "host", "user", "tool", "from a map", known)
    last = F.element_at("custody", -1)["event_action"]
    return out.select("path", F.round(F.col("photo.gps_latitude").cast("double"), 6).alias("latitude"), F.size("custody").alias("events"), last.alias("last_action"), (F.col("content_hash") != "h").alias("made"))


# --- similarity: the signs of an embedding are a 64-bit hash -----------------------------------------

SIGNS = "h AS (SELECT vec_id, list_reduce(list_prepend(0::UBIGINT, list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] >= 0 THEN CAST(1 AS UBIGINT) << i ELSE 0::UBIGINT END)), lambda a, x: a | x) AS h FROM embeddings)"


def sign_hashes(spark, sf_dir) -> DataFrame:
    bit = lambda x, i: F.when(x >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(F.transform("embedding", bit), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)).alias("h"))


@query(f"WITH {SIGNS} SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(a.h, b.h)) AS INT) AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.h, b.h)) <= 16")
def hamming_pairs(spark, sf_dir):
    return graph.hamming_pairs(sign_hashes(spark, sf_dir), "vec_id", "h", 16)


@query(f"""WITH RECURSIVE {SIGNS}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(a.h, b.h)) AS INT) AS d FROM h a JOIN h b ON a.vec_id <> b.vec_id WHERE bit_count(xor(a.h, b.h)) <= 20),
                r AS (SELECT a AS n, a AS m FROM p UNION SELECT r.n, p.b FROM r JOIN p ON r.m = p.a), c AS (SELECT n, min(m) AS root FROM r GROUP BY 1), s AS (SELECT root, count(*) AS size FROM c GROUP BY 1)
           SELECT c.root AS group_id, c.root AS representative, c.n AS member, CASE WHEN c.n = c.root THEN 0 ELSE coalesce(p.d, 20) END AS distance, s.size FROM c JOIN s USING (root) LEFT JOIN p ON p.a = c.root AND p.b = c.n""")
def similarity_groups(spark, sf_dir):
    return graph.Similar(sign_hashes(spark, sf_dir), "vec_id", "h", 20).groups()


@query(f"""WITH {SIGNS}, p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM h a JOIN h b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.h, b.h)) <= 16)
           SELECT (SELECT count(*) FROM h) AS processed, (SELECT count(*) FROM p) AS pairs, (SELECT count(*) FROM h) - (SELECT count(DISTINCT x) FROM (SELECT a AS x FROM p UNION ALL SELECT b FROM p)) AS unique""")
def similarity_counts(spark, sf_dir):
    return graph.Similar(sign_hashes(spark, sf_dir), "vec_id", "h", 16).counts()


@query(f"""WITH {SIGNS}, c AS (SELECT h, min(vec_id) AS representative, count(*) AS n FROM h GROUP BY h)
           SELECT a.representative, a.n, CAST(count(b.h) AS BIGINT) AS links, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS copies
           FROM c a LEFT JOIN c b ON a.h <> b.h AND bit_count(xor(a.h, b.h)) <= 16 GROUP BY a.h, a.representative, a.n""")
def similar_classes(spark, sf_dir):
    return graph.Similar(sign_hashes(spark, sf_dir), "vec_id", "h", 16).summary().drop("hash")


@query("""WITH m AS (SELECT vec_id, embedding, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding) AS m FROM embeddings)
          SELECT vec_id, bit_count(list_reduce(list_prepend(0::UBIGINT, list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1]::DOUBLE >= m THEN CAST(1 AS UBIGINT) << i ELSE 0::UBIGINT END)), lambda a, x: a | x))::INT AS bits,
                 round(list_sort(list_transform(embedding, lambda x: x::DOUBLE))[33], 9) AS upper_median FROM m""")
def grid_hash(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("g"))
    return e.select("vec_id", F.bit_count(imagehash.grid_ahash(F.col("g"))).cast("int").alias("bits"), F.round(metadata.upper_median(F.col("g")), 9).alias("upper_median"))


@query("""SELECT doc_id, CASE WHEN source <> '' AND lang <> '' THEN round(len(list_intersect(list_distinct(string_split(source, '')), list_distinct(string_split(lang, ''))))::DOUBLE / len(list_distinct(list_concat(string_split(source, ''), string_split(lang, '')))), 9) END AS jaccard FROM documents""")
def char_jaccard(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(graph.char_jaccard(F.col("source"), F.col("lang")), 9).alias("jaccard"))


# --- windows ---------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events),
               k AS (SELECT user_id FROM g GROUP BY 1 HAVING count(*) >= 3 AND max(gap) <= 2000)
          SELECT user_id, event_id, min(event_id) OVER (PARTITION BY user_id) AS first, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS place FROM events WHERE user_id IN (SELECT user_id FROM k)""")
def burst_sequences(spark, sf_dir):
    return related.sequences(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", "event_id", 2000)


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS seq FROM documents")
def batch_sequence(spark, sf_dir):
    return related.number_in_order(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("""SELECT user_id, round(list_reduce(list(value ORDER BY event_id), lambda a, x: 0.15 * x + 0.85 * a), 6) AS ewma, CAST(count(*) AS INT) AS n FROM events GROUP BY 1""")
def ewma(spark, sf_dir):
    return registry.ewma(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value").withColumn("ewma", F.round("ewma", 6))


@query("""SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1""")
def keep_latest(spark, sf_dir):
    return dedup.keep_latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_id")


@query("""SELECT l_linenumber, CASE l_linenumber WHEN 1 THEN 2.5 WHEN 2 THEN 6.0 WHEN 3 THEN 8.5 WHEN 4 THEN 22.5 WHEN 5 THEN 52.5 WHEN 6 THEN 75.0 ELSE 85.0 END::DOUBLE AS overall FROM (SELECT DISTINCT l_linenumber FROM lineitem)""")
def overall_percent(spark, sf_dir):
    steps = F.array(*[F.lit(n) for n, _ in registry.STEPS])
    d = table(spark, sf_dir, "lineitem").select("l_linenumber").distinct()
    return d.select("l_linenumber", registry.overall_percent(F.element_at(steps, F.col("l_linenumber")), F.lit(50.0)).alias("overall"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 >= 3 AND o_totalprice / (o_orderkey % 10 + 1) * 1000 <= 1e9 THEN o_totalprice / (o_orderkey % 10 + 1) * 1000 END AS eta FROM orders""")
def eta(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k, registry.eta_ms(F.col("o_totalprice"), k % 10 + 1, F.lit(0), F.lit(0), k % 6, F.lit(1e8)).alias("eta"))


# --- lookups, registries, custody ---------------------------------------------------------------------

RULES = [(1, "BRASS", "metal"), (2, "STEEL", "metal"), (3, "PROMO", "offer"), (4, "SMALL", "size"), (5, "ECONOMY", "size")]


@query("""WITH r AS (SELECT * FROM (VALUES (1, 'BRASS', 'metal'), (2, 'STEEL', 'metal'), (3, 'PROMO', 'offer'), (4, 'SMALL', 'size'), (5, 'ECONOMY', 'size')) t(priority, word, kind))
          SELECT p_partkey, p_type, (SELECT arg_min(kind, priority) FROM r WHERE contains(p_type, word)) AS kind FROM part""")
def priority_lookup(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "priority int, word string, kind string")
    return registry.first_match(table(spark, sf_dir, "part").select("p_partkey", "p_type"), rules, "p_partkey", F.expr("contains(p_type, word)"), "kind")


@query("""WITH m AS (SELECT * FROM (VALUES ('http', 'web'), ('https://', 'tls'), ('https://a', 'a')) t(mount, fs_type)), u AS (SELECT DISTINCT url FROM pages)
          SELECT url, arg_max(mount, length(mount)) AS mount, arg_max(fs_type, length(mount)) AS fs_type FROM u LEFT JOIN m ON starts_with(url, mount) GROUP BY 1""")
def longest_prefix(spark, sf_dir):
    mounts = spark.createDataFrame([("http", "web"), ("https://", "tls"), ("https://a", "a")], "mount string, fs_type string")
    return registry.longest_prefix(table(spark, sf_dir, "pages"), mounts, "url")


VENDOR_ROWS, PRODUCT_ROWS = (", ".join(map(str, rows)) for rows in (registry.VENDORS, registry.PRODUCTS))


@query(f"""WITH d AS (SELECT o_orderkey, [1193, 1356, 1921, 10007, 77, 7086, 1256][CAST(o_orderkey % 7 AS INT) + 1] AS vid, [12818, 2551, 1665, 256, 1, 12818, 2557][CAST(o_orderkey % 7 AS INT) + 1] + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS pid FROM orders)
           SELECT o_orderkey, vendor, category, device FROM d LEFT JOIN (VALUES {VENDOR_ROWS}) AS v(vid, vendor, category) ON d.vid = v.vid LEFT JOIN (VALUES {PRODUCT_ROWS}) AS p(vid, pid, device) ON d.vid = p.vid AND d.pid = p.pid""")
def known_vendors(spark, sf_dir):
    """Orders seen as devices that were plugged in, by the fixed tables of vendors and products."""
    k = F.col("o_orderkey")
    at = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (k % 7 + 1).cast("int")).cast("long")
    d = table(spark, sf_dir, "orders").select(k, at(1193, 1356, 1921, 10007, 77, 7086, 1256).alias("vid"), (at(12818, 2551, 1665, 256, 1, 12818, 2557) + F.when(k % 3 == 0, 1).otherwise(0)).alias("pid"))
    return registry.vendor_lookup(d).select("o_orderkey", "vendor", "category", "device")


PATHS = r"""f AS (SELECT p_partkey, '/' || lower(p_type) || '/' || replace(p_brand, '#', '_') || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || '.jpg' AS path,
                    CASE WHEN p_partkey % 3 = 0 THEN lower(split_part(p_name, ' ', 1)) END AS make, CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand || CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE '' END) END AS model,
                    CASE WHEN p_partkey % 2 = 0 THEN p_size * 30 END AS width, CASE WHEN p_partkey % 2 = 0 THEN p_size * 20 END AS height FROM part)"""


def part_files(spark, sf_dir) -> DataFrame:
    """Parts seen as picture files: path of type, brand, name and key; some with the maker (first word of the name) and model (brand), some with a frame size."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    path = F.concat(F.lit("/"), F.lower("p_type"), F.lit("/"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), k, F.lit(".jpg"))
    model = F.concat("p_brand", F.when(k % 2 == 0, "x").otherwise(""))
    return p.select(k, path.alias("path"), F.when(k % 3 == 0, F.split_part("p_name", F.lit(" "), F.lit(1))).alias("make"), F.when(k % 3 == 0, model).alias("model"), F.when(k % 2 == 0, F.col("p_size") * 30).alias("width"), F.when(k % 2 == 0, F.col("p_size") * 20).alias("height"))


@query(rf"""WITH {PATHS}, m AS (SELECT p_type AS t, p_brand AS b, min(p_partkey) AS k FROM part GROUP BY 1, 2),
                 mounts AS (SELECT '/' || lower(t) AS mount, min(k) AS kind FROM m GROUP BY 1 UNION ALL SELECT '/' || lower(t) || '/' || replace(b, '#', '_'), k FROM m WHERE k % 4 <> 0)
            SELECT f.path, arg_max(mount, length(mount)) AS mount, arg_max(kind, length(mount)) AS kind FROM f LEFT JOIN mounts ON starts_with(path, mount) GROUP BY 1""")
def part_mounts(spark, sf_dir):
    """Longest prefix among the folders of types, and of most pairs of type and brand."""
    m = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.min("p_partkey").alias("k"))
    top, below = F.concat(F.lit("/"), F.lower("p_type")), F.replace("p_brand", F.lit("#"), F.lit("_"))
    mounts = m.groupBy(top.alias("mount")).agg(F.min("k").alias("kind")).union(m.where("k % 4 <> 0").select(F.concat(top, F.lit("/"), below), "k"))
    return registry.longest_prefix(part_files(spark, sf_dir), mounts, "path", "mount", "kind")


@query(rf"""WITH {PATHS}, c AS (SELECT min(p_partkey) AS ord, p_brand AS id, lower(arg_min(split_part(p_name, ' ', 1), p_partkey)) AS make, lower(p_brand) AS model, lower(substr(p_brand, 1, 7)) AS variant,
                               arg_min(split_part(p_name, ' ', 2), p_partkey) AS word, '/' || lower(arg_min(p_type, p_partkey)) || '/' || replace(p_brand, '#', '_') || '/' AS folder FROM part GROUP BY p_brand),
                 x AS (SELECT p_partkey, arg_max(id, ord) AS id FROM f JOIN c USING (make, model) GROUP BY 1),
                 v AS (SELECT p_partkey, arg_min(id, (CASE WHEN f.model = v THEN CASE WHEN contains(f.make, c.make) THEN 0 ELSE 1 END ELSE 2 END)::BIGINT * 1000000000 + ord) AS id
                       FROM f JOIN (SELECT ord, id, make, model AS v FROM c UNION SELECT ord, id, make, variant FROM c) c ON f.model = v OR (contains(f.make, c.make) AND contains(f.model, v)) GROUP BY 1),
                 n AS (SELECT p_partkey, arg_min(id, ord) AS id FROM f JOIN c ON regexp_full_match(lower(split_part(path, '/', 4)), '.*_' || word || '_.?' || (ord % 10) || '[.]jpg') GROUP BY 1),
                 d AS (SELECT p_partkey, arg_min(id, ord) AS id FROM f JOIN c ON contains(lower(path), lower(folder)) GROUP BY 1)
            SELECT p_partkey, coalesce(x.id, v.id, n.id, d.id, 'unknown:' || CASE WHEN width IS NULL THEN NULL WHEN greatest(width, height) < 480 AND abs(width::DOUBLE / height - 4 / 3.0) < 0.1 THEN 'super8' WHEN greatest(width, height) < 720 THEN 'dadcam' ELSE 'modern' END) AS camera_id,
                   CASE WHEN coalesce(x.id, v.id) IS NOT NULL THEN 0.95 WHEN n.id IS NOT NULL THEN 0.8 WHEN d.id IS NOT NULL THEN 0.7 WHEN width IS NOT NULL THEN 0.3 END::DOUBLE AS confidence,
                   CASE WHEN coalesce(x.id, v.id) IS NOT NULL THEN 'exif' WHEN n.id IS NOT NULL THEN 'filename' WHEN d.id IS NOT NULL THEN 'folder' WHEN width IS NOT NULL THEN 'heuristic' END AS matched_by
            FROM f LEFT JOIN x USING (p_partkey) LEFT JOIN v USING (p_partkey) LEFT JOIN n USING (p_partkey) LEFT JOIN d USING (p_partkey)""")
def camera_match(spark, sf_dir):
    """A camera for each brand, with the maker, name pattern and folder of its first part."""
    word = lambda k: F.min_by(F.split_part("p_name", F.lit(" "), F.lit(k)), "p_partkey")
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("ord"), word(1).alias("make"), word(2).alias("word"), F.min_by("p_type", "p_partkey").alias("type"))
    names = F.array(F.concat(F.lit("*_"), "word", F.lit("_?"), F.col("ord") % 10, F.lit(".jpg")), F.concat(F.lit("*_"), "word", F.lit("_"), F.col("ord") % 10, F.lit(".jpg")))
    folders = F.array(F.concat(F.lit("*/"), F.lower("type"), F.lit("/"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("/*")))
    cameras = p.select("ord", F.col("p_brand").alias("id"), "make", F.col("p_brand").alias("model"), F.array(F.substring("p_brand", 1, 7)).alias("variants"), names.alias("filename_patterns"), folders.alias("folder_patterns"))
    return registry.camera_match(part_files(spark, sf_dir), cameras).select("p_partkey", "camera_id", "confidence", "matched_by")


@query("""SELECT p_partkey, CASE WHEN p_partkey < 0 THEN 'added' WHEN p_partkey % 5 = 0 THEN 'removed' ELSE 'modified' END AS change
          FROM (SELECT p_partkey, p_size FROM part UNION ALL SELECT -1 - p_partkey, 10 FROM part WHERE p_partkey % 7 = 0) WHERE p_partkey < 0 OR p_partkey % 5 = 0 OR (p_partkey % 3 = 0 AND p_size <> 10)""")
def versioned_parts(spark, sf_dir):
    """Parts as a table in versions: loaded, changed and added to, removed from; what changed between the first and the last."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    t = versioned.Versioned(spark, f"{graph.shared_dir(spark)}/parts-{uuid.uuid4().hex}", ["p_partkey"], "p_partkey long, p_name string, p_size int")
    t.upsert(p)
    changed = p.where("p_partkey % 3 = 0").withColumn("p_size", F.lit(10)).union(p.where("p_partkey % 7 = 0").withColumn("p_partkey", -1 - F.col("p_partkey")))
    t.upsert(changed)
    t.add(p.withColumn("p_size", F.lit(99)))  # all are there: they stay
    t.remove(p.where("p_partkey % 5 = 0"))
    return t.changes(1, 4)


@query("""WITH s AS (SELECT event_type AS extension, CAST(user_id AS VARCHAR) AS path, min(ts) AS t0 FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY extension ORDER BY t0, path) AS k FROM s)
          SELECT e.extension, e.n, (SELECT array_to_string(list(path ORDER BY k.k), ',') FROM k WHERE k.k <= 5 AND k.extension = e.extension) AS samples FROM (SELECT event_type AS extension, count(*) AS n FROM events GROUP BY 1) e""")
def unknown_extensions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("extension"), F.col("user_id").cast("string").alias("path"), F.col("ts").alias("seen_at"))
    return registry.unknown_extensions(e).select("extension", "n", F.array_join("samples", ",").alias("samples"))


@query("""WITH l AS (SELECT CAST(user_id AS VARCHAR) AS extension, event_type AS category, CASE WHEN event_type = 'purchase' THEN 'user' ELSE 'auto' END AS learned_by, value AS c, event_id FROM events WHERE value IS NOT NULL),
               k AS (SELECT *, row_number() OVER (PARTITION BY extension ORDER BY learned_by = 'user' DESC, event_id DESC) AS k FROM l)
          SELECT extension, category, learned_by, CASE WHEN learned_by = 'auto' THEN least(c, 0.9) ELSE c END AS confidence, event_id AS learned_at FROM k WHERE k = 1""")
def learn_extensions(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null")
    rows = e.select(F.col("user_id").cast("string").alias("extension"), F.col("event_type").alias("category"), F.when(F.col("event_type") == "purchase", "user").otherwise("auto").alias("learned_by"), F.col("value").alias("confidence"), F.col("event_id").alias("learned_at"))
    return registry.learn(rows.limit(0), rows)


@query("""SELECT conv_id, count(*) AS events, min(turn) AS first, max(turn) AS last, arg_max(role, turn) AS last_action FROM conversations GROUP BY 1""")
def custody_chain(spark, sf_dir):
    return registry.custody_chain(table(spark, sf_dir, "conversations").dropDuplicates(["conv_id", "turn"]), "conv_id", "turn", "role")


@query("""SELECT s_suppkey AS pid, s_nationkey AS vid, n_name AS vendor, CAST(n_regionkey AS VARCHAR) AS category, s_name AS device FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def vendor_lookup(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    devices = s.select(F.col("s_suppkey").alias("pid"), F.col("s_nationkey").alias("vid"))
    vendors = n.select(F.col("n_nationkey").alias("vid"), F.col("n_name").alias("vendor"), F.col("n_regionkey").cast("string").alias("category"))
    return registry.vendor_lookup(devices, vendors, s.select(F.col("s_nationkey").alias("vid"), F.col("s_suppkey").alias("pid"), F.col("s_name").alias("device")))


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, upper(c_name) FROM customer WHERE c_custkey % 3 = 0""")
def merge_registries(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return registry.merge_registries(c.where("c_custkey % 3 <> 0"), c.select("c_custkey", F.upper("c_name").alias("c_name")), "c_custkey")


# --- paths, types and values ---------------------------------------------------------------------------


@query(r"""SELECT page_id, regexp_replace(url, '/?[^/]*$', '') AS dir, regexp_extract(url, '([^/]*)$', 1) AS base, regexp_extract(regexp_extract(url, '([^/]*)$', 1), '[^.].*?(\.[^.]*)$', 1) AS ext, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages""")
def parse_path(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", paths.directory(u).alias("dir"), paths.base_name(u).alias("base"), paths.extension(u).alias("ext"), F.regexp_extract(u, "^https?://([^/]+)", 1).alias("host"))


NAMES = "n AS (SELECT p_partkey, p_partkey % 100 AS k, CASE p_partkey % 7 WHEN 0 THEN '/Volumes/EOS_DIGITAL/DCIM/100CANON/IMG_' || p_partkey || '.CR2' WHEN 1 THEN '/home/u/a b/x' || p_partkey || '.jpeg' WHEN 2 THEN '/mnt/nas/v' || p_partkey || '.mp4' WHEN 3 THEN '/data/.hidden' WHEN 4 THEN 'smb://s/' || p_partkey || '.flac' WHEN 5 THEN '/tmp/n' || p_partkey || '.tmp' ELSE '/a/b/c' || p_partkey END AS path FROM part)"


def part_paths(spark, sf_dir) -> DataFrame:
    """part as paths of several kinds."""
    k = F.col("p_partkey")
    forms = [F.concat(F.lit("/Volumes/EOS_DIGITAL/DCIM/100CANON/IMG_"), k, F.lit(".CR2")), F.concat(F.lit("/home/u/a b/x"), k, F.lit(".jpeg")), F.concat(F.lit("/mnt/nas/v"), k, F.lit(".mp4")), F.lit("/data/.hidden"), F.concat(F.lit("smb://s/"), k, F.lit(".flac")), F.concat(F.lit("/tmp/n"), k, F.lit(".tmp")), F.concat(F.lit("/a/b/c"), k)]
    path = forms[6]
    for i in range(6):
        path = F.when(k % 7 == i, forms[i]).otherwise(path)
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))


@query(f"""WITH {NAMES} SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'raw' WHEN 1 THEN 'image' WHEN 2 THEN 'video' WHEN 4 THEN 'audio' ELSE 'other' END AS category,
                  CASE p_partkey % 7 WHEN 0 THEN 'camera_media' WHEN 2 THEN 'network' WHEN 4 THEN 'network' ELSE 'local' END AS storage,
                  CASE p_partkey % 7 WHEN 0 THEN 'canon' END AS make, CASE p_partkey % 7 WHEN 0 THEN 'EOS_DIGITAL' END AS volume, p_partkey % 7 = 5 AS ignored,
                  p_partkey % 7 IN (0, 2) AS network_path, p_partkey % 7 = 1 AS glob FROM n""")
def classify_paths(spark, sf_dir):
    p = F.col("path")
    return part_paths(spark, sf_dir).select(
        "p_partkey", filetype.media_category(p).alias("category"), filetype.storage_type(p).alias("storage"), registry.camera_of_folder(p).alias("make"), paths.volume_name(p).alias("volume"),
        paths.ignored(paths.base_name(p)).alias("ignored"), paths.is_network_path(p).alias("network_path"), paths.simple_glob(p, "/home/*.jpeg").alias("glob"),
    )


@query(f"""WITH {NAMES} SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'known' WHEN 1 THEN 'image' WHEN 2 THEN 'video' WHEN 4 THEN 'audio' ELSE 'other' END AS category FROM n""")
def learned_category(spark, sf_dir):
    learned = spark.createDataFrame([(".cr2", "known")], "extension string, category string")
    f = part_paths(spark, sf_dir).withColumn("ext", paths.extension(F.col("path")))
    return registry.category_of(f, filetype.extension_table(spark), learned).select("p_partkey", "category")


@query("""SELECT doc_id, CASE WHEN b = 0 THEN '0 B' WHEN b < 1024 THEN printf('%.1f B', b::DOUBLE) WHEN b < 1048576 THEN printf('%.1f KB', round(b / 1024.0::DOUBLE, 1)) ELSE printf('%.1f MB', round(b / 1048576.0::DOUBLE, 1)) END AS size,
                 CASE WHEN s >= 3600 THEN (s // 3600) || 'h' || (s // 60 % 60) || 'm' || (s % 60) || 's' WHEN s >= 60 THEN (s // 60) || 'm' || (s % 60) || 's' ELSE s || 's' END AS duration
          FROM (SELECT doc_id, n_chars * 37 AS b, n_chars + 1 AS s FROM documents)""")
def format_values(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", paths.format_bytes(F.col("n_chars") * 37).alias("size"), paths.format_duration((F.col("n_chars") + 1) * 1000).alias("duration"))


@query("""SELECT page_id, nullif(regexp_extract(html, '<title(?:\\s[^>]*)?>([^<]*)</title>', 1), '') AS title FROM pages""".replace("\\\\", "\\"))
def extract_tag(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", paths.tag_text(F.col("html"), "title").alias("title"))


@query("""SELECT item_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped, true AS round_trip FROM benchmark""")
def xml_escape(spark, sf_dir):
    e = paths.xml_escape(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", e.alias("escaped"), (paths.xml_unescape(e) == F.col("text")).alias("round_trip"))


@query("""SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> ''))::INT AS words, length(text)::INT AS chars, substr(text, 1, 20) AS head, length(text) > 20 AS cut FROM conversations""".replace("\\\\", "\\"))
def text_stats(spark, sf_dir):
    t = metadata.truncated(F.col("text"), 20)
    words = F.size(F.filter(F.split("text", "[ \t\n\r]+"), lambda w: w != ""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("words"), F.length("text").alias("chars"), t["text"].alias("head"), t["truncated"].alias("cut"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || 'T01:02:03' AS taken, CASE o_orderkey % 3 WHEN 0 THEN 3723.5 WHEN 1 THEN 62.0 ELSE 12.5 END::DOUBLE AS seconds, CASE WHEN o_orderkey % 2 = 0 THEN 'f/2.8' END AS aperture,
                 '1/' || (o_orderkey % 8 + 2) AS shutter, 3661.25::DOUBLE AS cue, '10:20:30:04' AS timecode, round(30000 / 1001.0::DOUBLE, 9) AS rate FROM orders""")
def parse_values(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, "1:02:03.5").when(k % 3 == 1, "1:02").otherwise("12.5 s")
    return o.select(
        k, metadata.exif_iso(F.concat(F.date_format("o_orderdate", "yyyy:MM:dd"), F.lit(" 01:02:03"))).alias("taken"), metadata.seconds(raw).alias("seconds"), metadata.aperture(F.when(k % 2 == 0, F.lit(2.8))).alias("aperture"),
        metadata.shutter(1 / (k % 8 + 2)).alias("shutter"), metadata.cue_seconds(F.lit("01:01:01,250")).alias("cue"), metadata.timecode(F.lit("10203004")).alias("timecode"), F.round(filetype.frame_rate(F.lit("30000/1001")), 9).alias("rate"),
    )


@query("""SELECT d.doc_id, coalesce(nullif(CASE WHEN d.doc_id % 2 = 0 THEN '' ELSE d.lang END, ''), d.source) AS text, coalesce(l.quality, d.n_chars) AS number FROM documents d LEFT JOIN labels l USING (doc_id)""")
def merge_metadata(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    j = d.join(l, "doc_id", "left").select("doc_id", F.struct(F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang")).alias("text"), F.col("quality").cast("long").alias("number")).alias("a"), F.struct(F.col("source").alias("text"), F.col("n_chars").alias("number")).alias("b"))
    return j.select("doc_id", metadata.merged_struct("a", "b", ["text"], ["number"]).alias("m")).select("doc_id", "m.text", "m.number")


@query("""SELECT event_id, event_type AS a, coalesce(nullif(CASE WHEN event_id % 2 = 0 THEN '' ELSE 'p' END, ''), 's') AS b, CAST(user_id AS VARCHAR) AS gps, 'moi' AS taken FROM events""")
def merge_companions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)])
    primary = m(A=F.col("event_type"), B=F.when(F.col("event_id") % 2 == 0, "").otherwise("p"), GPSLatitude=F.lit("0"), DateTimeOriginal=F.lit("p"))
    sides = F.array(F.struct(F.lit(".srt").alias("ext"), m(B=F.lit("s"), GPSLatitude=F.col("user_id").cast("string"), DateTimeOriginal=F.lit("srt")).alias("tags")), F.struct(F.lit(".moi").alias("ext"), m(B=F.lit("t"), DateTimeOriginal=F.lit("moi")).alias("tags")))
    t = e.select("event_id", metadata.merged_companions(primary, sides).alias("m"))
    return t.select("event_id", F.col("m.A").alias("a"), F.col("m.B").alias("b"), F.col("m.GPSLatitude").alias("gps"), F.col("m.DateTimeOriginal").alias("taken"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'lossless' WHEN p_size % 4 = 1 THEN 'lossy' WHEN p_size % 4 = 2 THEN 'lossless' ELSE 'unknown' END AS quality,
                 CASE WHEN p_size < 10 THEN 'super8' WHEN p_size < 30 THEN 'dadcam' ELSE 'modern' END AS era, CASE WHEN p_size < 25 THEN 'sd' WHEN p_size < 45 THEN 'ssd' ELSE 'hdd' END AS media,
                 CASE WHEN p_partkey % 2 = 0 THEN 'interlaced' ELSE 'progressive' END AS scan FROM part""")
def classify_media(spark, sf_dir):
    s = F.col("p_size")
    ext = F.when(s % 4 == 0, ".flac").when(s % 4 == 1, ".mp3").when(s % 4 == 2, ".bin").otherwise(".bin")
    depth = F.when(s % 4 == 2, 24)
    side = F.when(s < 10, 320).when(s < 30, 640).otherwise(1920)
    gb = F.when(s < 25, 64).when(s < 45, 2000).otherwise(8000).cast("long")
    return table(spark, sf_dir, "part").select(
        "p_partkey", filetype.audio_quality(ext, F.lit(None).cast("string"), depth, F.lit(None).cast("int")).alias("quality"), registry.era(side, side * 3 / 4).alias("era"),
        filetype.media_type(gb * (1 << 30), F.lit("")).alias("media"), filetype.scan_type(F.when(F.col("p_partkey") % 2 == 0, "Interlaced").otherwise("Progressive")).alias("scan"),
    )


# --- related files: part keys as camera file names -----------------------------------------------------------

SHOTS = "s AS (SELECT l_orderkey AS o, l_linenumber AS n, '/d' || l_orderkey || '/S_' || l_linenumber || '.jpg' AS path FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))"


@query(f"""WITH {SHOTS}, g AS (SELECT o, n, path, n - lag(n) OVER (PARTITION BY o ORDER BY n) AS gap FROM s), k AS (SELECT o FROM g GROUP BY 1 HAVING count(*) >= 3 AND max(gap) <= 2)
           SELECT 'burst_sequence' AS type, first_value(path) OVER (PARTITION BY o ORDER BY n) AS "primary", path AS member, CAST(row_number() OVER (PARTITION BY o ORDER BY n) - 1 AS INT) AS seq FROM s WHERE o IN (SELECT o FROM k)""")
def related_bursts(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    s = s.select(F.concat(F.lit("/d"), "l_orderkey", F.lit("/S_"), "l_linenumber", F.lit(".jpg")).alias("path"))
    return related.bursts(related.parsed(s)).drop("group_id")


@query("""WITH f AS (SELECT p_partkey AS k FROM part) SELECT 'raw_jpeg_pair' AS type, '/d/IMG_' || k || 'a.CR2' AS "primary", m AS member, i AS seq FROM f, (VALUES (0), (1)) t(i), LATERAL (SELECT CASE i WHEN 0 THEN '/d/IMG_' || k || 'a.CR2' ELSE '/d/img_' || k || 'A.jpg' END AS m) WHERE k % 3 = 0
          UNION ALL SELECT 'raw_sidecar', '/d/IMG_' || k || 'a.CR2', m, i FROM f, (VALUES (0), (1)) t(i), LATERAL (SELECT CASE i WHEN 0 THEN '/d/IMG_' || k || 'a.CR2' ELSE '/d/IMG_' || k || 'a.xmp' END AS m) WHERE k % 3 = 1""")
def related_pairs(spark, sf_dir):
    k = F.col("p_partkey")
    names = F.array(F.concat(F.lit("/d/IMG_"), k, F.lit("a.CR2")), F.when(k % 3 == 0, F.concat(F.lit("/d/img_"), k, F.lit("A.jpg"))), F.when(k % 3 == 1, F.concat(F.lit("/d/IMG_"), k, F.lit("a.xmp"))))
    f = table(spark, sf_dir, "part").select(F.explode(names).alias("path")).where("path is not null")
    return related.related_files(f).drop("group_id")
