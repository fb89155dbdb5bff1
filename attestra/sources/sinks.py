"""Sinks: result lines, manifests, hash lists, bags, sidecars; and the execution of file actions.

An action is planned as a DataFrame and executed apart from it, as a dry run unless told otherwise.
Executors write to a temporary name and rename, so a task that runs twice leaves one file.
"""

from __future__ import annotations

import os
import shutil
import time

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.hashing import blake3_full
from attestra.functions.metadata import last_wins
from attestra.functions.paths import xml_escape

from .documents import CORE, NAMESPACE, PARTS, TAG_PREFIX, snake

# --- lines -----------------------------------------------------------------------------------------


def hash_lines(hashed: DataFrame, fmt: str = "text", algorithm: str = "blake3") -> DataFrame:
    """(line) of (path, hash) as text, bsd, sfv, csv or json."""
    forms = {
        "text": F.concat_ws("  ", "hash", "path"),
        "bsd": F.concat(F.lit(algorithm.upper() + " ("), "path", F.lit(") = "), "hash"),
        "sfv": F.concat_ws(" ", "path", "hash"),
        "csv": F.concat_ws(",", "path", "hash", F.lit(algorithm)),
        "json": F.to_json(F.struct("path", "hash", F.lit(algorithm).alias("algorithm"))),
    }
    if fmt not in forms:
        raise ValueError(f"unknown format {fmt!r}")
    return hashed.select(forms[fmt].alias("line"))


# The labels of the digests of one file, in order.
ALL_HASHES = (("BLAKE3", "blake3"), ("BLAKE3-256", "blake3_full"), ("SHA256", "sha256"), ("SHA512", "sha512"), ("MD5", "md5"), ("XXHASH64", "xxhash64"))


def all_hash_lines(hashed: DataFrame, fmt: str = "text") -> DataFrame:
    """(path, line) of (path, size and the columns of hashing.all_hashes()): a line for each digest, or one JSON object."""
    if fmt not in ("text", "json"):
        raise ValueError(f"unknown format {fmt!r}")
    if fmt == "json":
        return hashed.select("path", F.to_json(F.struct("path", *[F.col(c).alias(c.replace("_", "-")) for _, c in ALL_HASHES], "size")).alias("line"))
    lines = F.array(*[F.concat(F.rpad(F.lit(label), 11, " "), F.col(c), F.lit("  "), F.col("path").cast("string")) for label, c in ALL_HASHES])
    return hashed.select("path", F.explode(lines).alias("line"))


def device_text(card_reader: Column, usb: Column, media: Column, body_serial: Column, connection: Column) -> Column:
    """What a device is, in lines: card reader (vendor, model, serial), USB (device_name, vendor_id, product_id, serial), medium
    (type, manufacturer, serial, capacity in bytes), camera body and connection. What is null or empty is left out."""
    of = lambda label, c: F.when(c.cast("string") != "", F.concat(F.lit(label), c.cast("string")))
    within = lambda part, *lines: [F.when(part.isNotNull(), x) for x in lines]
    word = lambda c: F.coalesce(c.cast("string"), F.lit("undefined"))
    size = F.when(media["capacity"] > 0, F.concat(F.lit("  Capacity: "), F.format_string("%.1f", media["capacity"].cast("double") / (1 << 30)), F.lit(" GB")))
    return F.concat_ws(
        "\n",
        *within(card_reader, F.concat(F.lit("Card Reader: "), word(card_reader["vendor"]), F.lit(" "), word(card_reader["model"])), of("  Serial: ", card_reader["serial"])),
        *within(usb, F.concat(F.lit("USB: "), word(usb["device_name"])), F.concat(F.lit("  VID:PID: "), word(usb["vendor_id"]), F.lit(":"), word(usb["product_id"])), of("  Serial: ", usb["serial"])),
        *within(media, F.concat(F.lit("Media: "), F.upper(F.coalesce(F.nullif(media["type"], F.lit("")), F.lit("unknown")))), of("  Manufacturer: ", media["manufacturer"]), of("  Serial: ", media["serial"]), size),
        of("Camera Body: ", body_serial), of("Connection: ", connection),
    )


def verify_lines(verified: DataFrame) -> DataFrame:
    return verified.select(F.concat(F.col("path"), F.when(F.col("match"), ": OK").otherwise(": FAILED")).alias("line"))


def id_lines(rows: DataFrame, c: str, kind: str, as_json: bool = False) -> DataFrame:
    return rows.select((F.to_json(F.struct(F.lit(kind).alias("type"), F.col(c).alias("id"))) if as_json else F.col(c)).alias("line"))


def message_lines(rows: DataFrame, message: str, error: bool = False) -> DataFrame:
    return rows.select(F.concat(F.lit("Error: " if error else "✓ "), F.col(message)).alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Text part files; the order of lines is that of the partitions."""
    lines.select("line").write.mode("overwrite").text(path)


# --- manifests, hash lists, bags ---------------------------------------------------------------------


def in_order(c: Column) -> Column:
    """A sort key of the locale's order, not of code units."""
    return F.collate(c, "UNICODE")


def manifest_document(entries: DataFrame, root: str, algorithm: str = "blake3", hash_length: int = 16, generated: Column | None = None) -> DataFrame:
    """One row (text): the manifest as one JSON document, entries in locale order. One document is
    what the format is; write_manifest() keeps entries apart and scales with them."""
    e = F.struct(F.collate("path", "UNICODE").alias("k"), F.struct("path", "hash", "size", *(["mtime"] if "mtime" in entries.columns else [])).alias("e"))
    files = F.transform(F.array_sort(F.collect_list(e)), lambda x: x["e"])
    head = entries.agg(files.alias("files"), F.count("*").alias("fileCount"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("totalBytes"))
    when = F.date_format(F.coalesce(generated, F.current_timestamp()) if generated is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return head.select(F.to_json(F.struct(F.lit("1.0").alias("version"), when.alias("generated"), F.lit(algorithm).alias("algorithm"), F.lit(hash_length).alias("hashLength"), F.lit(root).alias("root"), "fileCount", "totalBytes", "files")).alias("text"))


def manifest_csv_lines(entries: DataFrame) -> DataFrame:
    """(line): path in quotes, hash, size."""
    return entries.orderBy(in_order(F.col("path"))).select(F.concat(F.lit('"'), F.replace("path", F.lit('"'), F.lit('""')), F.lit('",'), "hash", F.lit(","), F.col("size").cast("string")).alias("line"))


def write_manifest(entries: DataFrame, path: str) -> None:
    """Entries as JSON lines in part files."""
    entries.write.mode("overwrite").json(path)


def import_manifest(files: DataFrame) -> DataFrame:
    """The entries of an import: its copied and validated files."""
    return files.where(F.col("status").isin("copied", "validated")).select(F.col("dest_path").alias("path"), "hash", "size")


def hash_list_document(entries: DataFrame, name: str, host: str, version: str = "1.0", started: str = "", finished: str | None = None) -> DataFrame:
    """One row (text): a media hash list of (path, size, modified, xxh64, md5, hashed_at), in order of path."""
    tag = lambda t, c: F.when(c.isNotNull(), F.concat(F.lit(f"    <{t}>"), c.cast("string"), F.lit(f"</{t}>\n"))).otherwise("")
    one = F.concat(F.lit("  <hash>\n"), tag("file", xml_escape(F.col("path"))), tag("size", F.col("size")), tag("lastmodificationdate", F.col("modified")), tag("xxhash64", F.col("xxh64")), tag("md5", F.col("md5")), tag("hashdate", F.col("hashed_at")), F.lit("  </hash>\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", one.alias("x")))), lambda s: s["x"]), "")
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<hashlist version="2.0">\n  <creatorinfo>\n    <name>{esc(name)}</name>\n    <version>{esc(version)}</version>\n    <host>{esc(host)}</host>\n    <startdate>{started}</startdate>\n' + (f"    <finishdate>{finished}</finishdate>\n" if finished else "") + "  </creatorinfo>\n"
    return entries.agg(F.concat(F.lit(head), body, F.lit("</hashlist>")).alias("text"))


def hash_list_name(root: Column, at: Column) -> Column:
    return F.concat(F.regexp_extract(root, r"([^/]*)/?$", 1), F.lit("_"), F.date_format(at, "yyyy-MM-dd'T'HH-mm-ss"), F.lit(".mhl"))


def bag_lines(entries: DataFrame) -> DataFrame:
    """(line): the payload manifest's lines, hash and path, in locale order."""
    return entries.orderBy(in_order(F.col("path"))).select(F.concat_ws("  ", "hash", "path").alias("line"))


def bag_info_lines(payload: DataFrame, info: dict[str, str] | None = None) -> DataFrame:
    """(line): the given tags, the bagging date, and the payload's Oxum and size."""
    t = payload.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("b"), F.count("*").alias("n"))
    given = [F.lit(f"{k}: {v}") for k, v in (info or {}).items()]
    lines = F.array(*given, F.concat(F.lit("Bagging-Date: "), F.date_format(F.current_date(), "yyyy-MM-dd")), F.concat(F.lit("Payload-Oxum: "), F.concat_ws(".", "b", "n")))
    return t.select(F.explode(lines).alias("line"))


BAG_DECLARATION = "BagIt-Version: 1.0\nTag-File-Character-Encoding: UTF-8\n"


def make_bag(spark, folder: str, algorithm: str = "sha256", info: dict[str, str] | None = None, hidden: bool = True) -> DataFrame:
    """Turns a folder that driver and executors reach into a bag in place: its entries move below
    data/, and declaration, info and both manifests are written. Returns the payload entries."""
    from attestra.functions.hashing import hash_of

    from .fsscan import scan

    data = os.path.join(folder, "data")
    names = [n for n in os.listdir(folder) if n != "data" and (hidden or not n.startswith("."))]
    os.makedirs(data, exist_ok=True)
    for n in names:
        os.rename(os.path.join(folder, n), os.path.join(data, n))
    f = scan(spark, data, includeHidden=hidden, exclude="", content=True)
    payload = f.select(F.concat(F.lit("data/"), "rel_path").alias("path"), hash_of(F.col("content"), algorithm).alias("hash"), "size")
    write = lambda name, lines: _write(os.path.join(folder, name), "".join(x + "\n" for x in lines))
    rows = lambda df: (r[0] for r in df.toLocalIterator())
    _write(os.path.join(folder, "bagit.txt"), BAG_DECLARATION)
    write("bag-info.txt", rows(bag_info_lines(payload, info)))
    write(f"manifest-{algorithm}.txt", rows(bag_lines(payload)))
    tags = spark.createDataFrame([(n, bytearray(_read(os.path.join(folder, n)))) for n in ("bagit.txt", "bag-info.txt", f"manifest-{algorithm}.txt")], "path string, content binary")
    write(f"tagmanifest-{algorithm}.txt", rows(bag_lines(tags.select("path", hash_of(F.col("content"), algorithm).alias("hash")))))
    return payload


def verify_bag(spark, folder: str) -> DataFrame:
    """One row as of bag_rollup(), with error set where there is no bag or no manifest. The SHA-256 manifest is preferred, then SHA-512."""
    from attestra.functions.hashing import hash_of
    from attestra.operators import manifest

    from .documents import bag_manifest_entries, declared_oxum
    from .fsscan import scan

    empty = "matched long, mismatched long, missing long, unreadable long, extra long, oxum string, oxum_matches boolean, valid boolean, error string"
    fail = lambda e: spark.createDataFrame([(0, 0, 0, 0, 0, None, None, False, e)], empty)
    if not os.path.exists(os.path.join(folder, "bagit.txt")):
        return fail("no bagit.txt")
    algorithm = next((a for a in ("sha256", "sha512") if os.path.exists(os.path.join(folder, f"manifest-{a}.txt"))), None)
    if algorithm is None:
        return fail("no manifest")
    listed = bag_manifest_entries(spark.read.text(os.path.join(folder, f"manifest-{algorithm}.txt")))
    f = scan(spark, folder, includeHidden=True, exclude="", content=True)
    hashed = f.select(F.col("rel_path").alias("path"), hash_of(F.col("content"), algorithm).alias("hash"), "size", "error")
    payload = hashed.where(F.col("path").startswith("data/"))
    tag = os.path.join(folder, f"tagmanifest-{algorithm}.txt")
    tags = bag_manifest_entries(spark.read.text(tag)) if os.path.exists(tag) else None
    verified = manifest.bag_verify(listed, payload, tags, hashed.where(~F.col("path").startswith("data/")))
    info = os.path.join(folder, "bag-info.txt")
    oxum = spark.createDataFrame([(_read(info).decode(),)], "t string").select(declared_oxum(F.col("t")).alias("o")).select("o.bytes", "o.count").first() if os.path.exists(info) else None
    return manifest.bag_rollup(verified, payload, None if not oxum or oxum[0] is None else f"{oxum[0]}.{oxum[1]}").withColumn("error", F.lit(None).cast("string"))


def _write(path: str, text: str) -> None:
    with open(path + ".part", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(path + ".part", path)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


# --- sidecars ------------------------------------------------------------------------------------------

EVENT_TAGS = ("EventID", "EventTimestamp", "EventAction", "EventOutcome", "EventLocation", "EventUser", "EventHost", "EventTool", "EventHashValue", "EventNotes")


def sidecar_text(columns: list[str]) -> Column:
    """A sidecar's text from the columns of sidecar_records() that there are: every field that is
    not null is written, custody events in order, and the document's own hash last."""
    have = set(columns)
    line = lambda tag, c, pad="      ": F.when(c.isNotNull(), F.concat(F.lit(f"{pad}<{TAG_PREFIX}:{tag}>"), xml_escape(c.cast("string")), F.lit(f"</{TAG_PREFIX}:{tag}>\n"))).otherwise("")
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<x:xmpmeta xmlns:x="adobe:ns:meta/">\n  <rdf:RDF\n    xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"\n    xmlns:{TAG_PREFIX}="{NAMESPACE}">\n    <rdf:Description rdf:about="">\n'
    parts = [F.lit(head)]
    parts += [line(t, F.col(snake(t))) for t in CORE if snake(t) in have]
    for name, (_, tags) in PARTS.items():
        if name in have:
            parts += [line(t, F.col(f"{name}.{snake(t)}")) for t in tags]
    if "custody" in have:
        event = lambda e: F.concat(F.lit("          <rdf:li rdf:parseType=\"Resource\">\n"), *[line(t, e[snake(t)], "            ") for t in EVENT_TAGS], F.lit("          </rdf:li>\n"))
        chain = F.concat(F.lit(f"      <{TAG_PREFIX}:CustodyChain>\n        <rdf:Seq>\n"), F.array_join(F.transform("custody", event), ""), F.lit(f"        </rdf:Seq>\n      </{TAG_PREFIX}:CustodyChain>\n"))
        parts.append(F.when(F.size("custody") > 0, chain).otherwise(""))
    tail = "    </rdf:Description>\n  </rdf:RDF>\n</x:xmpmeta>\n"
    body = F.concat(*parts)
    whole = F.concat(body, F.lit(tail))
    return F.concat(F.regexp_replace(body, r"\n$", ""), F.lit(f"\n      <{TAG_PREFIX}:SidecarHash>"), blake3_full(whole_without(whole)), F.lit(f"</{TAG_PREFIX}:SidecarHash>\n"), F.lit(tail))


def whole_without(c: Column) -> Column:
    """A sidecar's text without its hash line, the form that is hashed."""
    from .documents import HASH_LINE

    return F.regexp_replace(c, HASH_LINE, "")


def new_custody_event(action: str, outcome: Column | str, at: Column, host: str, user: str, tool: str, hash_value: Column, event_id: Column) -> Column:
    """The struct of a custody event."""
    none = F.lit(None).cast("string")
    values = (event_id, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(action), outcome if isinstance(outcome, Column) else F.lit(outcome), none, F.lit(user), F.lit(host), F.lit(tool), hash_value, none)
    return F.struct(*[v.cast("string").alias(snake(t)) for t, v in zip(EVENT_TAGS, values, strict=True)])


def with_event(records: DataFrame, event: Column, updated: Column) -> DataFrame:
    """Sidecar records with one more event, their count and time of change."""
    return records.withColumn("custody", F.array_append("custody", event)).withColumn("event_count", F.size("custody").cast("string")).withColumn("sidecar_updated", updated.cast("string"))


def write_documents(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Writes each text to its path, in the tasks; (path, error)."""

    def run(frames):
        for pdf in frames:
            out = []
            for p, t in zip(pdf[path], pdf[text], strict=True):
                try:
                    os.makedirs(os.path.dirname(p) or ".", exist_ok=True)
                    _write(p, t)
                    out.append((p, None))
                except OSError as e:
                    out.append((p, str(e)))
            yield pd.DataFrame(out, columns=["path", "error"])

    return docs.select(path, text).mapInPandas(run, "path string, error string")


def metadata_json(tags: Column, binary: Column | None = None) -> Column:
    """A map of tags as JSON; those of a second map, of binary values, by their size."""
    if binary is not None:
        sizes = F.transform_values(binary, lambda _, v: F.concat(F.lit("(Binary data "), F.octet_length(v), F.lit(" bytes)")))
        tags = last_wins(tags, sizes)
    return F.to_json(tags)


# --- file actions ---------------------------------------------------------------------------------------

#: Error codes after which an action is tried again, and the backoff in ms.
RETRYABLE = ("EBUSY", "EAGAIN", "ETIMEDOUT", "ECONNRESET", "ECONNREFUSED", "ENETUNREACH", "EHOSTUNREACH", "EPIPE", "EIO", "ENOTCONN", "ESTALE", "EMFILE", "ENFILE")
BACKOFF_MS, LONGEST_MS = 1000, 10_000


def backoff_ms(attempt: int) -> int:
    return min(BACKOFF_MS * 2 ** (attempt - 1), LONGEST_MS)


#: Bytes of a file that a copy holds at once.
PIECE = 4 << 20


def running_digest(algorithm: str):
    """An object with update() and hexdigest() for an algorithm by name."""
    import hashlib

    from attestra.operators.content import Running

    if algorithm.startswith("blake3"):
        return Running()
    if algorithm == "xxhash64":
        import xxhash

        return xxhash.xxh64()
    return hashlib.new(algorithm)


def copy_file(source: str, destination: str, algorithm: str = "blake3", verify: bool = True, overwrite: bool = False, keep_times: bool = True, retries: int = 3) -> tuple:
    """(bytes, digest, verified) of a copy; the digest is of what was read, and verified by reading what was written. A
    file passes in pieces, so that its size does not matter."""
    import errno

    def passed(path: str, out=None) -> tuple[int, str]:
        h, n = running_digest(algorithm), 0
        with open(path, "rb") as f:
            while piece := f.read(PIECE):
                h.update(piece)
                n += len(piece)
                if out is not None:
                    out.write(piece)
        return n, h.hexdigest()[: 16 if algorithm == "blake3" else None]

    for attempt in range(1, retries + 1):
        part = f"{destination}.{os.getpid()}.part"
        try:
            if os.path.exists(destination) and not overwrite:
                raise FileExistsError(errno.EEXIST, "destination exists", destination)
            os.makedirs(os.path.dirname(destination) or ".", exist_ok=True)
            with open(part, "wb") as f:
                n, h = passed(source, f)
            if verify and passed(part)[1] != h:
                raise OSError(errno.EIO, "copy differs from source", destination)
            if keep_times:
                shutil.copystat(source, part)
            os.replace(part, destination)
            return n, h, verify
        except OSError as e:
            if os.path.exists(part):
                os.unlink(part)
            if attempt == retries or errno.errorcode.get(e.errno) not in RETRYABLE:
                raise
            time.sleep(backoff_ms(attempt) / 1000)
    raise AssertionError


def copy_files(plan: DataFrame, algorithm: str = "blake3", verify: bool = True, overwrite: bool = False, move: bool = False, dry_run: bool = True) -> DataFrame:
    """(source, destination, bytes, hash, status, error) of a plan (source, destination), run in the
    tasks; a move deletes the source of a verified copy. A dry run does nothing and says 'planned'."""
    schema = "source string, destination string, bytes bigint, hash string, status string, error string"
    if dry_run:
        return plan.select("source", "destination", F.lit(None).cast("bigint").alias("bytes"), F.lit(None).cast("string").alias("hash"), F.lit("planned").alias("status"), F.lit(None).cast("string").alias("error"))

    def run(frames):
        for pdf in frames:
            out = []
            for s, d in zip(pdf["source"], pdf["destination"], strict=True):
                try:
                    n, h, _ = copy_file(s, d, algorithm, verify or move, overwrite)
                    if move:
                        os.unlink(s)
                    out.append((s, d, n, h, "copied", None))
                except OSError as e:
                    out.append((s, d, None, None, "error", str(e)))
            yield pd.DataFrame(out, columns=["source", "destination", "bytes", "hash", "status", "error"])

    return plan.select("source", "destination").mapInPandas(run, schema)


def execute(plan: DataFrame, dry_run: bool = True) -> DataFrame:
    """(path, action, status, freed, error) of a plan (path, keep, action delete|link|rename, freed); for rename, keep is the new name."""

    def run(frames):
        for pdf in frames:
            out = []
            for p, keep, action, freed in zip(pdf["path"], pdf["keep"], pdf["action"], pdf["freed"], strict=True):
                try:
                    if action == "delete":
                        os.unlink(p)
                    elif action == "link":
                        os.link(keep, p + ".link")
                        os.replace(p + ".link", p)
                    elif action == "rename":
                        os.rename(p, keep)
                    else:
                        raise OSError(f"unknown action {action}")
                    out.append((p, action, "done", freed, None))
                except OSError as e:
                    out.append((p, action, "error", 0, str(e)))
            yield pd.DataFrame(out, columns=["path", "action", "status", "freed", "error"])

    if dry_run:
        return plan.select("path", "action", F.lit("planned").alias("status"), F.col("freed").cast("bigint").alias("freed"), F.lit(None).cast("string").alias("error"))
    return plan.select("path", "keep", "action", F.col("freed").cast("bigint").alias("freed")).mapInPandas(run, "path string, action string, status string, freed bigint, error string")


F_EVENTS = "array<struct<" + ", ".join(f"{snake(t)}: string" for t in EVENT_TAGS) + ">>"

# --- places into sidecars ---------------------------------------------------------------------------------


def with_places(records: DataFrame, places: DataFrame, at: Column, host: str, user: str, tool: str, note: str = "", files: DataFrame | None = None, path: str = "path") -> DataFrame:
    """Sidecar records (path and any columns of sidecar_records()) with the places of (path, latitude, longitude,
    altitude) in their photo part; each change is a custody event. A place of a file without a record makes a record of what
    files (path, content_hash, file_size) tell, and none without files; other records stay as they are. An altitude that is
    not known leaves the one that is there. The event's id follows from path and time, so that a task that runs again makes the same."""
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    tags = [snake(t) for t in PARTS["photo"][1]]
    if files is not None:
        new = places.select(path).distinct().join(records.select(path), path, "left_anti").join(files, path)
        made = new.select(path, "content_hash", F.col("file_size").cast("string").alias("file_size"), F.lit("blake3").alias("hash_algorithm"), F.col(path).cast("string").alias("source_path"), stamp.alias("import_timestamp"), stamp.alias("sidecar_created"), F.lit("gps").alias("session_id"))
        records = records.unionByName(made, allowMissingColumns=True)
    have = records.columns
    old = lambda t: F.col(f"photo.{t}") if "photo" in have and t in records.schema["photo"].dataType.names else F.lit(None).cast("string")
    new = {"gps_latitude": "_p.latitude", "gps_longitude": "_p.longitude", "gps_altitude": "_p.altitude"}
    photo = F.struct(*[(F.coalesce(F.col(new[t]).cast("string"), old(t)) if t in new else old(t)).alias(t) for t in tags])
    event = new_custody_event("metadata_modification", "success", at, host, user, tool, F.lit(None), F.substring(F.sha2(F.concat_ws("|", F.col(path).cast("string"), stamp), 256), 1, 16))
    event = F.struct(*[(F.lit(note) if t == "EventNotes" else event[snake(t)]).cast("string").alias(snake(t)) for t in EVENT_TAGS])
    chain = F.coalesce("custody", F.array().cast(F_EVENTS)) if "custody" in have else F.array().cast(F_EVENTS)
    p = places.groupBy(path).agg(F.min(F.struct("latitude", "longitude", "altitude")).alias("_p"))
    j = records.join(p, path, "left").withColumn("_on", F.col("_p").isNotNull())
    keep = lambda c, v: F.when(F.col("_on"), v).otherwise(F.col(c) if c in have else F.lit(None)).alias(c)
    had = F.col("photo").isNotNull() if "photo" in have else F.lit(False)
    j = j.withColumn("_photo", F.when(F.col("_on") | had, photo)).withColumn("_chain", F.array_append(chain, event))
    cols = {"custody": F.col("_chain"), "event_count": F.size("_chain").cast("string"), "sidecar_updated": stamp}
    return j.select(*[F.col(c) for c in have if c not in cols and c != "photo"], F.col("_photo").alias("photo"), *[keep(c, v) for c, v in cols.items()])
