"""Lookups and registries: cameras, vendors, mounts, extensions, custody events, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.functions.paths import base_name

from . import patterns
from .ordered import exponential_mean

# --- lookups by priority -------------------------------------------------------------------------


def first_match(rows: DataFrame, rules: DataFrame, key: str, on: Column, result: str, order: str = "priority", most_rules: int = 10_000) -> DataFrame:
    """rows with result: that of the first rule (by order) for which the condition holds, null if
    none does. For conditions that are no equality; rules is a table of at most most_rules rows, checked before it is broadcast."""
    n = rules.limit(most_rules + 1).count()
    if n > most_rules:
        raise ValueError(f"more than {most_rules} rules")
    j = rows.join(F.broadcast(rules), on, "left")
    best = j.groupBy(key).agg(F.min_by(result, F.when(F.col(result).isNotNull(), F.col(order))).alias(result))
    return rows.join(best, key, "left")


def longest_prefix(paths: DataFrame, mounts: DataFrame, path: str = "path", mount: str = "mount", kind: str = "fs_type") -> DataFrame:
    """(path, mount, kind): the longest mount that a path starts with, character by character."""
    return patterns.longest_prefix(paths, mounts, path, mount, kind)


def is_smb(fs_type: Column) -> Column:
    return F.lower(fs_type).isin("cifs", "smbfs", "smb", "smb3")


def is_nfs(fs_type: Column) -> Column:
    return F.lower(fs_type).isin("nfs", "nfs3", "nfs4")


# USB vendors by number, name and category, and products by vendor and number.
VENDORS = (
    (1003, "Samsung", "unknown"), (1058, "Kingston", "card_reader"), (1112, "Panasonic", "camera_professional"), (1133, "Nikon", "camera_professional"),
    (1193, "Canon", "camera_professional"), (1227, "Fujifilm", "camera_prosumer"), (1256, "Samsung", "unknown"), (1265, "JVC", "camera_consumer"), (1266, "Pentax", "camera_prosumer"),
    (1356, "Sony", "camera_professional"), (1452, "Apple", "phone"), (1921, "SanDisk", "card_reader"), (2316, "Lexar", "card_reader"), (2385, "Transcend", "unknown"),
    (2996, "GoPro", "camera_action"), (4047, "ProGrade", "unknown"), (4328, "Sigma", "unknown"), (6353, "Google", "phone"), (7086, "RED", "camera_cinema"), (8711, "Olympus", "camera_prosumer"),
    (8921, "OnePlus", "unknown"), (9191, "Atomos", "external_recorder"), (9817, "Leica", "unknown"), (9987, "ARRI", "camera_cinema"), (10007, "DJI", "drone"), (10239, "Insta360", "camera_action"),
    (11046, "Blackmagic", "camera_cinema"), (11270, "DJI", "drone"), (11271, "DJI Action", "unknown"),
)
PRODUCTS = (
    (1112, 58113, "Panasonic GH5/GH6"), (1112, 58114, "Panasonic S5/S1H"), (1193, 12818, "Canon EOS R5"), (1193, 12819, "Canon EOS R6"), (1193, 12855, "Canon EOS C70"), (1265, 775, "JVC Everio"),
    (1265, 776, "JVC GY-HM"), (1356, 2479, "Sony Alpha (MTP)"), (1356, 2551, "Sony A7S III"), (1356, 2557, "Sony FX3/FX6"), (1921, 1665, "SanDisk ImageMate"), (1921, 21889, "SanDisk Extreme Pro"),
    (2316, 1792, "Lexar Professional"), (2996, 512, "GoPro HERO"), (2996, 513, "GoPro HERO (MTP)"), (10007, 256, "DJI Ronin"), (10007, 3840, "DJI Mavic"), (10007, 3872, "DJI Mini"), (10007, 3904, "DJI Air"),
)


def known_vendors(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(vendors, products) of the fixed tables, for vendor_lookup()."""
    return spark.createDataFrame(list(VENDORS), "vid long, vendor string, category string"), spark.createDataFrame(list(PRODUCTS), "vid long, pid long, device string")


def vendor_lookup(devices: DataFrame, vendors: DataFrame | None = None, products: DataFrame | None = None) -> DataFrame:
    """devices (vid, pid) with vendor, category and device, null where unknown; by the fixed tables unless others are given."""
    if vendors is None or products is None:
        known = known_vendors(devices.sparkSession)
        vendors, products = (known[0] if vendors is None else vendors), (known[1] if products is None else products)
    return devices.join(vendors.select("vid", "vendor", "category"), "vid", "left").join(products.select("vid", "pid", "device"), ["vid", "pid"], "left")


def vendor_kind(category: Column) -> Column:
    """camera, drone, reader or null by the category's prefix."""
    return F.when(category.startswith("camera"), "camera").when(category.startswith("drone"), "drone").when(category.startswith("card_reader"), "reader")


# --- cameras -------------------------------------------------------------------------------------


def era(width: Column, height: Column) -> Column:
    most, ratio = F.greatest(width, height), F.try_divide(width.cast("double"), height.cast("double"))
    return F.when((most < 480) & (F.abs(ratio - F.lit(4 / 3)) < 0.1), "super8").when(most < 720, "dadcam").otherwise("modern")


def camera_match(files: DataFrame, cameras: DataFrame, path: str = "path") -> DataFrame:
    """files (path, make, model, width, height) with camera_id, confidence and matched_by.

    By EXIF make and model (0.95): the exact pair, of equal cameras the last; else a model variant,
    of a make that the file's make holds if there is one; else a make with a model that holds a variant. Then by the name's
    pattern (0.8), the folder's (0.7), and the era of the frame size (0.3, 'unknown:' and the era). cameras
    (ord, id, make, model, variants, filename_patterns, folder_patterns) is a table in its order, of any size: names, folders and
    models meet its patterns by pieces of three letters (see patterns).
    """
    make, model = F.lower(F.trim("make")), F.lower(F.trim("model"))
    cam = cameras.select("ord", "id", F.lower("make").alias("cmake"), F.lower("model").alias("cmodel"), F.transform(F.coalesce("variants", F.array().cast("array<string>")), F.lower).alias("cvariants"), "filename_patterns", "folder_patterns")
    f = files.withColumn("_make", make).withColumn("_model", model)
    exact = cam.groupBy("cmake", "cmodel").agg(F.max_by("id", "ord").alias("exact_id"))
    variant = cam.select("ord", "id", "cmake", F.explode(F.array_union(F.array("cmodel"), F.col("cvariants"))).alias("v"))
    known = f.select("_make", "_model").distinct().where("_model is not null")
    v = patterns.containing(known, variant, "_model", "v").join(known, "_model")
    v = v.where((F.col("_model") == F.col("v")) | F.contains("_make", F.col("cmake")))
    rank = F.struct(F.when(F.col("_model") == F.col("v"), F.when(F.coalesce(F.contains("_make", F.col("cmake")), F.lit(False)), 0).otherwise(1)).otherwise(2), F.col("ord"))
    v = v.groupBy("_make", "_model").agg(F.min_by("id", rank).alias("variant_id"))
    pattern = lambda c: cam.select("ord", "id", F.explode(c).alias("p"))
    names = f.select(path).distinct().withColumn("_name", base_name(F.col(path)))
    by_name = patterns.matching(names, pattern("filename_patterns"), "_name", "p").groupBy("_name").agg(F.min_by("id", "ord").alias("name_id"))
    by_name = names.join(by_name, "_name").select(path, "name_id")
    by_folder = patterns.containing(names, pattern("folder_patterns").withColumn("r", F.regexp_replace("p", r"\*", "")), path, "r").groupBy(path).agg(F.min_by("id", "ord").alias("folder_id"))
    j = f.join(exact, (F.col("_make") == F.col("cmake")) & (F.col("_model") == F.col("cmodel")), "left")
    j = j.join(v, ["_make", "_model"], "left").join(by_name, path, "left").join(by_folder, path, "left")
    guess = F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.concat(F.lit("unknown:"), era(F.col("width"), F.col("height"))))
    exif = F.coalesce("exact_id", "variant_id")
    by = F.when(exif.isNotNull(), "exif").when(F.col("name_id").isNotNull(), "filename").when(F.col("folder_id").isNotNull(), "folder").when(guess.isNotNull(), "heuristic")
    sure = F.when(by == "exif", 0.95).when(by == "filename", 0.8).when(by == "folder", 0.7).when(by == "heuristic", 0.3)
    return j.select(*[F.col(c) for c in files.columns], F.coalesce(exif, "name_id", "folder_id", guess).alias("camera_id"), sure.alias("confidence"), by.alias("matched_by"))


# Folder patterns by make, in the order in which they are tried.
FOLDERS = (
    ("sony", ("PRIVATE/M4ROOT/CLIP", "PRIVATE/AVCHD/BDMV/STREAM", "XDROOT/Clip", "MP_ROOT")),
    ("canon", ("DCIM/100CANON", "DCIM/100EOS", "CONTENTS/CLIPS", "PRIVATE/AVCHD")),
    ("panasonic", ("PRIVATE/PANA_GRP", "PRIVATE/AVCHD", "DCIM/100_PANA")),
    ("blackmagic", ("Blackmagic",)),
    ("red", ("R3D", ".RDC")),
    ("gopro", ("DCIM/100GOPRO", "DCIM/101GOPRO")),
    ("dji", ("DCIM/100MEDIA", "DCIM/DJI_", "DJI_")),
    ("iphone", ("DCIM/100APPLE", "DCIM/101APPLE")),
    ("generic", ("DCIM",)),
)


def camera_of_folder(path: Column) -> Column:
    """The make whose folder pattern a path holds first, whatever the case."""
    out = F.lit(None).cast("string")
    for make, patterns in reversed(FOLDERS):
        hit = F.lit(False)
        for p in patterns:
            hit = hit | F.contains(F.lower(path), F.lit(p.lower()))
        out = F.when(hit, make).otherwise(out)
    return out


#: The last year in which a consumer camera is taken to interlace.
INTERLACED_UNTIL = 2014
# Tiers by medium or category, in the order in which they are tried.
TIERS = (("medium", "dadcam", "legacy"), ("medium", "super8", "legacy"), ("category", "cinema", "pro"), ("category", "professional", "pro"), ("category", "prosumer", "prosumer"))
# Extensions of files beside a camera's own, by make, categories and parts of the model's name (empty: any).
BESIDE = (
    ("dji", (), (), (".srt",)), ("gopro", (), (), (".thm", ".lrv")), ("sony", ("cinema", "professional"), (), (".xml",)), ("sony", (), ("HDR", "DCR"), (".moi", ".mpl")), ("canon", (), (), (".thm",)),
    ("canon", ("cinema",), (), (".cif",)), ("red", (), (), (".rmd",)), ("blackmagic", (), (), (".sidecar",)), ("arri", (), (), (".ale", ".xml")), ("apple", (), (), (".aae",)),
)
# What an unknown extension may be, by pattern, in the order in which they are tried.
GUESSES = (
    (r"^\.(vid|mov|clip|rec|cap)", "video"), (r"\d{3,4}p$", "video"), (r"^\.(snd|aud|sfx|mus|vox)", "audio"), (r"^\.(img|pic|pho|tex)", "image"),
    (r"^\.(z[0-9]+|part[0-9]+)$", "archive"), (r"\.(bak|tmp|temp|old|orig|backup)$", "document"),
)


def deinterlace(medium: Column, category: Column, year: Column, flag: Column) -> Column:
    """Whether a camera's video is to be deinterlaced: it is said, the medium is, or it is an old consumer camera of a known year."""
    holds = (flag, medium == "dadcam", (category == "consumer") & (year != 0) & (year <= INTERLACED_UNTIL))
    return F.exists(F.array(*[F.coalesce(h, F.lit(False)) for h in holds]), lambda x: x)


def quality_tier(medium: Column, category: Column) -> Column:
    of = {"medium": medium, "category": category}
    return F.coalesce(*[F.when(of[column] == value, tier) for column, value, tier in TIERS], F.lit("consumer"))


def expected_sidecars(make: Column, model: Column, category: Column) -> Column:
    """The extensions that a camera's files may be accompanied by."""
    def row(of_make, categories, parts, extensions):
        holds = F.lower(make) == of_make
        if categories:
            holds = holds & category.isin(*categories)
        if parts:
            holds = holds & F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(model, p))
        return F.when(holds, F.array(*map(F.lit, extensions))).otherwise(F.array().cast("array<string>"))

    return F.concat(F.array(F.lit(".xmp")), *[row(*r) for r in BESIDE])


def merge_registries(mine: DataFrame, other: DataFrame, key: str = "id") -> DataFrame:
    """mine and those rows of other whose id mine lacks (repeated ones all)."""
    return mine.unionByName(other.join(mine.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


# --- extensions ----------------------------------------------------------------------------------


def guess_category(ext: Column) -> Column:
    """The category that GUESSES give first; null if none does."""
    return F.coalesce(*[F.when(F.lower(ext).rlike(pattern), category) for pattern, category in GUESSES])


def unknown_extensions(events: DataFrame, samples: int = 5) -> DataFrame:
    """(extension, n, first_seen, last_seen, samples, suggested) of events (extension, path, seen_at);
    samples are the first distinct paths by time seen."""
    e = events.withColumn("extension", F.lower("extension"))
    first = e.groupBy("extension", "path").agg(F.min("seen_at").alias("at"))
    w = Window.partitionBy("extension").orderBy("at", "path")
    kept = first.withColumn("k", F.row_number().over(w)).where(F.col("k") <= samples).groupBy("extension").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "path"))), lambda x: x["path"]).alias("samples"))
    counts = e.groupBy("extension").agg(F.count("*").alias("n"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))
    return counts.join(kept, "extension").withColumn("suggested", guess_category(F.col("extension")))


def learn(learned: DataFrame, new: DataFrame) -> DataFrame:
    """The registry after new rows (extension, category, learned_by user|auto, confidence, learned_at):
    what a user taught stays over what was inferred, later over earlier; inferred confidence is 0.9 at most."""
    every = learned.unionByName(new).withColumn("extension", F.lower("extension")).withColumn("confidence", F.when(F.col("learned_by") == "auto", F.least("confidence", F.lit(0.9))).otherwise(F.col("confidence")))
    row = F.struct(F.col("learned_by") == "user", "learned_at")
    return every.groupBy("extension").agg(F.max_by(F.struct("category", "learned_by", "confidence", "learned_at"), row).alias("r")).select("extension", "r.*")


def forget(learned: DataFrame, extensions: list[str]) -> DataFrame:
    return learned.where(~F.col("extension").isin([e.lower() for e in extensions]))


def still_unknown(unknown: DataFrame, learned: DataFrame) -> DataFrame:
    return unknown.join(learned.select("extension"), "extension", "left_anti")


def learner_stats(unknown: DataFrame, learned: DataFrame) -> DataFrame:
    """One row: unknown, learned, by_user, by_auto."""
    l = learned.agg(F.count("*").alias("learned"), F.count_if(F.col("learned_by") == "user").alias("by_user"), F.count_if(F.col("learned_by") == "auto").alias("by_auto"))
    return unknown.agg(F.count("*").alias("unknown")).crossJoin(l)  # one row each


def category_of(files: DataFrame, builtin: DataFrame, learned: DataFrame, ext: str = "ext") -> DataFrame:
    """files with category: the learned one, else that of the built-in table (ext, category, priority) of least priority, else 'other'."""
    b = builtin.groupBy("ext").agg(F.min_by("category", "priority").alias("_b"))
    l = learned.select(F.col("extension").alias("ext"), F.col("category").alias("_l"))
    j = files.withColumn("_e", F.lower(ext)).join(b.withColumnRenamed("ext", "_e"), "_e", "left").join(l.withColumnRenamed("ext", "_e"), "_e", "left")
    return j.withColumn("category", F.coalesce("_l", "_b", F.lit("other"))).drop("_e", "_b", "_l")


# --- custody -------------------------------------------------------------------------------------


def append_event(events: DataFrame, more: DataFrame) -> DataFrame:
    """The log with more events; nothing of it is ever rewritten."""
    return events.unionByName(more, allowMissingColumns=True)


def fixity_events(verified: DataFrame, at: Column, agent: str) -> DataFrame:
    """A fixity_check event for each verified row (path, status)."""
    return verified.select("path", F.lit("fixity_check").alias("action"), at.alias("at"), F.lit(agent).alias("agent"), F.when(F.col("status") == "matched", "success").otherwise("failure").alias("outcome"))


def custody_chain(events: DataFrame, key: str, order: str, action: str) -> DataFrame:
    """(key, events, first, last, last_action) of each chain; order numbers a chain's events."""
    return events.groupBy(key).agg(F.count("*").alias("events"), F.min(order).alias("first"), F.max(order).alias("last"), F.max_by(action, order).alias("last_action"))


# --- progress ------------------------------------------------------------------------------------

# Import steps and their weights in percent, in order.
STEPS = (("scanning", 5), ("detecting-device", 2), ("detecting-related", 3), ("hashing", 25), ("copying", 35), ("validating", 10), ("extracting-metadata", 10), ("generating-sidecars", 8), ("generating-manifest", 2))
ALPHA, LEAST_MS = 0.15, 100


def ewma(samples: DataFrame, key: list[str], order: str, value: str, alpha: float = ALPHA) -> DataFrame:
    """(*key, ewma, n): the exponentially weighted mean of each key's values in order, begun with the
    first; of equal orders the smaller value comes first. A key's samples are folded in parts, as maps (see ordered)."""
    return exponential_mean(samples, key, order, value, alpha)


def throughput(samples: DataFrame, key: list[str], at: str = "at_ms", done: str = "bytes", retained_ms: int = 30_000) -> DataFrame:
    """(*key, ewma, samples, last_done): rates between samples at least LEAST_MS after the one used
    before, averaged; samples counts those of the last retained_ms."""
    a = samples.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("t"), F.col(done).alias("d")))).alias("s"))
    start = F.struct(F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("d"), F.lit(None).cast("double").alias("e"), F.array().cast("array<bigint>").alias("kept"))

    def step(acc, x):
        dt = x["t"] - acc["t"]
        rate = (x["d"] - acc["d"]) / dt * 1000.0
        e = F.when(acc["e"].isNull(), rate).otherwise(ALPHA * rate + (1 - ALPHA) * acc["e"])
        kept = F.array_append(F.filter(acc["kept"], lambda t: t > x["t"] - retained_ms), x["t"])
        on = dt >= LEAST_MS
        pick = lambda a, b: F.when(on, a).otherwise(b)
        return F.struct(pick(x["t"], acc["t"]).cast("long").alias("t"), x["d"].cast("long").alias("d"), pick(e, acc["e"]).alias("e"), pick(kept, acc["kept"]).alias("kept"))

    f = a.select(*key, F.aggregate("s", start, step).alias("f"))
    return f.select(*key, F.col("f.e").alias("ewma"), F.size("f.kept").alias("samples"), F.col("f.d").alias("last_done"))


def overall_percent(step: Column, percent: Column) -> Column:
    """The weight of the steps before, and as much of this one's; 100 for a step that is not among them."""
    out, before = F.lit(100.0), 0
    for name, weight in STEPS:
        out = F.when(step == name, F.round(F.lit(float(before)) + percent / 100 * weight, 1)).otherwise(out)
        before += weight
    return out


def eta_ms(left_bytes: Column, byte_rate: Column, left_files: Column, file_rate: Column, samples: Column, elapsed_ms: Column) -> Column:
    """Remaining milliseconds by bytes, else by files; null with fewer than 3 samples or beyond ten times the elapsed time."""
    eta = F.when((byte_rate > 0) & (left_bytes > 0), left_bytes / byte_rate * 1000).when((file_rate > 0) & (left_files > 0), left_files / file_rate * 1000)
    return F.when((samples >= 3) & (eta <= elapsed_ms * 10), eta)


def import_counters(files: DataFrame) -> DataFrame:
    """One row of counts by status."""
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    return files.agg(F.count("*").alias("total"), count("copied", "validated").alias("processed"), count("skipped").alias("duplicates"), count("error").alias("errors"), count("pending", "hashed").alias("waiting"))


def basename_is(path: Column, names: list[str]) -> Column:
    return base_name(path).isin(names)


def totals(devices: DataFrame, *columns: str) -> DataFrame:
    """One row under the names of three columns: rows of the first, distinct values of the second, the sum of the third."""
    device, maker, files = columns
    return devices.agg(F.count(device).alias(device), F.countDistinct(maker).alias(maker), F.coalesce(F.sum(files), F.lit(0)).alias(files))


def by_count(extensions: DataFrame, count: str = "count") -> DataFrame:
    """Extensions, the most frequent first, ties by name."""
    return extensions.orderBy(F.desc(count), "ext")
