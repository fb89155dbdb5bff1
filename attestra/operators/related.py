"""Related files: live photos, RAW pairs and sidecars, bursts, SDR/HDR pairs, companions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.paths import base_name, directory, extension, stem

from .graph import cut
from .ordered import Ordered, row_before, row_number, whole

# Extensions by role.
RAW = (".dng", ".cr2", ".cr3", ".crw", ".nef", ".nrw", ".arw", ".srf", ".sr2", ".raf", ".orf", ".rw2", ".rwl", ".pef", ".ptx", ".srw", ".x3f", ".3fr", ".fff", ".iiq", ".mef", ".mos", ".dcr", ".kdc", ".mrw", ".erf", ".gpr", ".rwz")
JPEG = (".jpg", ".jpeg", ".jpe")
LIVE_VIDEO = (".mov", ".mp4", ".m4v")
HEIC = (".heic", ".heif", ".hif")
SIDECAR = (".xmp", ".aae", ".nksc", ".thm", ".lrv", ".lrf", ".srt", ".moi", ".cpi", ".bdm", ".mpl", ".rmd", ".ale", ".sidecar", ".gpr")
VIDEO_WITH_COMPANIONS = (".mp4", ".mov", ".mts", ".m2ts", ".avi", ".mkv", ".m4v", ".mxf", ".r3d", ".braw", ".tod", ".ari")
PHOTO_WITH_COMPANIONS = JPEG + HEIC + RAW
#: The order in which a file is claimed.
KINDS = ("live_photo", "raw_jpeg_pair", "raw_sidecar", "burst_sequence", "sdr_hdr_pair")


def parsed(files: DataFrame, path: str = "path") -> DataFrame:
    """files with dir, base, name (its stem), ext (lower case)."""
    p = F.col(path)
    return files.select(p.alias("path"), directory(p).alias("dir"), base_name(p).alias("base"), stem(p).alias("name"), F.lower(extension(p)).alias("ext"))


def long_form(groups: DataFrame, kind: str) -> DataFrame:
    """(type, group_id, primary, member, seq) from (primary, members)."""
    e = groups.select(F.col("primary"), F.posexplode("members").alias("seq", "member"))
    return e.select(F.lit(kind).alias("type"), F.concat(F.lit(kind + ":"), F.col("primary")).alias("group_id"), "primary", "member", "seq")


def by_name(files: DataFrame) -> list[DataFrame]:
    """The three kinds that live on one name in one folder; of several files of a role the last by path counts."""
    last = lambda on, c="path": F.max(F.when(on, F.col(c)))
    image, video = F.col("ext").isin(*HEIC, *JPEG), F.col("ext").isin(*LIVE_VIDEO)
    g = files.groupBy("dir", F.lower("name").alias("key"))
    live = g.agg(last(image).alias("i"), last(video).alias("v"), F.max_by("name", F.when(image, F.col("path"))).alias("iname"), F.max_by("name", F.when(video, F.col("path"))).alias("vname"))
    live = live.where("i is not null and v is not null").where(F.regexp_replace("iname", "_HEVC$", "") == F.col("vname"))
    pair = g.agg(last(F.col("ext").isin(*RAW)).alias("r"), last(F.col("ext").isin(*JPEG)).alias("j")).where("r is not null and j is not null")
    is_side = F.col("ext").isin(*SIDECAR) & ~F.col("ext").isin(*RAW)
    side = g.agg(last(F.col("ext").isin(*RAW)).alias("r"), F.sort_array(F.collect_list(F.when(is_side, F.col("path")))).alias("s")).where("r is not null and size(s) > 0")
    return [
        long_form(live.select(F.col("i").alias("primary"), F.array("i", "v").alias("members")), KINDS[0]),
        long_form(pair.select(F.col("r").alias("primary"), F.array("r", "j").alias("members")), KINDS[1]),
        long_form(side.select(F.col("r").alias("primary"), F.concat(F.array("r"), F.col("s")).alias("members")), KINDS[2]),
    ]


def sequences(rows: DataFrame, key: list[str], seq: str, member: str, most_gap: int = 2, least: int = 3) -> DataFrame:
    """rows of those keys that have at least `least` rows and no gap of seq above most_gap, with
    first (the member that opens the sequence) and place (from 0); one gap rejects the whole key."""
    line = Ordered(rows, key, list(dict.fromkeys([seq, member])))
    inner, others = line.apart()
    before = {"_before": row_before(F.col(seq)), "place": row_number(), "first": whole(F.min, F.struct(seq, F.col(member).alias("_first"))), "_n": whole(F.count, F.lit(1), F.sum)}
    most = {"_most": whole(F.max, F.col("_gap"))}
    gap = lambda d: d.withColumn("_gap", F.col(seq) - F.col("_before.v"))
    d = line.within(gap(line.within(inner, **before)), **most).unionByName(others.scan(gap(others.scan(**before)), **most))
    d = d.where((F.col("_n") >= least) & (F.col("_most") <= most_gap)).withColumn("place", F.col("place") - 1).withColumn("first", F.col("first._first"))
    return d.drop("_before", "_n", "_gap", "_most", "_chunk")


def bursts(files: DataFrame) -> DataFrame:
    """Numbered names of one prefix and extension in one folder: name_N, else name(N)."""
    under, paren = r"^.+_(\d+)\.[^.]+$", r"^.+\((\d+)\)\.[^.]+$"
    rows = files.withColumn("_u", F.regexp_extract("base", under, 1))  # each pattern once a name; the rest by lengths
    rows = rows.withColumn("_d", F.when(F.col("_u") != "", F.col("_u")).otherwise(F.regexp_extract("base", paren, 1))).where("_d <> ''")
    tail = F.length(F.substring_index("base", ".", -1)) + 1
    name = F.substring("base", F.lit(1), F.length("base") - tail - F.length("_d") - F.when(F.col("_u") != "", 1).otherwise(2))
    key = F.concat(F.when(F.col("_u") != "", "").otherwise("paren:"), name, F.right("base", tail))
    rows = rows.select("path", "dir", key.alias("key"), F.col("_d").cast("decimal(38,0)").alias("no"))
    s = sequences(rows, ["dir", "key"], "no", "path")
    return s.select(F.lit(KINDS[3]).alias("type"), F.concat(F.lit(KINDS[3] + ":"), F.col("first")).alias("group_id"), F.col("first").alias("primary"), F.col("path").alias("member"), F.col("place").alias("seq"))


def sdr_hdr(files: DataFrame) -> DataFrame:
    """X_SDR.ext with X.ext in the same folder; the latter is primary."""
    sdr = files.where(F.contains("base", F.lit("_SDR."))).select("dir", F.regexp_replace("base", r"_SDR\.", ".").alias("base"), F.col("path").alias("sdr"))
    g = sdr.groupBy("dir", "base").agg(F.min("sdr").alias("sdr")).join(files.select("dir", "base", F.col("path").alias("hdr")), ["dir", "base"])
    return long_form(g.select(F.col("hdr").alias("primary"), F.array("hdr", "sdr").alias("members")), KINDS[4])


def related_files(files: DataFrame, path: str = "path") -> DataFrame:
    """(type, group_id, primary, member, seq): all groups. Kinds are tried in the order of KINDS,
    and a file that one has claimed takes no part in the next. Each step is cut by a checkpoint,
    since the next one uses it several times."""
    left = cut(parsed(files, path))
    out = None
    for k in range(len(KINDS)):
        found = cut(by_name(left)[k] if k < 3 else bursts(left) if k == 3 else sdr_hdr(left))
        out = found if out is None else out.unionByName(found)
        if k + 1 < len(KINDS):
            left = cut(left.join(found.select(F.col("member").alias("path")), "path", "left_anti"))
    return out


def with_group(files: DataFrame, groups: DataFrame, path: str = "path") -> DataFrame:
    """files with type, group_id, is_primary and hidden; a file in no group is primary, and only
    the other sides of SDR/HDR pairs and live photos are hidden."""
    g = groups.groupBy("member").agg(F.max_by(F.struct("type", "group_id", "primary"), "group_id").alias("g"))
    j = files.join(g, F.col(path) == F.col("member"), "left")
    first = F.coalesce(F.col(path) == F.col("g.primary"), F.lit(True))
    return j.select(files["*"], "g.type", "g.group_id", first.alias("is_primary"), (~first & F.col("g.type").isin("sdr_hdr_pair", "live_photo")).alias("hidden"))


def companions(files: DataFrame, path: str = "path") -> DataFrame:
    """(path, companion): sidecars of the same name in the same folder, whatever the case, and XML
    files with a clip suffix (M01, C01, S01 and so on) behind the name."""
    p = parsed(files, path).withColumn("key", F.lower("name"))
    main = p.where(F.col("ext").isin(*VIDEO_WITH_COMPANIONS, *PHOTO_WITH_COMPANIONS)).select("dir", "key", F.col("path").alias("main"))
    same = p.where(F.col("ext").isin(*SIDECAR, ".xml")).select("dir", "key", "path", "ext")
    plain = same.where("ext <> '.xml'").select("dir", "key", "path")
    clip = same.where("ext = '.xml'").where(F.col("key").rlike("[mcs]0[1-9]$")).select("dir", F.regexp_replace("key", "[mcs]0[1-9]$", "").alias("key"), "path")
    return main.join(plain.union(clip), ["dir", "key"]).where("main <> path").select(F.col("main").alias("path"), F.col("path").alias("companion"))


# Companions that are only told to be there.
PRESENT = (".lrf", ".lrv", ".gpr", ".sidecar", ".nksc")


def companion_tags(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, companion, extension, tags) of files (path, text) and their companions: the tags that each companion's text
    has by its format; of a binary one that it is there; none of an XML that is no clip's. Texts travel once, with the companion."""
    from attestra.sources import documents

    pairs = companions(files.select(path), path)
    c = files.select(F.col(path).alias("companion"), F.col(text).alias("_text"), F.lower(extension(F.col(path))).alias("extension"))
    ext, none = F.col("extension"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    clip = F.contains("_text", F.lit("NonRealTimeMeta")) | F.contains("_text", F.lit("professionalDisc"))
    kind = F.upper(F.substring(ext, 2, 20))
    there = F.create_map(F.concat(kind, F.lit(":Present")), F.lit("true"), F.concat(kind, F.lit(":MetadataSource")), kind)
    ale = F.col("_text").rlike(r"(?:^|\n)Column\r?\n")
    head = lambda section: F.split(F.regexp_extract(F.regexp_replace("_text", "\r", ""), rf"(?:^|\n){section}\n([^\n]*)", 1), "\t")
    named = F.filter(F.arrays_zip(head("Column").alias("k"), head("Data").alias("v")), lambda x: x["k"].isNotNull() & (x["k"] != "") & x["v"].isNotNull())
    row = F.map_from_entries(F.transform(named, lambda x: F.struct(F.concat(F.lit("ALE:"), x["k"]), x["v"])))
    tags = (
        F.when(ext == ".srt", documents.drone_tags("_text")).when((ext == ".xml") & clip, documents.sony_tags("_text")).when(ext == ".aae", documents.edit_tags("_text"))
        .when(ext == ".rmd", documents.cinema_tags("_text")).when((ext == ".ale") & ale, row).when(ext.isin(*PRESENT), there)
    )
    return pairs.join(c, "companion").select("path", "companion", "extension", F.coalesce(tags, none).alias("tags"))


def with_sidecar(files: DataFrame, path: str = "path", suffix: str = ".xmp", out: str = "has_sidecar") -> DataFrame:
    """files with out: whether the file of the same path and suffix is there too."""
    there = files.select(F.col(path).alias("_side")).where(F.endswith("_side", F.lit(suffix))).distinct()
    j = files.join(there, F.concat(F.col(path), F.lit(suffix)) == F.col("_side"), "left")
    return j.withColumn(out, F.col("_side").isNotNull()).drop("_side")


XML_SUFFIXES = ("", "M01", "M02", "_metadata", "_meta", "_info")


def linked_videos(files: DataFrame, path: str = "path", video_ext=(".mp4", ".mov", ".mxf", ".avi", ".mts", ".m2ts")) -> DataFrame:
    """(xml, video): each XML file's video in its folder; the same name first, then the name without
    a suffix of XML_SUFFIXES, each by the order of video_ext in lower or upper case."""
    p = parsed(files, path)
    x = p.where("ext in ('.xml', '.fcpxml')").select("dir", F.col("path").alias("xml"), "name")
    tries = F.array(*[F.when(F.lit(s == "") | F.endswith("name", F.lit(s)), F.struct(F.lit(i).alias("order"), F.substring("name", F.lit(1), F.length("name") - len(s)).alias("n"))) for i, s in enumerate(XML_SUFFIXES)])
    x = x.select("dir", "xml", F.explode(F.filter(tries, lambda t: t.isNotNull())).alias("t")).select("dir", "xml", "t.order", F.col("t.n").alias("name"))
    raw = extension(F.col("path"))
    v = p.where(F.col("ext").isin(*video_ext)).where((raw == F.lower(raw)) | (raw == F.upper(raw))).select("dir", "name", F.col("path").alias("video"), F.array_position(F.array(*map(F.lit, video_ext)), F.col("ext")).alias("rank"))
    return x.join(v, ["dir", "name"]).groupBy("xml").agg(F.min_by("video", F.struct("order", "rank", "video")).alias("video"))


def number_in_order(rows: DataFrame, order: str, out: str = "seq") -> DataFrame:
    """rows with out: 1, 2, ... in order of a unique column, without a window over all rows: rows
    are sorted by range, partitions are counted, and each starts where the ones before it end."""
    s = rows.sort(order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    s = cut(s)
    counts = s.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    base = counts.select("_p", "_first", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # one row a partition
    return s.join(F.broadcast(base), "_p").withColumn(out, F.col("_base") + F.col("_m") - F.col("_first") + 1).drop("_p", "_m", "_first", "_base")
