"""File types by magic bytes, MIME and extension, and other classifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .paths import base_name, extension

# Extensions by category in order of priority; the first category that has one wins.
CATEGORIES = (
    ("raw", (
        "dng", "cr2", "cr3", "crw", "nef", "nrw", "arw", "srf", "sr2", "raf", "orf", "rw2", "pef", "srw", "x3f", "3fr", "fff", "iiq",
        "mef", "mos", "dcr", "kdc", "mrw", "erf", "gpr",
    )),
    ("image", (
        "jpg", "jpeg", "jpe", "png", "apng", "gif", "webp", "avif", "bmp", "tiff", "tif", "ico", "heic", "heif", "hif", "jxl", "jp2",
        "psd", "svg", "tga", "exr", "hdr",
    )),
    ("video", (
        "mp4", "m4v", "mov", "mkv", "webm", "avi", "wmv", "flv", "mpg", "mpeg", "vob", "ts", "mts", "m2ts", "tod", "3gp", "3g2", "mxf",
        "r3d", "braw", "ogv", "dv", "asf", "3gpp", "3gp2", "rm", "rmvb", "f4v", "mk3d", "h264", "hevc",
    )),
    ("audio", (
        "mp3", "aac", "m4a", "m4b", "ogg", "oga", "opus", "wma", "flac", "alac", "ape", "wv", "tta", "wav", "aiff", "aif", "au", "mid",
        "midi", "amr", "dsf", "aifc", "caf", "mka", "dff", "ac3", "dts", "ra",
    )),
    ("sidecar", (
        "xmp", "aae", "srt", "vtt", "ass", "ssa", "lrv", "thm", "moi", "cpi", "bdm", "mpl", "rmd", "ale", "sidecar", "cube", "md5",
        "sha256", "sfv", "nfo",
    )),
    ("ebook", (
        "epub", "mobi", "azw", "azw3", "kfx", "fb2", "cbz", "cbr", "djvu",
    )),
    ("game", (
        "nsp", "xci", "nds", "gba", "n64", "sfc", "nes", "iso", "cue", "rvz",
    )),
    ("archive", (
        "zip", "rar", "7z", "tar", "gz", "tgz", "bz2", "xz", "zst", "lz4", "cab", "dmg", "vmdk", "apk", "deb", "rpm", "jar", "warc",
    )),
    ("font", (
        "ttf", "otf", "woff", "woff2", "eot", "ttc",
    )),
    ("geospatial", (
        "gpx", "kml", "kmz", "geojson", "shp", "gpkg", "fit", "tcx", "osm",
    )),
    ("data", (
        "parquet", "avro", "sqlite", "db", "npy", "h5",
    )),
    ("executable", (
        "exe", "dll", "so", "dylib", "elf",
    )),
    ("document", (
        "doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp", "pdf", "rtf", "txt", "csv", "tsv", "md", "html", "htm", "xml",
        "json", "yaml", "yml", "eml", "msg", "js", "py", "rs", "go", "c", "h", "css",
    )),
)
#: Parts of a MIME subtype that tell an archive, a program or a document; of the rest, the main type is the category.
BY_SUBTYPE = (("archive", ("zip", "tar", "compress", "archive", "cpio", "shar")), ("executable", ("octet-stream", "msdownload", "python-code")), ("document", ("pdf", "word", "excel", "powerpoint", "postscript", "tex", "troff", "json", "xml", "javascript", "rtf", "pkcs")))
BY_TYPE = {"image": "image", "video": "video", "audio": "audio", "font": "font", "text": "document", "message": "document"}
#: Families of extensions by rule: parts of split archives, backups, numbered manual pages and so on.
FAMILIES = ((r"^\.(r|z|c)\d{2,3}$|^\.(part\d+|\d{3})$", "archive"), (r"^\.(adoc|asciidoc|rst|org|textile|tex|bib|log|ini|cfg|conf|toml|env)$", "document"))


def registered(known=()) -> list[tuple[str, tuple[str, ...]]]:
    """Categories in the form of CATEGORIES of those extensions of the standard library's MIME registry (the same on every
    host; the host's own tables are left out) that known lacks."""
    import mimetypes

    table, out = mimetypes.MimeTypes(filenames=()), {}
    for ext, mime in sorted({**table.types_map[False], **table.types_map[True]}.items()):
        main, _, sub = mime.partition("/")
        category = BY_TYPE.get(main) or next((name for name, parts in BY_SUBTYPE if any(p in sub for p in parts)), None)
        if category and ext[1:] not in known:
            out.setdefault(category, []).append(ext[1:])
    return [(name, tuple(exts)) for name, exts in out.items()]


RAW_EXT = tuple("." + e for e in CATEGORIES[0][1])


def extension_rows(categories=CATEGORIES) -> list[tuple[str, str, int]]:
    """(ext, category, priority): the table's, then the MIME registry's; a longer table may be given in the same form."""
    every = [*categories, *registered({x for _, xs in categories for x in xs})]
    return [("." + e, name, i) for i, (name, exts) in enumerate(every) for e in exts]


def extension_table(spark: SparkSession, categories=CATEGORIES) -> DataFrame:
    return spark.createDataFrame(extension_rows(categories), "ext string, category string, priority int")


def media_category(path: Column, categories=CATEGORIES) -> Column:
    """The category of a path's extension, whatever the case: that of the table, else of the MIME registry, else of a
    family; 'other' if none has it. categories: another table, which may be as long as need be."""
    e = F.lower(extension(path))
    out = F.lit("other")
    for pattern, name in reversed(FAMILIES):
        out = F.when(e.rlike(pattern), name).otherwise(out)
    for name, exts in reversed([*categories, *registered({x for _, xs in categories for x in xs})]):
        out = F.when(e.isin(*["." + x for x in exts]), name).otherwise(out)
    return out


# Leading bytes (hex, at an offset) of common formats, MIME type and usual extension.
MAGIC = (
    (0, "ffd8ff", "image/jpeg", ".jpg"),
    (0, "89504e470d0a1a0a", "image/png", ".png"),
    (0, "474946383761", "image/gif", ".gif"),
    (0, "474946383961", "image/gif", ".gif"),
    (0, "49492a0010000000435202", "image/x-canon-cr2", ".cr2"),
    (0, "49492a00", "image/tiff", ".tif"),
    (0, "4d4d002a", "image/tiff", ".tif"),
    (0, "424d", "image/bmp", ".bmp"),
    (0, "38425053", "image/vnd.adobe.photoshop", ".psd"),
    (8, "57454250", "image/webp", ".webp"),
    (4, "6674797068656963", "image/heic", ".heic"),
    (4, "667479706d696631", "image/heif", ".heic"),
    (4, "6674797061766966", "image/avif", ".avif"),
    (4, "6674797071742020", "video/quicktime", ".mov"),
    (4, "667479704d345620", "video/x-m4v", ".m4v"),
    (4, "667479704d344120", "audio/x-m4a", ".m4a"),
    (4, "66747970", "video/mp4", ".mp4"),
    (8, "41564920", "video/x-msvideo", ".avi"),
    (8, "57415645", "audio/wav", ".wav"),
    (0, "1a45dfa3", "video/x-matroska", ".mkv"),
    (0, "464c5601", "video/x-flv", ".flv"),
    (0, "494433", "audio/mpeg", ".mp3"),
    (0, "fffb", "audio/mpeg", ".mp3"),
    (0, "664c6143", "audio/flac", ".flac"),
    (0, "4f676753", "audio/ogg", ".ogg"),
    (8, "41494646", "audio/x-aiff", ".aif"),
    (0, "25504446", "application/pdf", ".pdf"),
    (0, "7b5c727466", "application/rtf", ".rtf"),
    (30, "6d696d65747970656170706c69636174696f6e2f657075622b7a6970", "application/epub+zip", ".epub"),
    (0, "504b0304", "application/zip", ".zip"),
    (0, "526172211a07", "application/x-rar-compressed", ".rar"),
    (0, "377abcaf271c", "application/x-7z-compressed", ".7z"),
    (257, "7573746172", "application/x-tar", ".tar"),
    (0, "1f8b", "application/gzip", ".gz"),
    (0, "425a68", "application/x-bzip2", ".bz2"),
    (0, "fd377a585a00", "application/x-xz", ".xz"),
    (0, "7f454c46", "application/x-executable", ".elf"),
    (0, "4d5a", "application/x-dosexec", ".exe"),
    (0, "cffaedfe", "application/x-mach-binary", ".macho"),
)
DOCUMENT_MIME = ("application/pdf", "application/msword", "application/rtf", "text/plain", "text/html", "text/markdown", "text/csv")
ARCHIVE_MIME = ("application/zip", "application/x-rar-compressed", "application/x-7z-compressed", "application/x-tar", "application/gzip", "application/x-bzip2", "application/x-xz")
# Categories of extensions when no magic bytes are known.
FALLBACK = (
    ("sidecar", (
        ".xmp", ".thm", ".lrf", ".lrv", ".aae", ".moi", ".cpi", ".bdm", ".mpl", ".rmd", ".ale", ".sidecar", ".nksc", ".gpr",
    )),
    ("document", (
        ".txt", ".md", ".markdown", ".rst", ".csv", ".tsv",
    )),
    ("data", (
        ".log", ".json", ".yaml", ".yml", ".xml",
    )),
    ("ebook", (
        ".epub", ".mobi", ".azw", ".azw3", ".azw4", ".kfx", ".fb2",
    )),
    ("email", (
        ".eml", ".msg", ".mbox",
    )),
    ("font", (
        ".ttf", ".otf", ".woff", ".woff2", ".eot",
    )),
    ("model3d", (
        ".glb", ".gltf", ".obj", ".fbx", ".stl", ".dae", ".3ds", ".blend", ".usdz",
    )),
    ("calendar", (
        ".ics", ".ical", ".vcs",
    )),
    ("contact", (
        ".vcf", ".vcard",
    )),
    ("geospatial", (
        ".gpx", ".kml", ".kmz", ".geojson", ".shp", ".gpkg", ".fit", ".tcx",
    )),
    ("subtitle", (
        ".srt", ".vtt", ".ass", ".ssa", ".sub", ".sbv",
    )),
)
SIDECARS = FALLBACK[0][1]
SUBTITLES = FALLBACK[-1][1]


def magic_mime(content: Column) -> tuple[Column, Column]:
    """(MIME type, usual extension) by leading bytes; null if they say nothing. The head is read once and the table
    is an array, since a chain of conditions outgrows what Spark compiles."""
    table = F.array(*[F.struct(F.lit(2 * at + 1).alias("at"), F.lit(magic).alias("magic"), F.lit(m).alias("mime"), F.lit(e).alias("ext")) for at, magic, m, e in MAGIC])
    first = lambda head: F.get(F.filter(table, lambda r: F.substring(head, r["at"], F.length(r["magic"])) == r["magic"]), F.lit(0))
    found = F.transform(F.array(F.lower(F.hex(F.substring(content, 1, 300)))), first)[0]
    return found["mime"], found["ext"]


def mime_category(mime: Column) -> Column:
    return (
        F.when(mime.startswith("image/"), "image").when(mime.startswith("video/"), "video").when(mime.startswith("audio/"), "audio")
        .when(mime.isin(*DOCUMENT_MIME) | mime.startswith("application/vnd.openxmlformats") | mime.startswith("application/vnd.ms-"), "document")
        .when(mime.isin(*ARCHIVE_MIME), "archive").when(mime.isin("application/epub+zip", "application/x-mobipocket-ebook"), "ebook")
        .when(mime.isin("application/json", "application/xml", "text/xml", "application/x-yaml"), "data")
        .when(mime.isin("application/x-executable", "application/x-mach-binary", "application/x-dosexec", "application/x-sharedlib"), "executable")
        .otherwise("other")
    )


def fallback_category(ext: Column) -> Column:
    out = F.when(ext.isin(*RAW_EXT), "image").otherwise("other")
    for name, exts in FALLBACK:
        out = F.when(ext.isin(*exts), name).otherwise(out)
    return out


def fallback_mime(ext: Column) -> Column:
    known = {".xmp": "application/rdf+xml", ".json": "application/json", ".xml": "application/xml", ".txt": "text/plain", ".md": "text/markdown", ".csv": "text/csv", ".srt": "text/plain", ".vtt": "text/vtt"}
    out = F.when(ext.isin(*RAW_EXT), "image/x-raw").otherwise("application/octet-stream")
    for e, m in known.items():
        out = F.when(ext == e, m).otherwise(out)
    return out


def subcategory(category: Column, mime: Column, ext: Column) -> Column:
    image = F.when(ext.isin(*RAW_EXT), "raw").when(F.contains(mime, F.lit("svg")), "graphic").otherwise("photo")
    sheet = F.contains(mime, F.lit("spreadsheet")) | ext.isin(".xlsx", ".xls")
    show = F.contains(mime, F.lit("presentation")) | ext.isin(".pptx", ".ppt")
    doc = F.when(mime == "application/pdf", "pdf").when(sheet, "spreadsheet").when(show, "presentation").otherwise("text")
    side = F.when(ext.isin(".xmp", ".json", ".xml", ".thm"), F.substring(ext, 2, 10))
    return F.when(category == "image", image).when(category == "document", doc).when(category == "sidecar", side).when(category == "archive", F.when(ext.isin(".dmg", ".iso"), "disk_image").otherwise("compressed"))


def detect_type(path: Column, content: Column) -> Column:
    """struct<category, subcategory, mime, ext, mismatch, by_magic>: magic bytes win; without any, the
    extension decides. mismatch: the declared extension is not the usual one of the content."""
    mime, usual = magic_mime(content)

    def decided(x: Column) -> Column:
        ext, found = x["ext"], x["mime"].isNotNull()
        m = F.coalesce(x["mime"], fallback_mime(ext))
        c = F.when(found, mime_category(x["mime"])).otherwise(fallback_category(ext))
        return F.struct(c.alias("category"), m.alias("mime"), F.coalesce(x["usual"], ext).alias("ext"), (found & (ext != x["usual"])).alias("mismatch"), found.alias("by_magic"), ext.alias("declared"))

    def whole(x: Column) -> Column:
        return F.struct(x["category"].alias("category"), subcategory(x["category"], x["mime"], x["declared"]).alias("subcategory"), *[x[c].alias(c) for c in ("mime", "ext", "mismatch", "by_magic")])

    seen = F.array(F.struct(mime.alias("mime"), usual.alias("usual"), F.lower(extension(path)).alias("ext")))
    return F.transform(F.transform(seen, decided), whole)[0]


def is_sidecar(path: Column) -> Column:
    return F.lower(extension(path)).isin(*SIDECARS)


def is_subtitle(path: Column) -> Column:
    return F.lower(extension(path)).isin(*SUBTITLES)


def is_hidden(path: Column) -> Column:
    """Proxies, thumbnails, edits and SDR doubles: imported, but not shown."""
    return F.lower(extension(path)).isin(".aae", ".lrf", ".lrv", ".thm", ".moi", ".cpi", ".bdm", ".mpl") | F.contains(base_name(path), F.lit("_SDR."))


def is_skipped(path: Column) -> Column:
    """Files of operating systems."""
    return base_name(path).rlike(r"^\._|^\.DS_Store$|^(?i)Thumbs\.db$|^(?i)desktop\.ini$|^\.Spotlight-|^\.fseventsd$|^\.Trashes$")


def is_xml_sidecar(path: Column) -> Column:
    return F.lower(extension(path)).isin(".xml", ".fcpxml")


NOT_EMBEDDED = (".thm", ".lrv", ".lrf", ".gpr", ".sidecar")


def embeds(ext: Column, size: Column) -> Column:
    """Whether a companion's content goes into the record: 10 MiB at most, no proxies."""
    return (size <= 10 * 1024 * 1024) & ~F.lower(ext).isin(*NOT_EMBEDDED)


KNOWN_CATEGORIES = ("image", "video", "audio", "document", "archive", "sidecar", "ebook", "email", "font", "model3d", "calendar", "contact", "geospatial", "subtitle", "executable", "data")


def import_category(c: Column) -> Column:
    return F.when(c == "photo", "image").when(c.isin(*KNOWN_CATEGORIES), c).otherwise("other")


def source_type(has_chain: Column, network: Column, camera: Column, phone: Column, card: Column, removable: Column, mount: Column) -> Column:
    cloud = F.lower(mount).rlike("dropbox|google drive|onedrive|icloud")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(~yes(has_chain), "unknown").when(yes(network), "network_share").when(yes(camera), "camera_direct").when(yes(phone), "phone_direct").when(yes(card), "memory_card")
        .when(yes(removable) & yes(cloud), "cloud_sync").otherwise("local_disk")
    )


def media_type(capacity: Column, name: Column) -> Column:
    n = F.lower(F.coalesce(name, F.lit("")))
    gb = capacity / F.lit(float(1 << 30))
    return (
        F.when(n.rlike("nvme|pcie"), "nvme").when(n.rlike("ssd|solid state"), "ssd").when(n.rlike("hdd|hard drive"), "hdd").when(n.rlike("cfexpress|cfx"), "cfexpress")
        .when(n.rlike("compactflash| cf "), "cf").when(gb <= 512, "sd").when(gb <= 4096, "ssd").otherwise("hdd")
    )


# Names of volumes.
NETWORK_PREFIXES = ("//", "\\\\", "smb://", "nfs://", "afp://", "/net/")
LOCAL_VOLUMES = ("macintosh hd", "ssd", "internal", "system", "data", "preboot", "recovery", "vm")
CAMERA_VOLUMES = ("sdcard", "sd card", "no name", "untitled", "dcim", "eos_digital", "canon_dc", "canon", "nikon", "sony", "pmhome", "private", "panasonic", "lumix", "fuji", "fujifilm", "gopro", "hero", "dji", "mavic", "phantom", "blackmagic", "bmpcc", "red", "r3d")


def storage_type(path: Column) -> Column:
    low, volume = F.lower(path), F.lower(F.split_part(path, F.lit("/"), F.lit(3)))
    any_of = lambda c, names: F.expr("false") if not names else c.rlike("|".join(n.replace(".", r"\.") for n in names))
    starts = F.lit(False)
    for p in NETWORK_PREFIXES:
        starts = starts | low.startswith(p)
    volumes = F.when(any_of(volume, LOCAL_VOLUMES), "local").when(any_of(volume, CAMERA_VOLUMES), "camera_media").otherwise("network")
    mounted = F.when(any_of(low, CAMERA_VOLUMES), "camera_media").otherwise("network")
    return F.when(path.isNull() | (path == ""), "unknown").when(starts, "network").when(path.startswith("/Volumes/"), volumes).when(path.startswith("/mnt/") | path.startswith("/media/"), mounted).otherwise("local")


# Buffer bytes, parallel operations and delay in ms by storage type.
STORAGE = {"local": (64 * 1024, 8, 0), "camera_media": (256 * 1024, 2, 10), "network": (1024 * 1024, 1, 50), "unknown": (128 * 1024, 2, 10)}


def storage_config(kind: Column) -> Column:
    """struct<buffer, parallel, delay_ms>."""
    one = lambda k: F.struct(*[F.lit(v).alias(n) for n, v in zip(("buffer", "parallel", "delay_ms"), STORAGE[k], strict=True)])
    return F.when(kind == "local", one("local")).when(kind == "camera_media", one("camera_media")).when(kind == "network", one("network")).otherwise(one("unknown"))


# Audio extensions and codecs.
LOSSLESS_EXT = (".flac", ".aiff", ".aif", ".wav", ".wave", ".alac", ".ape", ".wv", ".tta", ".tak", ".dsd", ".dsf")
LOSSY_EXT = (".mp3", ".m4a", ".aac", ".ogg", ".opus", ".wma", ".mpc", ".mp2")
LOSSY_CODECS = ("mp3", "aac", "vorbis", "opus", "wma", "wmav1", "wmav2", "mp2", "mp1", "ac3", "eac3", "dts", "truehd")
LOSSLESS_CODEC = r"^(flac|alac|wavpack|ape|tta|tak|pcm_s(16|24|32)(le|be)|pcm_f32(le|be)|pcm_s(16|24|32)le_planar|dsd_(lsbf|msbf)(_planar)?)$"


def audio_quality(ext: Column, codec: Column, bit_depth: Column, cutoff_hz: Column) -> Column:
    """lossless, lossy, transcode_suspected (a lossless container cut below 20 kHz) or unknown."""
    e, lossless = F.lower(ext), F.coalesce(codec.rlike(LOSSLESS_CODEC), F.lit(False))
    return (
        F.when((e.isin(*LOSSLESS_EXT) | lossless) & (cutoff_hz < 20000) & (cutoff_hz != 0), "transcode_suspected")
        .when(e.isin(*LOSSY_EXT) | F.coalesce(codec.isin(*LOSSY_CODECS), F.lit(False)), "lossy")
        .when(lossless | e.isin(*LOSSLESS_EXT) | (bit_depth >= 16), "lossless").otherwise("unknown")
    )


def can_convert_to_flac(quality: Column, fmt: Column) -> Column:
    return (quality == "lossless") & (fmt != "flac")


def hdr_format(declared: Column, compatible: Column, transfer: Column) -> Column:
    t = F.upper(transfer)
    return F.coalesce(F.nullif(declared, F.lit("")), F.nullif(compatible, F.lit("")), F.when(t.isin("PQ", "SMPTE ST 2084", "SMPTE2084"), "HDR10").when(t.isin("HLG", "ARIB STD-B67", "ARIB-STD-B67"), "HLG"))


def scan_type(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), None).when(F.contains(F.lower(c), F.lit("interlace")), "interlaced").otherwise("progressive")


def frame_rate(c: Column) -> Column:
    """A fraction such as 30000/1001 as a double."""
    return F.try_divide(F.expr("1.0D") * F.split_part(c, F.lit("/"), F.lit(1)).try_cast("double"), F.coalesce(F.nullif(F.split_part(c, F.lit("/"), F.lit(2)), F.lit("")).try_cast("double"), F.lit(1.0)))


def frame_rate_mode(real: Column, average: Column) -> Column:
    r, a = frame_rate(real), frame_rate(average)
    return F.when((r > 0) & (a > 0), F.when(F.abs(r - a) < 0.5, "constant").otherwise("variable"))


def mesh_complexity(vertices: Column) -> Column:
    return F.when(vertices < 1000, "simple").when(vertices < 50_000, "moderate").when(vertices < 500_000, "complex").otherwise("very_complex")
