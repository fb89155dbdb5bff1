"""Metadata extractors over binary content: one row in, one struct of tags out.

What the standard library can read is read here; where a format needs a library that is absent,
or content is broken, tags are null and error says why. Dumps of external tools (MediaInfo,
ffprobe, fpcalc) are parsed as JSON by expressions.
"""

from __future__ import annotations

import io
import json
import re
import struct
import tarfile
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.filetype import frame_rate, frame_rate_mode, hdr_format, scan_type

TEXT_LIMIT, ENTRY_LIMIT, TOP_EXECUTABLES = 100_000, 100, 10
EXECUTABLE = (".exe", ".dll", ".bat", ".cmd", ".com", ".msi", ".scr", ".ps1", ".vbs", ".js", ".jar", ".sh", ".app", ".deb", ".rpm")


def office(data: bytes) -> dict:
    """Text and counts of docx, pptx and xlsx."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = z.namelist()

    def texts(name, tags):
        return ["".join(e.itertext()) for e in ElementTree.fromstring(z.read(name)).iter() if e.tag.rpartition("}")[2] in tags]

    out: dict = {}
    if "word/document.xml" in names:
        body, out["kind"] = texts("word/document.xml", {"p"}), "docx"
        out["paragraphs"] = len(body)
    elif any(n.startswith("ppt/slides/slide") for n in names):
        slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        body, out["kind"], out["slides"] = [t for n in slides for t in texts(n, {"t"})], "pptx", len(slides)
    elif "xl/workbook.xml" in names:
        sheets = [n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
        body, out["kind"], out["sheets"] = texts("xl/sharedStrings.xml", {"si"}) if "xl/sharedStrings.xml" in names else [], "xlsx", len(sheets)
    else:
        raise ValueError("no office document")
    text = "\n".join(t for t in body if t)
    if "docProps/core.xml" in names:
        for e in ElementTree.fromstring(z.read("docProps/core.xml")):
            if e.text and e.tag.rpartition("}")[2] in ("title", "creator", "created", "modified"):
                out[e.tag.rpartition("}")[2]] = e.text
    return out | {"words": len(text.split()), "chars": len(text), "text": text[:TEXT_LIMIT], "truncated": len(text) > TEXT_LIMIT}


def epub(data: bytes) -> dict:
    z = zipfile.ZipFile(io.BytesIO(data))
    opf = ElementTree.fromstring(z.read(next(e.attrib["full-path"] for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if e.tag.endswith("rootfile"))))
    out = {"kind": "epub"}
    for e in opf.iter():
        t = e.tag.rpartition("}")[2]
        if t in ("title", "creator", "language", "publisher", "identifier", "date", "description") and e.text:
            out.setdefault(t, e.text.strip())
    return out | {"items": sum(e.tag.endswith("}item") for e in opf.iter())}


def archive(data: bytes) -> dict:
    """Entries, sizes and executables of zip and tar archives."""
    if zipfile.is_zipfile(io.BytesIO(data)):
        z = zipfile.ZipFile(io.BytesIO(data))
        rows = [(i.filename, i.file_size, i.compress_size, i.is_dir()) for i in z.infolist()]
        kind, locked = "zip", any(i.flag_bits & 1 for i in z.infolist())
    else:
        t = tarfile.open(fileobj=io.BytesIO(data))
        rows, kind, locked = [(m.name, m.size, 0, m.isdir()) for m in t.getmembers()], "tar", False
    size, packed = sum(r[1] for r in rows), sum(r[2] for r in rows)
    exe = [r[0] for r in rows if r[0].lower().endswith(EXECUTABLE)]
    return {"kind": kind, "files": sum(not r[3] for r in rows), "folders": sum(r[3] for r in rows), "size": size, "packed": packed, "ratio": packed / size if size and packed else None, "encrypted": locked, "executables": exe[:TOP_EXECUTABLES], "entries": [r[0] for r in rows[:ENTRY_LIMIT]]}


def email(data: bytes) -> dict:
    from email import policy
    from email.parser import BytesParser

    m = BytesParser(policy=policy.default).parsebytes(data)
    if not m.keys():
        raise ValueError("no headers")
    body = m.get_body(preferencelist=("plain", "html"))
    text = body.get_content() if body is not None else ""
    files = [p.get_filename() for p in m.iter_attachments() if p.get_filename()]
    return {"kind": "eml", **{k.lower().replace("-", "_"): str(m[k]) for k in ("Subject", "From", "To", "Cc", "Date", "Message-ID", "In-Reply-To") if m[k]}, "attachments": files, "attachment_count": len(files), "preview": text[:500], "chars": len(text)}


def mesh(data: bytes) -> dict:
    """Counts of OBJ, STL and GLB models."""
    if data[:4] == b"glTF":
        n = struct.unpack_from("<I", data, 12)[0]
        g = json.loads(data[20 : 20 + n])
        acc = g.get("accessors", [])
        prims = [p for m in g.get("meshes", []) for p in m.get("primitives", [])]
        v = sum(acc[p["attributes"]["POSITION"]]["count"] for p in prims if "POSITION" in p.get("attributes", {}))
        f = sum(acc[p["indices"]]["count"] // 3 for p in prims if "indices" in p)
        return {"kind": "glb", "vertices": v, "faces": f, "meshes": len(g.get("meshes", [])), "materials": len(g.get("materials", [])), "animations": len(g.get("animations", []))}
    if len(data) >= 84 and len(data) == 84 + 50 * struct.unpack_from("<I", data, 80)[0]:
        n = struct.unpack_from("<I", data, 80)[0]
        return {"kind": "stl", "vertices": 3 * n, "faces": n}
    lines = data.decode("utf-8").splitlines()
    v, f = sum(x.startswith("v ") for x in lines), sum(x.startswith("f ") for x in lines)
    if not v:
        raise ValueError("no mesh")
    return {"kind": "obj", "vertices": v, "faces": f, "materials": len({x.split()[1] for x in lines if x.startswith("usemtl ") and len(x.split()) > 1})}


def font(data: bytes) -> dict:
    """Names and glyph count of TrueType and OpenType fonts."""
    if data[:4] not in (b"\0\1\0\0", b"OTTO", b"true"):
        raise ValueError("no font")
    n = struct.unpack_from(">H", data, 4)[0]
    at = {data[12 + 16 * i : 16 + 16 * i]: struct.unpack_from(">II", data, 20 + 16 * i) for i in range(n)}
    out: dict = {"kind": "otf" if data[:4] == b"OTTO" else "ttf", "variable": b"fvar" in at, "color": b"COLR" in at or b"SVG " in at}
    if b"maxp" in at:
        out["glyphs"] = struct.unpack_from(">H", data, at[b"maxp"][0] + 4)[0]
    if b"name" in at:
        o = at[b"name"][0]
        count, text = struct.unpack_from(">HH", data, o + 2)
        for i in range(count):
            p, _, _, nid, length, off = struct.unpack_from(">6H", data, o + 6 + 12 * i)
            key = {1: "family", 2: "style", 4: "full_name", 5: "version"}.get(nid)
            if key:
                raw = data[o + text + off : o + text + off + length]
                out.setdefault(key, raw.decode("utf-16-be" if p in (0, 3) else "latin-1", "replace"))
    return out


def pdf(data: bytes) -> dict:
    """Pages, version and, with pypdf, the text."""
    if not data.startswith(b"%PDF-"):
        raise ValueError("no PDF")
    out = {"kind": "pdf", "version": data[5:8].decode("latin-1"), "pages": len(re.findall(rb"/Type\s*/Page[^s]", data)), "encrypted": b"/Encrypt" in data}
    try:
        import pypdf

        text = "\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages)
        out |= {"text": text[:TEXT_LIMIT], "chars": len(text), "words": len(text.split()), "truncated": len(text) > TEXT_LIMIT}
    except ImportError:
        pass
    return out


# EXIF tags by number.
EXIF = {0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0131: "Software", 0x0132: "ModifyDate", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "ISO", 0x9003: "DateTimeOriginal", 0x920A: "FocalLength", 0xA002: "ExifImageWidth", 0xA003: "ExifImageHeight", 0xA431: "SerialNumber", 0xA434: "LensModel"}
GPS = {1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude"}


def exif(data: bytes) -> dict:
    """EXIF tags of a JPEG or TIFF; GPS in signed degrees."""
    if data[:2] == b"\xff\xd8":
        i = data.find(b"Exif\0\0")
        if i < 0:
            raise ValueError("no EXIF")
        data = data[i + 6 :]
    end = {b"II": "<", b"MM": ">"}.get(data[:2])
    if end is None:
        raise ValueError("no EXIF")
    out: dict = {"kind": "exif"}

    def values(kind, n, at):
        size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}.get(kind, 1)
        o = at if size * n <= 4 else struct.unpack_from(end + "I", data, at)[0]
        if kind == 2:
            return data[o : o + n].split(b"\0")[0].decode("utf-8", "replace").strip()
        if kind in (5, 10):
            f = struct.unpack_from(f"{end}{2 * n}{'I' if kind == 5 else 'i'}", data, o)
            v = [a / b if b else 0.0 for a, b in zip(f[::2], f[1::2], strict=True)]
        else:
            v = list(struct.unpack_from(f"{end}{n}{ {1: 'B', 3: 'H', 4: 'I', 7: 'B', 9: 'i'}.get(kind, 'B')}", data, o))
        return v[0] if n == 1 else v

    def folder(at, names):
        for i in range(struct.unpack_from(end + "H", data, at)[0]):
            e = at + 2 + 12 * i
            tag, kind, n = struct.unpack_from(end + "HHI", data, e)
            if tag in (0x8769, 0x8825):
                folder(struct.unpack_from(end + "I", data, e + 8)[0], EXIF if tag == 0x8769 else GPS)
            elif tag in names:
                out[names[tag]] = values(kind, n, e + 8)

    folder(struct.unpack_from(end + "I", data, 4)[0], EXIF)
    for c, neg in (("GPSLatitude", "S"), ("GPSLongitude", "W")):
        if isinstance(v := out.get(c), list) and len(v) == 3:
            out[c] = (v[0] + v[1] / 60 + v[2] / 3600) * (-1 if out.get(c + "Ref") == neg else 1)
    return out


EXTRACTORS: dict[str, Callable[[bytes], dict]] = {"office": office, "epub": epub, "archive": archive, "email": email, "mesh": mesh, "font": font, "pdf": pdf, "exif": exif}
# Extensions by extractor.
BY_EXTENSION = {
    "office": (".docx", ".xlsx", ".pptx",),
    "epub": (".epub",),
    "archive": (".zip", ".tar", ".tgz", ".gz", ".bz2", ".xz", ".jar",),
    "email": (".eml",),
    "mesh": (".obj", ".stl", ".glb",),
    "font": (".ttf", ".otf",),
    "pdf": (".pdf",),
    "exif": (".jpg", ".jpeg", ".jpe", ".tif", ".tiff", ".dng", ".nef", ".cr2", ".arw",),
}


def extract(files: DataFrame, extractor: str | None = None, key: str = "path", content: str = "content", prefix: bool = True) -> DataFrame:
    """(key, extractor, tags map<string,string>, error) of each row; without a name the extractor is
    chosen by the key's extension, and rows that have none give null tags. Lists are JSON texts."""
    ext = {e: n for n, es in BY_EXTENSION.items() for e in es}

    def run(frames):
        for pdf_ in frames:
            out = []
            for k, data in zip(pdf_[key], pdf_[content], strict=True):
                name = extractor or ext.get(re.search(r"(\.[^./]*)?$", str(k).lower())[0])
                try:
                    if name is None or data is None:
                        out.append((k, name, None, None if name is None else "no content"))
                        continue
                    found = EXTRACTORS[name](bytes(data))
                    tag = name.capitalize() + "_" if prefix else ""
                    out.append((k, name, {tag + a: v if isinstance(v, str) else json.dumps(v) for a, v in found.items() if v is not None}, None))
                except Exception as e:  # noqa: BLE001  a broken file is a row, whatever its parser raises
                    out.append((k, name, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["key", "extractor", "tags", "error"])

    kind = dict(files.dtypes)[key]
    return files.select(key, content).mapInPandas(run, f"key {kind}, extractor string, tags map<string,string>, error string").withColumnRenamed("key", key)


# --- dumps of external tools ----------------------------------------------------------------------------

MEDIAINFO = "media struct<track array<map<string,string>>>"
FFPROBE = "format struct<format_name string, duration string, bit_rate string, tags map<string,string>>, streams array<struct<codec_type string, codec_name string, width int, height int, r_frame_rate string, avg_frame_rate string, color_transfer string, color_primaries string, field_order string, channels int, sample_rate string, bit_rate string, bits_per_raw_sample string, tags map<string,string>>>, chapters array<struct<id bigint>>"


def mediainfo(docs: DataFrame, dump: str = "dump") -> DataFrame:
    """docs with mediainfo: container, codec, size, rate, HDR and scan of a JSON dump."""
    d = docs.withColumn("_m", F.from_json(dump, MEDIAINFO))
    track = lambda kind: F.get(F.filter("_m.media.track", lambda t: t["@type"] == kind), F.lit(0))
    g, v, a = (track(k) for k in ("General", "Video", "Audio"))
    mode = F.when(v["FrameRate_Mode"].isNotNull(), F.when(F.lower(v["FrameRate_Mode"]).isin("constant", "cfr"), "constant").otherwise("variable"))
    s = F.struct(
        g["Format"].alias("container"), v["Format"].alias("codec"), v["Width"].try_cast("int").alias("width"), v["Height"].try_cast("int").alias("height"), v["FrameRate"].try_cast("double").alias("frame_rate"), mode.alias("frame_rate_mode"),
        g["Duration"].try_cast("double").alias("duration_s"), hdr_format(v["HDR_Format"], v["HDR_Format_Compatibility"], v["transfer_characteristics"]).alias("hdr"), scan_type(v["ScanType"]).alias("scan_type"), a["Format"].alias("audio_codec"), a["Channels"].try_cast("int").alias("channels"), a["SamplingRate"].try_cast("int").alias("sample_rate"),
    )
    return d.withColumn("mediainfo", F.when(F.col("_m.media").isNotNull(), s)).drop("_m")


def ffprobe(docs: DataFrame, dump: str = "dump") -> DataFrame:
    """docs with ffprobe: container, codecs, rates, HDR, and numbers of streams and chapters of a JSON dump."""
    d = docs.withColumn("_p", F.from_json(dump, FFPROBE))
    of = lambda kind: F.filter("_p.streams", lambda s: s["codec_type"] == kind)
    v, a = F.get(of("video"), F.lit(0)), F.get(of("audio"), F.lit(0))
    hdr = F.when(v["color_primaries"] == "bt2020", F.when(v["color_transfer"] == "arib-std-b67", "HLG").when(v["color_transfer"] == "smpte2084", "HDR10"))
    dolby = F.exists("_p.streams", lambda s: F.contains(F.lower(F.coalesce(s["codec_name"], F.lit(""))), F.lit("dolby")))
    s = F.struct(
        F.col("_p.format.format_name").alias("container"), v["codec_name"].alias("codec"), v["width"].alias("width"), v["height"].alias("height"), frame_rate(v["avg_frame_rate"]).alias("frame_rate"), frame_rate_mode(v["r_frame_rate"], v["avg_frame_rate"]).alias("frame_rate_mode"),
        F.col("_p.format.duration").try_cast("double").alias("duration_s"), F.when(dolby, "Dolby Vision").otherwise(hdr).alias("hdr"), a["codec_name"].alias("audio_codec"), a["channels"].alias("channels"), a["sample_rate"].try_cast("int").alias("sample_rate"),
        F.size(of("video")).alias("video_streams"), F.size(of("audio")).alias("audio_streams"), F.size(of("subtitle")).alias("subtitle_streams"), F.coalesce(F.size("_p.chapters"), F.lit(0)).alias("chapters"),
    )
    return d.withColumn("ffprobe", F.when(F.col("_p.format").isNotNull(), s)).drop("_p")


def video_cascade(exif_: str, mediainfo_: str, ffprobe_: str) -> Column:
    """A video's fields: EXIF first, then MediaInfo, then ffprobe where MediaInfo is missing or has no rate."""
    from attestra.functions.metadata import first_text

    texts, numbers = ("container", "codec", "hdr", "frame_rate_mode", "audio_codec"), ("width", "height", "frame_rate", "duration_s")
    use = F.col(mediainfo_).isNull() | F.col(f"{mediainfo_}.frame_rate").isNull()
    p = lambda c: F.when(use, F.col(f"{ffprobe_}.{c}"))
    return F.struct(*[first_text(F.col(f"{exif_}.{c}"), F.col(f"{mediainfo_}.{c}"), p(c)).alias(c) for c in texts], *[F.coalesce(F.col(f"{exif_}.{c}"), F.col(f"{mediainfo_}.{c}"), p(c)).alias(c) for c in numbers])


def acoustic(docs: DataFrame, dump: str = "dump") -> DataFrame:
    """docs with fingerprint and duration of an fpcalc JSON dump."""
    d = docs.withColumn("_f", F.from_json(dump, "duration double, fingerprint string"))
    return d.select(*docs.columns, F.col("_f.duration").alias("duration"), F.col("_f.fingerprint").alias("fingerprint"))


def guess_name(name: Column) -> Column:
    """struct<type, title, season, episode, year, resolution> guessed from a video's file name."""
    tv = r"(?i)^(.*?)[ ._-]+s(\d{1,2})[ ._-]?e(\d{1,3})"
    movie = r"^(.*?)[ ._(\[-]+((?:19|20)\d{2})(?!\d)"
    clean = lambda c: F.trim(F.regexp_replace(c, r"[._]+", " "))
    num = lambda c: F.nullif(c, F.lit("")).try_cast("int")
    is_tv = name.rlike(tv)
    title = F.when(is_tv, F.regexp_extract(name, tv, 1)).when(name.rlike(movie), F.regexp_extract(name, movie, 1)).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))
    return F.struct(F.when(is_tv, "episode").otherwise("movie").alias("type"), clean(title).alias("title"), num(F.regexp_extract(name, tv, 2)).alias("season"), num(F.regexp_extract(name, tv, 3)).alias("episode"), F.when(~is_tv, num(F.regexp_extract(name, movie, 2))).alias("year"), F.nullif(F.regexp_extract(name, r"(?i)(\d{3,4}[pi])\b", 1), F.lit("")).alias("resolution"))


def available_tools() -> dict[str, bool]:
    """Which optional tools and libraries this host has."""
    import importlib.util
    import shutil

    return {t: shutil.which(t) is not None for t in ("exiftool", "mediainfo", "ffprobe", "fpcalc", "b3sum")} | {m: importlib.util.find_spec(m) is not None for m in ("blake3", "PIL", "pypdf", "fontTools")}
