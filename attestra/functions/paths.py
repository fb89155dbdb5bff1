"""Paths, patterns and formats as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    """The part after the last slash."""
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """The part before the last slash; empty if there is none."""
    return F.substring(path, F.lit(1), F.greatest(F.lit(0), F.length(path) - F.length(base_name(path)) - 1))


def extension(path: Column) -> Column:
    """The extension with its dot, as written; a name's leading dots do not begin one."""
    return F.regexp_extract(base_name(path), r"[^.].*?(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    """The name without its extension; empty if it has none."""
    name, ext = base_name(path), extension(path)
    return F.when(ext == "", F.lit("")).otherwise(F.substring(name, F.lit(1), F.length(name) - F.length(ext)))


def parse_path(path: Column) -> Column:
    """struct<dir, base, name, ext, ext_lower, name_lower>."""
    return F.struct(directory(path).alias("dir"), base_name(path).alias("base"), stem(path).alias("name"), extension(path).alias("ext"), F.lower(extension(path)).alias("ext_lower"), F.lower(stem(path)).alias("name_lower"))


def simple_glob(path: Column, pattern: str) -> Column:
    """Whether the whole path matches: a star stands for anything, a slash too; a dot is itself."""
    return path.rlike("^" + pattern.replace(".", r"\.").replace("*", ".*") + "$")


def wildcard(name: Column, pattern: str) -> Column:
    """Whether the whole name matches a pattern of stars and question marks, whatever the case."""
    body = re.escape(pattern).replace(r"\*", ".*").replace(r"\?", ".")
    return name.rlike(f"(?i)^{body}$")


# Patterns that are always ignored.
DEFAULT_IGNORES = (".git/", ".svn/", ".hg/", ".DS_Store", "Thumbs.db", "*.partial", "*.tmp", "*.swp", "*~", "node_modules/", ".scanignore")


def ignore_regex(pattern: str) -> tuple[str, bool] | None:
    """(regular expression over a relative path, negated) of one line of an ignore file; None for blanks and comments."""
    p = pattern.strip()
    if not p or p.startswith("#"):
        return None
    negated = p.startswith("!")
    p = p[1:] if negated else p
    folder = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out, i = out + "/.+", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and (j := p.find("]", i + 2)) > 0:
            body = p[i + 1 : j]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", j + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}{'/.*' if folder else '(?:/.*)?'}$", negated


def ignored(path: Column, patterns=DEFAULT_IGNORES) -> Column:
    """Whether a relative path is ignored: of the patterns that match it or a folder above it, the
    last decides. A pattern that ends in a slash names folders, so only what is below one matches."""
    out = F.lit(False)
    for p in patterns:
        if (r := ignore_regex(p)) is not None:
            out = F.when(path.rlike(r[0]), F.lit(not r[1])).otherwise(out)
    return out


def ignore_lines(text: str) -> list[str]:
    """The patterns of an ignore file: trimmed, without blanks and comments."""
    return [x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]


def is_network_path(path: Column) -> Column:
    return path.rlike(r"^/Volumes/|^/mnt/|^/media/|^/run/user/.*/gvfs|^/net/|^\\\\|^//[^/]+/")


def volume_name(path: Column) -> Column:
    return F.when(path.startswith("/Volumes/"), F.nullif(F.split_part(path, F.lit("/"), F.lit(3)), F.lit("")))


def already_hashed(name: Column) -> Column:
    """Whether the name without its extension ends in a dot and a 16 or 64 digit hash."""
    return name.rlike(r"\.[a-f0-9]{16}(\.[^.]*)?$|\.[a-f0-9]{64}(\.[^.]*)?$")


def renamed(path: Column, h: Column, pattern: str = "{name}.{hash}{ext}", full: bool = False) -> Column:
    """The name that a pattern of {name}, {hash} and {ext} gives; null if the name has its hash already."""
    digest = h if full else F.substring(h, 1, 16)
    name = F.when(extension(path) == "", base_name(path)).otherwise(stem(path))
    out = F.lit(pattern)
    for key, value in (("{name}", name), ("{hash}", digest), ("{ext}", extension(path))):
        out = F.replace(out, F.lit(key), value)
    return F.when(~already_hashed(base_name(path)), F.concat(F.when(directory(path) == "", F.lit("")).otherwise(F.concat(directory(path), F.lit("/"))), out))


ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def xml_escape(c: Column) -> Column:
    for raw, name in ENTITIES:
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def xml_unescape(c: Column) -> Column:
    for raw, name in reversed(ENTITIES):
        c = F.replace(c, F.lit(name), F.lit(raw))
    return c


def tag_text(xml: Column, tag: str) -> Column:
    """The text of the first element of a name, without markup inside; null if there is none."""
    return F.nullif(F.regexp_extract(xml, rf"<{re.escape(tag)}(?:\s[^>]*)?>([^<]*)</{re.escape(tag)}>", 1), F.lit(""))


def strip_cue_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ""), r"\{[^}]*\}", ""), r"\\[Nn]", " "))


UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def format_bytes(n: Column, decimals: int = 1) -> Column:
    """A size in units of 1024; zero is '0 B', a negative size has its sign in front."""
    size = F.abs(n.cast("double"))
    out = F.lit(None).cast("string")
    for k in range(len(UNITS) - 1, -1, -1):
        out = F.when(size < float(1024 ** (k + 1)), F.format_string(f"%.{decimals}f {UNITS[k]}", F.round(size / float(1024**k), decimals))).otherwise(out) if k < len(UNITS) - 1 else F.format_string(f"%.{decimals}f {UNITS[k]}", F.round(size / float(1024**k), decimals))
    return F.when(n == 0, "0 B").when(n < 0, F.concat(F.lit("-"), out)).otherwise(out)


def format_duration(ms: Column) -> Column:
    """2h5m0s, 5m3s or 7s; '--' if unknown, '<1s' below a second."""
    s = F.floor(ms / 1000).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    text = F.when(h > 0, F.concat(h, F.lit("h"), m, F.lit("m"), r, F.lit("s"))).when(m > 0, F.concat(m, F.lit("m"), r, F.lit("s"))).otherwise(F.concat(r, F.lit("s")))
    return F.when(ms.isNull(), "--").when(ms < 1000, "<1s").otherwise(text)


def format_throughput(rate: Column) -> Column:
    return F.when(rate > 0, F.concat(format_bytes(rate), F.lit("/s"))).otherwise("--")


def format_eta(ms: Column) -> Column:
    return F.when(ms.isNull(), "calculating...").when(ms < 1000, "almost done").otherwise(format_duration(ms))


def progress_bar(percent: Column, width: int = 20) -> Column:
    filled = F.round(percent / 100 * width).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled), F.lit("] "), F.round(percent).cast("int"), F.lit("%"))


def truncated_path(path: Column, width: int = 50) -> Column:
    """path in at most width characters: the name is kept, then as much of the parents' end as fits behind an ellipsis."""
    name = base_name(path)
    room = F.lit(width - 4) - F.length(name)
    parents = F.right(directory(path), F.greatest(room, F.lit(0)))
    short = F.when(room > 0, F.concat(F.lit("..."), parents, F.lit("/"), name)).otherwise(F.concat(F.lit("..."), F.right(name, F.lit(width - 3))))
    return F.when(F.length(path) <= width, path).otherwise(short)


def pascal_keys(m: Column, prefix: str = "") -> Column:
    """A map with snake_case keys in PascalCase behind a prefix."""
    return F.transform_keys(m, lambda k, _: F.concat(F.lit(prefix), F.replace(F.initcap(F.replace(k, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))))


def hex_id(c: Column) -> Column:
    """The number of an id such as '0x04f1 (name)'; null if there is none."""
    return F.conv(F.nullif(F.regexp_extract(c, r"(?:0x)?([0-9A-Fa-f]+)", 1), F.lit("")), 16, 10).cast("int")


def vid_pid(vendor: Column, product: Column) -> Column:
    return F.concat_ws(":", F.lpad(F.lower(F.hex(vendor)), 4, "0"), F.lpad(F.lower(F.hex(product)), 4, "0"))


def normal_serial(c: Column) -> Column:
    """A trimmed serial number; placeholders are null."""
    return F.when((c != "") & ~F.lower(c).isin("0", "000000000000", "na", "n/a", "none", "unknown"), F.trim(c))


def file_stamp(at: Column) -> Column:
    """An ISO time without colons and dots, for names."""
    return F.date_format(at, "yyyy-MM-dd'T'HH-mm-ss-SSS'Z'")


def acoustid_url(client: Column, duration: Column, fingerprint: Column) -> Column:
    return F.concat(F.lit("https://api.acoustid.org/v2/lookup?client="), F.url_encode(client), F.lit("&duration="), F.round(duration).cast("int"), F.lit("&fingerprint="), F.url_encode(fingerprint))
