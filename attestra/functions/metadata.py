"""Parsing and merging of metadata values and maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def exif_iso(c: Column) -> Column:
    """2024:01:02 03:04:05 as 2024-01-02T03:04:05; other texts unchanged."""
    return F.regexp_replace(c, r"^(\d{4}):(\d{2}):(\d{2}) (\d{2}:\d{2}:\d{2})", "$1-$2-$3T$4")


def leading_number(c: Column) -> Column:
    """The number that a text begins with; null if none."""
    return F.nullif(F.regexp_extract(c, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1), F.lit("")).try_cast("double")


def seconds(c: Column) -> Column:
    """'12.5 s', 'H:M:S' or 'M:S' in seconds."""
    p = F.split(c, ":")
    part = lambda i: F.get(p, i).try_cast("double")
    return F.when(F.size(p) == 3, part(0) * 3600 + part(1) * 60 + part(2)).when(F.size(p) == 2, part(0) * 60 + part(1)).otherwise(leading_number(c))


def millis_seconds(c: Column) -> Column:
    return c.try_cast("double") / 1000


def cue_seconds(c: Column) -> Column:
    """A subtitle time in seconds: 01:02:03,004 (SRT), 02:03.004 or 1:02:03.04 (VTT, ASS, SBV)."""
    p = F.split(F.replace(F.trim(c), F.lit(","), F.lit(".")), ":")
    n = F.size(p)
    part = lambda i: F.try_element_at(p, i).try_cast("double")
    return F.when(n == 3, part(F.lit(1)) * 3600 + part(F.lit(2)) * 60 + part(F.lit(3))).when(n == 2, part(F.lit(1)) * 60 + part(F.lit(2)))


def focal(c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(c.cast("string"), F.lit("mm")))


def aperture(c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.lit("f/"), c.cast("string")))


def shutter(c: Column) -> Column:
    """Seconds as '1/640' below one, else as '2s'."""
    return F.when(c >= 1, F.concat(c.cast("string"), F.lit("s"))).when(c > 0, F.concat(F.lit("1/"), F.round(1 / c).cast("int")))


def keywords(c: Column) -> Column:
    """The trimmed parts of a list separated by commas or semicolons."""
    return F.filter(F.transform(F.split(c, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def timecode(c: Column) -> Column:
    """HHMMSSFF with colons."""
    return F.regexp_replace(c, r"^(\d{2})(\d{2})(\d{2})(\d{2})$", "$1:$2:$3:$4")


def first_text(*cs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])


def merged_struct(base: str, other: str, texts: list[str], numbers: list[str]) -> Column:
    """A struct of fields of which base wins: empty texts count as missing, numbers only if null."""
    f = lambda s, c: F.col(f"{s}.{c}")
    return F.struct(*[first_text(f(base, c), f(other, c)).alias(c) for c in texts], *[F.coalesce(f(base, c), f(other, c)).alias(c) for c in numbers])


def filled(primary: Column, other: Column) -> Column:
    """primary with what it lacks, or has empty, from other."""
    return F.map_filter(F.map_zip_with(primary, other, lambda _, a, b: first_text(a, b)), lambda _, v: v.isNotNull())


def last_wins(*maps: Column) -> Column:
    """The union of maps; of equal keys the later map's value."""
    return reduce(lambda a, b: F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x)), maps)


def merged_companions(primary: Column, sidecars: Column) -> Column:
    """primary filled from sidecars, an array of struct<ext, tags map>, in their order. A .moi then
    overrides DateTimeOriginal; a .srt the GPS tags and all of the drone's own."""
    fill = F.aggregate(sidecars, primary, lambda acc, s: filled(acc, s["tags"]))

    def override(acc, s):
        mine = F.map_filter(
            s["tags"],
            lambda k, v: v.isNotNull() & (((s["ext"] == ".moi") & (k == "DateTimeOriginal")) | ((s["ext"] == ".srt") & (k.startswith("GPS") | k.startswith("DJI:")))),
        )
        return last_wins(acc, mine)

    return F.aggregate(sidecars, fill, override)


def flat(prefix: str, **fields: Column) -> Column:
    """A map of those fields that are known, keys behind a prefix, values as text."""
    pairs = F.array(*[F.struct(F.lit(f"{prefix}{k}").alias("key"), v.cast("string").alias("value")) for k, v in fields.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def interpolate(a: Column, b: Column, part: Column) -> Column:
    return a + (b - a) * part


def confidence(delta: Column, tolerance: float) -> Column:
    return 1 - F.try_divide(delta, F.lit(float(tolerance)))


def truncated(c: Column, most: int = 100_000) -> Column:
    """struct<text, truncated>."""
    return F.struct(F.substring(c, 1, most).alias("text"), (F.length(c) > most).alias("truncated"))


def upper_median(a: Column) -> Column:
    """The element at floor(n / 2) of the sorted array."""
    return F.get(F.array_sort(a), (F.size(a) / 2).cast("int"))
