"""Functions by name, for SQL: register(spark), then SELECT ... FROM t, LATERAL parse_gpx(t.text).

Table functions read one document a row and give its parts as rows: parse_gpx, parse_subtitle, parse_ics. A document that is
null, empty or of another format gives none. A second argument of parse_gpx and parse_ics, a constant list of names joined by
commas, picks columns, from which the result's schema is made before the query runs. Scalar functions: blake3 (64 digits),
blake3_16, xxh64, ulid, ulid_millis.
"""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType, TimestampType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import hashing, ids

GPX = {"track": IntegerType(), "track_name": StringType(), "seq": IntegerType(), "name": StringType(), "latitude": DoubleType(), "longitude": DoubleType(), "altitude": DoubleType(), "ts": TimestampType()}
ICS = {"kind": StringType(), "seq": IntegerType(), "uid": StringType(), "summary": StringType(), "starts": StringType(), "ends": StringType(), "recurring": BooleanType(), "alarms": IntegerType()}
CUE = {"format": StringType(), "seq": IntegerType(), "start_s": DoubleType(), "end_s": DoubleType(), "cue": StringType()}


def schema_of(kinds: dict, columns: AnalyzeArgument | None, function: str) -> AnalyzeResult:
    """The schema of the columns that a constant argument names, all without one."""
    names = list(kinds)
    if columns is not None:
        if not columns.isConstantExpression or not isinstance(columns.value, str):
            raise ValueError(f"{function}: the names of columns must be a constant")
        names = [n.strip() for n in columns.value.split(",")]
        if wrong := [n for n in names if n not in kinds]:
            raise ValueError(f"{function} has no column {', '.join(wrong)}; it has {', '.join(kinds)}")
    return AnalyzeResult(StructType([StructField(n, kinds[n]) for n in names]))


def only(kinds: dict, row: tuple, columns: str | None) -> tuple:
    if columns is None:
        return row
    at = list(kinds)
    return tuple(row[at.index(n.strip())] for n in columns.split(","))


def number(text: str | None) -> float | None:
    try:
        return float(text) if text is not None else None
    except ValueError:
        return None


def moment(text: str | None) -> datetime | None:
    try:
        t = datetime.fromisoformat(text.strip()) if text else None
    except ValueError:
        return None
    return t if t is None or t.tzinfo else t.replace(tzinfo=UTC)


def within(text: str, tag: str) -> str | None:
    m = re.search(rf"<{tag}[^>]*>(.*?)</{tag}>", text, re.S | re.I)
    return m and m[1].strip()


class ParseGpx:
    """Waypoints as track -1, then tracks (their segments joined) and routes (without times), counted from 0. A point names
    lat before lon; one whose numbers do not read keeps its place with nulls."""

    @staticmethod
    def analyze(text: AnalyzeArgument, columns: AnalyzeArgument | None = None) -> AnalyzeResult:
        return schema_of(GPX, columns, "parse_gpx")

    def eval(self, text, columns=None):
        tracks = [(None, "wpt", True, text or "")]
        for tag, point, timed in (("trk", "trkpt", True), ("rte", "rtept", False)):
            tracks += [(within(b, "name"), point, timed, b) for b in re.findall(rf"<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", text or "", re.S | re.I)]
        for k, (name, tag, timed, body) in enumerate(tracks):
            for seq, m in enumerate(re.finditer(rf'<{tag}\s+lat="([^"]+)"\s+lon="([^"]+)"[^>]*?(?:/>|>(.*?)</{tag}>)', body, re.S | re.I)):
                inside = m[3] or ""
                yield only(GPX, (k - 1, name, seq, within(inside, "name"), number(m[1]), number(m[2]), number(within(inside, "ele")), moment(within(inside, "time")) if timed else None), columns)


def unfolded(text: str | None) -> list[str]:
    return re.sub(r"\n[ \t]", "", re.sub(r"\r\n?", "\n", text or "")).split("\n")


class ParseIcs:
    """Events, to-dos and journals of a calendar, in order; times as they are written."""

    @staticmethod
    def analyze(text: AnalyzeArgument, columns: AnalyzeArgument | None = None) -> AnalyzeResult:
        return schema_of(ICS, columns, "parse_ics")

    def eval(self, text, columns=None):
        open_parts, seq, now = [], 0, {}
        for line in unfolded(text):
            head, _, value = line.partition(":")
            name = head.split(";")[0].strip().upper()
            if name == "BEGIN":
                open_parts.append(value.strip().upper())
                if open_parts[-1] in ("VEVENT", "VTODO", "VJOURNAL"):
                    now = {"kind": open_parts[-1][1:].lower(), "alarms": 0}
                elif open_parts[-1] == "VALARM":
                    now["alarms"] = now.get("alarms", 0) + 1
            elif name == "END" and open_parts:
                if open_parts.pop() in ("VEVENT", "VTODO", "VJOURNAL") and now:
                    yield only(ICS, (now["kind"], seq, now.get("UID"), now.get("SUMMARY"), now.get("DTSTART"), now.get("DTEND") or now.get("DUE"), "RRULE" in now, now["alarms"]), columns)
                    seq, now = seq + 1, {}
            elif open_parts and open_parts[-1] in ("VEVENT", "VTODO", "VJOURNAL"):
                now.setdefault(name, value.strip())


def cue_seconds(text: str) -> float:
    out = 0.0
    for part in text.replace(",", ".").split(":"):
        out = out * 60 + float(part)
    return out


class ParseSubtitle:
    """Cues with a text of SRT, WebVTT, SubViewer or SubStation documents, told apart by their heads; tags are left out."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        return schema_of(CUE, None, "parse_subtitle")

    def eval(self, text):
        t = re.sub(r"\r\n?", "\n", text or "").lstrip()
        time = r"((?:\d+:)?\d+:\d+[.,]\d+)"
        if t.startswith("WEBVTT"):
            kind, blocks, form = "vtt", re.split(r"\n\s*\n", t), rf"(?:^|\n)\s*{time}\s*-->\s*{time}[^\n]*\n?(.*)$"
        elif "[Script Info]" in t:
            kind, blocks, form = "ass", t.split("\n"), r"^Dialogue:\s*[^,]*,([^,]*),([^,]*),(?:[^,]*,){6}(.*)$"
        elif re.match(r"\d+\s*\n\d{2}:\d{2}:\d{2},\d{3}", t):
            kind, blocks, form = "srt", re.split(r"\n\s*\n", t), rf"(?:^|\n)\s*{time}\s*-->\s*{time}[^\n]*\n?(.*)$"
        elif re.match(r"\d+:\d{2}:\d{2}\.\d{3},\d+:\d{2}:\d{2}\.\d{3}", t):
            kind, blocks, form = "sbv", re.split(r"\n\s*\n", t), r"^\s*(\d+:\d+:\d+\.\d+),(\d+:\d+:\d+\.\d+)[^\n]*\n?(.*)$"
        else:
            return
        for seq, block in enumerate(blocks):
            if m := re.search(form, block, re.S):
                cue = re.sub(r"\s*\n\s*", " ", re.sub(r"<[^>]*>|\{[^}]*\}", "", m[3]).replace("\\N", "\n").replace("\\n", "\n")).strip()
                if cue and re.fullmatch(r"[\d:.,]+", m[1].strip()):
                    yield kind, seq, cue_seconds(m[1].strip()), cue_seconds(m[2].strip()), cue


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL of the session."""
    for name, cls in (("parse_gpx", ParseGpx), ("parse_subtitle", ParseSubtitle), ("parse_ics", ParseIcs)):
        spark.udtf.register(name, udtf(cls))
    spark.udf.register("blake3", hashing.blake3_full)
    spark.udf.register("xxh64", hashing.xxh64)
    spark.udf.register("ulid", ids.ulid)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION blake3_16(content STRING) RETURNS STRING RETURN substring(blake3(content), 1, 16)")
    alphabet = ids.CROCKFORD
    digits = f"transform(split(upper(substring(u, 1, 10)), ''), c -> instr('{alphabet}', c) - 1)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ulid_millis(u STRING) RETURNS BIGINT RETURN aggregate({digits}, CAST(0 AS BIGINT), (a, d) -> a * 32 + d)")
