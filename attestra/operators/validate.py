"""Schemas as tables of rules, compiled into one projection that gives what breaks them as rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, FractionalType, IntegralType, StringType, StructType, TimestampType

KINDS = ("string", "int", "number", "boolean", "datetime", "array")
#: Integers beyond it are not exact in a double.
SAFE = 2**53 - 1


@dataclass(frozen=True)
class Field:
    """What a column (or a path into structs) must be. least, most: bounds of a number, both included; shortest, longest: of the
    length of a text or array; pattern: a regular expression that a text holds; among: the values there are; above: another column
    that this one is not to fall short of."""

    name: str
    kind: str = "string"
    required: bool = True
    least: float | None = None
    most: float | None = None
    shortest: int | None = None
    longest: int | None = None
    pattern: str | None = None
    among: tuple[str, ...] = ()
    above: str | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind!r}; known: {', '.join(KINDS)}")


def type_of(schema: StructType, name: str):
    """The type of a column or nested field; None if there is none."""
    for part in name.split("."):
        if not isinstance(schema, StructType) or part not in schema.names:
            return None
        schema = schema[part].dataType
    return schema


def typed(f: Field, kind, c: Column) -> tuple[Column, Column]:
    """(value, is of the kind): text is read as the kind that is asked for."""
    text = isinstance(kind, StringType)
    if f.kind in ("string", "array"):
        return c, F.lit(isinstance(kind, StringType if f.kind == "string" else ArrayType))
    if f.kind == "boolean":
        return c, F.lower(c).isin("true", "false") if text else F.lit(isinstance(kind, BooleanType))
    if f.kind == "datetime":
        return c, F.try_to_timestamp(c).isNotNull() & c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$") if text else F.lit(isinstance(kind, TimestampType))
    v = c.try_cast("double") if text else c.cast("double") if isinstance(kind, IntegralType | FractionalType) else F.lit(None).cast("double")
    real = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return v, real & (v == F.floor(v)) & (F.abs(v) <= SAFE) if f.kind == "int" else real


def violations(df: DataFrame, fields: list[Field], key: str) -> DataFrame:
    """(key, field, rule, value) for each rule that a row of df breaks: required, type, range, length, pattern, among or
    above. A value that is null breaks only required, one of a wrong type only type. A column that df lacks is null in all
    rows. One projection, whatever the number of rules."""
    found = []
    for f in fields:
        kind = type_of(df.schema, f.name)
        if kind is None:
            if f.required:
                found.append(F.struct(F.lit(f.name).alias("field"), F.lit("required").alias("rule"), F.lit(None).cast("string").alias("value")))
            continue
        c = F.col(f.name)
        v, good = typed(f, kind, c)
        shown = F.to_json(F.struct(c)) if isinstance(kind, ArrayType | StructType) else c.cast("string")
        tests = [("required", c.isNull())] if f.required else []
        tests.append(("type", c.isNotNull() & ~F.coalesce(good, F.lit(False))))
        more = []
        if f.least is not None or f.most is not None:
            more.append(("range", reduce(lambda a, b: a | b, [t for t in ((v < f.least) if f.least is not None else None, (v > f.most) if f.most is not None else None) if t is not None])))
        if f.shortest is not None or f.longest is not None:
            n = F.size(c) if isinstance(kind, ArrayType) else F.length(c.cast("string"))
            more.append(("length", (n < (f.shortest or 0)) | (n > (f.longest if f.longest is not None else 1 << 31))))
        if f.pattern is not None:
            more.append(("pattern", ~c.cast("string").rlike(f.pattern)))
        if f.among:
            more.append(("among", ~c.cast("string").isin(*f.among)))
        if f.above is not None:
            more.append(("above", c < F.col(f.above)))
        tests += [(name, c.isNotNull() & F.coalesce(good, F.lit(False)) & F.coalesce(broken, F.lit(False))) for name, broken in more]
        found += [F.when(broken, F.struct(F.lit(f.name).alias("field"), F.lit(name).alias("rule"), shown.alias("value"))) for name, broken in tests]
    if not found:
        return df.select(key).where("false").select(key, *[F.lit(None).cast("string").alias(n) for n in ("field", "rule", "value")])
    return df.select(key, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("_v")).select(key, "_v.field", "_v.rule", "_v.value")


def valid(df: DataFrame, fields: list[Field], key: str, out: str = "valid") -> DataFrame:
    """df with out: whether no rule is broken; key tells its rows apart."""
    broken = violations(df, fields, key).select(F.col(key).alias("_k")).distinct()
    return df.join(broken, F.col(key).eqNullSafe(F.col("_k")), "left").withColumn(out, F.col("_k").isNull() & F.col(key).isNotNull()).drop("_k")


HASH16 = "^[a-f0-9]{16}$"
SIZE = {"kind": "int", "least": 0}
#: The relations of the package, as they travel in documents.
SCHEMAS: dict[str, list[Field]] = {
    "hash_result": [Field("path", shortest=1), Field("hash"), Field("algorithm", among=("blake3", "blake3-full", "sha256", "sha512", "md5", "xxhash64")), Field("size", **SIZE), Field("duration_ms", "number", least=0)],
    "manifest_entry": [Field("path", shortest=1), Field("hash", pattern=HASH16), Field("size", **SIZE), Field("mtime", "datetime", required=False)],
    "copy_result": [Field("source"), Field("destination"), Field("hash", pattern=HASH16), Field("size", **SIZE), Field("verified", "boolean"), Field("duration_ms", "number", least=0)],
    "custody_event": [Field("event_id"), Field("event_timestamp", "datetime"), Field("event_outcome", among=("success", "failure", "partial")), Field("event_location", required=False)],
    "waypoint": [Field("latitude", "number", least=-90, most=90), Field("longitude", "number", least=-180, most=180), Field("altitude", "number", required=False), Field("ts", "datetime", required=False)],
}
