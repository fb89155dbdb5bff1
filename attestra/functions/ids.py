"""Identifiers: UUIDs, ULIDs and hash-derived ids, and checks of their form."""

from __future__ import annotations

import os
import time

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .hashing import blake3, blake3_digests

# The name spaces of RFC 9562 and the ULID alphabet.
NAMESPACES = {
    "dns": "6ba7b810-9dad-11d1-80b4-00c04fd430c8",
    "url": "6ba7b811-9dad-11d1-80b4-00c04fd430c8",
    "oid": "6ba7b812-9dad-11d1-80b4-00c04fd430c8",
    "x500": "6ba7b814-9dad-11d1-80b4-00c04fd430c8",
}
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def dashed(h: Column) -> Column:
    """32 hex digits in the form of a UUID."""
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))


def with_version(h: Column, version: int) -> Column:
    """32 hex digits with a UUID's version and variant set."""
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return dashed(F.concat(F.substring(h, 1, 12), F.lit(str(version)), F.substring(h, 14, 3), variant, F.substring(h, 18, 15)))


def uuid5(name: Column, namespace: str = "dns") -> Column:
    """The version-5 UUID of a name, in a name space of NAMESPACES or given as a UUID."""
    space = NAMESPACES.get(namespace.lower(), namespace).replace("-", "")
    return with_version(F.substring(F.sha1(F.concat(F.unhex(F.lit(space)), name.cast("binary"))), 1, 32), 5)


def uuid4() -> Column:
    return F.uuid()


def uuid7(at: Column) -> Column:
    """A version-7 UUID of a timestamp: 48 bits of milliseconds, the rest random."""
    stamp = F.lpad(F.lower(F.hex(F.unix_millis(at))), 12, "0")
    return with_version(F.concat(stamp, F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 20)), 7)


@pandas_udf(StringType())
def uuid1(row: pd.Series) -> pd.Series:
    """A version-1 UUID for each row (of any column)."""
    import uuid

    return pd.Series([str(uuid.uuid1()) for _ in row])


uuid1 = uuid1.asNondeterministic()


def make_uuid(version: int = 4, name: Column | None = None, namespace: str = "dns", at: Column | None = None) -> Column:
    """A UUID of the version asked for; version 5 needs a name."""
    if version == 5:
        if name is None:
            raise ValueError("a version 5 UUID needs a name")
        return uuid5(name, namespace)
    makers = {1: lambda: uuid1(F.monotonically_increasing_id()), 4: uuid4, 7: lambda: uuid7(F.current_timestamp() if at is None else at)}
    if version not in makers:
        raise ValueError(f"no UUID of version {version}")
    return makers[version]()


def uuid_version(u: Column) -> Column:
    return F.when(is_uuid(u), F.substring(u, 15, 1).cast("int"))


def encode32(value: int, digits: int) -> str:
    out = ""
    for _ in range(digits):
        value, r = divmod(value, 32)
        out = CROCKFORD[r] + out
    return out


@pandas_udf(StringType())
def ulid(millis: pd.Series) -> pd.Series:
    """A ULID of each time in milliseconds; null and 0 stand for now."""
    now = time.time_ns() // 1_000_000
    return pd.Series([encode32(int(now if pd.isna(m) or not m else m), 10) + encode32(int.from_bytes(os.urandom(10), "big"), 16) for m in millis])


ulid = ulid.asNondeterministic()


@pandas_udf(StringType())
def monotonic_ulid(millis: pd.Series) -> pd.Series:
    """ULIDs that rise within a batch of rows even where their times are equal or fall back."""
    out, last, tail = [], -1, 0
    now = time.time_ns() // 1_000_000
    for m in millis:
        m = int(now if pd.isna(m) or not m else m)
        if m > last:
            last, tail = m, int.from_bytes(os.urandom(10), "big") >> 1
        else:
            tail += 1
        out.append(encode32(last, 10) + encode32(tail, 16))
    return pd.Series(out)


monotonic_ulid = monotonic_ulid.asNondeterministic()


def ulid_millis(u: Column) -> Column:
    """The time of a ULID in milliseconds; a character out of the alphabet counts as -1."""
    digit = lambda c: F.instr(F.lit(CROCKFORD), c) - 1
    return F.aggregate(F.split(F.upper(F.substring(u, 1, 10)), ""), F.lit(0).cast("long"), lambda acc, c: acc * 32 + digit(c))


@pandas_udf(StringType())
def random_ids(row: pd.Series) -> pd.Series:
    """A random 16-digit BLAKE3 id for each row."""
    return pd.Series([h[:16] for h in blake3_digests([os.urandom(32) for _ in row])])


random_ids = random_ids.asNondeterministic()


def id_of(content: Column) -> Column:
    """The deterministic 16-digit id of content."""
    return blake3(content)


def is_hash(h: Column, algorithm: str = "blake3") -> Column:
    digits = {"blake3": 16, "xxhash64": 16, "md5": 32, "sha256": 64, "blake3-full": 64, "sha512": 128}[algorithm]
    return h.rlike(f"^[a-f0-9]{{{digits}}}$")


def is_uuid(u: Column) -> Column:
    return u.rlike("^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def is_ulid(u: Column) -> Column:
    return u.rlike(f"^[{CROCKFORD}]{{26}}$")
