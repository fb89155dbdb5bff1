"""Secret scans: fixed patterns, and a battery of randomness tests on what else looks encoded.

The battery takes runs of 20 and more encoding characters, infers the encoding, and tests the
symbols for a uniform alphabet (chi-squared), for runs about the alphabet's middle and for serial
correlation. The three tests depend on each other, so their combined statistic is compared with its own
distribution over random tokens of the same encoding and length (NULLS, drawn once by a fixed
generator). Keys are random, so their p-values are spread evenly over 0 to 1; words are not, and
theirs crowd at 0. In each class of encoding and length, tokens of high p estimate the random ones, and the
threshold is the lowest at which the others make up at most a given part of what is reported; a class
in which there is none reports nothing.

Built of DataFrame functions alone, over one row at a time; only per-class counts are shuffled.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered

#: Kinds and their patterns, in the order in which spans at one place are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ENCODED = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST = 8
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encoding: its pattern and its alphabet; the first that fits is taken. Digits and letters must both occur.
ENCODINGS = {
    "hex": (r"^[0-9a-f]+$", DIGITS + LOWER[:6]),
    "HEX": (r"^[0-9A-F]+$", DIGITS + UPPER[:6]),
    "base32": (r"^[A-Z2-7]+$", UPPER + DIGITS[2:8]),
    "base36": (r"^[a-z0-9]+$", LOWER + DIGITS),
    "BASE36": (r"^[A-Z0-9]+$", UPPER + DIGITS),
    "base64": (r"[A-Z].*[a-z]|[a-z].*[A-Z]", UPPER + LOWER + DIGITS + "+/"),
}
#: Thresholds tried; p above which tokens count as random; tokens with which a class is estimated by itself; false part.
GRID = (0.001, 0.003, 0.01, 0.03, 0.1, 0.2, 0.3)
HIGH, ENOUGH, FALSE_PART = 0.4, 60, 0.05
#: The null tables: lengths (between two, p-values are mixed; the last stands for all beyond), upper tails, random tokens of each length.
LENGTHS = (20, 22, 24, 26, 28, 30, 32, 36, 40, 44, 48, 56, 64, 80, 96, 128, 256, 512)
TAILS = (1.0, 0.99, 0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05, 0.03, 0.02, 0.01, 0.005, 0.003, 0.001, 0.0)
DRAWN = 4000


def spans_of(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """array<struct<start, kind, end, s>>: where pattern matches, leftmost first, in code points;
    keep: filter on (match, index). Between matches lie the pieces of a split by the pattern."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,s:string>>")
    both = F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("b"))
    if keep is not None:
        both = F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("b"), keep.alias("k"))
    ok = (lambda x: F.length(x["k"]) >= ASSIGN_LEAST) if keep is not None else (lambda x: F.lit(True))

    def step(acc, x):
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("s"))
        return F.struct(end.alias("at"), F.when(ok(x), F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def placed(acc, part):
        moved = F.transform(part["out"], lambda x: F.struct((x["start"] + acc["at"]).alias("start"), x["kind"].alias("kind"), (x["end"] + acc["at"]).alias("end"), x["s"].alias("s")))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.array_append(acc["out"], moved).alias("out"))

    # Appending copies a list: matches are placed in parts of the root of their number, and the parts one after the other.
    def in_parts(x):
        n = F.ceil(F.sqrt(F.size(x["v"]))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.aggregate(F.slice(x["v"], i * n + 1, n), F.struct(F.lit(0).alias("at"), empty.alias("out")), step))
        none = F.array().cast("array<array<struct<start:int,kind:int,end:int,s:string>>>")
        return F.when(n > 0, F.flatten(F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), placed)["out"])).otherwise(empty)

    return bound(F.struct(both.alias("v")), in_parts)


def bound(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def log_above(z: Column) -> Column:
    """The logarithm of the normal distribution's upper tail, by a logistic approximation."""
    clipped = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), z))
    return bound(clipped, lambda x: -F.log1p(F.exp(x * (0.07056 * x * x + 1.5976))))


def normal_tail(z: np.ndarray) -> np.ndarray:
    """The tail of log_above() for arrays, for the null tables."""
    z = np.clip(z, -12, 12)
    return 1 / (1 + np.exp(0.07056 * z**3 + 1.5976 * z))


def statistic(v: np.ndarray, k: int) -> np.ndarray:
    """The combined statistic of each row of symbols from 0 to k - 1: minus the logarithms of the three tests' p-values."""
    rows, n = v.shape
    counts = np.bincount((v + k * np.arange(rows)[:, None]).ravel(), minlength=rows * k).reshape(rows, k)
    df = k - 1
    z1 = ((np.maximum((k / n * (counts.astype(float) ** 2).sum(1) - n) / df, 0) ** (1 / 3)) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df))
    upper = v >= k / 2
    z2 = ((upper[:, 1:] != upper[:, :-1]).sum(1) - (n - 1) / 2) / np.sqrt((n - 1) / 4)
    d = v - (k - 1) / 2
    z3 = (d[:, 1:] * d[:, :-1]).sum(1) / ((k * k - 1) / 12) / np.sqrt(n - 1)
    return -sum(np.log(p) for p in (normal_tail(z1), 2 * normal_tail(np.abs(z2)), 2 * normal_tail(np.abs(z3))))


@functools.cache
def nulls() -> dict[int, list[list[float]]]:
    """For each size of alphabet and each of LENGTHS, the statistic that so many random tokens exceed as TAILS says, ascending."""
    rng = np.random.default_rng(11)
    out = {}
    for k in sorted({len(a) for _, a in ENCODINGS.values()}):
        tables = []
        for n in LENGTHS:
            drawn = np.concatenate([statistic(rng.integers(0, k, (DRAWN // 8, n)), k) for _ in range(8)])
            q = np.quantile(drawn, [1 - t for t in TAILS])
            tables.append([*q[:-1].tolist(), float(q[-1]) + 3.0])
        out[k] = tables
    return out


def upper_tail(k: Column, n: Column, statistic: Column) -> Column:
    """The part of random tokens of alphabet size k and length n whose statistic is greater, interpolated in nulls()."""
    written = lambda xs: "array(" + ", ".join(written(x) if isinstance(x, list) else f"{float(x)!r}D" for x in xs) + ")"
    sizes = nulls()
    tables = F.expr(written([t for of_size in sizes.values() for t in of_size]))  # a constant, folded once
    size_at = F.expr(written(list(sizes)))
    lengths, tails = F.expr(written(list(LENGTHS))), F.expr(written(list(TAILS)))

    def at(table: Column, s: Column) -> Column:
        def between(y: Column) -> Column:
            j, t = y["j"], y["t"]
            p, q = F.get(tails, j - 1), F.get(tails, j)
            share = (y["s"] - F.get(t, j - 1)) / F.greatest(F.get(t, j) - F.get(t, j - 1), F.lit(1e-12))
            return F.when(j == 0, 1.0).when(j >= len(TAILS), 0.0).otherwise(p + (q - p) * share)

        return bound(F.struct(F.size(F.filter(table, lambda x: x <= s)).alias("j"), table.alias("t"), s.alias("s")), between)

    def mixed(y: Column) -> Column:
        i, a = y["row"], y["below"]
        near, far = F.get(lengths, a), F.get(lengths, F.least(F.lit(len(LENGTHS) - 1), a + 1))
        weight = F.when(far > near, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y["n"] - near) / (far - near)))).otherwise(0.0)
        beyond = F.when(weight > 0, at(F.get(tables, i + 1), y["s"])).otherwise(0.0)
        return (1 - weight) * at(F.get(tables, i), y["s"]) + weight * beyond

    def placed(y: Column) -> Column:
        row = (F.array_position(size_at, y["k"]).cast("int") - 1) * len(LENGTHS) + y["below"]
        return bound(F.struct(row.alias("row"), y["below"].alias("below"), y["n"].alias("n"), y["s"].alias("s")), mixed)

    below = F.greatest(F.lit(0), F.size(F.filter(lengths, lambda x: x <= n)) - 1)
    return bound(F.struct(below.alias("below"), k.alias("k"), n.alias("n"), statistic.alias("s")), placed)


def battery(token: Column) -> Column:
    """struct<enc, n, p> of a token: inferred encoding (null: none), symbols, combined p-value."""

    def encoding(s: Column) -> Column:
        enc = F.lit(None).cast("string")
        for name, (pattern, _) in reversed(ENCODINGS.items()):
            enc = F.when(s.rlike(pattern), name).otherwise(enc)
        return F.struct(s.alias("s"), F.when(s.rlike("[0-9]") & s.rlike("[A-Za-z]"), enc).alias("enc"))

    def alphabet(x: Column) -> Column:
        letters = F.coalesce(*[F.when(x["enc"] == name, F.lit(a)) for name, (_, a) in ENCODINGS.items()])
        return F.struct(x["s"].alias("s"), x["enc"].alias("enc"), letters.alias("letters"), F.length(letters).cast("double").alias("k"))

    def symbols(x: Column) -> Column:
        v = F.transform(F.split(x["s"], ""), lambda c: F.instr(x["letters"], c) - 1)
        return F.struct(v.alias("v"), *[x[c].alias(c) for c in ("s", "enc", "letters", "k")])

    def sums(x: Column) -> Column:
        """What the three tests need of a token, each computed once."""
        v, k, n = x["v"], x["k"], F.size(x["v"]).cast("double")
        squares = F.aggregate(F.split(x["letters"], ""), F.lit(0.0), lambda acc, c: acc + F.pow(n - F.length(F.replace(x["s"], c)), F.lit(2.0)))
        pairs = F.arrays_zip(F.slice(v, 1, F.size(v) - 1).alias("a"), F.slice(v, 2, F.size(v) - 1).alias("b"))
        half, mean = k / 2, (k - 1) / 2
        changes = F.size(F.filter(pairs, lambda y: (y["a"] >= half) != (y["b"] >= half))).cast("double")
        product = F.aggregate(pairs, F.lit(0.0), lambda acc, y: acc + (y["a"] - mean) * (y["b"] - mean))
        return F.struct(k.alias("k"), n.alias("n"), squares.alias("squares"), changes.alias("changes"), product.alias("product"), x["enc"].alias("enc"))

    def tests(y: Column) -> Column:
        k, n = y["k"], y["n"]
        df = k - 1
        z1 = (F.pow(F.greatest((k / n * y["squares"] - n) / df, F.lit(0.0)), F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        z2 = (y["changes"] - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        z3 = y["product"] / ((k * k - 1) / 12) / F.sqrt(n - 1)
        logs = log_above(z1) + log_above(F.abs(z2)) + log_above(F.abs(z3)) + 2 * F.log(F.lit(2.0))
        return F.struct(y["enc"].alias("enc"), n.cast("int").alias("n"), upper_tail(k, n, -logs).alias("p"))

    none = F.struct(F.lit(None).cast("string").alias("enc"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("double").alias("p"))
    plain = F.translate(F.rtrim(token, F.lit("=")), "-_", "+/")
    tested = lambda x: F.when(x["enc"].isNotNull(), bound(bound(bound(bound(x, alphabet), symbols), sums), tests)).otherwise(none)
    return bound(bound(plain, encoding), tested)


def detect(text: Column) -> tuple[Column, Column]:
    """(base spans: array<struct<start, kind, end>>, tokens: array<struct<start, end, t struct<enc, n, p>>>), each in its own order."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,s:string>>")
    if_any = lambda pattern, *a, **k: F.when(text.rlike(pattern), spans_of(text, pattern, *a, **k)).otherwise(none)
    base = F.concat(
        if_any(ASSIGN, 0, keep=F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))),
        F.when(F.contains(text, F.lit("AKIA")), spans_of(text, ACCESS, 1)).otherwise(none),
        if_any(HEX, 2),
    )
    tokens = F.transform(if_any(ENCODED, 3), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), battery(x["s"]).alias("t")))
    return F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))), tokens


def detected(docs: DataFrame, text: str, *keep: Column | str) -> DataFrame:
    """(*keep, _base, _tokens) of each row by its column text: tokens only those that have an encoding and meet no base span."""
    base, tokens = detect(F.coalesce(F.col(text), F.lit("")))
    d = docs.select(*keep, base.alias("_base"), tokens.alias("_tokens"))
    apart = lambda x: x["t"]["enc"].isNotNull() & ~F.exists("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    return d.withColumn("_tokens", F.filter("_tokens", apart))


def band(n: Column) -> Column:
    """Classes of length, each twice the one before; the last is open."""
    return F.least(F.lit(8), F.floor(F.log2(n / 20.0)).cast("int"))


def threshold(n: int, high: int, at: list[int]) -> float | None:
    """The lowest of GRID that keeps the part of false reports, from n tokens of which high are above HIGH
    and at[i] at or above GRID[i]; None if none keeps it by more than the estimate's standard error."""
    random = high / (1 - HIGH)
    error = (random * HIGH / (1 - HIGH)) ** 0.5
    ok = [g for g, m in zip(GRID, at, strict=True) if m and m - random * (1 - g) <= FALSE_PART * m + error * (1 - g)]
    return min(ok, default=None)


def pooled(counts: dict[int, np.ndarray], band: int) -> np.ndarray:
    """The counts of a band of lengths; with fewer than ENOUGH tokens, those of the nearest bands with it, until there are enough."""
    total = np.zeros_like(counts[band])
    for b in sorted(counts, key=lambda x: (abs(x - band), x)):
        if total[0] >= ENOUGH:
            break
        total = total + counts[b]
    return total


def levels(found: DataFrame) -> dict[tuple[str, int], float]:
    """The threshold of each class of encoding and length that has one; at most 54 classes come to the driver."""
    t = found.select(F.explode("_tokens.t").alias("t")).groupBy(F.col("t.enc").alias("enc"), band(F.col("t.n")).alias("band"))
    by_encoding: dict[str, dict[int, np.ndarray]] = {}
    for enc, length, *c in t.agg(F.count("*"), F.count_if(F.col("t.p") > HIGH), *[F.count_if(F.col("t.p") >= g) for g in GRID]).collect():
        by_encoding.setdefault(enc, {})[length] = np.array(c, np.int64)
    out = {}
    for enc, counts in by_encoding.items():
        for b in counts:
            n, high, *at = pooled(counts, b).tolist()
            if (level := threshold(n, high, at)) is not None:
                out[enc, b] = level
    return out


def all_spans(at: dict[tuple[str, int], float]) -> tuple[Column, Column]:
    """(base, all) as sorted arrays of (start, kind, end), from the columns of detected()."""
    limit = F.create_map(*[F.lit(x) for (e, b), v in at.items() for x in (f"{e}/{b}", v)]) if at else F.create_map().cast("map<string,double>")
    name = lambda x: F.concat(x["t"]["enc"], F.lit("/"), band(x["t"]["n"]).cast("string"))
    hits = F.filter("_tokens", lambda x: x["t"]["p"] >= F.coalesce(F.try_element_at(limit, name(x)), F.lit(2.0)))
    more = F.transform(hits, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    return F.array_sort("_base"), F.array_sort(F.concat("_base", more))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base_spans, spans) for each row of docs (doc_id, text): arrays of (start, kind, end)
    by start, then kind; places in code points, end exclusive; kind is an index of KINDS.

    A null or empty text has none; a null doc_id stays null; repeated rows each come back; an
    empty table gives an empty result; other columns of docs are not looked at.
    """
    found = cut(detected(docs, "text", F.col("doc_id").cast("long").alias("doc_id")))
    base, every = all_spans(levels(found))
    return found.select("doc_id", base.alias("base_spans"), every.alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each found span of text replaced by mark (spans that overlap, by one); all other
    columns and rows unchanged, whatever they are called, null and empty texts too; repeated rows come
    back alike; an empty table gives an empty result. Texts are searched once."""
    d, at = numbered(docs)
    text = at["text"]
    found = cut(detected(d, text, *d.columns))
    _, every = all_spans(levels(found))

    # A text is cleaned in parts of the root of the number of spans, since adding to a text and counting into it both walk it.
    def cleaned(x):
        spans, whole = x["v"], x["t"]
        n = F.ceil(F.sqrt(F.size(spans))).cast("int")
        last = F.ceil(F.size(spans) / n).cast("int") - 1
        start = lambda i: F.when(i == 0, 0).when(i > last, F.length(whole)).otherwise(F.get(spans, i * n)["start"])
        cut_up = lambda i: F.struct(start(i).alias("a"), start(i + 1).alias("z"), F.substring(whole, start(i) + 1, start(i + 1) - start(i)).alias("t"), F.slice(spans, i * n + 1, n).alias("v"))

        def part(acc, y):
            def step(now, x):
                fresh = x["start"] >= now["at"]
                more = F.when(fresh, F.concat(now["out"], F.substring(y["t"], now["at"] - y["a"] + 1, x["start"] - now["at"]), F.lit(mark))).otherwise(now["out"])
                return F.struct(F.greatest(now["at"], x["end"]).alias("at"), more.alias("out"))

            tail = lambda now: F.struct(F.greatest(now["at"], y["z"]).alias("at"), F.when(now["at"] < y["z"], F.concat(now["out"], F.substring(y["t"], now["at"] - y["a"] + 1, y["z"] - now["at"]))).otherwise(now["out"]).alias("out"))
            done = F.aggregate(y["v"], F.struct(acc["at"].alias("at"), F.lit("").alias("out")), step, tail)
            return bound(done, lambda d: F.struct(d["at"].alias("at"), F.array_append(acc["out"], d["out"]).alias("out")))

        parts = F.transform(F.sequence(F.lit(0), last), cut_up)
        return F.array_join(F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), part)["out"], "")

    out = found.withColumn("_spans", every)
    return out.select(*[F.when(F.size("_spans") > 0, bound(F.struct(F.col("_spans").alias("v"), F.col(text).alias("t")), cleaned)).otherwise(F.col(text)).alias(c) if c == text else F.col(c) for c in d.columns]).toDF(*docs.columns)
