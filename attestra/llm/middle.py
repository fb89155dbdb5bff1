"""Fill-in-the-middle: texts cut at two unit ranks and rearranged, by ropes.

A rope is a balanced tree over slices of a text's UTF-8 bytes. Leaves and nodes cache how many units
(runs of letters, or single other code points) and code points they hold, and whether they begin and
end within a run of letters, so that counts of joined parts are known without looking at the text
again. A text is split at two unit ranks on the way down the tree; prefix, middle and suffix are
subtrees that share their leaves with the text, joined anew with sentinels. The inverse builds
the rope of the output, splits it at the ranks of the sentinels and joins the parts in their first order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, real_id, slices

#: Part of a text -> the letter of its sentinel.
SENTINEL = {"prefix": "P", "suffix": "S", "middle": "M"}
ORDER = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
TEXT = ("prefix", "middle", "suffix")
#: Bytes of a leaf; of a long text a 4096th part.
LEAF, PARTS = 2048, 12


class Rope:
    """A node: data for a leaf, left and right for an inner node; units and chars of all below it."""

    __slots__ = ("chars", "closes", "data", "left", "opens", "right", "units")

    def __init__(self, units, chars, opens, closes, data=None, left=None, right=None):
        self.units, self.chars, self.opens, self.closes = units, chars, opens, closes
        self.data, self.left, self.right = data, left, right


EMPTY = Rope(0, 0, False, False, b"")


def join(a: Rope, b: Rope) -> Rope:
    """The texts of a and b in turn; a run of letters that goes on from a to b is one unit."""
    if not a.chars:
        return b
    if not b.chars:
        return a
    return Rope(a.units + b.units - (a.closes and b.opens), a.chars + b.chars, a.opens, b.closes, None, a, b)


def joined(ropes: list[Rope]) -> Rope:
    """A balanced tree over ropes."""
    while len(ropes) > 1:
        ropes = [join(*ropes[k : k + 2]) if k + 1 < len(ropes) else ropes[k] for k in range(0, len(ropes), 2)]
    return ropes[0] if ropes else EMPTY


def starts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begins a unit, begins a code point, is a letter) for each byte; the first byte has nothing before it."""
    letter = ((raw | 32) - np.uint8(97)) < 26
    char = (raw & 0xC0) != 0x80
    unit = char.copy()
    unit[1:] &= ~(letter[1:] & letter[:-1])
    return unit, char, letter


def leaf(data) -> Rope:
    """The rope of a piece of text that is looked at afresh."""
    if not len(data):
        return EMPTY
    unit, char, letter = starts(np.frombuffer(data, np.uint8))
    return Rope(int(unit.sum()), int(char.sum()), bool(letter[0]), bool(letter[-1]), data)


def split(rope: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first rank units of rope, and the rest."""
    if rank <= 0:
        return EMPTY, rope
    if rank >= rope.units:
        return rope, EMPTY
    if rope.data is not None:
        unit = starts(np.frombuffer(rope.data, np.uint8))[0]
        at = int(np.flatnonzero(unit)[rank])
        return leaf(rope.data[:at]), leaf(rope.data[at:])
    a, b = rope.left, rope.right
    if rank < a.units:
        x, y = split(a, rank)
        return x, join(y, b)
    x, y = split(b, rank - a.units + (a.closes and b.opens))
    return join(a, x), y


def pieces(rope: Rope) -> list:
    """The leaves' bytes, from left to right."""
    out, todo = [], [rope]
    while todo:
        r = todo.pop()
        if r.data is not None:
            out.append(r.data)
        else:
            todo += (r.right, r.left)
    return out


def text_of(rope: Rope) -> bytes:
    return b"".join(pieces(rope))


class Batch:
    """The texts of an Arrow array: their ropes, and where in them sentinels stand."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        self.off = off - off[0]
        self.data = memoryview(texts.buffers()[2] or b"")[off[0] : off[-1]]
        raw = np.frombuffer(self.data, np.uint8)
        unit, char, letter = starts(raw)
        size = np.diff(self.off)
        step = np.maximum(LEAF, size >> PARTS)
        count = -(-size // step)
        self.first = np.concatenate([[0], np.cumsum(count)])
        doc = np.repeat(np.arange(len(size)), count)
        cut = self.off[doc] + (np.arange(len(doc)) - self.first[doc]) * step[doc]
        for _ in range(3):  # to the beginning of a code point
            cut -= ~char[cut] & (cut > self.off[doc])
        ends = np.r_[cut[1:], len(raw)]
        self.cut, self.ends, self.opens, self.closes = cut.tolist(), ends.tolist(), letter[cut].tolist(), letter[ends - 1].tolist()
        self.unit = unit
        opened = unit.copy()
        opened[cut] |= letter[cut]  # a leaf counts the run that it opens
        self.units = np.add.reduceat(opened, cut, dtype=np.int64).tolist() if len(cut) else []
        self.chars = np.add.reduceat(char, cut, dtype=np.int64).tolist() if len(cut) else []
        at = np.flatnonzero((raw[:-2] == 60) & (raw[2:] == 62) & np.isin(raw[1:-1], [ord(x) for x in SENTINEL.values()]))
        of = np.searchsorted(self.off, at, side="right") - 1
        inside = at + 2 < self.off[of + 1]
        self.marks: dict[int, list[int]] = {}
        for d, p in zip(of[inside].tolist(), at[inside].tolist(), strict=True):
            self.marks.setdefault(d, []).append(p)

    def rope(self, d: int) -> Rope:
        return joined([Rope(self.units[k], self.chars[k], self.opens[k], self.closes[k], self.data[self.cut[k] : self.ends[k]]) for k in range(self.first[d], self.first[d + 1])])

    def parts(self, d: int, form: str) -> Rope | None:
        """The text from which the output d of that form was made; None if it is no such output."""
        marks = self.marks.get(d, [])
        letters = [chr(self.data[p + 1]) for p in marks]
        if letters != [SENTINEL[x] for x in ORDER[form]] or marks[0] != self.off[d]:
            return None
        rest, found, done = self.rope(d), {}, int(self.off[d])
        for name, p in zip((None, *ORDER[form]), (*marks, None), strict=True):
            rank = rest.units if p is None else int(np.count_nonzero(self.unit[done:p]))
            found[name], rest = split(rest, rank)
            rest = split(rest, 3)[1]  # a sentinel has three units and three bytes
            done = (p or 0) + 3
        return joined([found[x] for x in TEXT])


def draws(key: bytes) -> list[int]:
    h = hashlib.sha256(key).hexdigest()
    return [int(h[k : k + 8], 16) for k in range(0, 32, 8)]


def transform(docs: DataFrame, seed: int = 1, moved: int = 90, suffix_first: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of docs (doc_id, text).

    n is the number of units. The first four 8-digit groups of the SHA-256 of `seed:doc_id` choose both ends of the
    middle, whether the text is rearranged (moved of 100) and whether the suffix comes first (suffix_first of 100). An
    empty text, a null one (taken as empty) and one that holds a sentinel stay plain; parts are then null. A null doc_id is
    hashed as no digits. Rows of equal doc_id and text come back alike; an empty table gives an empty result; other
    columns of docs are not looked at.
    """

    def run(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                texts, rows = Batch(b.column("text")), []
                for d, key in enumerate(b.column("key").to_pylist()):
                    h = draws(key.encode())
                    rope = texts.rope(d)
                    n = rope.units
                    if not n or d in texts.marks or h[2] % 100 >= moved:
                        rows.append((n, "plain", None, None, text_of(rope)))
                        continue
                    a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                    head, suffix = split(rope, z)
                    prefix, middle = split(head, a)
                    part = {"prefix": prefix, "middle": middle, "suffix": suffix}
                    form = "spm" if h[3] % 100 < suffix_first else "psm"
                    out = joined([x for name in ORDER[form] for x in (leaf(f"<{SENTINEL[name]}>".encode()), part[name])])
                    rows.append((n, form, prefix.chars, middle.chars, text_of(out)))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("id"), *arrays[:4], arrays[4].cast(pa.string())], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    d = doc_columns(docs)
    d = d.select("id", F.concat(F.lit(f"{seed}:"), F.coalesce(real_id("id").cast("string"), F.lit(""))).alias("key"), "text")
    out = d.mapInArrow(run, "id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.select(real_id("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output")


def restore(moved: DataFrame) -> DataFrame:
    """moved (form, output and any columns) with restored: the text from which output was made, by output and form
    alone. Null where output is null or is no output of that form; an unknown or null form counts as plain."""

    def run(batches):
        for batch in batches:
            for b in slices(batch, "_output"):
                texts, out = Batch(b.column("_output").fill_null("")), []
                for d, (form, known) in enumerate(zip(b.column("_form").to_pylist(), b.column("_output").is_valid().to_pylist(), strict=True)):
                    rope = (texts.parts(d, form) if form in ORDER else texts.rope(d)) if known else None
                    out.append(None if rope is None else text_of(rope))
                yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(out, pa.binary()).cast(pa.string())], [*b.schema.names[2:], "_restored"])

    names = [f"c{i}" for i in range(len(moved.columns))]
    at = dict(zip(moved.columns, names, strict=True))
    inner = moved.toDF(*names)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema.fields) + ", _restored string"
    found = inner.select(F.col(at["form"]).alias("_form"), F.col(at["output"]).alias("_output"), "*").mapInArrow(run, schema)
    return found.toDF(*moved.columns, "restored")
