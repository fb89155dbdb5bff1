"""Best-fit packing by patterns: lengths go into sequences of a fixed size.

The histogram of lengths (at most one bin a token count) is all that the planner sees. Patterns
of a few lengths that fill a sequence exactly are fitted to it by non-negative least squares,
rounded down, and what is left over is packed by best fit decreasing over counts, not items.
The plan says for runs of equal lengths which run of sequences they go to, at which offset; items
take their places by their rank among items of their length.
"""

from __future__ import annotations

import bisect
import itertools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, doc_columns, gapless_rank, real_id, worker_cache

SEQUENCE = 2048
#: Most patterns that the fit looks at; bytes of text encoded at once.
PATTERNS, PART = 6000, 8 << 20


#: How a byte-level BPE cuts a text before it merges bytes (fixed: the tokenizer file's pre-tokenizer means this).
CUTS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Characters beyond those whose classes no version of Unicode has changed; texts that hold any keep to the tokenizer itself.
OTHERS = re.compile("[^\x00-\u024f\u2010-\u2027\u20ac]")


def byte_names() -> dict[str, int]:
    """The character by which a byte-level BPE names each byte: itself if printable, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def merger(path: str):
    """tiktoken's encoder of the byte-level BPE in the tokenizer file at path, which merges several times
    faster; None if the file asks for more than merges in order of their ids."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    model, pre = d["model"], d.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or d.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    names, vocab = byte_names(), model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [vocab["".join(m)] for m in pairs]
    if ids != sorted(set(ids)) or len(vocab) != len(names) + len(ids) or max(map(vocab.__getitem__, names)) > min(ids, default=1 << 30):
        return None
    import tiktoken

    ranks = {bytes(map(names.__getitem__, t)): i for t, i in vocab.items()}
    return tiktoken.Encoding("merges", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})


def encoder(path: str):
    """Arrow texts, none null -> the token ids of each, exactly those of the tokenizer file at path without
    added special tokens. A byte-level BPE never joins a space with what stands before it if a word
    follows, so texts are cut there; the distinct pieces are merged once, in one long text whose ids
    are told apart by their bytes, and gathered. Texts with white space after a space are merged whole;
    those with a special token's name or one of OTHERS go to the tokenizer itself."""
    from tokenizers import Tokenizer

    kept = worker_cache()
    if ("encoder", path) not in kept:
        tok, fast = Tokenizer.from_file(path), merger(path)
        size = np.zeros(0, np.int64) if fast is None else np.zeros(fast.max_token_value + 1, np.int64)
        for token, i in fast._mergeable_ranks.items() if fast is not None else ():
            size[i] = len(token)
        kept["encoder", path] = tok, fast, [t.content for t in tok.get_added_tokens_decoder().values()], size
    tok, fast, special, size = kept["encoder", path]

    def plain(t: str) -> bool:
        try:
            t.encode("latin-1")
        except UnicodeEncodeError:
            if OTHERS.search(t):
                return False
        return fast is not None and not any(name in t for name in special)

    def merged(units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units, each after a space; where each unit's begin, and the end)."""
        text = " " + " ".join(units.to_pylist())
        ids = np.array(fast.encode_ordinary(text), np.uint32)
        ends = np.cumsum(size[ids])
        token = np.zeros(int(ends[-1]) + 1, np.int32)
        token[ends] = np.arange(1, len(ids) + 1)
        return ids, token[np.concatenate([[0], np.cumsum(pc.binary_length(units).to_numpy().astype(np.int64) + 1)])]

    def by_pieces(texts: pa.Array) -> list[np.ndarray | None]:
        """The ids of plain texts; None where one is to be merged whole."""
        parts = pc.split_pattern(texts, " ")
        units = parts.flatten()
        n = np.diff(parts.offsets.to_numpy())
        first = np.cumsum(n) - n
        d = units.dictionary_encode()
        ids, at = merged(d.dictionary)
        bad = np.fromiter((not u or u[0].isspace() for u in d.dictionary.to_pylist()), bool, len(d.dictionary))
        code = d.indices.to_numpy()
        wrong = bad[code]
        wrong[first] = False
        whole = np.add.reduceat(wrong, first) > 0
        begin, count = at[code], (at[1:] - at[:-1])[code]
        count[first] = 0  # a text's first piece has no space before it
        ends = np.cumsum(count)
        found = ids[np.arange(ends[-1]) + np.repeat(begin - (ends - count), count)]
        upto = np.concatenate([[0], ends[np.cumsum(n) - 1]]).tolist()
        opens = units.take(pa.array(first)).to_pylist()
        return [None if w else np.concatenate([np.array(fast.encode_ordinary(o), np.uint32), found[a:z]]) for o, w, a, z in zip(opens, whole.tolist(), upto[:-1], upto[1:], strict=True)]

    def encode(texts: pa.Array) -> list[np.ndarray]:
        words = texts.to_pylist()
        out: list = [None] * len(words)
        at = [i for i, t in enumerate(words) if plain(t)]
        for i, ids in zip(at, by_pieces(texts.take(pa.array(at))) if at else (), strict=True):
            out[i] = np.array(fast.encode_ordinary(words[i]), np.uint32) if ids is None else ids
        for i, ids in enumerate(out):
            if ids is None:
                out[i] = np.array(tok.encode(words[i], add_special_tokens=False).ids, np.uint32)
        return out

    return encode


def slices(batch: pa.RecordBatch, column: str, most: int):
    """batch in slices of at most `most` bytes of a text column, of one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most, side="right")))
        yield batch.slice(a, z - a)
        a = z


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = SEQUENCE) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each row's tokens and the end id. Texts of more
    than size ids are cut into pieces of size, of which the first takes what is over."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(tokenizer)
        end = end_id.to_bytes(4, "little")
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for b in batches:
            for part in slices(b, "text", PART):
                rows = []
                for d, found in zip(part.column("id").to_pylist(), encode(part.column("text")), strict=True):
                    ids = found.tobytes() + end
                    n = len(ids) // 4
                    s, k = 0, 0
                    while s < n:
                        e = s + ((n - s - 1) % size + 1 if k == 0 else size)
                        rows.append((d, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])))
                        s, k = e, k + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "piece", "start", "length", "ids_crc32"])

    return doc_columns(docs).mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


def patterns(hist: np.ndarray) -> list[tuple[int, ...]]:
    """Few-length patterns that sum to the sequence size, of lengths that occur: all pairs, then
    triples and quadruples, those of the most frequent lengths first."""
    size = len(hist) - 1
    there = np.flatnonzero(hist)
    has = hist > 0
    out = [(size,)] if has[size] else []
    out += [(int(a), int(size - a)) for a in there if 0 < a <= size - a and has[size - a]]
    often = there[np.argsort(-hist[there], kind="stable")]
    k = 24
    while len(out) < PATTERNS and k <= 2 * len(often):
        top = [int(x) for x in often[: min(k, len(often))]]
        seen = set(out)
        for r in (2, 3):
            for c in itertools.combinations_with_replacement(top, r):
                rest = size - sum(c)
                if rest > 0 and has[rest] and (p := tuple(sorted((*c, rest)))) not in seen:
                    seen.add(p)
                    out.append(p)
            if len(out) >= PATTERNS:
                break
        k *= 2
    return out[:PATTERNS]


def fit(hist: np.ndarray, pats: list[tuple[int, ...]], steps: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 of pats with the least squared difference of their lengths from hist
    (accelerated projected gradient)."""
    if not pats:
        return np.zeros(0)
    col = np.repeat(np.arange(len(pats)), [len(p) for p in pats])
    row = np.array([v for p in pats for v in p])
    scale = 1.0 / max(np.bincount(row, minlength=len(hist)).max() * max(map(len, pats)), 1)
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(steps):
        over = np.bincount(row, weights=y[col], minlength=len(hist)) - hist
        new = np.maximum(0, y - scale * np.bincount(col, weights=over[row], minlength=len(pats)))
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        x, y = new, new + (was - 1) / t * (new - x)
    return x


#: Parts of the fitted repeat counts that a plan may use; patterns can take short lengths that long ones need.
SHARES = (1.0, 0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.2, 0.0)


def plan(hist: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first_rank, count, first_sequence, offset) that place every item of hist
    (hist[n]: items of length n) into sequences of len(hist) - 1; the one of SHARES with the fewest sequences."""
    pats = patterns(hist)
    x = fit(hist, pats)
    return min((plan_with(hist, pats, share * x) for share in SHARES), key=lambda p: p[1])[0]


def plan_with(hist: np.ndarray, pats: list[tuple[int, ...]], repeats: np.ndarray) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(runs, number of sequences): patterns as often as repeats says, rounded down, and best fit decreasing for the rest."""
    size = len(hist) - 1
    left = hist.astype(np.int64).copy()
    runs, used, sequences = [], np.zeros(size + 1, np.int64), 0

    def put(length, count, sequence, offset):
        runs.append((int(length), int(used[length]), int(count), int(sequence), int(offset)))
        used[length] += count
        left[length] -= count

    for p, x in sorted(zip(pats, np.floor(repeats + 1e-9).astype(np.int64), strict=True), key=lambda z: -z[1]):
        lengths, each = np.unique(p, return_counts=True)
        n = int(min(x, (left[lengths] // each).min()))
        if n <= 0:
            continue
        offset = 0
        for v in sorted(p, reverse=True):
            put(v, n, sequences, offset)
            offset += v
        sequences += n
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs of sequences (first, count)
    free: list[int] = []
    for length in range(size, 0, -1):
        while left[length]:
            i = bisect.bisect_left(free, length)
            if i == len(free):
                n = int(left[length])
                first, count, space = sequences, n, size
                sequences += n
            else:
                space = free[i]
                first, count = room[space].pop()
                if not room[space]:
                    free.pop(i)
                    del room[space]
                n = int(min(count, left[length]))
                if n < count:
                    if space not in room:
                        bisect.insort(free, space)
                    room.setdefault(space, []).append((first + n, count - n))
            put(length, n, first, size - space)
            if rest := space - length:
                if rest not in room:
                    bisect.insort(free, rest)
                    room[rest] = []
                room[rest].append((first, n))
    return runs, sequences


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of docs (doc_id, text).

    A null or empty text is the end id alone, one piece of length 1; a null doc_id stays null;
    repeated rows are packed each for itself; an empty table gives an empty result; other columns
    of docs are not looked at. Two runs give the same plan.
    """
    items = cut(pieces(docs, tokenizer, end_id, size))
    hist = np.zeros(size + 1, np.int64)
    for length, n in items.groupBy("length").count().collect():  # at most size rows
        hist[length] = n
    by_length: dict[int, tuple] = {}
    for length, group in itertools.groupby(sorted(plan(hist)), key=lambda r: r[0]):
        _, rank, _, sequence, offset = map(np.array, zip(*group, strict=True))
        by_length[length] = (rank, sequence, offset)
    spark = items.sparkSession
    plan_b = spark.sparkContext.broadcast(by_length)  # runs number a few times size, whatever the input

    def run(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                first, sequence, offset = plan_b.value[int(length[part[0]])]
                i = np.searchsorted(first, rank[part], side="right") - 1
                seq[part], off[part] = sequence[i] + rank[part] - first[i], offset[i]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], [*b.schema.names[:5], "sequence_id", "offset"])

    ranked = gapless_rank(items, ["length"], ["id", "piece", "ids_crc32", "start"], "rank", int(hist.sum())).select("id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank"))
    placed = ranked.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.select(real_id("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
