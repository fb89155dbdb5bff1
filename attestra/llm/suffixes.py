"""Exact substring dedup by hash-compared suffix sorting.

Which suffixes of the corpus share their first 50 bytes is told by sorting them. Suffixes are compared by
polynomial prefix hashes: where their first eight bytes agree, a binary search over the length finds how far two do, so
that a comparison takes some six probes, and mergesort orders them; neighbours are then compared byte by byte, and where these tell
that hashes collided, the suffixes concerned are sorted by their bytes.

To sort in parallel, suffixes are dealt by the minimiser of their first 50 bytes (the least hash of the runs of K
bytes in them), on which suffixes that agree must agree, as on the distance to it: those alike in both are a cell, and only
cells are sorted; of very many copies of a window only one is. Suffixes that start in turn and share a minimiser travel as
one piece of text. Most minimisers occur in one document; a first exchange, of four bytes a piece, finds those that occur in
several, and only their pieces travel.
Equal pieces are one piece with the smallest doc_id, within a block of documents and again where blocks meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, doc_columns, real_id, slices
from .substrings import least, mixed, ranges, rolled

WINDOW, K = 50, 24
#: Bytes of text of a block; pieces of a bucket of the first exchange; bytes of text of a bucket of the second (about).
BLOCK, KEYS, TEXT = 4 << 20, 1_000_000, 5_000_000
#: Windows that are looked at together, so that they stay in cache.
STRIDE = 1 << 16
#: Of a bucket of the second exchange: bytes of text that are sorted together, windows that are, and windows of a cell;
#: larger cells are cut by a hash of the window. Copies of a window in one cell beyond which they are sorted as one.
TOGETHER, SORTED, CELL, COPIES = 1 << 19, 1 << 17, 1 << 10, 1 << 5
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LETTER = mixed(np.arange(1, 257, dtype=np.uint64) * BASE)


def blocks_of(docs: DataFrame) -> DataFrame:
    """(block, ids, sizes, z): documents (id, text) in blocks of about BLOCK bytes, compressed."""

    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        ids, texts, size = [], [], 0

        def block():
            sizes = np.array([len(t) for t in texts], np.int64)
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (np.array(ids, np.int64).tobytes(), sizes.tobytes(), press.compress(b"".join(texts)))], ["ids", "sizes", "z"])

        for batch in batches:
            for b in slices(batch, "text", BLOCK // 4):
                ids += b.column("id").to_pylist()
                texts += b.column("text").cast(pa.binary()).to_pylist()
                size += b.column("text").nbytes
                if size >= BLOCK:
                    yield block()
                    ids, texts, size = [], [], 0
        if ids:
            yield block()

    packed = docs.mapInArrow(run, "ids binary, sizes binary, z binary")
    return cut(packed.select(F.monotonically_increasing_id().alias("block"), "*"))


class Block:
    """The documents of a block, end to end, and their pieces: at (its first window), n (windows), low (their minimiser)."""

    def __init__(self, ids: bytes, sizes: bytes, z: bytes):
        import zstandard

        self.ids = np.frombuffer(ids, np.int64)
        self.off = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))])
        self.raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(z) if self.off[-1] else b"", np.uint8)

    def cut_up(self) -> Block:
        total = len(self.raw) - WINDOW + 1
        inside = np.ones(max(total, 0) + WINDOW, bool)
        for k in range(1, WINDOW):  # a window that begins less than 50 bytes before the end of a document is none
            inside[np.maximum(self.off[1:] - k, 0)] = False
        at, low, end = [], [], []
        for a in range(0, total, STRIDE):
            z = min(total, a + STRIDE)
            h = least(mixed(rolled(self.raw[a : z + WINDOW - 1].astype(np.uint64) + np.uint64(7), K)), WINDOW - K + 1)
            ok = inside[a:z]
            new = ok.copy()
            new[1:] &= (h[1:] != h[:-1]) | ~ok[:-1]
            s = np.flatnonzero(new)
            stop = ok.copy()  # where a piece has its last window
            stop[:-1] &= new[1:] | ~ok[1:]
            at.append(s + a)
            end.append(np.flatnonzero(stop) + a)
            low.append(h[s])
        self.at, self.low, end = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((at, np.int64), (low, np.uint64), (end, np.int64)))
        if len(self.at):  # what a stride cut in two
            on = np.r_[False, (self.at[1:] == end[:-1] + 1) & (self.low[1:] == self.low[:-1]) & (self.at[1:] % STRIDE == 0)]
            self.at, self.low, end = self.at[~on], self.low[~on], end[np.r_[~on[1:], True]]
        self.n = end - self.at + 1
        self.doc = np.searchsorted(self.off, self.at, side="right") - 1
        return self

    def keys(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The block's distinct minimisers by bucket: (buckets, keys within them, places of these in distinct minimisers, minimiser of each piece)."""
        kinds, of = np.unique(self.low, return_inverse=True)
        full = mixed(kinds * BASE)
        bucket = (full & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
        key = (full >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((key, bucket))
        return bucket[order].astype(np.int64), key[order], order, of


def pieces_of(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """The bytes at places of raw, as binary values."""
    data = raw[ranges(at, size)] if len(at) else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(data)])


def spread(bucket: np.ndarray):
    """(bucket, first, end) of the runs of a sorted array."""
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, np.int64)
    return zip(bucket[edges[:-1]].tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def in_several(each: list[np.ndarray]) -> list[np.ndarray]:
    """For each key (32 bits) of some arrays, whether it is there again, in any of them: one sort of all, however many arrays there are."""
    every = np.concatenate(each).astype(np.uint64) << np.uint64(32) | np.arange(sum(map(len, each)), dtype=np.uint64)
    every.sort()
    again = np.flatnonzero(every[1:] >> np.uint64(32) == every[:-1] >> np.uint64(32))
    at = (every & np.uint64(0xFFFFFFFF)).astype(np.int64)
    found = np.zeros(len(every), bool)
    found[at[again]] = found[at[again + 1]] = True
    return np.split(found, np.cumsum([len(x) for x in each])[:-1])


def first_exchange(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, shared, n): for the distinct minimisers of a block in a bucket, in order, a bit that tells whether
    other blocks have it too; n of them have. Two minimisers that share a key count as one, which only sends more pieces on."""

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row["ids"], row["sizes"], row["z"]).cut_up()
                bucket, key, _, _ = b.keys(buckets)
                out = [(k, row["block"], key[a:z].tobytes()) for k, a, z in spread(bucket)]
                for k in range(0, len(out), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 5000], strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["bucket", "block", "keys"])

    def count(t: pa.Table) -> pa.Table:
        found = in_several([np.frombuffer(x, np.uint32) for x in t.column("keys").to_pylist()])
        return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "shared": pa.array([np.packbits(x).tobytes() for x in found], pa.binary()), "n": pa.array([int(x.sum()) for x in found], pa.int64())})

    return cut(blocks.mapInArrow(send, "bucket long, block long, keys binary").groupBy("bucket").applyInArrow(count, "block long, bucket long, shared binary, n long"))


def travel(blocks: DataFrame, shared: DataFrame, keyed: int, buckets: int) -> DataFrame:
    """(bucket, block, settled, packed, n): pieces whose minimiser several documents have, by bucket; with settled,
    windows that a document of smaller id in the same block has too."""

    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row["ids"], row["sizes"], row["z"]).cut_up()
                bucket, _, order, of = b.keys(keyed)
                far = np.zeros(len(order), bool)
                bits = {x["bucket"]: x["shared"] for x in row["shared"] or ()}
                for k, a, z in spread(bucket):
                    far[order[a:z]] = np.unpackbits(np.frombuffer(bits[k], np.uint8), count=z - a).astype(bool)
                ids = b.ids[b.doc]
                if len(of):
                    by = np.lexsort((ids, of))
                    edge = np.flatnonzero(np.r_[True, of[by][1:] != of[by][:-1]])
                    far |= np.minimum.reduceat(ids[by], edge) != np.maximum.reduceat(ids[by], edge)
                p = np.flatnonzero(far[of]) if len(of) else np.zeros(0, np.int64)
                if not len(p):
                    continue
                size = b.n[p] + WINDOW - 1
                code = pieces_of(b.raw, b.at[p], size).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                smallest = np.full(code.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(smallest, code, ids[p])
                gone = ids[p] > smallest[code]
                start = (b.at - b.off[b.doc]).astype(np.int32)
                out = []
                if gone.any():
                    q = p[gone]
                    out.append((row["block"] % buckets, row["block"], True, press.compress(spans_of(b.doc[q], start[q], b.n[q])), len(q)))
                q = p[~gone]
                to = (mixed(b.low[q] * BASE) >> np.uint64(20)) % np.uint64(buckets)
                q, to = q[np.argsort(to, kind="stable")], np.sort(to)
                for k, a, z in spread(to.astype(np.int64)):
                    r = q[a:z]
                    head = (b.doc[r].astype(np.int32), ids[r], start[r], b.n[r].astype(np.int32))
                    data = b.raw[ranges(b.at[r], b.n[r] + WINDOW - 1)]
                    out.append((k, row["block"], False, press.compress(b"".join(x.tobytes() for x in (*head, data))), len(r)))
                for k in range(0, len(out), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 1000], strict=True), (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32()), strict=True)], ["bucket", "block", "settled", "packed", "n"])

    replies = shared.groupBy("block").agg(F.collect_list(F.struct("bucket", "shared")).alias("shared"))
    return blocks.join(replies, "block", "left").mapInArrow(run, "bucket long, block long, settled boolean, packed binary, n int")


def spans_of(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> bytes:
    return b"".join(x.astype(np.int32).tobytes() for x in (doc, start, n))


class Hashes:
    """Polynomial prefix hashes of raw: those of any two stretches of equal length compare in two look-ups each."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.raw = raw
        self.power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, BASE)])
        falling = np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(n - 1, 0), UNBASE)])
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LETTER[raw] * falling[:n])])

    def whole(self, i: np.ndarray) -> np.ndarray:
        """A hash of the windows at i; those that agree have the same."""
        return mixed((self.sums[i + WINDOW] - self.sums[i]) * self.power[i])

    def agree(self, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
        """How many bytes, up to most, the suffixes at i and at j have in common: all of them if one probe says so, else
        by binary search over lengths."""
        at_i, at_j, by_i, by_j = self.sums[i], self.sums[j], self.power[i], self.power[j]
        out = np.full(len(i), most, np.int64)
        k = np.flatnonzero((self.sums[i + most] - at_i) * by_i != (self.sums[j + most] - at_j) * by_j)
        i, j, at_i, at_j, by_i, by_j = (x[k] for x in (i, j, at_i, at_j, by_i, by_j))
        far = np.zeros(len(k), np.int64)
        step = 1 << (most.bit_length() - 1)
        while step:
            longer = np.minimum(far + step, most - 1)  # fewer than most agree
            same = (self.sums[i + longer] - at_i) * by_i == (self.sums[j + longer] - at_j) * by_j
            far = np.where(same, longer, far)
            step >>= 1
        out[k] = far
        return out

    def before(self, i: np.ndarray, j: np.ndarray, most: int, w: np.ndarray) -> np.ndarray:
        """Whether the suffix at i comes before that at j, in their first most bytes. w: words(raw), whose first look-up tells
        many apart."""
        x, y = w[i], w[j]
        out = x < y
        k = np.flatnonzero(x == y)
        i, j = i[k], j[k]
        far = self.agree(i, j, most)
        apart = far < most
        far[~apart] = 0
        out[k] = apart & (self.raw[i + far] < self.raw[j + far])
        return out


def merge_sort(hashes: Hashes, at: np.ndarray, cell: np.ndarray, most: int, w: np.ndarray) -> np.ndarray:
    """An order of suffixes (at), already gathered by cell, that sorts each cell by the first most bytes; those that agree
    keep their order. w: words of the text.

    Runs of doubling width are merged in all cells at once: a suffix of the left run goes behind the suffixes of the right
    one that come first, whose number is found by binary search; those of the right take the places that are left.
    """
    n = len(at)
    order = np.arange(n)
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, n])
    within, end, size = np.arange(n) - np.repeat(first, size), np.repeat(first + size, size), np.repeat(size, size)
    width = 1
    while n and width < size.max():
        k = np.flatnonzero(size > width)
        left = within[k] & width == 0
        a = k[left]
        lo = np.minimum(a - (within[a] & (width - 1)) + width, end[a])
        hi = np.minimum(lo + width, end[a])
        right, sorted_at = lo.copy(), at[order]
        mine = sorted_at[a]
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            bottom, top = lo[todo], hi[todo]
            mid = (bottom + top) // 2
            up = hashes.before(sorted_at[mid], mine[todo], most, w)
            lo[todo] = bottom = np.where(up, mid + 1, bottom)
            hi[todo] = top = np.where(up, top, mid)
            todo = todo[bottom < top]
        count = np.arange(len(a))
        place = np.maximum.accumulate(a + (lo - right) - count) + count  # one place each, whatever hashes say
        free = np.ones(n, bool)
        free[place] = False
        placed = order.copy()
        placed[place] = order[a]
        placed[k[free[k]]] = order[k[~left]]
        order = placed
        width *= 2
    return order


def words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes at each place of raw as a number that orders as they do."""
    n = len(raw) - 7
    w = np.zeros(max(n, 0), np.uint64)
    for k in range(8):
        w = (w << np.uint64(8)) | raw[k : k + n]
    return w


def sorted_cells(raw: np.ndarray, at: np.ndarray, cell: np.ndarray, window: int, hashes: Hashes | None = None, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, class): suffixes (at), gathered by cell, sorted within cells; those of a class agree in window bytes.
    The order that hashes gave is held against the bytes of neighbours, and cells in which it is wrong are sorted by bytes.
    w: words(raw), if they are there already."""
    w = words(raw) if w is None else w
    order = merge_sort(hashes or Hashes(raw), at, cell, window, w)
    steps = [*range(0, window - 8, 8), window - 8]

    def neighbours(order):
        a, b, same_cell = at[order[:-1]], at[order[1:]], cell[order[1:]] == cell[order[:-1]]
        same, wrong = same_cell.copy(), np.zeros(len(a), bool)
        for s in steps:
            x, y = w[a + s], w[b + s]
            wrong |= same & (x > y)
            same &= x == y
        return same, wrong

    same, wrong = neighbours(order)
    if wrong.any():
        data = raw.tobytes()
        for c in np.unique(cell[order[1:]][wrong]).tolist():
            k = np.flatnonzero(cell == c)
            order[k] = sorted(k.tolist(), key=lambda i: data[at[i] : at[i] + window])
        same, _ = neighbours(order)
    return order, np.cumsum(np.r_[False, ~same]) if len(at) else np.zeros(0, np.int64)


def batched(group: np.ndarray, weight: np.ndarray, most: int):
    """(first, end) of stretches of whole groups (sorted) that weigh some `most`, and less than that and one group."""
    if len(group):
        edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        before = (np.cumsum(weight) - weight)[edge] // most
        cuts = [*edge[np.r_[True, before[1:] != before[:-1]]].tolist(), len(group)]
        yield from zip(cuts[:-1], cuts[1:], strict=True)


def repeated(raw: np.ndarray, first: np.ndarray, n: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The windows (their places in raw) of distinct pieces that a piece with a smaller own has too, in order. Minimisers
    are taken a few at a time, so that what is held beside raw does not grow with its windows."""
    runs = [mixed(rolled(raw[a : a + STRIDE + K - 1].astype(np.uint64) + np.uint64(7), K)) for a in range(0, len(raw), STRIDE)]
    h = np.concatenate(runs) if runs else np.zeros(0, np.uint64)
    low = np.concatenate([h[first[a : a + STRIDE, None] + np.arange(WINDOW - K + 1)].min(axis=1) for a in range(0, len(first), STRIDE)] or [np.zeros(0, np.uint64)])
    kinds, of, count = np.unique(low, return_inverse=True, return_counts=True)
    smallest, largest = np.full(len(kinds), np.iinfo(np.int64).max), np.full(len(kinds), np.iinfo(np.int64).min)
    np.minimum.at(smallest, of, own)
    np.maximum.at(largest, of, own)
    p = np.flatnonzero(((count > 1) & (smallest < largest))[of])
    p = p[np.argsort(of[p], kind="stable")]
    found = [np.zeros(0, np.int64)]
    for a, z in batched(of[p], n[p] + WINDOW - 1, TOGETHER):
        q = p[a:z]
        found.append(repeated_among(raw, h, low[q], of[q], first[q], n[q], own[q]))
    return np.sort(np.concatenate(found))


def leads(hashes: Hashes, w: np.ndarray, at: np.ndarray, cell: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For windows (at) gathered by cell, the number of the one each is sorted as: itself, or of more than COPIES windows whose
    hashes and bytes agree the one of smallest own."""
    lead = np.arange(len(at))
    many = np.diff(np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True]))
    k = np.flatnonzero(np.repeat(many > COPIES, many))
    if len(k):
        whole = hashes.whole(at[k])
        by = np.lexsort((own[k], whole))
        k, whole = k[by], whole[by]
        edge = np.flatnonzero(np.r_[True, whole[1:] != whole[:-1]])
        size = np.diff(np.r_[edge, len(k)])
        first, k = np.repeat(k[edge], size)[np.repeat(size > COPIES, size)], k[np.repeat(size > COPIES, size)]
        same = np.ones(len(k), bool)
        for s in (*range(0, WINDOW - 8, 8), WINDOW - 8):
            same &= w[at[k] + s] == w[at[first] + s]
        lead[k[same]] = first[same]
    return lead


def repeated_among(raw: np.ndarray, h: np.ndarray, low: np.ndarray, of: np.ndarray, first: np.ndarray, n: np.ndarray, own: np.ndarray) -> np.ndarray:
    """What repeated finds among all pieces of some minimisers (low, numbered by of); h: the hashes of runs of raw."""
    size = n + WINDOW - 1
    offset = np.cumsum(size) - size
    where = ranges(first, size)  # the text of these pieces alone
    mark = np.repeat(low, size) == h[np.minimum(where, len(h) - 1)]
    mark[(offset[:, None] + size[:, None] - np.arange(1, K)).ravel()] = False
    nearest = np.minimum.accumulate(np.where(mark, np.arange(len(mark)), len(mark))[::-1])[::-1]
    at = ranges(offset, n)
    piece = np.repeat(np.arange(len(n)), n)
    cell = of[piece] * WINDOW + nearest[at] - at
    del mark, nearest
    text = raw[where]
    hashes, w = Hashes(text), words(text)
    by = np.argsort(cell, kind="stable")
    at, cell, own = at[by], cell[by], own[piece[by]]
    del piece
    lead = leads(hashes, w, at, cell, own)
    alone = lead == np.arange(len(at))
    copies, later, lead = at[~alone], (own > own[lead])[~alone], at[lead[~alone]]
    at, cell, own = at[alone], cell[alone], own[alone]
    many = np.bincount(np.cumsum(np.r_[False, cell[1:] != cell[:-1]]))
    if many.max() > CELL:
        parts = np.repeat(-(-many // CELL), many)
        part = (hashes.whole(at) % parts.astype(np.uint64)).astype(np.int64)
        by = np.lexsort((part, cell))
        at, own, cell, part = at[by], own[by], cell[by], part[by]
        cell = np.cumsum(np.r_[False, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])])
    several = np.r_[False, cell[1:] == cell[:-1]]
    several |= np.r_[several[1:], False]
    at, own, cell = at[several], own[several], cell[several]
    gone = np.zeros(len(text), bool)
    for a, z in batched(cell, np.ones(len(cell), np.int64), SORTED):
        order, kind = sorted_cells(text, at[a:z], cell[a:z], WINDOW, hashes, w)
        mine = own[a:z][order]
        least_own = np.minimum.reduceat(mine, np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]]))
        gone[at[a:z][order[mine > least_own[kind]]]] = True
    gone[copies] = later | gone[lead]
    return where[gone]


def second_exchange(packed: DataFrame) -> DataFrame:
    """(block, z): runs of windows that a document of smaller id has too, as (document of the block, first window, windows)."""

    def settle(t: pa.Table) -> pa.Table:
        import zstandard

        press, open_up = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        out, heads, data, of = [], [], [], []
        for block, settled, z, n in zip(*(t.column(c).to_pylist() for c in ("block", "settled", "packed", "n")), strict=True):
            if settled:
                out.append((block, z))
                continue
            raw = open_up.decompress(z)
            heads.append([np.frombuffer(raw, d, n, o * n) for d, o in ((np.int32, 0), (np.int64, 4), (np.int32, 12), (np.int32, 16))])
            data.append(np.frombuffer(raw, np.uint8, offset=20 * n))
            of.append(np.full(n, block))
        del t
        if heads:
            doc, ids, start, n = (np.concatenate(c) for c in zip(*heads, strict=True))
            block, size = np.concatenate(of), n.astype(np.int64) + WINDOW - 1
            raw = np.concatenate(data)
            del data, heads
            kinds = pieces_of(raw, np.cumsum(size) - size, size).dictionary_encode()
            del raw
            code = kinds.indices.to_numpy(zero_copy_only=False)
            own = np.full(len(kinds.dictionary), np.iinfo(np.int64).max)
            np.minimum.at(own, code, ids)
            off = np.frombuffer(kinds.dictionary.buffers()[1], np.int64, len(own) + 1)
            distinct = np.frombuffer(kinds.dictionary.buffers()[2], np.uint8)
            first, windows = off[:-1], np.diff(off) - WINDOW + 1
            again = repeated(distinct, first, windows, own)
            whole = np.flatnonzero(ids > own[code])
            r_code = np.searchsorted(off, again, side="right") - 1
            edge = np.flatnonzero(np.r_[True, (np.diff(again) != 1) | (np.diff(r_code) != 0)]) if len(again) else np.zeros(0, np.int64)
            r_n, r_at, r_code = np.diff(np.r_[edge, len(again)]), (again - first[r_code])[edge], r_code[edge]
            many = np.bincount(r_code, minlength=len(own))
            partly = np.flatnonzero((ids == own[code]) & (many[code] > 0))
            k = ranges((np.cumsum(many) - many)[code[partly]], many[code[partly]])
            q = np.repeat(partly, many[code[partly]])
            q, at, n = np.r_[whole, q], np.r_[start[whole], start[q] + r_at[k]], np.r_[n[whole], r_n[k]]
            by = np.argsort(block[q], kind="stable")
            for b, a, z in spread(block[q][by]):
                r = by[a:z]
                out.append((b, press.compress(spans_of(doc[q[r]], at[r], n[r]))))
        return pa.table({"block": pa.array([b for b, _ in out], pa.int64()), "z": pa.array([z for _, z in out], pa.binary())})

    return packed.groupBy("bucket").applyInArrow(settle, "block long, z binary")


def without(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): the documents of blocks without the bytes that the windows of spans cover."""

    def run(batches):
        import zstandard

        open_up = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row["ids"], row["sizes"], row["z"])
                edge = np.zeros(len(b.raw) + 1, np.int32)
                for z in row["spans"] or ():
                    doc, start, n = np.frombuffer(open_up.decompress(z), np.int32).reshape(3, -1)
                    s = b.off[doc] + start
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + n + WINDOW - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                opened = gone.copy()
                opened[1:] &= ~gone[:-1]
                some = b.off[:-1][b.off[:-1] < len(gone)]
                opened[some] = gone[some]
                upto = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[b.off]  # noqa: E731, B023
                removed = upto(gone)
                kept = pa.Array.from_buffers(pa.large_binary(), len(b.ids), [None, pa.py_buffer(b.off - removed), pa.py_buffer(b.raw[~gone])]).cast(pa.binary())
                cols = [pa.array(x) for x in (b.ids, np.diff(b.off), np.diff(removed), np.diff(upto(opened)))]
                yield pa.RecordBatch.from_arrays([*cols, kept], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    found = spans.groupBy("block").agg(F.collect_list("z").alias("spans"))
    return blocks.join(found, "block", "left").mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept binary")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row of docs (doc_id, text): kept is the text's UTF-8
    without the bytes covered by a string of 50 bytes that also starts in a row of smaller doc_id; n_spans counts the
    maximal runs removed.

    A null doc_id is smaller than all others and stays null; a null text is empty. Rows of equal doc_id take nothing from
    each other, so rows of equal doc_id and text come back alike. An empty table gives an empty result; other columns are not
    looked at. A task holds a block of documents, or one text that is longer.
    """
    d = doc_columns(docs)
    size = d.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = blocks_of(d)
    pieces = size * 2 // (WINDOW - K + 2)
    keyed = max(12, pieces // KEYS)
    shared = first_exchange(blocks, keyed)
    moved = min(pieces, (shared.agg(F.sum("n")).first()[0] or 0) * 2) * (WINDOW + (WINDOW - K) // 2)
    packed = travel(blocks, shared.drop("n"), keyed, max(12, moved // TEXT))
    out = without(blocks, second_exchange(packed))
    return out.select(real_id("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
