"""Fill-in-the-middle, conversation repair and suffix dedup against brute force, with nulls, empties, repeats and ties."""

import hashlib
import heapq
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from attestra.llm import middle, repair, suffixes

DOCS = "doc_id long, text string, lang string, n long, output string, id long, part int, block long"
TURNS = "conv_id long, turn long, role string, text string, id long, part int, symbol int, fault string"


def doc(i, t):
    return (i, t, "en", 1, "x", 2, 3, 4)


def turn(c, t, role, text):
    return (c, t, role, text, 1, 2, 3, "x")


# --- 11 ------------------------------------------------------------------------------------------------

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def moved(i, t):
    t = t or ""
    w = UNIT.findall(t)
    x = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[k : k + 8], 16) for k in range(0, 32, 8)]
    a, z = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:z]), "".join(w[z:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, len(w), "plain", None, None, t
    if h[3] % 100 < 20:
        return i, len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    r = np.random.default_rng(5)
    some = ["".join(r.choice(list("abcXYZ é日😀<P\n  .")) for _ in range(r.integers(0, 200))) for _ in range(60)]
    return some + [None, "", "a", " ", "a" * 30_000, "word " * 8000, "日" * 5000, "has <P> in it", "has <M> in it", "<S>", "ends <P", "P>x<S", "<", "<<P>>"]


def test_middle_is_what_the_text_says(spark):
    rows = [doc(i * 7, t) for i, t in enumerate(texts())]
    rows += [rows[3], doc(None, "no id here, but text"), doc(21, "another text of an id")]
    out = middle.transform(spark.createDataFrame(rows, DOCS).repartition(3))
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=repr) == sorted((moved(r[0], r[1]) for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = middle.restore(out).select("doc_id", "restored").collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((r[0], r[1] or "") for r in rows), key=repr)


def test_middle_of_other_parameters_and_of_nothing(spark):
    rows = spark.createDataFrame([doc(i, t) for i, t in enumerate(texts())], DOCS)
    out = middle.restore(middle.transform(rows, seed=9, moved=100, suffix_first=100))
    assert {r["form"] for r in out.collect()} == {"plain", "spm"}
    assert all((r["text"] or "") == r["restored"] for r in out.join(rows.select("doc_id", "text"), "doc_id").collect())
    assert middle.restore(middle.transform(rows.limit(0))).count() == 0


def test_no_output_of_a_form_is_not_restored(spark):
    cases = [("psm", "<P>a<S>b", None), ("psm", "<S>a<P>b<M>c", None), ("psm", "x<P>a<S>b<M>c", None), ("psm", None, None), ("spm", "<S>a<P>b<M>c", "bca"), ("plain", "<P>", "<P>"), (None, "x", "x"), ("psm", "<P><S><M>", "")]
    got = middle.restore(spark.createDataFrame([(f, o, "r") for f, o, _ in cases], "form string, output string, c0 string")).collect()
    assert [(r["form"], r["output"], r["restored"]) for r in got] == cases and got[0]["c0"] == "r"


def test_ropes_split_at_every_rank(monkeypatch):
    monkeypatch.setattr(middle, "LEAF", 5)
    for t in texts():
        t = (t or "")[:120]
        b = middle.Batch(pa.array(["x", t, "y"]))
        rope, w = b.rope(1), UNIT.findall(t)
        assert (rope.units, rope.chars) == (len(w), len(t))
        for k in range(len(w) + 1):
            x, y = middle.split(rope, k)
            assert (middle.text_of(x).decode(), middle.text_of(y).decode()) == ("".join(w[:k]), "".join(w[k:]))
            assert (x.units, y.units, x.chars) == (k, len(w) - k, len("".join(w[:k])))


# --- 12 ------------------------------------------------------------------------------------------------


def damaged(rows):
    out = defaultdict(list)
    for c, t, role, text, *_ in rows:
        one = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{one(c)}:{one(t)}".encode()) % 20
        role, text = one(role), one(text)
        if k == 4:
            role = "user"
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out[c] += [(t, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def best(rows):
    """(cost, audit, repaired): Dijkstra over (rows used, roles so far) with audits compared as strings."""
    start = (0, "", 0, "", ())
    todo, done = [start], set()
    while todo:
        cost, audit, k, last, made = heapq.heappop(todo)
        if (k, last) in done:
            continue
        done.add((k, last))
        if k == len(rows) and last in ("", "a"):
            return cost, audit, made
        nxt = ("assistant", "a") if last == "u" else ("user", "u")
        heapq.heappush(todo, (cost + 2, audit + "I", k, nxt[1], (*made, f"{nxt[0]}:")))
        if k < len(rows):
            (_, role, text), fault = rows[k]
            heapq.heappush(todo, (cost + 3, audit + "D", k + 1, last, made))
            if fault not in (1, 2):
                more = fault == 3
                heapq.heappush(todo, (cost + 2 + more, audit + "R", k + 1, nxt[1], (*made, f"{nxt[0]}:{text}")))
                if role[:1] == nxt[1] or (role[:1] == "s" and last == ""):
                    heapq.heappush(todo, (cost + more, audit + "K", k + 1, role[:1], (*made, f"{role}:{text}")))
    return None


def reported(c, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip("\t\n\x0b\f\r ")
        faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    x = [r[1][:1] for r in rows]
    t = {r[0] for r in rows if r[0] is not None}
    cost, audit, made = best(list(zip(rows, faults, strict=True)))
    return (
        c, max(t) - min(t) + 1 - len(t) if t else 0, *(faults.count(k) for k in (1, 2, 3)),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(x, x[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest(),
    )


def talk(seed, conversations, most):
    r = np.random.default_rng(seed)
    rows = []
    for c in range(conversations):
        for k in range(r.integers(1, most)):
            role = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "ass"][r.integers(9)]
            text = [f"Text {k}.", "Same again!", "no end", "  \n", "", None, "Ends? \t", f"Line {k}\nmore."][r.integers(8)]
            rows.append(turn(None if c == 3 else c, None if r.random() < 0.05 else int(k * (1 + r.integers(2))), role, text))
    return rows


def test_repair_is_the_cheapest(spark):
    rows = talk(1, 150, 12)
    rows += rows[:20] + [turn(900, t, "user", "Alone.") for t in (1, 2, 2, 9)] + [turn(901, 1, "s", "x.")]
    df = spark.createDataFrame(rows, TURNS).repartition(4)
    got = {r["conv_id"]: tuple(r) for r in repair.with_reports(df, repair.damage(df)).collect()}
    broken = damaged(rows)
    assert set(got) == {r[0] for r in rows}
    assert all(got[c] == reported(c, broken[c]) for c in got)
    assert any(not v for v in broken.values()), "no conversation is lost whole"


def test_repair_of_a_conversation_over_many_partitions(spark):
    """One conversation holds most rows: it is scanned in pieces, and its pieces come together."""
    r = np.random.default_rng(3)
    big = [(7, int(k), ["user", "assistant", "system"][r.choice(3, p=[0.5, 0.4, 0.1])], f"Text {k % 300}" + "."[: r.integers(2)]) for k in range(1500) for _ in range(r.integers(1, 3))]
    rows = [turn(*x) for x in big] + talk(2, 30, 6)
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, TURNS)
        df = df.where("conv_id is not null or turn is null or turn is not null")
        fixed = repair.Repair(df)
        assert fixed.spans.where("id = 7").count() >= 3
        text = defaultdict(list)
        for x in rows:
            text[x[0]].append((x[1], x[2] if x[2] is not None else " ", x[3] if x[3] is not None else " "))
        got = {x["conv_id"]: tuple(x) for x in repair.with_reports(df, df).collect()}
        assert all(got[c] == reported(c, text[c]) for c in got)
        made = defaultdict(list)
        for x in fixed.repaired().orderBy("part", "place").collect():
            made[x["conv_id"]].append(f"{x['role']}:{x['text']}")
        assert all(hashlib.sha256("\n".join(made[c]).encode()).hexdigest() == got[c][-1] for c in got)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], TURNS)
    assert repair.with_reports(df, repair.damage(df)).count() == 0
    lone = spark.createDataFrame([turn(5, 1, "user", "x.")], TURNS)
    assert [tuple(r) for r in repair.with_reports(lone, lone.limit(0)).collect()] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# --- 13 ------------------------------------------------------------------------------------------------


def without_repeats(rows):
    least = {}
    order = lambda i: -(2**63) if i is None else i
    data = [(i, order(i), (t or "").encode()) for i, t, *_ in rows]
    for _, o, b in data:
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            least[w] = min(o, least.get(w, o))
    out = []
    for i, o, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < o:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept))
    return out


def repeats():
    r = np.random.default_rng(8)
    letters = lambda n, a="abcdefgh é": "".join(r.choice(list(a)) for _ in range(n))
    common, line = letters(400), letters(60)
    out = [letters(r.integers(0, 300)) for _ in range(40)]
    out += [letters(30) + common[r.integers(0, 150) : r.integers(200, 400)] + letters(30) for _ in range(40)]
    out += [f"{line}\n" * 12 + letters(40), f"{line}\n" * 3, "a" * 700, "ab" * 200 + "c" + "a" * 300, "b" + "a" * 49, "a" * 50, None, "", common, common, common + "x", "日本" * 60, "日本" * 30]
    for _ in range(40):  # edited copies
        t = list(common + line + common[::-1])
        for k in r.integers(0, len(t), 5):
            t[k] = "#"
        out.append("".join(t))
    rows = [doc(int(i), t) for i, t in zip(r.permutation(len(out)), out, strict=True)]
    return rows + [rows[41], doc(None, common[:120]), doc(7, common[50:220]), doc(7, line * 2)]


def removed(df):
    return sorted(((*tuple(r)[:4], bytes(r["kept"])) for r in suffixes.remove_repeats(df).collect()), key=repr)


def test_bytes_that_repeat_go(spark, monkeypatch):
    rows = repeats()
    df = spark.createDataFrame(rows, DOCS)
    expected = sorted(without_repeats(rows), key=repr)
    assert sum(r[2] for r in expected) > 10_000
    assert removed(df.repartition(1)) == expected  # one block
    assert removed(df.repartition(9)) == expected  # several, which share passages
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def test_pieces_are_the_same_over_strides(monkeypatch):
    r = np.random.default_rng(2)
    data = [bytes(r.integers(97, 101, n).astype(np.uint8)) for n in (500, 10, 0, 49, 50, 51, 3000)] + [b"a" * 400]
    import zstandard

    args = np.arange(len(data)).tobytes(), np.array([len(x) for x in data], np.int64).tobytes(), zstandard.compress(b"".join(data))
    one = suffixes.Block(*args).cut_up()
    monkeypatch.setattr(suffixes, "STRIDE", 64)
    two = suffixes.Block(*args).cut_up()
    assert one.n.sum() == sum(max(0, len(x) - 49) for x in data)
    assert all((getattr(one, c) == getattr(two, c)).all() for c in ("at", "n", "low", "doc"))


@pytest.mark.parametrize("collide", [False, True])
def test_cells_are_sorted_even_if_hashes_collide(collide):
    r = np.random.default_rng(4)
    raw = r.integers(97, 99, 4000).astype(np.uint8)
    raw[1000:1400] = raw[2000:2400]
    at = np.concatenate([np.arange(k, 3900, 5) for k in range(5)])
    cell = at % 5
    hashes = suffixes.Hashes(raw)
    if collide:
        hashes.sums = np.zeros_like(hashes.sums)  # all stretches look alike
    order, kind = suffixes.sorted_cells(raw, at, cell, 50, hashes)
    data = raw.tobytes()
    cut = lambda k: data[at[k] : at[k] + 50]
    for c in range(5):
        k = [int(i) for i in order if cell[i] == c]
        assert [cut(i) for i in k] == sorted(cut(i) for i in np.flatnonzero(cell == c))
    same = [cell[a] == cell[b] and cut(a) == cut(b) for a, b in zip(order[:-1], order[1:], strict=True)]
    assert same == (kind[1:] == kind[:-1]).tolist() and any(same)


@pytest.mark.parametrize("parts", [1, 3, 1000])
def test_keys_are_counted_in_the_same_time_however_many_blocks_have_them(parts):
    import time

    r = np.random.default_rng(8)
    keys = r.integers(0, 1 << 32, 150_000, dtype=np.uint32)
    keys[:3] = 0, 1, (1 << 32) - 1
    every = r.permutation(np.r_[keys, keys[:50_000], keys[:3]])
    each = [np.zeros(0, np.uint32), *np.array_split(every, parts)]
    start = time.process_time()
    found = suffixes.in_several(each)
    assert time.process_time() - start < 2  # looked up block by block in all that several have, 1,000 took 12 s
    kinds, of, count = np.unique(every, return_inverse=True, return_counts=True)
    assert [len(x) for x in found] == [len(x) for x in each]
    assert (np.concatenate(found) == (count > 1)[of]).all() and 50_000 <= (count > 1).sum() < 60_000
    assert [x.tolist() for x in suffixes.in_several([each[0], each[0]])] == [[], []]


def bucket_of(lines, copies):
    """Pieces of documents that each have one of some lines of 60 bytes before 20 other bytes: (raw, first, n, own)."""
    import zstandard

    r = np.random.default_rng(6)
    m = lines * copies
    raw = r.integers(97, 123, (m, 80), dtype=np.uint8)
    raw[:, :60] = np.repeat(raw[:lines, :60], copies, axis=0)
    raw[5], raw[7, 60:65] = raw[6], raw[8, 60:65]
    ids = r.permutation(m).astype(np.int64)
    b = suffixes.Block(ids.tobytes(), np.full(m, 80).tobytes(), zstandard.compress(raw.tobytes())).cut_up()
    return b.raw, b.at, b.n, ids[b.doc]


@pytest.mark.parametrize("lines", [1, 9])
def test_large_cells_are_cut_and_all_of_their_windows_found(lines, monkeypatch):
    for name in ("TOGETHER", "SORTED", "CELL"):
        monkeypatch.setattr(suffixes, name, 64)
    raw, first, n, own = bucket_of(lines, 150)
    data, least = raw.tobytes(), {}
    at = [(a + k, o) for a, m, o in zip(first.tolist(), n.tolist(), own.tolist(), strict=True) for k in range(m)]
    for a, o in at:
        least[data[a : a + 50]] = min(o, least.get(data[a : a + 50], o))
    expected = sorted(a for a, o in at if least[data[a : a + 50]] < o)
    assert suffixes.repeated(raw, first, n, own).tolist() == expected and len(expected) > lines * 149 * 11


@pytest.mark.parametrize("collide", [False, True])
def test_copies_that_are_sorted_as_one_are_all_found(collide, monkeypatch):
    import zstandard

    monkeypatch.setattr(suffixes, "COPIES", 3)
    monkeypatch.setattr(suffixes, "CELL", 16)
    if collide:
        monkeypatch.setattr(suffixes.Hashes, "whole", lambda self, i: np.zeros(len(i), np.uint64))
    r = np.random.default_rng(9)
    line, other = (r.integers(97, 123, 64, dtype=np.uint8).tobytes() for _ in range(2))
    noise = lambda n: r.integers(97, 123, n, dtype=np.uint8).tobytes()
    texts = [line * k for k in (1, 2, 9)] * 4 + [line * 8 + noise(30) for _ in range(9)] + [noise(9) + line + other * 5 + noise(70) for _ in range(9)]
    ids = r.permutation(len(texts)).astype(np.int64)
    sizes = np.array([len(x) for x in texts], np.int64)
    b = suffixes.Block(ids.tobytes(), sizes.tobytes(), zstandard.compress(b"".join(texts))).cut_up()
    own, data, least = ids[b.doc], b.raw.tobytes(), {}
    at = [(a + k, o) for a, m, o in zip(b.at.tolist(), b.n.tolist(), own.tolist(), strict=True) for k in range(m)]
    for a, o in at:
        least[data[a : a + 50]] = min(o, least.get(data[a : a + 50], o))
    expected = sorted(a for a, o in at if least[data[a : a + 50]] < o)
    assert suffixes.repeated(b.raw, b.at, b.n, own).tolist() == expected and len(expected) > 5000


def test_very_many_copies_of_a_window_are_sorted_as_one(monkeypatch):
    args = bucket_of(1, 3000)
    line = args[0][:60].tobytes()
    sort, seen = suffixes.sorted_cells, []

    def sorted_cells(raw, at, *more):
        data = raw.tobytes()
        seen.extend(a for a in at.tolist() if data[a : a + 50] in line)
        return sort(raw, at, *more)

    monkeypatch.setattr(suffixes, "sorted_cells", sorted_cells)
    assert len(suffixes.repeated(*args)) > 2999 * 11
    assert len(seen) < 50


def test_a_bucket_of_many_repeated_windows_is_sorted_in_parts():
    import tracemalloc

    args = bucket_of(60, 200)
    tracemalloc.start()
    try:
        assert len(suffixes.repeated(*args)) > 60 * 199 * 11
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
    finally:
        tracemalloc.stop()
