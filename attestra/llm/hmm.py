"""LM scoring with a hidden Markov model over word classes.

The most frequent words are classes of their own, and all others, unseen ones included, share
classes by their ending. The chance of a text is that of its classes under a hidden Markov model,
times each word's chance within its class by its exact corpus count. Baum-Welch counts come from
all training texts: each task sums them for what it reads, Spark adds them up by class, and what
comes to the driver is one row a class. Scores are exact sequence likelihoods by the scaled
forward recursion over whole texts.

Texts are read once, into blocks that hold each word as a number in the block's own vocabulary.
Corpus counts by word are a distributed table; blocks and counts meet in a join with one row for
each word and block, not for each token.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, doc_columns, real_id
from .substrings import split_words

#: Words that are classes of their own, classes by ending, hidden states, rounds over all texts.
OWN, ENDINGS, STATES, ROUNDS = 2000, 2000, 6, 3
#: Hashes of blocks are taken modulo this.
SPAN = 1_000_000_007
#: The first guess learns moves and words from at most FIRST stretches of at most STRETCH tokens, in so many rounds.
STRETCH, FIRST, FIRST_ROUNDS = 64, 4000, 12
#: Tokens whose forward vectors are held at once; of longer runs they are computed anew from kept ones.
HELD = 700_000
#: Tokens of a block, the counts' smoothing.
BLOCK, ALPHA = 1_500_000, 0.1
#: Stands for the end of a text among words, none of which is empty.
END = ""


def pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(z: bytes, *kinds: tuple) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(z), 0, []
    for dtype, n in kinds:
        out.append(np.frombuffer(raw, dtype, n, at))
        at += n * np.dtype(dtype).itemsize
    return out


def one_by_one(batches):
    """The rows of Arrow batches. A batch may hold many blocks, so each is taken out of it alone."""
    for b in batches:
        for k in range(b.num_rows):
            yield from b.slice(k, 1).to_pylist()


def blocks_of(docs: DataFrame) -> DataFrame:
    """(block, n, tokens, kinds, docs, seq, words) from (id, text, held): packed ids, folds and lengths of
    n texts, their tokens as numbers of the block's words, and these with their counts in training texts."""

    def flush(ids, held, texts, block):
        text = pa.chunked_array(texts).combine_chunks() if len(texts) > 1 else texts[0]
        lowered = pa.array([t.encode().lower().decode() for t in text.to_pylist()], pa.string())
        words, counts = split_words(lowered)
        d = words.dictionary_encode()
        code = d.indices.to_numpy(zero_copy_only=False)
        lens = counts + 1
        ends = np.cumsum(lens) - 1
        seq = np.full(int(lens.sum()), len(d.dictionary), np.uint32)
        seq[np.delete(np.arange(len(seq)), ends)] = code
        train = np.repeat(~held, lens)
        c = np.bincount(seq[train], minlength=len(d.dictionary) + 1)
        words = "\n".join([*d.dictionary.to_pylist(), END]).encode()
        return (block, len(ids), len(seq), len(c), pack(ids, held, lens.astype(np.int32)), pack(seq), pack(c, np.frombuffer(words, np.uint8)))

    def run(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        ids, held, texts, size = [], [], [], 0

        def out():
            row = flush(np.concatenate(ids), np.concatenate(held), texts, (part << 32) + n)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], ["block", "n", "tokens", "kinds", "docs", "seq", "words"])

        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                b = batch.slice(k, 1000)
                ids.append(b.column("id").to_numpy())
                held.append(b.column("held").to_numpy(zero_copy_only=False))
                texts.append(b.column("text"))
                size += b.column("text").nbytes // 6
                if size >= BLOCK:
                    yield out()
                    ids, held, texts, size, n = [], [], [], 0, n + 1
        if ids:
            yield out()

    return docs.mapInArrow(run, "block long, n int, tokens long, kinds long, docs binary, seq binary, words binary")


def vocabularies(blocks: DataFrame) -> DataFrame:
    """(block, i, word, c): the i-th word of a block and how often its training texts have it."""

    def run(batches):
        import zstandard

        for row in one_by_one(batches):
            block, k = row["block"], row["kinds"]
            raw = zstandard.ZstdDecompressor().decompress(row["words"])
            words = pa.array(raw[8 * k :].decode().split("\n"), pa.string())
            counts = pa.array(np.frombuffer(raw, np.int64, k))
            whole = pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), pa.array(np.arange(k)), words, counts], ["block", "i", "word", "c"])
            for a in range(0, k, 50_000):
                yield whole.slice(a, 50_000)

    return blocks.select("block", "kinds", "words").mapInArrow(run, "block long, i long, word string, c long")


def with_classes(blocks: DataFrame, entries: DataFrame, counts: DataFrame, within: np.ndarray, seen: int, kinds: int) -> DataFrame:
    """(block, n, tokens, docs, seq, sums): seq now holds classes; sums, of each text, the known
    tokens, the unigram log10 and the log10 of the words within their classes."""
    looked = entries.select("block", "i", "word").join(counts.select("word", "c", "class"), "word").select(F.col("block").alias("b"), "i", "c", "class")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.select(["block", "n", "tokens", "docs", "seq"]).append_column("sums", pa.array([], pa.binary()))
        i, c, cls = (right.column(x).to_numpy() for x in ("i", "c", "class"))
        count, classes = np.empty(len(i)), np.empty(len(i), np.uint16)
        count[i], classes[i] = c, cls
        base = np.log10((count + ALPHA) / (seen + ALPHA * (kinds + 1)))
        own = np.where(within[0][classes] < 0, 0.0, np.log10((count + ALPHA) / np.maximum(within[0][classes] + ALPHA * (within[1][classes] + 1), ALPHA)))
        n, tokens = left.column("n")[0].as_py(), left.column("tokens")[0].as_py()
        _, _, lens = unpack(left.column("docs")[0].as_py(), (np.int64, n), (bool, n), (np.int32, n))
        (seq,) = unpack(left.column("seq")[0].as_py(), (np.uint32, tokens))
        at = np.cumsum(lens) - lens
        sums = [np.add.reduceat(v[seq], at) for v in ((count > 0).astype(float), base, own)]
        return pa.table({"block": left.column("block"), "n": left.column("n"), "tokens": left.column("tokens"), "docs": left.column("docs"), "seq": pa.array([pack(classes[seq])], pa.binary()), "sums": pa.array([pack(*sums)], pa.binary())})

    return blocks.select("block", "n", "tokens", "docs", "seq").groupBy("block").cogroup(looked.groupBy("b")).applyInArrow(meet, "block long, n int, tokens long, docs binary, seq binary, sums binary")


def stretches(seq: np.ndarray, lens: np.ndarray, most: int) -> list[np.ndarray]:
    """At most `most` pieces of at most STRETCH tokens of the texts, spread evenly."""
    at, parts = np.cumsum(lens) - lens, -(-lens // STRETCH)
    ends = np.cumsum(parts)
    total = int(ends[-1]) if len(ends) else 0
    out = []
    for i in np.linspace(0, total - 1, min(most, total)).astype(int) if total else ():
        text = int(np.searchsorted(ends, i, side="right"))
        k = i - (ends[text] - parts[text])
        out.append(seq[at[text] + k * STRETCH : at[text] + min((k + 1) * STRETCH, lens[text])])
    return out


class Model:
    """start (K), move (K, K) and emit (classes, K) of a hidden Markov model."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def guess(freq: np.ndarray, k: int) -> Model:
        rng = np.random.default_rng(0)
        emit = freq[:, None] * rng.uniform(0.5, 1.5, (len(freq), k))
        move = np.full((k, k), 0.3 / k) + np.eye(k) * 0.7
        return Model(np.full(k, 1 / k), move, emit / emit.sum(0))

    @staticmethod
    def of_counts(start, move, emit, freq) -> Model:
        """From expected counts, smoothed so that nothing is impossible."""
        start, move = start + 0.1, move + 0.1
        emit = emit + 0.1 * freq[:, None] * len(freq)
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def expected(self, seq: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch counts of whole texts: starts, moves and emissions. Texts go side by side, the longest
        first; forward vectors of more than HELD tokens are kept at some steps only and made anew from there."""
        k = len(self.start)
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros(self.emit.shape)
        order = np.argsort(-lens, kind="stable")
        at, n = (np.cumsum(lens) - lens)[order], lens[order]
        longest = int(n[0]) if len(n) else 0
        live = np.searchsorted(-n, -np.arange(longest), side="left")  # texts longer than t

        def forward(v, a, z):
            """Steps a to z from v, the vectors of the step before: classes, scaled vectors and scales."""
            for t in range(a, z):
                m = live[t]
                x = seq[at[:m] + t]
                v = (np.broadcast_to(self.start, (m, k)) if t == 0 else v[:m] @ self.move) * self.emit[x]
                scale = v.sum(1, keepdims=True)
                v = v / scale
                yield x, v, scale

        cuts, held = [0], 0
        for t in range(longest):
            if held and held + live[t] > HELD:
                cuts.append(t)
                held = 0
            held += int(live[t])
        opens = [None]
        for a, z in zip(cuts, cuts[1:], strict=False):
            v = opens[-1]
            for _, v, _ in forward(v, a, z):  # noqa: B007
                pass
            opens.append(v)
        b = None  # what the step after says of each state that a text can move to
        for a, z, v in zip(reversed(cuts), reversed([*cuts[1:], longest]), reversed(opens), strict=True):
            steps = list(forward(v, a, z))
            xs, gammas = [], []
            while steps:
                x, v, scale = steps.pop()
                after = np.ones_like(v)
                if b is not None:
                    move += v[: len(b)].T @ b
                    after[: len(b)] = b @ self.move.T
                gamma = v * after
                xs.append(x)
                gammas.append(gamma)
                b = after * self.emit[x] / scale
            if a == 0 and gammas:
                start = gammas[-1].sum(0)
            if xs:
                x, gamma = np.concatenate(xs), np.concatenate(gammas)
                for j in range(k):
                    emit[:, j] += np.bincount(x, gamma[:, j], len(emit))
        return start, move * self.move, emit

    def log10(self, seq: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The log10 likelihood of each whole text, by the scaled forward recursion."""
        order = np.argsort(-lens, kind="stable")
        at, n = (np.cumsum(lens) - lens)[order], lens[order]
        total = np.zeros(len(lens))
        live = np.searchsorted(-n, -np.arange(int(n[0])), side="left") if len(n) else []
        v = None
        for t, m in enumerate(live):
            v = (np.broadcast_to(self.start, (m, len(self.start))) if t == 0 else v[:m] @ self.move) * self.emit[seq[at[:m] + t]]
            s = v.sum(1, keepdims=True)
            v = v / s
            total[:m] += np.log10(s[:, 0])
        out = np.empty(len(lens))
        out[order] = total
        return out


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, fold: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs (doc_id, text).

    Rows whose crc32 of doc_id modulo fold is 0 are scored but not learned from. Tokens are the lower-cased
    words and one end; a null or empty text is the end alone; a null doc_id stays null and is learned from; repeated
    rows each count and each come back; an empty table gives an empty result; with nothing to
    learn from all words are unknown. Other columns of docs are not looked at.
    """
    held = F.coalesce(F.pmod(F.crc32(real_id("id").cast("string").cast("binary")), F.lit(fold)) == 0, F.lit(False))
    blocks = cut(blocks_of(doc_columns(docs).select("id", "text", held.alias("held"))))
    entries = vocabularies(blocks)
    counts = cut(entries.groupBy("word").agg(F.sum("c").alias("c")))
    tokens = counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    often = counts.where(F.col("c") >= max(1, tokens // (OWN * 20))).collect()  # 20 * OWN words can be as frequent, or all if there are fewer tokens
    own = [w for _, w in sorted((-r["c"], r["word"]) for r in often)[:OWN]]
    spark = blocks.sparkSession
    named = spark.createDataFrame([(w, i) for i, w in enumerate(own)], "word string, own int")
    ending = F.lit(OWN) + F.pmod(F.xxhash64(F.substring("word", -3, 3), F.least(F.length("word"), F.lit(12))), F.lit(ENDINGS)).cast("int")
    counts = counts.join(F.broadcast(named), "word", "left").select("word", "c", F.coalesce("own", ending).alias("class"))  # OWN words at most
    total = counts.groupBy("class").agg(F.sum("c"), F.count_if(F.col("c") > 0)).collect()  # OWN + ENDINGS rows at most
    within = np.zeros((2, OWN + ENDINGS))
    for cls, c, v in total:
        within[:, cls] = c, v
    seen, kinds = int(within[0].sum()), int(within[1].sum())
    freq = (within[0] + ALPHA * (within[1] + 1)) / (seen + ALPHA * (kinds + OWN + ENDINGS))
    inner = within.copy()
    inner[0, : len(own)] = -1  # a word of its own class is certain within it
    coded = cut(with_classes(blocks, entries, counts, inner, seen, kinds))

    def texts(row):
        n, tokens = row["n"], row["tokens"]
        ids, away, lens = unpack(row["docs"], (np.int64, n), (bool, n), (np.int32, n))
        (seq,) = unpack(row["seq"], (np.uint16, tokens))
        return ids, away, lens, seq

    # Of many blocks some are drawn by the hash of their ids, so that the driver gets some FIRST stretches, however many there are.
    blocks_left = coded.count()
    drawn = coded.where(F.pmod(F.xxhash64("docs"), F.lit(SPAN)) < int(SPAN * min(1.0, FIRST / max(1, blocks_left))))
    each = -(-FIRST // max(1, min(FIRST, blocks_left)))

    def learned(row):
        _, away, lens, seq = texts(row)
        return seq[np.repeat(~away, lens)], lens[~away]

    def some(batches):
        for row in one_by_one(batches):
            found = stretches(*learned(row), each)
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.uint16).tobytes() for x in found], pa.binary())], ["x"])

    first = sorted((np.frombuffer(r[0], np.uint16) for r in drawn.mapInArrow(some, "x binary").collect()), key=lambda s: (-len(s), s.tobytes()))[: 2 * FIRST]
    model = Model.guess(freq, states)
    if first:
        x, n = np.concatenate(first), np.array([len(s) for s in first])
        for _ in range(FIRST_ROUNDS):
            _, move, emit = model.expected(x, n)
            model = Model.of_counts(np.zeros(states), move, emit, freq)  # where texts start, whole texts tell
    for _ in range(rounds if first else 0):

        def step(batches, model=model):
            start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((len(freq), states))
            for row in one_by_one(batches):
                for part, more in zip((start, move, emit), model.expected(*learned(row)), strict=True):
                    part += more
            all_rows = np.vstack([emit, start[None], move])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(all_rows))), *(pa.array(all_rows[:, j]) for j in range(states))], ["class", *(f"s{j}" for j in range(states))])

        partial = coded.mapInArrow(step, "class long, " + ", ".join(f"s{j} double" for j in range(states)))
        summed = np.zeros((len(freq) + 1 + states, states))
        for r in partial.groupBy("class").agg(*[F.sum(f"s{j}") for j in range(states)]).collect():
            summed[r[0]] = r[1:]
        model = Model.of_counts(summed[len(freq)], summed[len(freq) + 1 :], summed[: len(freq)], freq)

    def final(batches):
        for row in one_by_one(batches):
            ids, away, lens, seq = texts(row)
            known, base, inside = unpack(row["sums"], *[(np.float64, len(ids))] * 3)
            cols = (ids, away, lens.astype(np.int64), known.astype(np.int64), base, model.log10(seq, lens) + inside)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    out = coded.mapInArrow(final, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(real_id("id").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(seen).cast("long").alias("train_tokens"), "base_score", "score")
