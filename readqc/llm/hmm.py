"""Hidden Markov language model over words.

Words are emitted by way of symbols: the ``top`` most frequent training words are symbols of their own, every other word
belongs to one of ``groups`` symbols by a hash of its last three bytes, within which it has its smoothed share of the
training tokens. So the tables of the model are bounded while the vocabulary, counted over all training documents, is not:
it stays a distributed table, and the words of documents that are not among the ``known`` most frequent ones are joined
with it.

Baum-Welch over all training documents, which are stored once as symbols: first a pass in ``warm`` steps, in which each
document takes part once, in one of as many shares of them, and the expected counts of a step are mixed into those of the
steps before (stepwise EM); then ``iterations`` passes in one step. Each step runs scaled forward-backward in blocks of
``block`` words and sums the expected counts of all partitions in Spark. Scoring runs the scaled forward recursion over whole texts, which gives the exact likelihood.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, stored

END = b""
CHUNK = 400_000


class Symbols(dict):
    """Word to symbol; words that are not held go to their group. END is held."""

    def __init__(self, held: dict[bytes, int], first_group: int, groups: int):
        super().__init__(held)
        self.first_group, self.groups = first_group, groups

    def __missing__(self, word: bytes) -> int:
        return self.first_group + zlib.crc32(word[-3:]) % self.groups


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text.lower().split() if text else ()), END]


def training_counts(docs: DataFrame) -> DataFrame:
    """(w, c): how often each token is in docs(b)."""

    def work(batches):
        counts: dict[bytes, int] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["w", "c"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column("b").to_pylist():
                for w in tokens(text):
                    counts[w] = counts.get(w, 0) + 1
                if len(counts) > 400_000:
                    yield flush()
        yield flush()

    return docs.mapInArrow(work, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def _laid(lengths: np.ndarray):
    """Sequences from long to short: (order, starts, active at each step)."""
    order = np.argsort(-lengths, kind="stable")
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
    active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(lengths.max() if len(lengths) else 0), "right")
    return order, starts, active


def forward(flat: np.ndarray, lengths: np.ndarray, start: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each sequence, by the scaled forward recursion; start: (states) or one row a sequence."""
    order, starts, active = _laid(lengths)
    out = np.zeros(len(lengths))
    alpha = np.broadcast_to(start, (len(lengths), a.shape[0]))[order]
    for t, n in enumerate(active):
        alpha = alpha[:n] @ a if t else alpha[:n]
        alpha = alpha * b[flat[starts[:n] + t]]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        out[order[:n]] += np.log(scale)
    return out


def expected(flat, lengths, start, a, b):
    """Expected counts of one E-step: (starts of each sequence, transitions, occupancy of each token)."""
    order, starts, active = _laid(lengths)
    k = a.shape[0]
    alphas, scales = np.empty((len(flat), k)), np.empty(len(flat))
    alpha = start[order]
    for t, n in enumerate(active):
        at = starts[:n] + t
        alpha = (alpha[:n] @ a if t else alpha[:n]) * b[flat[at]]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        alphas[at], scales[at] = alpha, scale
    moves = np.zeros((k, k))
    beta = np.ones((0, k))
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        if len(beta):
            m = len(beta)
            nxt = starts[:m] + t + 1
            ahead = b[flat[nxt]] * beta / scales[nxt][:, None]
            moves += alphas[at[:m]].T @ ahead
            beta = np.concatenate([ahead @ a.T, np.ones((n - m, k))])
        else:
            beta = np.ones((n, k))
        alphas[at] *= beta
    gamma = alphas / alphas.sum(axis=1, keepdims=True)
    first = np.empty((len(lengths), k))
    first[order] = gamma[starts]
    return first, moves * a, gamma


def blocks(rows, block: int):
    """Chunks of (flat symbols, lengths of the blocks, which blocks begin a text); rows: the symbols of each text, at least one."""
    flat, lengths, heads, held = [], [], [], 0
    for row in rows:
        more, rest = divmod(len(row), block)
        flat.append(row)
        lengths += [block] * more + [rest] * (rest > 0)
        heads += [True] + [False] * (more + (rest > 0) - 1)
        held += len(row)
        if held > CHUNK:
            yield np.concatenate(flat).astype(np.int32), np.array(lengths), np.array(heads)
            flat, lengths, heads, held = [], [], [], 0
    if flat:
        yield np.concatenate(flat).astype(np.int32), np.array(lengths), np.array(heads)


class Model:
    """start, middle (of later blocks): states; a: states x states; b: symbols x states."""

    def __init__(self, start, middle, a, b):
        self.start, self.middle, self.a, self.b = start, middle, a, b

    @classmethod
    def random(cls, share: np.ndarray, states: int, seed: int):
        rng = np.random.default_rng(seed)
        b = share[:, None] * rng.gamma(2.0, 0.5, (len(share), states))
        a = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
        return cls(np.full(states, 1 / states), np.full(states, 1 / states), a / a.sum(axis=1, keepdims=True), b / b.sum(axis=0))

    def counts(self, flat, lengths, heads):
        """One row a symbol, then transitions and the two kinds of starts."""
        s = len(self.b)
        start = np.where(heads[:, None], self.start, self.middle)
        first, moves, gamma = expected(flat, lengths, start, self.a, self.b)
        emitted = np.stack([np.bincount(flat, weights=gamma[:, j], minlength=s) for j in range(self.a.shape[0])], 1)
        return np.concatenate([emitted, moves, first[heads].sum(axis=0, keepdims=True), first[~heads].sum(axis=0, keepdims=True)])

    def step(self, counts: np.ndarray, share: np.ndarray, weight: float = 20.0):
        """The model that the counts give, smoothed towards the share of each symbol."""
        s, k = self.b.shape
        emitted, moves, start, middle = counts[:s], counts[s : s + k], counts[s + k], counts[s + k + 1]
        b = (emitted + weight * share[:, None]) / (emitted.sum(axis=0) + weight)
        a = (moves + 1.0) / (moves.sum(axis=1, keepdims=True) + k)
        return Model((start + 0.1) / (start.sum() + 0.1 * k), (middle + 0.1) / (middle.sum() + 0.1 * k), a, b)


def score(docs: DataFrame, folds: int = 10, held: int = 0, states: int = 6, top: int = 8192, groups: int = 512, known: int = 65_536, iterations: int = 2, sample: int = 600, sample_bytes: int = 200_000, warm: int = 10, block: int = 256, seed: int = 3) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learns from the rows with crc32(doc_id as text) % folds != held; rows without id are learned from. A null or wordless
    text is its end token alone. Without training rows N = V = 0 and every token is unknown. Repeated rows count as often
    as they are there; other columns are ignored. ``sample`` and ``sample_bytes`` have no effect any more: nothing is learnt
    from a sample.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", (remainder(F.col("doc_id"), folds) == held).alias("held_out"), F.col("text").cast("binary").alias("b"))
    train = rows.filter("NOT held_out").select("b", "doc_id")
    counts = stored(training_counts(train.select("b")), "counts")
    total, vocabulary = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # Words from a level of counts up, of which there are at most ``known``; a level is an eighth of a power of two.
    level = F.floor(F.log2(F.col("c").cast("double")) * 8)
    least, held_so_far = 1 << 20, 0
    for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect():
        held_so_far += r.n
        if held_so_far > known:
            break
        least = r.level
    frequent = sorted(((bytes(r.w), r.c) for r in counts.filter(level >= least).collect()), key=lambda x: (-x[1], x[0]))
    by_group = counts.groupBy(F.when(F.col("w") == F.lit(bytearray(END)), -1).otherwise(F.crc32(F.expr("substring(w, -3, 3)")) % groups).alias("g")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
    held_words = {END: 0} | {w: i + 1 for i, (w, _) in enumerate([x for x in frequent if x[0] != END][: top - 1])}
    counted = dict(frequent)
    counted.setdefault(END, 0)
    first_group = len(held_words)
    mass, kinds = np.zeros(groups), np.zeros(groups)
    for r in by_group:
        if r.g >= 0:
            mass[r.g], kinds[r.g] = r.c, r.v
    for w in held_words:
        if w != END:
            g = zlib.crc32(w[-3:]) % groups
            mass[g] -= counted[w]
            kinds[g] -= 1
    inside = mass + 0.1 * (kinds + 1)
    share = np.concatenate([[counted[w] + 0.1 for w in held_words], inside])
    share /= share.sum()

    symbols = Symbols(held_words, first_group, groups)
    model = Model.random(share, states, seed)
    if total:
        steps = max(1, warm)
        encoded = stored(_encoded(train.select("b", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "b"), F.lit(steps)).cast("int").alias("step")), spark.sparkContext.broadcast(symbols)), "symbols", by="step")
        mixed = None
        for i in range(warm):
            found = _full_counts(encoded.filter(F.col("step") == i), spark.sparkContext.broadcast((model, block)))
            if size := found[: len(share)].sum():
                found *= total / size
                mixed = found if mixed is None else mixed + (i + 1.0) ** -0.7 * (found - mixed)
                model = model.step(mixed, share)
        for _ in range(iterations):
            model = model.step(_full_counts(encoded, spark.sparkContext.broadcast((model, block))), share)

    shared = spark.sparkContext.broadcast((model, symbols, counted, math.log10(total + 0.1 * (vocabulary + 1)), np.log10(inside)))
    scored = rows.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(_scorer(shared), "_row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<w:binary,n:int,inside:double>>")
    scored = stored(scored, "scored")
    rare = scored.select("_row", F.explode("rare").alias("r")).select("_row", "r.*").join(counts, "w", "left")
    c = F.coalesce("c", F.lit(0))
    log = F.log10(c + F.lit(0.1)) * F.col("n")
    rare = rare.groupBy("_row").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("_known"), F.sum(log).alias("_log"), F.sum(log - F.col("inside") * F.col("n")).alias("_in"), F.sum("n").alias("_n"))
    out = scored.drop("rare").join(rare, "_row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("_known")).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero("_log")).alias("base_score"), (F.col("score") + zero("_in")).alias("score"),
    )


def _encoded(train: DataFrame, shared) -> DataFrame:
    """(s, step): the symbols of each text, as numbers of four bytes."""

    def work(batches):
        symbols = shared.value
        for batch in batches:
            made = [np.array(list(map(symbols.__getitem__, tokens(text))), "<i4").tobytes() for text in batch.column("b").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), batch.column("step")], names=["s", "step"])

    return train.mapInArrow(work, "s binary, step int")


def _full_counts(train: DataFrame, shared) -> np.ndarray:
    """The expected counts of encoded documents, summed over the partitions by symbol."""
    model, _ = shared.value
    size, k = len(model.b) + model.a.shape[0] + 2, model.a.shape[0]

    def work(batches):
        model, block = shared.value
        sums = np.zeros((size, k))
        for batch in batches:
            for part in blocks([np.frombuffer(x, "<i4") for x in batch.column("s").to_pylist()], block):
                sums += model.counts(*part)
        at = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(sums[at, j]) for j in range(k))], names=["i", *(f"s{j}" for j in range(k))])

    found = train.select("s").mapInArrow(work, ", ".join(["i int", *(f"s{j} double" for j in range(k))])).groupBy("i").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(k)]).toPandas()
    out = np.zeros((size, k))
    out[found["i"].to_numpy()] = found.drop(columns="i").to_numpy()
    return out


def _scorer(shared):
    def work(batches):
        model, symbols, counted, log_all, log_inside = shared.value
        first = symbols.first_group
        cache: dict[bytes, tuple] = {}

        def of(w: bytes):
            if (got := cache.get(w)) is None:
                s, c = symbols[w], counted.get(w)
                inside = log_inside[s - first] if s >= first else 0.0
                got = (s, -1.0 if c is None else math.log10(c + 0.1), int(bool(c)), inside)
                if c is not None:
                    cache[w] = got
            return got

        def made(ids, outs, texts):
            """One batch of rows for some texts."""
            n = len(texts)
            n_tokens, n_known, base, inner = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            flat, offsets, rare_w, rare_n, rare_in = [], [0], [], [], []
            for i, text in enumerate(texts):
                words = tokens(text)
                n_tokens[i] = len(words)
                more: dict[bytes, list] = {}
                known, b, part = 0, 0.0, 0.0
                for w in words:
                    s, log, hit, inside = of(w)
                    flat.append(s)
                    if log == -1.0 and w not in counted:
                        if w in more:
                            more[w][0] += 1
                        else:
                            more[w] = [1, inside]
                    else:
                        known += hit
                        b += log
                        if s >= first:
                            part += log - inside
                n_known[i], base[i], inner[i] = known, b - len(words) * log_all, part
                rare_w += more
                rare_n += [x[0] for x in more.values()]
                rare_in += [x[1] for x in more.values()]
                offsets.append(len(rare_w))
            score = inner + forward(np.array(flat, np.int32), n_tokens, model.start, model.a, model.b) / math.log(10)
            rare = pa.StructArray.from_arrays([pa.array(rare_w, pa.binary()), pa.array(rare_n, pa.int32()), pa.array(rare_in, pa.float64())], names=["w", "n", "inside"])
            return pa.RecordBatch.from_arrays(
                [*ids, outs, pa.array(n_tokens), pa.array(n_known), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rare)],
                names=["_row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"],
            )

        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                hi, size = lo, 0
                while hi < batch.num_rows and (hi == lo or size < 4 * CHUNK):
                    size += len(batch.column("b")[hi].as_py() or b"")
                    hi += 1
                part = batch.slice(lo, hi - lo)
                yield made([part.column("_row"), part.column("doc_id").cast(pa.int64())], part.column("held_out"), part.column("b").to_pylist())
                lo = hi

    return work
