"""Toxicity by weak supervision.

Voters are lexicon words and word-beginning patterns mined from labelled rows, plus three patterns over them (any hit, at
least two different hits, no hit) and, as one more voter that mostly abstains, the given label. Every text that is not held
out is voted on, labelled or not. A generative label model estimates by EM over all of these texts how often each voter
votes on toxic and on other texts, and how voters correlate within a class; correlated voters share their say. Its
posterior labels of all these texts train a linear classifier over the mined features, which scores every text.

Features are mined in at most ``max_labelled`` labelled rows (a documented bound; all of them below it). All else covers all
rows: one pass finds the features of each text; what the label model and the classifier need are sums over distinct
sets of features with their numbers, added up in tasks and then in a tree, so the driver gets matrices of at most
``features`` squared numbers a round. Scoring reads the sets, not the texts again.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, remainder, stored

_WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)


def word_set(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(text: str | None) -> set[str]:
    """Words, beginnings written with a final *, and the patterns #shout (mostly capitals) and #bang (many !!)."""
    words = word_set(text)
    found = words | {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) > n}
    if text:
        if sum(map(str.isupper, words_raw := text.split())) * 2 > len(words_raw):
            found.add("#shout")
        if text.count("!!") * 40 > len(text):
            found.add("#bang")
    return found


class LabelModel(NamedTuple):
    """What the voters are worth.

    prior: share of toxic texts; rate: (voters, 2), how often each votes on classes 0 and 1; say: share of its evidence that
    a voter keeps; given: (2, 2), how often a label 0 or 1 (row) is given in classes 0 and 1.
    """

    prior: float
    rate: np.ndarray
    say: np.ndarray
    given: np.ndarray

    def posterior(self, votes: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Probability of class 1; y: the given labels, -1 where there is none."""
        r = np.clip(self.rate, 1e-6, 1 - 1e-6)
        hit, miss = np.log(r[:, 1] / r[:, 0]) * self.say, np.log((1 - r[:, 1]) / (1 - r[:, 0])) * self.say
        given = np.append(np.log(self.given[:, 1] / self.given[:, 0]), 0.0)  # the last one for no label
        return _sigmoid(np.log(self.prior / (1 - self.prior)) + given[y] + votes @ hit + (1 - votes) @ miss)

    @staticmethod
    def sums(votes: np.ndarray, y: np.ndarray, n: np.ndarray, post: np.ndarray) -> np.ndarray:
        """What estimate() needs of n copies each of some rows; sums of parts add up."""
        u = np.concatenate([votes, np.ones((len(votes), 1))], axis=1)
        both = u.T @ (n[:, None] * u)
        labels = [n @ ((y == label) * p) for label in (0, 1) for p in (1 - post, post)]
        return np.concatenate([both.ravel(), (n * post) @ u, [n @ (post * post)], labels])

    @classmethod
    def estimate(cls, sums: np.ndarray, voters: int, trust: float = 0.98, weight: float = 50.0) -> LabelModel:
        """The model that the sums give. Labels start from being right with probability ``trust``, which counts as much as ``weight`` labels of each kind."""
        size = (voters + 1) ** 2
        both, mixed, square, labels = sums[:size].reshape(voters + 1, -1), sums[size : size + voters + 1], sums[size + voters + 1], sums[-4:].reshape(2, 2)
        n, n1 = both[-1, -1], mixed[-1]
        on, off = mixed[:-1], both[-1, :-1] - mixed[:-1]
        r0, r1 = (off + 0.5) / (n - n1 + 1), (on + 0.5) / (n1 + 1)
        # Sum of outer products of votes less what is expected of them: (v - m)(v - m)' with m = post * r1 + (1 - post) * r0.
        cross = np.outer(on, r1) + np.outer(off, r0)
        expected = square * np.outer(r1, r1) + (n1 - square) * (np.outer(r1, r0) + np.outer(r0, r1)) + (n - 2 * n1 + square) * np.outer(r0, r0)
        rest = both[:-1, :-1] - cross - cross.T + expected
        scale = np.sqrt(np.maximum(np.diag(rest) / n, 0)) + 1e-9
        corr = np.clip(rest / n / np.outer(scale, scale), 0, 1)
        given = labels + weight * np.array([[trust, 1 - trust], [1 - trust, trust]])
        return cls(float(np.clip(n1 / n, 1e-4, 1 - 1e-4)), np.stack([r0, r1], 1), 1 / np.maximum(corr.sum(axis=1), 1), given / given.sum(axis=0))


class Linear(NamedTuple):
    """A linear classifier over features."""

    weights: np.ndarray
    bias: float

    def sums(self, x: np.ndarray, post: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Number of rows, log loss against posterior labels, its gradient and curvature (upper rows by weight, last the bias); sums of parts add up."""
        x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
        z = x @ np.append(self.weights, self.bias)
        p = _sigmoid(z)
        loss = n @ (np.logaddexp(0, z) - post * z)
        return np.concatenate([[n.sum(), loss], (n * (p - post)) @ x, (x.T @ ((n * p * (1 - p))[:, None] * x)).ravel()])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_linear(sums: Callable[[Linear], np.ndarray], size: int, prior: float, ridge: float = 1e-4, rounds: int = 30) -> Linear:
    """The classifier of least mean log loss plus ridge / 2 times the squared weights, by Newton steps, halved where the loss would grow. sums(classifier): Linear.sums of all rows."""
    keep = ridge * np.append(np.ones(size), 0.0)
    w, step, best = np.append(np.zeros(size), np.log(prior / (1 - prior))), np.zeros(size + 1), np.inf
    for _ in range(rounds):
        new = w + step
        s = sums(Linear(new[:-1], float(new[-1])))
        loss = s[1] / s[0] + keep @ (new * new) / 2
        if loss > best + 1e-12:
            step = step / 2
            continue
        w, best = new, loss
        slope = s[2 : size + 3] / s[0] + keep * w
        curve = s[size + 3 :].reshape(size + 1, -1) / s[0] + np.diag(keep + 1e-12)
        step = -np.linalg.solve(curve, slope)
        if -(slope @ step) < 1e-14:
            break
    return Linear(w[:-1], float(w[-1]))


class Sets(NamedTuple):
    """A block of the table of feature sets: x (rows, features) of 0 and 1, given labels, number of texts."""

    x: np.ndarray
    y: np.ndarray
    n: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch, size: int) -> Sets:
        found = batch.column("found")
        x = np.zeros((batch.num_rows, size))
        x[np.repeat(np.arange(batch.num_rows), found.value_lengths().to_numpy()), found.flatten().to_numpy()] = 1
        return Sets(x, batch.column("y").to_numpy(), batch.column("n").to_numpy().astype(float))

    def votes(self, lexicon: np.ndarray) -> np.ndarray:
        hits = self.x[:, lexicon]
        count = hits.sum(axis=1)
        return np.concatenate([hits, np.stack([count >= 1, count >= 2, count == 0], 1)], axis=1)


def _summed(sets: DataFrame, size: int, part: Callable[[Sets], np.ndarray]) -> np.ndarray:
    """part(block) of all blocks of the table of feature sets, added up: within a task first, then over tasks in a tree."""

    def work(batches):
        total = None
        for batch in pieces(batches, 2048):
            if batch.num_rows:
                now = part(Sets.of(batch, size))
                total = now if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["part"])

    add = lambda a, b: b if a is None else a if b is None else a + b
    return sets.mapInArrow(work, "part binary").rdd.treeAggregate(None, lambda a, r: add(a, pickle.loads(r.part)), add)


def mined(labelled: DataFrame, n1: int, n0: int, features: int, least: int) -> dict[str, int]:
    """Features of labelled(text, y), a bounded table, that tell toxic rows best, with their numbers."""

    def mine(batches):
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                for f in features_of(text):
                    counts.setdefault(f, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], names=["f", "pos", "neg"])

    counts = labelled.mapInArrow(mine, "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    p, q = (F.col("pos") + 0.5) / (n1 + 1), (F.col("neg") + 0.5) / (n0 + 1)
    gain = F.col("pos") * F.log(p / q)
    best = counts.filter(F.col("pos") >= least).filter(p > q * 5).orderBy(F.desc(gain), "f").limit(features).collect()
    return {r.f: i for i, r in enumerate(best)}


def covering(x: np.ndarray, y: np.ndarray, n: np.ndarray, voters: int, least: int) -> np.ndarray:
    """The features that together cover most toxic rows, a row of class 0 counting against them four times."""
    lexicon = np.zeros(0, int)
    left, open_rows = set(range(x.shape[1])), y == 1
    wrong = 4 * ((y == 0) * n) @ x
    while len(lexicon) < voters and left and open_rows.any():
        order = sorted(left)
        cover = (open_rows * n) @ x[:, order] - wrong[order]
        if cover.max() < least:
            break
        pick = order[int(cover.argmax())]
        lexicon, open_rows = np.append(lexicon, pick), open_rows & (x[:, pick] == 0)
        left.discard(pick)
    return lexicon


def train(sets: DataFrame, size: int, voters: int = 48, least: int = 4, rounds: int = 12) -> Linear:
    """The classifier learned from all rows of sets(found, y, n): distinct sets of feature numbers below size, label (-1: none), number of texts. There are rows with label 0 and with label 1."""
    if not size:
        total = {r.y: r.n for r in sets.filter("y >= 0").groupBy("y").agg(F.sum("n").alias("n")).collect()}
        return Linear(np.zeros(0), float(np.log(total[1] / total[0])))
    labelled = Sets.of(pa.Table.from_batches(sets.filter("y >= 0").toArrow().to_batches()).combine_chunks().to_batches()[0], size)  # at most max_labelled rows
    lexicon = covering(*labelled, voters, least)
    count = len(lexicon) + 3
    model = LabelModel.estimate(LabelModel.sums(labelled.votes(lexicon), labelled.y, labelled.n, labelled.y.astype(float)), count)
    for _ in range(rounds):

        def part(block, model=model):
            votes = block.votes(lexicon)
            return LabelModel.sums(votes, block.y, block.n, model.posterior(votes, block.y))

        model = LabelModel.estimate(_summed(sets, size, part), count)

    def sums(linear):
        return _summed(sets, size, lambda block: linear.sums(block.x, model.posterior(block.votes(lexicon), block.y), block.n))

    return fit_linear(sums, size, model.prior)


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, max_labelled: int = 20_000, seed: int = 9, features: int = 320, least: int = 4, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Labels of ids with crc32(id as text) % folds == held, null labels and labels of unknown ids are not used, nor are the
    texts of these ids learned from; an id with several labels counts as toxic if one is 1. Of more than ``max_labelled``
    labelled ids the others' texts count as texts without label. Null and empty texts score as texts without hits. Without
    labels of both classes the score is 0 everywhere. Rows without id are scored, not held out, and have no label. Rows that
    share a labelled id all have its label. Other columns are ignored.
    """
    out = remainder(F.col("doc_id"), folds) == held
    used = labels.filter((remainder(F.col("doc_id"), folds) != held) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    used = used.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("y")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_labelled)
    used = F.broadcast(stored(used, "labels"))  # at most max_labelled rows of two numbers
    rows = docs.select("doc_id", out.alias("held_out"), "text")
    labelled = stored(rows.join(used, "doc_id").select("text", "y"), "labelled")
    sizes = dict(labelled.groupBy("y").count().collect())
    if not sizes.get(0) or not sizes.get(1):
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(mined(labelled, sizes[1], sizes[0], features, least))

    def hits(batches):
        number = shared.value
        for batch in batches:
            found = [sorted(number[f] for f in features_of(t) & number.keys()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), batch.column("y"), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "held_out", "y", "found"])

    met = rows.join(used, "doc_id", "left").select("doc_id", "held_out", F.coalesce("y", F.lit(-1)).alias("y"), "text")
    met = stored(met.mapInArrow(hits, "doc_id long, held_out boolean, y int, found array<int>"), "hits")
    sets = stored(met.filter("NOT held_out").groupBy("found", "y").agg(F.count(F.lit(1)).alias("n")), "sets")
    linear = train(sets, len(shared.value), least=least, **options)
    weights = F.array(*map(F.lit, linear.weights.tolist())).cast("array<double>")
    z = F.aggregate("found", F.lit(linear.bias), lambda total, i: total + F.element_at(weights, i + 1))
    s = 1 / (1 + F.exp(-z))
    return met.select("doc_id", "held_out", s.alias("score"), (s >= 0.5).cast("int").alias("predicted"))
