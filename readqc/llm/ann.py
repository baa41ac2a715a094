"""Nearest neighbours by multi-index hashing, as a join on buckets.

Binary codes: learned rotations of the centred unit vectors (iterative quantisation), fitted on at most ``fit_rows`` vectors,
give the bits of a code, which is cut into substrings of log2(rows) bits. Each substring of each vector is an entry of the
index, keyed by (substring, value); a query probes all values within ``reach`` bits of its own in every substring. By the
pigeonhole principle this retrieves every code within a Hamming distance of parts * (reach + 1) - 1, and many beyond. The
number of substrings is the least one that retrieves ``target`` of the true neighbours of ``sampled`` queries, which one
pass over all rows finds. Retrieved codes are tested by their Hamming distance, on their first SIGNATURE bits within the join
and in full before the rerank, within radii that cover ``cover`` of these neighbours; those within are reranked by cosine in
double precision.

Equal vectors are one class, with the ids that can be among the k nearest, so copies make no hot bucket. The join on buckets
is an equi-join (a bucket of many near copies is split by adaptive execution); only ids leave it. It is a merge join by hint,
as are the joins that bring a class its ids and a query its class or vector: Spark would size the probes by the file of their
queries (thousands of rows a query), the others by compressed files, and would broadcast what the driver can't hold. The ids are dealt by
shard of the rows and block of the queries, both of bounded size, where each query comes along once with its candidates in
that shard. A query that finds fewer than k rows is compared with all rows, and so is every query if no number of
substrings reaches the target.
"""

from __future__ import annotations

import heapq
import itertools
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import stored

RESULT = "query_id long, rank int, vec_id long, score double"
FOUND = "q long, c long, vec_id long, score double"
MOST_PARTS, LEAST_PARTS, WORD, SIGNATURE = 512, 8, 64, 192


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors with an id, a norm above zero and only finite components."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    return vectors.filter(F.col("vec_id").isNotNull() & fine & (norm > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Codes:
    """Rotations of centred unit vectors; ``bits`` per substring."""

    def __init__(self, sample: np.ndarray, bits: int, rounds: int, seed: int):
        self.bits, self.rounds, self.rng = bits, rounds, np.random.default_rng(seed)
        self.mean = unit(sample).mean(axis=0)
        self.axes = np.zeros((sample.shape[1], 0))

    def grow(self, sample: np.ndarray, parts: int) -> None:
        """Learns further rotations until there are bits for so many parts."""
        x, d = unit(sample) - self.mean, sample.shape[1]
        while self.axes.shape[1] < parts * self.bits:
            r = np.linalg.qr(self.rng.standard_normal((d, d)))[0]
            for _ in range(self.rounds):
                u, _, vt = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
                r = (u @ vt).T
            self.axes = np.concatenate([self.axes, r], axis=1)

    def __call__(self, x: np.ndarray, first: int, last: int) -> np.ndarray:
        """(n, last - first) values of these substrings."""
        on = (unit(x) - self.mean) @ self.axes[:, first * self.bits : last * self.bits] > 0
        return on.reshape(len(x), last - first, self.bits) @ (1 << np.arange(self.bits, dtype=np.int64))


class Index:
    """codes, parts, reach, radius, near, the radius of the signature, and whether the target is reached. left and right: vectors of queries and of their true neighbours, pair by pair."""

    def __init__(self, sample: np.ndarray, rows: int, left: np.ndarray, right: np.ndarray, reach: int, target: float, cover: float, rounds: int = 6, seed: int = 11):
        self.codes, self.reach = Codes(sample, int(np.clip(np.ceil(np.log2(max(rows, 2))), 8, 30)), rounds, seed), reach
        least, whole, self.parts = np.full(len(left), 99), np.zeros(len(left), np.int64), 0
        while self.parts < MOST_PARTS and (self.parts < LEAST_PARTS or (least <= reach).sum() < target * len(left)):
            if self.codes.axes.shape[1] < (self.parts + 1) * self.codes.bits:
                self.codes.grow(sample, self.parts + 8)
            apart = np.zeros(0, np.int64) if not len(left) else np.bitwise_count(self.codes(left, self.parts, self.parts + 1) ^ self.codes(right, self.parts, self.parts + 1))[:, 0]
            least, whole, self.parts = np.minimum(least, apart), whole + apart, self.parts + 1
        self.codes.axes = self.codes.axes[:, : self.parts * self.codes.bits]
        self.reached = (least <= reach).sum() >= target * len(left)
        self.radius = int(np.quantile(whole, cover)) if len(whole) else self.parts * self.codes.bits
        self.near = int(np.quantile(np.bitwise_count(self.signature(left) ^ self.signature(right)).sum(axis=1), cover)) if len(whole) else SIGNATURE

    def masks(self, reach: int) -> np.ndarray:
        return np.array([sum(1 << b for b in bits) for n in range(reach + 1) for bits in itertools.combinations(range(self.codes.bits), n)], np.int64)

    def signature(self, x: np.ndarray) -> np.ndarray:
        """(n, words) the first SIGNATURE bits of each code as numbers without sign."""
        on = (unit(x) - self.codes.mean) @ self.codes.axes[:, :SIGNATURE] > 0
        on = np.pad(on, ((0, 0), (0, SIGNATURE - on.shape[1]))).reshape(len(x), SIGNATURE // WORD, WORD)
        return on @ (np.uint64(1) << np.arange(WORD, dtype=np.uint64))

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(n, parts) keys of buckets."""
        return self.codes(x, 0, self.parts) | (np.arange(self.parts, dtype=np.int64) << self.codes.bits)


def _vectors(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def _entries(table: DataFrame, shared, probe: bool, name: str, rows: int = 256) -> DataFrame:
    """(key, name, name + "s0", ...): the buckets of table(c, v) and its signature; with probe the buckets within reach as well."""
    names = [f"{name}s{i}" for i in range(SIGNATURE // WORD)]

    def work(batches):
        index = shared.value
        masks = index.masks(index.reach) if probe else np.zeros(1, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                x = _vectors(part.column("v"))
                keys = (index.keys(x)[:, :, None] ^ masks).reshape(len(x), -1)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(pa.array(np.repeat(a, keys.shape[1])) for a in (part.column("c").to_numpy(), *index.signature(x).view(np.int64).T))], names=["key", name, *names])

    return table.select("c", "v").mapInArrow(work, ", ".join(f"{n} long" for n in ("key", name, *names)))


def _true_pairs(classes: DataFrame, queries: DataFrame, k: int, sampled: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of at most ``sampled`` queries and of their k nearest other classes, pair by pair, by one pass over classes(c, v). At most sampled * k vectors reach the driver."""
    picked = queries.orderBy(F.xxhash64(F.lit(5), "v")).limit(sampled).toPandas()
    if not len(picked):
        return np.zeros((0, 1)), np.zeros((0, 1))
    shared = classes.sparkSession.sparkContext.broadcast((picked["c"].to_numpy(), unit(np.stack(picked["v"].to_list()).astype(float))))

    def nearest(batches):
        ids, q = shared.value
        best: list[list[tuple[float, int]]] = [[] for _ in ids]
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                c, score = part.column("c").to_numpy(), q @ unit(_vectors(part.column("v"))).T
                score[ids[:, None] == c[None, :]] = -2
                for i, row in enumerate(score):
                    at = np.argpartition(-row, min(k, len(row) - 1))[:k]
                    best[i] = heapq.nlargest(k, best[i] + [(float(row[a]), int(c[a])) for a in at if row[a] > -2])
        rows = [(i, c, s) for i, found in enumerate(best) for s, c in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.float64()))], names=["i", "c", "score"])

    near = classes.select("c", "v").mapInArrow(nearest, "i int, c long, score double")
    near = near.withColumn("at", F.row_number().over(W.partitionBy("i").orderBy(F.desc("score"), "c"))).filter(F.col("at") <= k)
    found = classes.select("c", "v").join(F.broadcast(near.select("i", "c")), "c").toPandas()  # sampled * k rows
    return np.stack(picked["v"].to_list()).astype(float)[found["i"].to_numpy()], np.stack(found["v"].to_list()).astype(float) if len(found) else np.zeros((0, 1))


def candidates(classes: DataFrame, queries: DataFrame, shared) -> DataFrame:
    """(q, c): the pairs that meet in a bucket and whose signatures are near, some more than once. classes and queries are (c, v)."""
    left, right = _entries(queries, shared, True, "q"), _entries(classes, shared, False, "c").withColumnRenamed("key", "k")
    apart = reduce(add, (F.bit_count(F.col(f"qs{i}").bitwiseXOR(F.col(f"cs{i}"))) for i in range(SIGNATURE // WORD)))
    return left.hint("merge").join(right, (F.col("key") == F.col("k")) & (apart <= shared.value.near)).select("q", "c")


def fit_sample(classes: DataFrame, rows: int, want: int) -> np.ndarray:
    """About ``want`` of so many vectors, by their hash: an ordered limit would send the driver as many from each partition."""
    parts = 1 << 30
    few = F.pmod(F.xxhash64(F.lit(7), "v"), F.lit(parts)) < int(parts * min(1.0, want / max(rows, 1)))
    table = classes.filter(few).select("v", F.xxhash64(F.lit(7), "v").alias("h")).toArrow()
    if not table.num_rows:  # a few rows, none of which has a small hash
        table = classes.select("v", F.xxhash64(F.lit(7), "v").alias("h")).limit(want).toArrow()
    return _vectors(table.column("v").combine_chunks())[np.argsort(table.column("h").to_numpy(), kind="stable")]


def _ranked(shared, k: int):
    """Reranks, in one shard, the candidates of each query: (q, qv, cs) and (c, v, ids) to the k + 1 best rows of each query. cs null: all classes."""

    def work(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        index, out = shared.value, []
        if len(asked) and len(held):
            held = held.sort_values("c")
            c, ids, x = held["c"].to_numpy(), held["ids"].to_list(), np.stack(held["v"].to_list()).astype(float)
            norms = np.sqrt((x * x).sum(axis=1))
            codes = index.codes(x, 0, index.parts)
            qs = np.stack(asked["qv"].to_list()).astype(float)
            for i, (q, cs) in enumerate(zip(asked["q"], asked["cs"], strict=True)):
                at = np.arange(len(c))
                if cs is not None:
                    at = np.searchsorted(c, np.sort(np.asarray(cs, np.int64)))
                    at = at[np.bitwise_count(codes[at] ^ index.codes(qs[i : i + 1], 0, index.parts)).sum(axis=1) <= index.radius]
                score = (x[at] @ qs[i]) / (norms[at] * np.sqrt(qs[i] @ qs[i]))
                if len(at) > k + 1:  # all that reach the k + 1st score, so that ties are settled by id
                    some = score >= np.partition(score, -k - 1)[-k - 1]
                    at, score = at[some], score[some]
                rows = sorted((-s, v, c[a]) for a, s in zip(at, score.tolist(), strict=True) for v in ids[a])[: k + 1]
                out += [(q, cc, v, -s) for s, v, cc in rows]
        return pd.DataFrame(out, columns=["q", "c", "vec_id", "score"]).astype({"q": "int64", "c": "int64", "vec_id": "int64", "score": "float64"})

    return work


def _search(rows: DataFrame, d: int, k: int, every: int, fit_rows: int, shard_rows: int, reach: int, target: float, cover: float, sampled: int) -> DataFrame:
    """The result over rows(vec_id, v) with vectors of length d."""
    spark = rows.sparkSession
    rows = stored(rows.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2")), "vectors")
    total = rows.count()
    rank = F.row_number().over(W.partitionBy("h1", "h2").orderBy("vec_id"))
    ids = rows.select("h1", "h2", "vec_id").withColumn("rank", rank).filter(F.col("rank") <= k + 1).groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = rows.groupBy("h1", "h2").agg(F.first("v").alias("v")).hint("merge").join(ids, ["h1", "h2"])
    classes = stored(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    asking = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "h1", "h2").join(classes.select("h1", "h2", F.col("c").alias("q")).hint("merge"), ["h1", "h2"])
    asking = stored(asking.select("vec_id", "q").withColumn("row", F.monotonically_increasing_id()), "asking")
    queries = stored(classes.join(asking.select(F.col("q").alias("c")).distinct(), "c", "left_semi").select("c", "v"), "queries")

    sample = fit_sample(classes, n, min(fit_rows, max(1000, (8 << 20) // d)))
    left, right = _true_pairs(classes, queries, k, sampled)
    shared = spark.sparkContext.broadcast(Index(sample, n, left, right, reach, target, cover))
    # A group holds one shard of the rows and one block of the queries, so neither side grows with the table.
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-queries.count() // shard_rows))
    shard = F.pmod(F.xxhash64("c"), F.lit(shards)).cast("int")
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    held = classes.select(shard.alias("shard"), numbers(blocks).alias("block"), "c", "v", "ids")
    asked = queries.select(F.col("c").alias("q"), F.col("v").alias("qv"), F.pmod(F.xxhash64(F.lit(3), "c"), F.lit(blocks)).cast("int").alias("block"))
    by = ["shard", "block"]
    ranked = lambda df: df.groupBy(*by).cogroup(held.groupBy(*by)).applyInPandas(_ranked(shared, k), FOUND)
    best = lambda df: df.withColumn("at", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("at") <= k + 1)

    found, full = spark.createDataFrame([], FOUND + ", at int"), spark.createDataFrame([], "q long")
    if shared.value.reached:
        pairs = candidates(classes, queries, shared).distinct().repartition("q").withColumn("shard", shard)
        pairs = pairs.groupBy("q", "shard").agg(F.collect_set("c").alias("cs")).join(asked.hint("merge"), "q").select(*by, "q", "qv", "cs")
        found = stored(best(ranked(pairs)), "found")
        full = found.filter(F.col("at") == min(k + 1, total)).select("q")
    again = asked.join(full, "q", "left_anti")
    if not again.isEmpty():
        each = again.select(numbers(shards).alias("shard"), "block", "q", "qv", F.lit(None).cast("array<long>").alias("cs"))
        found = found.join(full, "q", "left_semi").union(stored(best(ranked(each)), "found"))

    own = (F.col("c") == F.col("q")) & (F.col("vec_id") == F.col("query_id"))
    met = asking.select(F.col("vec_id").alias("query_id"), "q", "row").join(found, "q")
    met = met.withColumn("self", F.min(F.when(own, F.col("at"))).over(W.partitionBy("row"))).filter(~F.col("at").eqNullSafe(F.col("self")))
    rank = (F.col("at") - F.when(F.col("at") > F.col("self"), 1).otherwise(0)).cast("int")
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, k: int = 5, every: int = 50, fit_rows: int = 10_000, shard_rows: int = 8192, reach: int = 2, target: float = 0.95, cover: float = 0.995, sampled: int = 192) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine of each row whose vec_id is divisible by ``every``, ties to the smaller vec_id.

    Vectors that are null, zero or hold null or non-finite components, and rows without id, take no part; vectors are
    compared with those of their length, a pass a length. Candidates are all rows but the query's own: rows that share an
    id are each a candidate and a query of its own. Without usable rows the result is empty. Other columns are ignored.
    """
    rows = usable(vectors)
    out = vectors.sparkSession.createDataFrame([], RESULT)
    for r in rows.select(F.size("v").alias("d")).distinct().orderBy("d").collect():
        out = out.union(_search(rows.filter(F.size("v") == r.d), r.d, k, every, fit_rows, shard_rows, reach, target, cover, sampled))
    return out
