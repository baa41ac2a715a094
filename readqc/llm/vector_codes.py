"""Product codes of vectors by k-means with Exponion search, exact in integers.

Components become integers, vectors are cut into equal parts, and each part position has a codebook. A part is assigned to
its nearest entry by Exponion search: it starts at the entry of the round before, a, at squared distance u, and scans the
list of the entries sorted by their squared distance from a. An entry no farther than the best one so far (squared distance
b <= u) lies within sqrt(u) + sqrt(b) of a, so its squared distance from a is at most 2 * (u + b): where the sorted list
passes that radius, the scan ends with the true nearest entry. All numbers are integers and ties go to the lower index.

Rows are never shuffled in training. A round is one pass that rewrites the rows with their codes, and one that adds up parts by
entry, a table of parts * entries rows a task at most, which is aggregated by Spark; the codebooks (parts * entries entries) go
to the driver and back with the tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, scaled_vectors, stored


class Lists:
    """Codebooks as one table of entries (part * entries + index), and every entry's neighbours of the same part from near to far."""

    def __init__(self, books: np.ndarray):
        parts, self.entries, width = books.shape
        self.flat = np.ascontiguousarray(books.reshape(-1, width), np.int64)
        apart = ((books[:, :, None, :] - books[:, None, :, :]) ** 2).sum(-1)
        order = np.argsort(apart, axis=2, kind="stable")  # equal distances by index
        first = (np.arange(parts) * self.entries)[:, None, None]
        self.near = (order + first).reshape(-1, self.entries)
        self.apart = np.take_along_axis(apart, order, 2).reshape(-1, self.entries)
        #: Without an earlier entry the search starts at the one in the middle of its codebook.
        self.middle = apart.sum(2).argmin(1) + first[:, 0, 0]

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of the parts x, which start at the given entries of their codebooks."""
        best, least = start.copy(), ((x - self.flat[start]) ** 2).sum(1)
        first, at = least.copy(), np.arange(len(x))
        for step in range(self.entries):
            at = at[self.apart[start[at], step] <= 2 * (first[at] + least[at])]
            if not len(at):
                break
            other = self.near[start[at], step]
            far = ((x[at] - self.flat[other]) ** 2).sum(1)
            better = (far < least[at]) | ((far == least[at]) & (other < best[at]))
            best[at[better]], least[at[better]] = other[better], far[better]
        return best, least


def _parts(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows (vec_id, label, v and, from the second round on, code) with code, a byte a part, and error, the sum of squared distances."""
    parts, entries, width = books.shape
    again = "code" in rows.columns

    most = int((2**60 / width) ** 0.5) // 2  # radii must fit 64 bits

    def work(batches):
        lists = Lists(books)
        first = np.arange(parts) * entries
        for batch in pieces(batches, 2048):
            n = batch.num_rows
            x = _parts(batch, width)
            if n and max(np.abs(x).max(), np.abs(books).max()) > most:
                raise ValueError(f"scaled components must be within {most}")
            start = np.tile(lists.middle, n)
            if again:
                start = (np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, parts) + first).ravel()
            best, least = lists.nearest(x, start)
            code = (best.reshape(n, parts) - first).astype(np.uint8)
            new = [pa.array([c.tobytes() for c in code], pa.binary()), pa.array(least.reshape(n, parts).sum(1), pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "v")), *new], names=["vec_id", "label", "v", "code", "error"])

    kept = rows.select("vec_id", "label", "v", *(["code"] if again else []))
    kinds = dict(kept.dtypes)
    return kept.mapInArrow(work, f"vec_id {kinds['vec_id']}, label {kinds['label']}, v array<int>, code binary, error long")


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with every used entry at the floor of the mean of its parts."""
    parts, entries, width = books.shape

    def work(batches):
        count, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in pieces(batches, 2048):
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            at, x = (code + np.arange(parts) * entries).ravel(), _parts(batch, width)
            count += np.bincount(at, minlength=len(count))
            for j in range(width):  # in doubles, which hold the sums of one slice exactly
                total[:, j] += np.bincount(at, weights=x[:, j], minlength=len(count)).astype(np.int64)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], names=["entry", "n", "total"])

    sums = rows.select("v", "code").mapInArrow(work, "entry long, n long, total array<long>").groupBy("entry")
    out = books.reshape(-1, width).copy()
    for r in sums.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[j]) for j in range(width)]).alias("total")).collect():
        out[r.entry] = [t // r.n for t in r.total]
    return out.reshape(books.shape)


def book_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _with_label_error(rows: DataFrame) -> DataFrame:
    """rows with label_error. Labels with more than a quarter of a task's share of the rows, of which there are less than four a task, are broadcast; the others are joined."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = stored(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "labels").withColumnRenamed("label", "_label")
    share = max(1, rows.count() // (4 * n))
    heavy, light = F.broadcast(sums.filter(F.col("n") > share)), sums.filter(F.col("n") <= share)
    same = F.col("label").eqNullSafe(F.col("_label"))
    return rows.join(heavy, same).unionByName(rows.join(heavy, same, "left_anti").join(light, same)).drop("_label", "n")


def train(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks): vec_id, label, v, code and error of every usable row after the rounds, and codebooks[part, entry, position].

    See encode() for the rows left out and for odd rows. Without any usable row the codebooks have no entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has a byte a part: entries must be from 1 to 256")
    rows = scaled_vectors(vectors, scale, "vec_id", "label")
    order = [F.col("vec_id").asc_nulls_last(), F.col("v").asc()]
    first = rows.orderBy(*order).limit(1).collect()
    if not first:
        return rows.withColumns({"code": F.lit(b""), "error": F.lit(0).cast("long")}), np.zeros((parts, 0, 0), np.int64)
    size = len(first[0].v)
    if size % parts:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    rows = rows.filter(F.size("v") == size)
    seeds = np.array([r.v for r in rows.orderBy(*order).limit(entries).collect()], np.int64)
    books = np.ascontiguousarray(seeds.reshape(len(seeds), parts, size // parts).swapaxes(0, 1))
    for _ in range(rounds):
        rows = stored(assigned(rows, books), "codes")
        books = moved(rows, books)
    return assigned(rows, books), books


def encode(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every row of vectors with a usable embedding.

    Components are floor(scale * x). Codebooks start as the vectors of the ``entries`` smallest vec_ids (null ids come last,
    rows that share an id by their components); fewer rows give fewer entries. code has two hex digits a part, error is
    the row's squared distance from its code, label_error its sum over the rows of equal label (null is a label).

    Left out: vectors that are null, empty or hold null, NaN or infinite components, and vectors of another length than that
    of the smallest usable vec_id. Repeated rows count as often as they are there. Scaled components whose
    squared distances might not fit 64 bits (beyond 2**28 for parts of four) are an error. An empty table gives an empty
    table; other columns are ignored.
    """
    rows, books = train(vectors, parts, entries, rounds, scale)
    rows = stored(rows.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error"), "codes")
    return _with_label_error(rows).withColumn("codebooks_sha256", F.lit(book_digest(books)))


#: The same rows of the table embeddings in SQL, for 16 parts, 64 entries and two rounds.
def sql() -> str:
    nearest = "SELECT vec_id, p, min(d * 64 + e) AS m FROM (SELECT x.vec_id, x.p, b.e, CAST(sum((x.c - b.c) * (x.c - b.c)) AS BIGINT) AS d FROM x JOIN {b} b ON x.p = b.p AND x.j = b.j GROUP BY x.vec_id, x.p, b.e) t GROUP BY vec_id, p"
    means = "SELECT b.p, b.e, b.j, coalesce(m.c, b.c) AS c FROM {b} b LEFT JOIN (SELECT x.p, a.m % 64 AS e, x.j, CAST(floor(CAST(sum(x.c) AS DOUBLE) / count(*)) AS BIGINT) AS c FROM x JOIN {a} a ON x.vec_id = a.vec_id AND x.p = a.p GROUP BY x.p, a.m % 64, x.j) m ON b.p = m.p AND b.e = m.e AND b.j = m.j"
    return f"""
WITH kept AS (
  SELECT vec_id, label, embedding AS v, len(embedding) // 16 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS (
  SELECT vec_id, (i - 1) // w AS p, (i - 1) % w AS j, CAST(floor(256 * CAST(v[i] AS DOUBLE)) AS BIGINT) AS c FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM kept) t
), b0 AS (
  SELECT p, e, j, c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept) s USING (vec_id) WHERE e < 64
), a0 AS ({nearest.format(b="b0")}), b1 AS ({means.format(b="b0", a="a0")}), a1 AS ({nearest.format(b="b1")}), b2 AS ({means.format(b="b1", a="a1")}), a2 AS ({nearest.format(b="b2")}),
coded AS (
  SELECT vec_id, string_agg(lower(printf('%02x', CAST(m % 64 AS INT))), '' ORDER BY p) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a2 GROUP BY vec_id
), digest AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM b2)
SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest
"""
