"""Whitening of embeddings by a two-pass covariance.

Components become integers. Each distinct vector counts once, so copies, however many, weigh as one. The first pass adds
the integers up exactly, which gives the mean S / n without rounding; the second one sums the outer products of the centred
vectors (n * x - S, exact, over n) by matrix products of blocks. Both passes give one partial result a task, merged
by treeAggregate, so the driver gets a few matrices of size * size whatever the number of rows. LAPACK's symmetric
solver gives the axes; mean and axes go out with the tasks, which project every row. A third pass measures the
covariance of the whitened vectors.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, scaled_vectors, stored

SHIFT, BLOCK = 1_000_000, 4096
OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


class Moments(NamedTuple):
    """Number, mean and sum of centred outer products of vectors; two of them merge without loss of what is small."""

    n: int
    mean: np.ndarray
    outer: np.ndarray

    @staticmethod
    def of(y: np.ndarray) -> Moments:
        mean = y.mean(0)
        return Moments(len(y), mean, (y - mean).T @ (y - mean))

    def __add__(self, other: Moments) -> Moments:
        n, apart = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + apart * (other.n / n), self.outer + other.outer + np.outer(apart, apart) * (self.n * other.n / n))


class Axes(NamedTuple):
    """The fit: number of distinct vectors, sums of their components, unit axes (columns) with their variances, and the trace."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once."""
        return (self.n * x - self.sums) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes / np.sqrt(self.variances)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1) + SHIFT


def _merged(fit: DataFrame, part: Callable):
    """part(x) of all blocks x of the fit list, added up: within a task first, then over tasks in a tree. None without rows."""

    def work(batches):
        total = None
        for batch in pieces(batches, BLOCK):
            if batch.num_rows:
                now = part(_matrix(batch.column("v")))
                total = now if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["part"])

    add = lambda a, b: b if a is None else a if b is None else a + b
    return fit.select("v").mapInArrow(work, "part binary").rdd.treeAggregate(None, lambda a, r: add(a, pickle.loads(r.part)), add)


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, in Python's integers where 64 bits might not hold it; null beyond 64 bits."""
    y = n * x - sums
    if len(y) and x.shape[1] * int(np.abs(y).max()) ** 2 >= 2**63:
        exact = (y.astype(object) ** 2).sum(1)
        return [int(v) if v < 2**63 else None for v in exact]
    return (y * y).sum(1).tolist()


def fit_list(vectors: DataFrame, scale: int) -> DataFrame:
    """(v) of each distinct usable vector, stored: vectors of the length that the one of the smallest vec_id has. Copies meet in the tasks that read them first, so a common vector makes no large group."""
    once = stored(scaled_vectors(vectors, scale, "vec_id").groupBy("v").agg(F.min("vec_id").alias("vec_id")), "distinct")
    size = once.select(F.min_by(F.size("v"), F.struct(F.col("vec_id").isNull(), "vec_id", "v"))).first()[0]
    return once.filter(F.size("v") == F.lit(size)).select("v")


def fit_axes(fit: DataFrame, most: int) -> Axes | None:
    """Axes of the fit list by falling variance, ``most`` at most; None without rows. Axes whose variance is within rounding of zero are left out."""
    counted = _merged(fit, lambda x: np.concatenate([[len(x)], x.sum(0)]).astype(np.int64))
    if counted is None:
        return None
    n, sums = int(counted[0]), counted[1:]
    bare = Axes(n, sums, np.eye(len(sums)), np.ones(len(sums)), 0.0)

    def outer(x):
        y = bare.centred(x)
        return y.T @ y

    covariance = _merged(fit, outer) / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    rank = int((values > len(values) * np.finfo(float).eps * max(values[0], 0.0)).sum())
    values, axes = values[: min(most, rank)], axes[:, : min(most, rank)]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])  # the largest entry of an axis is positive
    return Axes(n, sums, axes, values, float(np.trace(covariance)))


def identity_error(fit: DataFrame, axes: Axes) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity, as it comes out of the data."""
    m = _merged(fit, lambda x: Moments.of(axes.whitened(x)))
    return float(np.abs(m.outer / m.n - np.eye(len(m.mean))).max()) if len(m.mean) else 0.0


def whiten(vectors: DataFrame, most: int = 16, scale: int = 64) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component, ``most`` components at most.

    A component is x = floor(scale * c) + 1,000,000. Left out: vectors that are null, empty or hold null, NaN or infinite
    components, and those of another length than that of the smallest usable vec_id (null ids come last). Rows with a null
    or shared id are projected one by one; copies give equal rows. Directions without variance have no component, so
    a table of one distinct vector gives no rows, as an empty one does. deviation is null where it exceeds 64 bits. Scaled
    components beyond 32 bits are an error. Other columns are ignored.
    """
    fit = fit_list(vectors, scale)
    rows = scaled_vectors(vectors, scale, "vec_id")
    schema = f"vec_id {dict(vectors.dtypes)['vec_id']}, {OUT}"
    axes = fit_axes(fit, most)
    if axes is None:
        return rows.sparkSession.createDataFrame([], schema)
    error, size, k = identity_error(fit, axes), len(axes.sums), len(axes.variances)
    explained = axes.variances / axes.trace if k else axes.variances

    def work(batches):
        for batch in pieces(batches, BLOCK):
            x, rows = _matrix(batch.column("v")), batch.num_rows
            each = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, axes.n)), pa.array(_deviation(x, axes.n, axes.sums), pa.int64()).take(each),
                 pa.array(axes.whitened(x).ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.filter(F.size("v") == size).mapInArrow(work, schema)
