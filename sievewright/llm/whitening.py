"""Whitening of embeddings: leading principal components of a distributed covariance, scaled to unit variance.

Vectors are quantised to whole numbers, so equal vectors are equal and sums are exact. Spark finds the distinct vectors
(the fit list), adds them up, and adds up the products of what is left of them after the mean is taken off: each task
sends one matrix, and the matrices are added by row and column in a shuffle. The driver holds one matrix of d by d
numbers. It is brought to tridiagonal form by Householder reflections; Sturm counts of the tridiagonal form say how many
eigenvalues lie under a value, and bisection with them finds the leading ones; inverse iteration finds their vectors,
those of close eigenvalues being made orthogonal to each other in every step. The components go to the tasks (d by k
numbers), which project every row.

Defined results: rows whose vector is null, is empty or has a null, NaN or infinite entry are dropped; so are rows of
another length than most rows have (of lengths equally frequent: the longest); rows that repeat a vector count once in
the fit and each get their result; repeated or null vec_id values are kept as they are; components whose eigenvalue is
not above rounding are left out, so a table of fewer than two distinct vectors gives no rows; components of equal
eigenvalues are any orthonormal set of their space; a deviation beyond 64 bits is null; an empty table gives no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

EPS = float(np.finfo(float).eps)


# --- symmetric eigenproblem


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal, off-diagonal and reflections (first row, unit vector) with a = H1 H2 ... T ... H2 H1."""
    a, reflections = np.array(a, float), []
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        largest = np.abs(x).max()
        if largest == 0.0 or not np.abs(x[1:]).any():
            continue
        x /= largest
        x[0] += math.copysign(float(np.sqrt(x @ x)), x[0])
        u = x / np.sqrt(x @ x)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ u
        q = p - (u @ p) * u
        rest -= 2.0 * (np.outer(u, q) + np.outer(q, u))
        a[k + 1 :, k] -= 2.0 * (u @ a[k + 1 :, k]) * u
        a[k, k + 1 :] = a[k + 1 :, k]
        reflections.append((k + 1, u))
    return a.diagonal().copy(), a.diagonal(-1).copy(), reflections


def sturm_count(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie under each of the values: negative pivots of T - x."""
    least = np.finfo(float).tiny ** 0.5
    pivot = diagonal[0] - values
    count = (pivot < 0).astype(int)
    for d, e in zip(diagonal[1:], off, strict=True):
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        pivot = d - values - e * e / pivot
        count += pivot < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection of Gershgorin's interval down to neighbouring numbers."""
    n = len(diagonal)
    reach = np.abs(np.append(off, 0.0)) + np.abs(np.concatenate([[0.0], off]))
    span = max(float((np.abs(diagonal) + reach).max()), np.finfo(float).tiny)
    low, high = np.full(k, float((diagonal - reach).min()) - EPS * span), np.full(k, float((diagonal + reach).max()) + EPS * span)
    wanted = n - 1 - np.arange(k)  # so many lie under it
    for _ in range(2100):
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        over = sturm_count(diagonal, off, middle) > wanted
        high, low = np.where(over, middle, high), np.where(over, low, middle)
    return low + (high - low) / 2


def _solved(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, small: float) -> np.ndarray:
    """x of (T - shift) x = right, by elimination with row exchanges; pivots of zero become small."""
    n = len(diagonal)
    main, upper, second, x = diagonal - shift, np.append(off, 0.0), np.zeros(n), right.copy()
    for i in range(n - 1):
        below, beside = off[i], main[i + 1]
        if abs(below) > abs(main[i]):
            main[i], below, upper[i], beside = below, main[i], beside, upper[i]
            second[i], upper[i + 1] = upper[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
            times = below / main[i]
            main[i + 1] = beside - times * upper[i]
            upper[i + 1] = -times * second[i]
        else:
            main[i] = main[i] if abs(main[i]) > small else small
            times = below / main[i]
            main[i + 1] = beside - times * upper[i]
        x[i + 1] -= times * x[i]
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            x[i] -= upper[i] * x[i + 1]
        if i + 2 < n:
            x[i] -= second[i] * x[i + 2]
        x[i] /= main[i] if abs(main[i]) > small else small
    return x


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix, one a column, for falling eigenvalues; within a cluster of close
    values each iterate is made orthogonal to the vectors before it."""
    n, scale = len(diagonal), max(float(np.abs(diagonal).max() + 2 * np.abs(np.append(off, 0.0)).max()), np.finfo(float).tiny)
    small, out, first = EPS * scale, np.zeros((n, len(values))), 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * scale:
            first = j
        x = np.cos(np.arange(n) * (1.0 + j)) + 1.5  # any start that isn't orthogonal to the vector
        shift = value - (j - first) * 2 * small  # equal values: not twice the same system
        for _ in range(8):
            x = _solved(diagonal, off, shift, x / np.abs(x).max(), small)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= out[:, first:j] @ (out[:, first:j].T @ x)
            x /= np.sqrt(x @ x)
        out[:, j] = x
    return out


def leading_components(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns): at most k, none whose eigenvalue is not above rounding."""
    n = len(a)
    diagonal, off, reflections = tridiagonal(a)
    values = leading_eigenvalues(diagonal, off, min(k, n))
    values = values[values > n * EPS * max(float(np.trace(a)), 0.0)]
    vectors = inverse_iteration(diagonal, off, values)
    for first, u in reversed(reflections):
        vectors[first:] -= 2.0 * np.outer(u, u @ vectors[first:])
    for j in range(len(values)):  # what rounding in the reflections left
        for _ in range(2):
            vectors[:, j] -= vectors[:, :j] @ (vectors[:, :j].T @ vectors[:, j])
        vectors[:, j] /= np.sqrt(vectors[:, j] @ vectors[:, j])
    return np.einsum("ij,ik,kj->j", vectors, a, vectors), vectors


# --- distributed parts


def quantised(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and x (array<long>): floor(256 c) of every entry, for rows with a whole vector of the usual length."""
    entry, array = "CAST(c AS DOUBLE)", f"`{column}`"
    whole = f"size({array}) > 0 AND forall({array}, c -> c IS NOT NULL AND NOT isnan({entry}) AND abs({entry}) < double('inf'))"
    fine = rows.where(F.col(column).isNotNull()).where(F.expr(whole))
    usual = fine.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return fine.where(F.size(column) == (usual["d"] if usual else 0)).select("vec_id", F.expr(f"transform({array}, c -> CAST(floor(256 * {entry}) AS BIGINT))").alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)


def _exact(x: np.ndarray, bound: int) -> np.ndarray:
    """x as it is, or as Python's own whole numbers if results of up to bound wouldn't fit."""
    return x if bound < 2**62 else x.astype(object)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


@dataclass
class Whitening:
    """n: distinct vectors; sums: of each dimension, exact; values, vectors: components; trace: of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        times = _exact(x, self.n * _largest(x) + max(map(abs, self.sums), default=0))
        return times * self.n - np.array(self.sums, times.dtype)

    def project(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x).astype(float) / self.n) @ self.vectors / np.sqrt(self.values)


def _added(parts: DataFrame) -> dict[tuple[int, int], float]:
    """Sums of numbers (row, column, v) over all tasks."""
    return {(r["row"], r["col"]): r["v"] for r in parts.groupBy("row", "col").agg(F.sum("v").alias("v")).collect()}


def _entries(matrix: np.ndarray) -> pa.RecordBatch:
    row, col = np.indices(matrix.shape)
    return pa.RecordBatch.from_arrays([pa.array(row.ravel()), pa.array(col.ravel()), pa.array(matrix.ravel())], names=["row", "col", "v"])


def fit(vectors: DataFrame, components: int = 4) -> tuple[Whitening, float]:
    """The whitening of the distinct vectors of x, and the largest entry by which the covariance of what it makes of them
    differs from the identity."""
    distinct = common.written(vectors.select("x").distinct(), "distinct-vectors")

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in it:
            if len(batch):
                x = _matrix(batch)
                own = [int(v) for v in _exact(x, len(x) * _largest(x)).sum(axis=0)]
                n, total = n + len(x), own if total is None else [a + b for a, b in zip(total, own, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array(map(str, [n, *total]), pa.string())], names=["at", "v"])

    added = distinct.mapInArrow(sums, "at int, v string").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    by = {r["at"]: int(r["v"]) for r in added}
    n = by.pop(-1, 0)
    d = len(by)
    model = Whitening(n, [by[i] for i in range(d)], np.zeros(0), np.zeros((d, 0)), 0.0)
    if not n:
        return model, 0.0

    def products(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in it:
            if len(batch):
                y = model.centred(_matrix(batch)).astype(float) / n
                total += y.T @ y
        yield _entries(total)

    covariance = np.zeros((d, d))
    for (i, j), v in _added(distinct.mapInArrow(products, "row long, col long, v double")).items():
        covariance[i, j] = v / n
    values, found = leading_components((covariance + covariance.T) / 2, components)
    model = Whitening(n, model.sums, values, found, float(np.trace(covariance)))
    k = len(values)

    def moments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in it:
            if len(batch):
                z = model.project(_matrix(batch))
                total[:k] += z.T @ z
                total[k] += z.sum(axis=0)
        yield _entries(total)

    if not k:
        return model, 0.0
    got = _added(distinct.mapInArrow(moments, "row long, col long, v double"))
    mean = [got[k, j] / n for j in range(k)]  # zero but for rounding: products were of centred values
    return model, max(abs(got[i, j] / n - mean[i] * mean[j] - (i == j)) for i in range(k) for j in range(k))


def whiten(rows: DataFrame, components: int = 4, column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each vector and component."""
    vectors = quantised(rows, column)
    model, error = fit(vectors, components)
    k = len(model.values)
    explained = (model.values / model.trace if k else np.zeros(0)).tolist()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not len(batch) or not k:
                continue
            x = _matrix(batch)
            away = model.centred(x)
            squares = _exact(away, away.shape[1] * _largest(away) ** 2)
            deviation = [v if v < 2**63 else None for v in map(int, (squares * squares).sum(axis=1))]
            z = model.project(x)
            row = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(deviation, pa.int64()).take(row), pa.array(z.ravel())], names=["vec_id", "component", "deviation", "whitened"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    out = vectors.mapInArrow(run, f"vec_id {kind}, component int, deviation long, whitened double")
    share = F.element_at(F.array(*map(F.lit, explained)), F.col("component")) if k else F.lit(None).cast("double")
    return out.select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(float(error)).alias("identity_error"))
