"""Whitening of embeddings by the leading components of their covariance.

Vectors are rounded down to whole numbers of 1/256. Sums and the centred covariance of the distinct ones are added up in tasks; the covariance, a
matrix of the vectors' dimensions, is made tridiagonal by Householder reflections, its leading eigenvalues are found by bisection on Sturm
counts, and their vectors by inverse iteration, orthogonalised inside clusters of close eigenvalues. The components are then broadcast and every vector is projected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from questlog.session import discard, materialise

STEPS = 256  # of a unit
LOW = (1 << 31) - 1
FARTHEST = 1 << 61
EPS = np.finfo(float).eps


# ---- symmetric eigenvalues

def householder(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, float]]]:
    """(diagonal, off-diagonal, reflections) of a tridiagonal matrix similar to symmetric `a`. Reflection k is I - scale * v v^T on the
    coordinates from k + 1 on."""
    a = np.array(a, float)
    size, reflections = len(a), []
    for k in range(size - 2):
        x = a[k + 1:, k]
        peak = np.abs(x).max()
        if np.abs(x[1:]).max() <= EPS * EPS * peak:
            reflections.append((np.zeros_like(x), 0.0))
            continue
        v = x / peak
        norm = np.linalg.norm(v)
        v[0] += np.copysign(norm, v[0])
        scale = 2.0 / (v @ v)
        first = -np.copysign(norm * peak, x[0])
        rest = a[k + 1:, k + 1:]
        p = scale * (rest @ v)
        w = p - 0.5 * scale * (p @ v) * v
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1:, k] = a[k, k + 1:] = 0.0
        a[k + 1, k] = a[k, k + 1] = first
        reflections.append((v, scale))
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), reflections


def sturm_count(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each `x`: the negative pivots of T - x I."""
    tiny = np.finfo(float).tiny / EPS + EPS * EPS * max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0))
    pivot, below = np.ones_like(x), np.zeros(len(x), np.int64)
    for d, e in zip(diagonal, [0.0, *off], strict=True):
        pivot = d - x - e * e / pivot
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        below += pivot < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The `count` largest eigenvalues, falling, each by bisection between the Gershgorin bounds to the last bit."""
    size = len(diagonal)
    around = np.concatenate([[0.0], np.abs(off), [0.0]])
    reach = around[:-1] + around[1:]
    low, high = np.full(count, (diagonal - reach).min()), np.full(count, (diagonal + reach).max())
    spare = 4 * EPS * max(abs(low[0]), abs(high[0])) + np.finfo(float).tiny
    low, high = low - spare, high + spare
    rank = size - 1 - np.arange(count)  # eigenvalues below the wanted one
    while True:
        middle = 0.5 * (low + high)
        if not ((middle > low) & (middle < high)).any():
            return middle
        under = sturm_count(diagonal, off, middle) <= rank
        low, high = np.where(under, middle, low), np.where(under, high, middle)


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, floor: float) -> np.ndarray:
    """(T - shift I) x = right by elimination with row exchanges; pivots below `floor` are raised to it."""
    size = len(diagonal)
    d, u, w, b, low = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * size, right.tolist(), off.tolist()
    for k in range(size - 1):
        if abs(low[k]) > abs(d[k]):
            factor = d[k] / low[k]
            d[k], u[k], d[k + 1], w[k], u[k + 1] = low[k], d[k + 1], u[k] - factor * d[k + 1], u[k + 1], -factor * u[k + 1]
            b[k], b[k + 1] = b[k + 1], b[k] - factor * b[k + 1]
        else:
            if abs(d[k]) < floor:
                d[k] = floor
            factor = low[k] / d[k]
            d[k + 1] -= factor * u[k]
            b[k + 1] -= factor * b[k]
    for k in range(size - 1, -1, -1):
        if abs(d[k]) < floor:
            d[k] = floor
        ahead = (u[k] * b[k + 1] if k + 1 < size else 0.0) + (w[k] * b[k + 2] if k + 2 < size else 0.0)
        b[k] = (b[k] - ahead) / d[k]
    return np.array(b)


def tridiagonal_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Unit eigenvectors (rows) of falling `values` by inverse iteration; one whose value is within a thousandth of the matrix's norm of the one before
    is kept orthogonal to its whole cluster."""
    size = len(diagonal)
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    floor, rng = EPS * norm, np.random.default_rng(12)
    out: list[np.ndarray] = []
    cluster, shift = 0, np.inf
    for k, value in enumerate(values):
        near = k > 0 and values[k - 1] - value <= 1e-3 * norm
        cluster = cluster if near else k
        shift = min(value, shift - 4 * floor) if near else value  # equal eigenvalues need different shifts
        x = rng.standard_normal(size)
        for _ in range(rounds):
            for other in out[cluster:k] * 2:
                x -= (x @ other) * other
            x /= np.linalg.norm(x)
            x = _solve(diagonal, off, shift, x, floor)
            x /= np.abs(x).max()
        for other in out[cluster:k] * 2:
            x -= (x @ other) * other
        out.append(x / np.linalg.norm(x))
    return np.array(out).reshape(len(values), size)


def leading_components(covariance: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as rows) of a symmetric matrix, the `count` largest, falling."""
    count = min(count, len(covariance))
    scale = np.abs(covariance).max()
    if not scale:
        return np.zeros(count), np.eye(len(covariance))[:count]
    diagonal, off, reflections = householder(covariance / scale)
    values = leading_eigenvalues(diagonal, off, count)
    vectors = tridiagonal_vectors(diagonal, off, values)
    for k in range(len(reflections) - 1, -1, -1):
        v, factor = reflections[k]
        vectors[:, k + 1:] -= factor * np.outer(vectors[:, k + 1:] @ v, v)
    return values * scale, vectors / np.linalg.norm(vectors, axis=1)[:, None]


# ---- sums in tasks

def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n in double precision; the whole part of the mean is taken away as a number without rounding."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole).astype(float) - np.array([(s % n) / n for s in sums])


def _sum_rows(width: int):
    """Per dimension the sums of the lower 31 bits and of the rest, so that neither overflows."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), width)
            low += (x & LOW).sum(axis=0)
            high += (x >> 31).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(low), pa.array(high)], names=["row", "low", "high"])

    return add


def _product_rows(width: int, prepare):
    """Rows of the matrix of summed products of prepared vectors, upper triangle: (row, column, value)."""
    above = np.triu_indices(width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = prepare(batch.column(0))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(above[0]), pa.array(above[1]), pa.array(total[above])], names=["row", "column", "value"])

    return add


def products(vectors: DataFrame, width: int, prepare) -> np.ndarray:
    """Summed outer products of prepared vectors, a `width` x `width` matrix on the driver."""
    rows = vectors.mapInArrow(_product_rows(width, prepare), "row long, column long, value double").groupBy("row", "column").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros((width, width))
    r, c, v = (rows.column(k).to_numpy() for k in ("row", "column", "value"))
    out[r, c] = v
    out[c, r] = v
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - sums) ** 2, exact; null beyond the range of a long."""
    peak = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if peak * peak * len(sums) < 1 << 62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def _usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite entry."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def whiten(vectors: DataFrame, count: int = 4) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for every usable row of `vectors` (vec_id, embedding; other columns
    are left) and each of the `count` leading components (fewer if the vectors have fewer dimensions).

    Rows whose vector is null, empty, or holds null or non-finite entries go, and so do those whose length is not the usable rows' most frequent one (of two as
    frequent the smaller). Entries become x = floor(256 * c), at most 2 ** 61 from 0. Means and covariance are over the `n` distinct x; repeated rows each give
    rows, ids may be null. A component without variance (an eigenvalue no larger than rounding errors of the largest) has null `whitened` and counts neither in
    identity_error nor as explained (0.0; null where no component has any). `deviation` is null beyond the range of a long. An empty table gives an empty result.
    The driver holds a matrix of the dimensions, whatever the number of rows; copies of a vector are one row from the first step on.
    """
    whole = F.transform("embedding", lambda c: F.least(F.greatest(F.floor(c.cast("double") * F.lit(float(STEPS))), F.lit(-FARTHEST)), F.lit(FARTHEST)))
    rows = vectors.select("vec_id", "embedding").filter(_usable(F.col("embedding")) & (F.size("embedding") > 0)).select("vec_id", whole.alias("x"))
    widths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    kind = StructType([vectors.schema["vec_id"], StructField("component", IntegerType()), *(StructField(c, LongType()) for c in ("n", "deviation")),
                       *(StructField(c, DoubleType()) for c in ("whitened", "explained", "identity_error"))])
    if widths is None:
        return vectors.sparkSession.createDataFrame([], kind)
    width = widths["d"]
    rows = rows.filter(F.size("x") == width)
    distinct = materialise(rows.select("x").distinct())
    n = distinct.count()
    summed = distinct.mapInArrow(_sum_rows(width), "row long, low long, high long").groupBy("row").agg(F.sum("low").alias("low"), F.sum("high").alias("high")).collect()  # a row per dimension
    sums = [0] * width
    for r in summed:
        sums[r["row"]] = (r["high"] << 31) + r["low"]
    covariance = products(distinct, width, lambda c: centred(_matrix(c, width), n, sums)) / n
    trace = float(np.trace(covariance))
    values, components = leading_components(covariance, count)
    live = values > max(width, 16) * EPS * max(values[0], 0.0)
    projection = components[live].T / np.sqrt(values[live])
    project = lambda x: centred(x, n, sums) @ projection
    error = None
    if live.any():
        mean = _means(distinct, width, project, int(live.sum())) / n
        error = float(np.abs(products(distinct, int(live.sum()), lambda c: project(_matrix(c, width)) - mean) / n - np.eye(int(live.sum()))).max())
    discard(distinct)
    explained = [float(v / trace) if a else 0.0 for v, a in zip(values, live, strict=True)] if live.any() else [None] * len(values)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, size = _matrix(batch.column(1), width), len(values)
            white = np.full((len(x), size), np.nan)
            if live.any():
                white[:, live] = project(x)
            row, component = pa.array(np.repeat(np.arange(len(x)), size)), np.tile(np.arange(size), len(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), pa.array(component + 1, pa.int32()), pa.array(np.full(len(row), n)), pa.array(deviations(x, n, sums), pa.int64()).take(row),
                 pa.array(white.ravel(), mask=np.tile(~live, len(x))), pa.array(explained, pa.float64()).take(pa.array(component)), pa.array([error] * len(row), pa.float64())], names=[f.name for f in kind])

    return rows.mapInArrow(answer, kind)


def _means(vectors: DataFrame, width: int, project, size: int) -> np.ndarray:
    """Sums of the projected vectors."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += project(_matrix(batch.column(0), width)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["row", "value"])

    rows = vectors.mapInArrow(add, "row long, value double").groupBy("row").agg(F.sum("value").alias("value")).collect()  # a row per component
    out = np.zeros(size)
    for r in rows:
        out[r["row"]] = r["value"]
    return out
