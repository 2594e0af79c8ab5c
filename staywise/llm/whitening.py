"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the factor.

Entries become whole numbers x, so counts, sums and deviations are exact.  The
fit list holds each distinct x vector once, staged in the shared folder.  Its
scatter is summed in two steps: every task multiplies its own centred rows and
sends one triangle of d(d+1)/2 numbers, cell by cell, which Spark adds up; the
driver sees d(d+1)/2 sums, whatever the number of rows.

With A the scatter over n, ``P' A P = R' R`` by Cholesky with the largest
remaining diagonal entry first, which stops where the rest is rounding.  One-sided
Jacobi turns pairs of columns of the lower factor R' until all are
orthogonal; A itself is not touched again.  The squared norms of the rotated
columns are the eigenvalues, the columns scaled to length one and put back in
order the components.  Small eigenvalues keep their relative precision, as the
factor is graded.

Defined cases: rows whose vector is null or has a null, NaN or infinite entry,
or an entry beyond 2**53 as a whole number, are left out; so are rows whose
length is not the most frequent one (the longer, if two are).  Rows that repeat
a vector or an id, or have a null id, are all returned.  With fewer independent
directions than components asked for, the table has only those; with none (one
distinct vector, empty vectors, an empty table) it has no rows.  A deviation
that doesn't fit in a long fails the job.  ``n`` times an entry may exceed a
long; such rows are worked out in unbounded integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.session import stage

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Sweeps after which Jacobi must have ended; some ten are usual.
SWEEPS = 60
#: Rows that a task multiplies at a time.
CHUNK = 4096

_CELLS = pa.schema([("cell", pa.int32()), ("value", pa.float64())])
_WHITENED = pa.schema(
    [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64())]
)


@dataclass(frozen=True)
class Whitening:
    """Count and exact sums of the fit list; unit components as columns, their eigenvalues, and the whole variance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower factor L (d × rank) and order p with ``a[p][:, p] = L @ L.T``, the largest remaining pivot first."""
    a = a.copy()
    d = len(a)
    order = np.arange(d)
    factor = np.zeros((d, d))
    least = d * np.finfo(float).eps * max(a.diagonal().max(initial=0.0), 0.0)
    for k in range(d):
        pivot = k + int(np.argmax(a.diagonal()[k:]))
        if a[pivot, pivot] <= least:
            return factor[:, :k], order
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
            a[:, [k, pivot]] = a[:, [pivot, k]]
            factor[[k, pivot]] = factor[[pivot, k]]
            order[[k, pivot]] = order[[pivot, k]]
        factor[k, k] = np.sqrt(a[k, k])
        factor[k + 1 :, k] = a[k + 1 :, k] / factor[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit left vectors and squared singular values of ``factor``, the largest first, by turning its columns."""
    g = factor.copy()
    rank = g.shape[1]
    for _ in range(SWEEPS):
        turned = False
        for i in range(rank - 1):
            for j in range(i + 1, rank):
                p, q, r = g[:, i] @ g[:, i], g[:, j] @ g[:, j], g[:, i] @ g[:, j]
                if abs(r) <= 1e-15 * np.sqrt(p * q):
                    continue
                turned = True
                z = (q - p) / (2 * r)
                t = (1.0 if z >= 0 else -1.0) / (abs(z) + np.hypot(1.0, z))
                c = 1 / np.hypot(1.0, t)
                left = g[:, i].copy()
                g[:, i] = c * (left - t * g[:, j])
                g[:, j] = c * (t * left + g[:, j])
        if not turned:
            break
    else:
        raise ArithmeticError("the columns did not become orthogonal")
    squares = (g * g).sum(axis=0)
    order = np.argsort(-squares, kind="stable")
    return g[:, order] / np.sqrt(squares[order]), squares[order]


def whole_vectors(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that count, staged; all x have the most frequent length."""
    entries = F.transform(F.col(f"`{vector_column}`"), lambda c: F.floor(SCALE * c.cast("double")) + SHIFT)
    scaled = F.transform(F.col(f"`{vector_column}`"), lambda c: F.abs(SCALE * c.cast("double")))
    # NaN and infinity are greater than any bound, a null makes the test unknown.
    counts = F.coalesce(F.forall(scaled, lambda c: c < 2.0**53), F.lit(False))
    found = stage(
        rows.where(counts).select(F.col(f"`{id_column}`").cast("bigint").alias("vec_id"), entries.cast("array<bigint>").alias("x")), "vectors"
    )
    lengths = found.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return found.where(F.size("x") == (lengths["length"] if lengths else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """rows × entries of a batch of equally long lists."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _scatter(rows: DataFrame, width: int, centred: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over ``rows`` (x) of the outer products of ``centred(x)``."""
    upper = np.triu_indices(width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column("x"))
            for at in range(0, len(x), CHUNK):
                y = centred(x[at : at + CHUNK])
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(total[upper])], schema=_CELLS)

    found = np.zeros((width, width))
    # One number for each pair of dimensions.
    for row in rows.select("x").mapInArrow(partial, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        i, j = upper[0][row["cell"]], upper[1][row["cell"]]
        found[i, j] = found[j, i] = row["value"]
    return found


def _centre(n: int, sums: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """x to x - S/n: the whole part of the mean is taken off exactly, before the rest."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return lambda x: (x - whole).astype(np.float64) - rest


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Sum over dimensions of (n*x - S)**2, exact."""
    largest = max(max(abs(int(x.max())), abs(int(x.min()))) * n, max(abs(int(s)) for s in sums))
    if 2 * largest >= 1 << 62:
        x = x.astype(object)
    y = x * n - (sums if x.dtype == object else sums.astype(np.int64))
    if y.dtype != object and x.shape[1] * int(np.abs(y).max()) ** 2 >= 1 << 63:
        y = y.astype(object)
    return [int(v) for v in (y * y).sum(axis=1)]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """The staged list of distinct vectors (x) and its whitening; none where the list has no variance."""
    distinct = stage(vectors.select("x").distinct(), "distinct-vectors")
    first = distinct.select(F.size("x").alias("d")).first()
    if first is None or not first["d"]:
        return distinct, None
    width = first["d"]
    total = distinct.agg(F.count("*").alias("n"), *[F.sum(F.col("x")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]).first()
    n = total["n"]
    sums = np.array([int(total[f"s{k}"]) for k in range(width)], dtype=object)
    covariance = _scatter(distinct, width, _centre(n, sums)) / n
    factor, order = pivoted_cholesky(covariance)
    if not factor.shape[1]:
        return distinct, None
    turned, squares = one_sided_jacobi(factor)
    vectors_back = np.empty_like(turned)
    vectors_back[order] = turned
    kept = min(components, len(squares))
    return distinct, Whitening(n, tuple(sums), vectors_back[:, :kept], squares[:kept], float(covariance.trace()))


def _projection(model: Whitening) -> Callable[[np.ndarray], np.ndarray]:
    centred = _centre(model.n, np.array(model.sums, dtype=object))
    directions = model.components / np.sqrt(model.eigenvalues)
    return lambda x: centred(x) @ directions


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, measured on its rows."""
    project = _projection(model)
    width = len(model.eigenvalues)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            total += project(_matrix(batch.column("x"))).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], schema=_CELLS)

    means = np.zeros(width)
    for row in distinct.mapInArrow(totals, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        means[row["cell"]] = row["value"] / model.n
    covariance = _scatter(distinct, width, lambda x: project(x) - means) / model.n
    return float(np.abs(covariance - np.eye(width)).max())


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, component, n, deviation, whitened): one row per vector and component."""
    project = _projection(model)
    width = len(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.array(model.sums, dtype=object)
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                part = batch.slice(at, CHUNK)
                x = _matrix(part.column("x"))
                deviation = pa.array(_deviations(x, model.n, sums), pa.int64())
                each = pa.array(np.repeat(np.arange(len(x)), width))
                columns = [
                    part.column("vec_id").take(each),
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), model.n)),
                    deviation.take(each),
                    pa.array(project(x).reshape(-1)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=_WHITENED)

    return vectors.mapInArrow(run, "vec_id bigint, component int, n bigint, deviation bigint, whitened double")


def whitened_components(
    rows: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """Every row on every component, with the component's share of the variance and the error of the whole."""
    vectors = whole_vectors(rows, id_column, vector_column)
    distinct, model = fit(vectors, components)
    if model is None:
        return vectors.sparkSession.createDataFrame(
            [], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        )
    shares = F.element_at(F.array(*[F.lit(float(share)) for share in model.explained]), F.col("component"))
    return whiten(vectors, model).withColumns({"explained": shares, "identity_error": F.lit(identity_error(distinct, model))})
