"""Whitening of embeddings by principal components from a matrix-free block Lanczos iteration.

The covariance is never formed. A pass over the vectors multiplies it by a block of directions: each task centres its
vectors exactly, multiplies them by the block and then by the transposed products, and the tasks' results are added up.
The driver keeps an orthonormal basis of what the passes gave, with full reorthogonalisation, and reads eigenvectors off
it until their residuals vanish. The trace, which explained shares need, is the sum of the vectors' deviations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import use_workers, written
from plumbline.llm.vectors import added_floats, blocks, integers, matrix, part, reduced, row_limit, sound, whole

LONG = 2**63 - 1
#: Directions beside the wanted ones in a block, bases of so many blocks at most before a restart, passes at most.
MORE, MOST_BLOCKS, MOST_PASSES = 4, 16, 400
#: Residuals below this times the largest eigenvalue have vanished; those stuck below the other are accepted; what is left
#: of a direction when the basis is taken out counts as nothing below the third; eigenvalues below the last are zero.
VANISHED, STUCK, NOTHING, ZERO = 1e-14, 1e-11, 1e-13, 1e-12


def orthonormal(w: np.ndarray, basis: np.ndarray, least: float) -> np.ndarray:
    """Directions of w that the basis lacks, orthonormal; those of a length below least are left out."""
    out = np.zeros((len(w), 0))
    for column in w.T:
        for _ in range(3):  # full reorthogonalisation, against the basis and the directions before
            column = column - basis @ (basis.T @ column)
            column = column - out @ (out.T @ column)
        length = np.linalg.norm(column)
        if length > least and basis.shape[1] + out.shape[1] < len(w):
            column = column / length
            column = column - basis @ (basis.T @ column) - out @ (out.T @ column)
            out = np.column_stack((out, column / np.linalg.norm(column)))
    return out


def lanczos(multiply: Callable[[np.ndarray], np.ndarray], d: int, count: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The count largest eigenvalues, falling, and eigenvectors of a symmetric d x d operator known by its products only.

    A block of count + MORE directions grows into a Krylov basis. Where a block breaks down, as its products add no new
    directions, it starts again from random ones, since an invariant subspace may have left out eigenvalues; a result is
    accepted only if such a restart has not moved it. A basis of MOST_BLOCKS blocks is cut down to its best directions.
    """
    draw = np.random.default_rng(seed)
    width = min(d, count + MORE)
    fresh = orthonormal(draw.standard_normal((d, width)), np.zeros((d, 0)), 0.0)
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    tested, best, stalled = True, np.inf, 0
    for _ in range(MOST_PASSES):
        basis, image = np.column_stack((basis, fresh)), np.column_stack((image, multiply(fresh)))
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        top = min(count, len(values))
        vectors = basis @ turn[:, :top]
        rest = image @ turn[:, :top] - vectors * values[:top]
        scale = max(values[0], 0.0)
        if basis.shape[1] >= d or scale == 0.0:
            break
        residual = np.linalg.norm(rest, axis=0).max() / scale
        stalled = stalled + 1 if residual > 0.9 * best else 0
        best = min(best, residual)
        if top == count and (residual <= VANISHED or (residual <= STUCK and stalled >= 8)):
            if tested:
                break
            tested, fresh = True, orthonormal(draw.standard_normal((d, width)), basis, NOTHING)
            continue
        fresh = orthonormal(image[:, -fresh.shape[1] :], basis, NOTHING * scale)
        if fresh.shape[1] < width:  # breakdown
            more = orthonormal(draw.standard_normal((d, width - fresh.shape[1])), np.column_stack((basis, fresh)), NOTHING)
            fresh, tested = np.column_stack((fresh, more)), False
        if basis.shape[1] + width > MOST_BLOCKS * width:  # the new block is free of the whole basis, so of a part of it too
            keep = turn[:, : 2 * width]
            basis, image = basis @ keep, image @ keep
    else:
        raise ArithmeticError(f"no convergence in {MOST_PASSES} passes: residual {best:g}")
    vectors /= np.linalg.norm(vectors, axis=0)
    return np.maximum(values[:top], 0.0), vectors


class Fit:
    """The number of fitted vectors and their sums by dimension, as exact whole numbers without the offset."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums, self.d = n, sums, len(sums)

    def scaled(self, x: np.ndarray) -> tuple[np.ndarray, bool]:
        """n * x - sums, exact, and whether as doubles; else as Python's whole numbers."""
        most = self.n * (np.abs(x).max() if x.size else 0) + max(map(abs, self.sums), default=0)
        if most < 2**53:
            return self.n * x - np.array(self.sums, np.float64), True
        return self.n * integers(x) - np.array(self.sums, object), False

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less its mean; the difference is exact before the division."""
        return self.scaled(x)[0].astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """Of each vector the sum over dimensions of (n * x - sums)^2, exact."""
        y, doubles = self.scaled(x)
        if doubles and (not y.size or self.d * np.abs(y).max() ** 2 < 2**62):
            return (y.astype(np.int64) ** 2).sum(axis=1).tolist()
        return [sum(int(v) ** 2 for v in row) for row in y.tolist()]


def exact_sums(partial: DataFrame) -> list[int] | None:
    """The sum of lists of whole numbers of any size, as (part int, sums array<string>) of many tasks."""

    def add(t: pa.Table) -> pa.Table:
        total = [sum(map(int, v)) for v in zip(*t.column("sums").to_pylist())]
        return pa.table({"one": pa.array([1], pa.int32()), "sums": pa.array([list(map(str, total))], pa.list_(pa.string()))})

    got = reduced(partial.withColumn("one", F.lit(1)), ["one"], "one int, sums array<string>", add).collect()  # one row
    return list(map(int, got[0]["sums"])) if got else None


def summed(fit_list: DataFrame, d: int, of: Callable[[np.ndarray], list[int]]) -> list[int] | None:
    """The sum over the fit list's blocks of what of() gives, as exact whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] | None = None
        for t in blocks(batches, row_limit(d)):
            new = of(matrix(t.column("x").to_pylist(), d))
            total = new if total is None else [a + b for a, b in zip(total, new)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part()], pa.int32()), pa.array([list(map(str, total))], pa.list_(pa.string()))], names=["part", "sums"])

    return exact_sums(fit_list.mapInArrow(run, "part int, sums array<string>"))


def products(fit_list: DataFrame, fit: Fit, of: Callable[[np.ndarray, np.ndarray], np.ndarray], directions: np.ndarray) -> np.ndarray:
    """The sum over the fit list's blocks of of(centred vectors, directions)."""
    shared = fit_list.sparkSession.sparkContext.broadcast((fit, directions))  # d rows of a block's directions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, q = shared.value
        total = None
        for t in blocks(batches, row_limit(fit.d)):
            new = of(fit.centred(matrix(t.column("x").to_pylist(), fit.d)), q)
            total = new if total is None else total + new
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "blob"])

    try:
        return added_floats(fit_list.mapInArrow(run, "part int, blob binary"))
    finally:
        shared.unpersist()


def column_sums(x: np.ndarray) -> list[int]:
    """The number of rows and each column's sum, exact."""
    exact = x if not x.size or np.abs(x).max() * len(x) < 2**53 else integers(x)
    return [len(x), *map(int, exact.sum(axis=0))]


def principal(fit_list: DataFrame, d: int, count: int) -> tuple[Fit, np.ndarray, np.ndarray, float] | None:
    """The fit, eigenvalues, eigenvectors and trace of the covariance of packed vectors (x); None if there are none."""
    sums = summed(fit_list, d, column_sums)
    if sums is None:
        return None
    fit = Fit(sums[0], sums[1:])
    total = summed(fit_list, d, lambda x: [sum(fit.deviations(x))])
    trace = total[0] / fit.n**3
    multiply = lambda q: products(fit_list, fit, lambda c, q: c.T @ (c @ q), q).reshape(q.shape) / fit.n
    values, vectors = lanczos(multiply, d, min(count, d)) if d and total[0] else (np.zeros(0), np.zeros((d, 0)))
    some = values > ZERO * (values[0] if len(values) else 0)
    return fit, values[some], vectors[:, some], trace


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", count: int = 16, scale: float = 64.0) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every sound vector and component up to count.

    Entries c become x = floor(scale * c) + 1000000; the offset changes sums, not differences, so it is left out inside.
    Vectors that are null or hold null or non-finite entries go; where lengths differ, shorter ones count as filled up with
    entries 0. Each distinct vector is fitted once, however many rows have it; every row is given, also those with a null
    or repeated key. Components whose variance is zero (1e-12 of the largest) cannot be whitened and are left out, so equal
    vectors, a single one or an empty table give no rows. Deviations are exact; those beyond 64 bits are shown as the
    largest long. Other columns are ignored.

    The driver sees the sums, a basis of d rows and at most MOST_BLOCKS * (count + MORE) columns, and nothing of the vectors.
    """
    spark = table.sparkSession
    use_workers(spark)
    kind = dict(table.dtypes)[key]
    kept = table.where(sound(vector)).select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(whole(b, "v", scale), pa.binary())], names=["vec_id", "x"])

    rows = written(kept.mapInArrow(pack, f"vec_id {kind}, x binary"), "vectors")
    fit_list = written(rows.select("x").distinct(), "fit")
    # a packed vector's first byte is the width of its numbers
    d = fit_list.agg(F.max(F.expr("(octet_length(x) - 1) div cast(conv(hex(substring(x, 1, 1)), 16, 10) as int)"))).first()[0]
    found = principal(fit_list, int(d), count) if d is not None else None
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if found is None or not len(found[1]):
        return spark.createDataFrame([], schema).withColumnRenamed("vec_id", key)
    fit, values, vectors, trace = found
    project = vectors / np.sqrt(values)
    count = len(values)

    def moments(c: np.ndarray, q: np.ndarray) -> np.ndarray:
        w = c @ q
        return np.concatenate((w.sum(axis=0), (w.T @ w).ravel()))

    got = products(fit_list, fit, moments, project) / fit.n
    mean, second = got[:count], got[count:].reshape(count, count)
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(count)).max())
    shared = spark.sparkContext.broadcast((fit, project, values / trace, error))

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, q, explained, error = shared.value
        for t in blocks(batches, min(4096, row_limit(fit.d))):
            x = matrix(t.column("x").to_pylist(), fit.d)
            n, m = len(x), len(explained)
            deviation = np.array([min(v, LONG) for v in fit.deviations(x)], np.int64)
            ids = t.column("vec_id").combine_chunks().take(pa.array(np.repeat(np.arange(n), m)))
            columns = [ids, pa.array(np.tile(np.arange(1, m + 1), n), pa.int32()), pa.array(np.full(n * m, fit.n), pa.int64()), pa.array(np.repeat(deviation, m)), pa.array((fit.centred(x) @ q).ravel()), pa.array(np.tile(explained, n)), pa.array(np.full(n * m, error))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(show, schema).withColumnRenamed("vec_id", key)
