"""Whitening of embeddings by matrix-free block subspace iteration.

The covariance V of the fit list is never formed.  A Spark pass multiplies a
block of directions Q by it: every task centres its rows, exactly in integers,
and adds up X^T (X Q).  The driver keeps the directions asked for so far with
their products, which are narrow (dimensions x block), and does QR and
Rayleigh-Ritz on them; the residuals ||V u - e u|| of the wanted components
certify them, or give the next block.  As earlier blocks stay in the subspace
(up to a bound, beyond which it restarts from its best Ritz vectors), close
eigenvalues cost a few passes more and not hundreds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, pick

#: Directions of one pass, columns that the subspace holds at most, passes at most, and the residual that certifies a component, as a share of the largest eigenvalue.
BLOCK, MOST_COLUMNS, MOST_PASSES, TOLERANCE = 32, 256, 400, 1e-13
#: Eigenvalues below this share of the largest one, a dimension, are rounding.
RANK = 2.0**-52
#: Rows that a task works on at once.
ROWS = 4096
#: Entries stay below this, as sums of them over all rows do below 2^62.
MOST_ENTRY = 1 << 40


@dataclass(frozen=True)
class Fit:
    """A whitening: n rows with integer sums, unit components (dimensions x k) by falling eigenvalue, and how good they are."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int
    identity_error: float


def integers(vectors: DataFrame, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id and x, floor(scale * c) + shift of each entry, taken as a double; null vectors, and those with null or non-finite entries or entries beyond 2^40, leave."""
    c = F.col("embedding").cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * F.lit(float(scale))) < F.lit(float(MOST_ENTRY - abs(shift))))
    rows = pick(vectors, "vec_id", "embedding").filter(c.isNotNull() & F.forall(c, finite))
    return rows.select("vec_id", F.transform(c, lambda v: F.floor(v * F.lit(float(scale))).cast("long") + F.lit(shift)).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], column: int, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            some = batch.slice(i, ROWS)
            yield some, some.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(some.num_rows, dims)


def _summed(fit: DataFrame, work: Callable[[np.ndarray], np.ndarray], dims: int, width: int, kind: str = "double") -> np.ndarray:
    """The sum over all rows of a matrix that ``work`` gives for some of them; added up by rows of the matrix on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches, 0, dims):
            part = work(x)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int64)), *[pa.array(total[:, j]) for j in range(width)]], ["i", *[f"v{j}" for j in range(width)]])

    parts = fit.select("x").mapInArrow(run, "i long, " + ", ".join(f"v{j} {kind}" for j in range(width)))
    rows = parts.groupBy("i").agg(*[F.sum(f"v{j}").alias(f"v{j}") for j in range(width)]).orderBy("i").toArrow()
    return np.stack([rows.column(j + 1).to_numpy() for j in range(width)], axis=1)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n: subtracted in integers, divided once."""
    return (n * x - sums).astype(np.float64) / n


def orthogonal(block: np.ndarray, basis: np.ndarray | None = None) -> np.ndarray:
    """An orthonormal base of what the block adds to a basis; directions that add nothing but rounding leave."""
    if not block.size:
        return block
    block = block / np.maximum(np.linalg.norm(block, axis=0), np.finfo(float).tiny)
    for _ in range(2 if basis is not None else 0):
        block = block - basis @ (basis.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-12]
    return np.linalg.qr(u - basis @ (basis.T @ u))[0] if basis is not None and u.size else u


def subspace_iteration(multiply: Callable[[np.ndarray], np.ndarray], dims: int, k: int, block: int = BLOCK, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k largest eigenvalues of a symmetric matrix, their unit vectors, the residuals, and the number of products.

    multiply(Q) is the matrix times Q.  Raises an error if the residuals do not
    certify all k after MOST_PASSES products.
    """
    k, block = min(k, dims), min(dims, max(block, k))
    basis, product = np.zeros((dims, 0)), np.zeros((dims, 0))
    new = orthogonal(np.random.default_rng(1).standard_normal((dims, block)))
    for passes in range(1, MOST_PASSES + 1):
        basis, product = np.hstack([basis, new]), np.hstack([product, multiply(new)])
        small = basis.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, images = basis @ turn, product @ turn
        residual = images[:, :block] - ritz[:, :block] * values[:block]
        size = np.linalg.norm(residual, axis=0)
        if size[:k].max(initial=0) <= tolerance * max(values[0], 0) or basis.shape[1] == dims:
            u = ritz[:, :k]
            return values[:k], u / np.linalg.norm(u, axis=0), size[:k], passes
        if basis.shape[1] + block > max(MOST_COLUMNS, 3 * block):
            basis, product = ritz[:, : 2 * block], images[:, : 2 * block]
        new = orthogonal(residual[:, size > tolerance * values[0] / 10][:, : min(block, dims - basis.shape[1])], basis)
        if not new.shape[1]:  # the residuals are rounding: look in directions not tried
            new = orthogonal(np.random.default_rng(passes).standard_normal((dims, min(block, dims - basis.shape[1]))), basis)
    raise ArithmeticError(f"after {MOST_PASSES} passes the residuals are still {size[:k].max():.3g}")


def fit(vectors: DataFrame, k: int = 16) -> Fit:
    """The whitening of different vectors ``x``, a written table of some arrays of one length; fewer components than k where the rank is less."""
    head = vectors.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dims"), F.max(F.array_max(F.transform("x", F.abs))).alias("largest")).first()
    n, dims, largest = head["n"], head["dims"], head["largest"]
    if n * (largest + 1) >= 1 << 62:
        raise ValueError(f"{n} rows with entries up to {largest} do not add up within 64 bits")
    sums = _summed(vectors, lambda x: x.sum(axis=0)[:, None], dims, 1, "long")[:, 0]
    trace = float(_summed(vectors, lambda x: (centred(x, n, sums) ** 2).sum().reshape(1, 1), dims, 1)[0, 0]) / n

    def multiply(q: np.ndarray) -> np.ndarray:
        def work(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums)
            return c.T @ (c @ q)

        return _summed(vectors, work, dims, q.shape[1]) / n

    if trace <= 0:
        return Fit(n, sums, np.zeros((dims, 0)), np.zeros(0), trace, np.zeros(0), 0, 0.0)
    values, components, residuals, passes = subspace_iteration(multiply, dims, k)
    some = values > RANK * dims * values[0]
    values, components = values[some], components[:, some]
    turned = components / np.sqrt(values)

    def gram(x: np.ndarray) -> np.ndarray:
        w = centred(x, n, sums) @ turned
        return w.T @ w

    error = np.abs(_summed(vectors, gram, dims, len(values)) / n - np.eye(len(values))).max()
    return Fit(n, sums, components, values, trace, residuals[some], passes, float(error))


def transform(rows: DataFrame, by: Fit) -> DataFrame:
    """vec_id, deviation (null where it does not fit a long) and whitened, an array of one number for each component; rows have vec_id and x."""
    dims, turned, wide = len(by.sums), by.components / np.sqrt(by.values), 2.0**62
    n, sums = by.n, by.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, x in _matrices(batches, 1, dims):
            apart = n * x - sums
            fits = (apart.astype(np.float64) ** 2).sum(axis=1) < wide
            squares = np.where(fits[:, None], apart, 0)
            w = (apart.astype(np.float64) / n) @ turned
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array((squares**2).sum(axis=1), pa.int64(), mask=~fits), lists], ["vec_id", "deviation", "whitened"])

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, k: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """Every vector on the unit eigenvectors of the covariance of all different vectors, over the root of the eigenvalue.

    One row for each row and component: vec_id, component (from 1, by falling
    eigenvalue), n (different vectors), deviation (squared distance from the
    mean, times n^2), whitened, explained (eigenvalue over trace),
    identity_error (largest entry by which the covariance of whitened departs
    from the identity).

    Null vectors and those with null or non-finite entries, or entries beyond
    2^40 after scaling, take no part.  Repeated vectors and ids: each row is
    returned, and the fit takes a vector once.  Vectors of different lengths are
    spaces of their own, each fitted for itself, one after the other.  Fewer
    components than k come back where a space has fewer dimensions or its
    vectors a lower rank; with one different vector, or no dimensions, none.  An
    empty table gives no rows.  A deviation beyond 2^62 is null.  Other columns
    are left out.
    """
    scratch = Scratch(vectors.sparkSession, "whitening")
    rows = scratch.save(integers(vectors, scale, shift), "rows")
    fitted = scratch.save(rows.select("x").distinct().withColumn("dims", F.size("x")), "different")
    spaces = [r["dims"] for r in fitted.select("dims").distinct().orderBy("dims").toLocalIterator() if r["dims"]]
    out = None
    for dims in spaces:
        by = fit(fitted.filter(F.col("dims") == dims).select("x"), k)
        if not len(by.values):
            continue
        explained: Column = F.array(*[F.lit(float(v / by.trace)) for v in by.values])
        of = F.posexplode("whitened").alias("place", "whitened")
        one = transform(rows.filter(F.size("x") == dims), by).select("vec_id", "deviation", of)
        one = one.select(
            "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(by.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("place")).alias("explained"), F.lit(by.identity_error).alias("identity_error")
        )
        out = one if out is None else out.unionByName(one)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out
