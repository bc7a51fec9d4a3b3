"""Whitening of embeddings by LOBPCG (operator 12).

The leading eigenvectors of the covariance come from locally optimal block preconditioned conjugate gradients (Knyazev
2001, without a preconditioner). The covariance itself is never formed: a round multiplies it with a block of columns by one
pass over the centred rows, in which every task adds up (x - m)((x - m)B) of its rows. The block is an orthonormal basis of
the iterate, its residuals and the previous directions; Rayleigh-Ritz on that basis gives the next iterate. The driver
holds matrices of some 3 * BLOCK columns, never rows.

A residual |Vb - eb| is taken from a product with the vector itself, not from a recurrence, so it certifies what is
returned: the eigenvalue is off by at most that much, the direction by at most that over the gap to the next eigenvalue.

Rows are quantised once to whole numbers and written in blocks to the shared folder; sums, centred rows times n and
deviations are exact integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattika.llm.batches import binary
from lattika.llm.common import materialize, table

#: Columns of the iterate for each component asked for; more columns than components make rounds fewer.
WIDTH = 3
#: A residual counts as zero below this share of the largest eigenvalue; where rounding keeps it above, below the second share after so many rounds that did not halve it.
RESIDUAL, ROUNDED, STALLED = 1e-13, 1e-10, 6
#: Rounds at most; without certified residuals by then the fit is an error.
ROUNDS = 1_000
#: Components whose eigenvalue is below this share of the largest are rounding, not variance.
NULL_SHARE = 1e-12
#: Entries of a block of rows; rows into which the partial sums of tasks are added up before they reach the driver.
ENTRIES, PARTIALS = 1 << 18, 16
#: Quantisation: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
_LARGEST = float(2**63)


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is neither null nor empty and has finite entries alone, of the length that most such rows have (of equally frequent ones the greatest)."""
    v = F.col(f"`{vector}`")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, odd)).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))
    most = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return rows.where(F.size("v") == (most["dim"] if most else 0))


def quantised(rows: DataFrame) -> DataFrame:
    """Blocks of rows: ids, absent (which ids are null), dim and x (little-endian 64-bit integers, row by row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = len(batch.column(1)[0]) if batch.num_rows else 1
            step = max(1, ENTRIES // dim)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = np.floor(SCALE * part.column(1).flatten().to_numpy()) + SHIFT
                x = np.clip(x, -(2.0**62), 2.0**62).astype(np.int64)
                ids, absent = part.column(0).fill_null(0).to_numpy(), part.column(0).is_null().to_numpy(zero_copy_only=False)
                one = np.ones(1, np.int64)
                yield pa.record_batch({"ids": binary(ids, one * len(ids)), "absent": binary(absent.astype(np.uint8), one * len(ids)), "dim": pa.array([dim], pa.int32()), "x": binary(x, one * len(x))})

    return rows.mapInArrow(run, "ids binary, absent binary, dim int, x binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, which of them are null, and the rows of each block."""
    for batch in batches:
        for ids, absent, dim, x in zip(*(c.to_pylist() for c in batch.columns)):
            yield np.frombuffer(ids, np.int64), np.frombuffer(absent, np.uint8) > 0, np.frombuffer(x, np.int64).reshape(-1, dim)


def _total(blocks: DataFrame, share: Callable[[np.ndarray], np.ndarray], dtype=np.float64) -> np.ndarray:
    """The sum over all blocks of rows of `share(rows)`, arrays of one shape: by task, by one of PARTIALS groups, then on the driver."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for _, _, x in _blocks(batches):
            part = share(x)
            whole = part if whole is None else whole + part
        if whole is not None:
            at = TaskContext.get().partitionId()
            yield pa.record_batch({"part": pa.array([at], pa.int64()), "sums": [whole.astype(dtype).tobytes()]})

    def merged(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        sums = sum(np.frombuffer(s.as_py(), dtype) for s in group.column("sums"))
        return pa.table({"part": group.column("part").slice(0, 1), "sums": [sums.tobytes()]})

    schema = "part long, sums binary"
    found = blocks.mapInArrow(task, schema).groupBy(F.pmod("part", F.lit(PARTIALS))).applyInArrow(merged, schema).orderBy("part").collect()
    return sum(np.frombuffer(r["sums"], dtype) for r in found)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Rows less the mean, whose whole and remaining parts are taken off one after the other, so that nothing is lost."""
    return (x - sums // n).astype(np.float64) - (sums % n) / n


def _basis(*blocks: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span the blocks; each block is cleared of the earlier ones twice, and directions that are rounding go."""
    out = np.zeros((blocks[0].shape[0], 0))
    for b in blocks:
        size = np.linalg.norm(b, axis=0)
        b = b[:, size > 0] / size[size > 0]
        for _ in range(2):
            b = b - out @ (out.T @ b)
        if b.shape[1]:
            u, s, _ = np.linalg.svd(b, full_matrices=False)
            u = u[:, s > 1e-10]
            u = u - out @ (out.T @ u)
            out = np.concatenate([out, np.linalg.qr(u)[0]], axis=1) if u.shape[1] else out
    return out


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dim: int, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix that is known by its products with blocks of columns: values, unit vectors (columns), residuals."""
    x = np.random.default_rng(seed).standard_normal((dim, min(dim, WIDTH * k)))
    residual, before = np.zeros((dim, 0)), np.zeros((dim, 0))
    best, waited, found = np.inf, 0, None
    for _ in range(ROUNDS):
        basis = _basis(x, residual, before)
        image = product(basis)
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][: x.shape[1]], turn[:, ::-1][:, : x.shape[1]]
        now, moved = basis @ turn, image @ turn
        residual = moved - now * values
        before = now - x @ (x.T @ now) if x.shape[1] == now.shape[1] else before
        x = now
        errors = np.linalg.norm(residual[:, :k], axis=0)
        waited = 0 if errors.max() < 0.5 * best else waited + 1
        if errors.max() < best:
            best, found = errors.max(), (values[:k], x[:, :k], errors)
        if best <= RESIDUAL * values[0] or (waited >= STALLED and best <= ROUNDED * values[0]):
            return found
    raise ArithmeticError(f"residuals of {best / values[0]:.1e} of the largest eigenvalue after {ROUNDS} rounds")


@dataclass
class Whitener:
    """What whitening needs: rows, exact sums by dimension, and the leading eigenvalues, unit eigenvectors and residuals of the covariance, with its trace."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Rows, centred and projected on the components, each of variance one over the fitted rows."""
        return _centred(x, self.n, self.sums) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """The sum over dimensions of (n * x - sums)^2, exact; null where 64 bits do not hold it."""
        apart = x.astype(np.float64) * self.n - self.sums
        large = (apart**2).sum(axis=1) >= _LARGEST * (1 - 1e-9)
        with np.errstate(over="ignore"):
            exact = ((x * self.n - self.sums) ** 2).sum(axis=1)
        return pa.array(exact, mask=large)


def fit(blocks: DataFrame, k: int = 8) -> Whitener | None:
    """Fit on all rows of `blocks`; None without rows. Fewer than k components where fewer have variance."""
    first = blocks.select("dim").first()
    if first is None:
        return None
    dim = first["dim"]
    counted = _total(blocks, lambda x: np.append(x.sum(axis=0), len(x)), np.int64)
    sums, n = counted[:-1], int(counted[-1])

    def product(columns: np.ndarray) -> np.ndarray:
        def share(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            return (c.T @ (c @ columns)).ravel()

        return _total(blocks, share).reshape(columns.shape) / n

    trace = float(_total(blocks, lambda x: np.array([(_centred(x, n, sums) ** 2).sum()]))[0]) / n
    if trace == 0:
        return Whitener(n, sums, 0.0, np.zeros(0), np.zeros((dim, 0)), np.zeros(0))
    values, vectors, residuals = lobpcg(product, dim, min(k, dim))
    kept = values > NULL_SHARE * values[0]
    vectors = vectors[:, kept]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return Whitener(n, sums, trace, values[kept], vectors, residuals[kept])


def whiten(vectors: DataFrame, vector: str = "embedding", k: int = 8) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error, residual: k rows for each usable row of `vectors`.

    Vectors that are null, empty, of another length than most or hold a null, NaN or infinite entry are dropped. Null and
    repeated ids and repeated rows count row by row; columns other than vec_id and the vector are not read. Where the rows vary in
    fewer than k directions, only these are components; rows without any variance, one row and an empty table give no rows.
    Components of equal variance are any basis of their space. A vector's length is bounded by memory for some 3 * WIDTH * k
    columns of it. deviation is null where 64 bits do not hold it. residual: |Vb - eb| / e of the component, as measured.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    blocks = materialize(quantised(usable(vectors, vector)), "quantised")
    fitted = fit(blocks, k)
    if fitted is None or not len(fitted.values):
        return vectors.sparkSession.createDataFrame([], schema)
    m, n = len(fitted.values), fitted.n

    def moments(x: np.ndarray) -> np.ndarray:
        z = fitted.scores(x)
        return np.concatenate([(z.T @ z).ravel(), z.sum(axis=0)])

    found = _total(blocks, moments)
    mean = found[m * m :] / n
    error = float(np.abs(found[: m * m].reshape(m, m) / n - np.outer(mean, mean) - np.eye(m)).max())
    explained, residual = fitted.values / fitted.trace, fitted.residuals / fitted.values

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, absent, x in _blocks(batches):
            own = lambda v: np.tile(v, len(ids))
            each = np.repeat(np.arange(len(ids)), m)
            yield pa.record_batch(
                {
                    "vec_id": pa.array(ids[each], mask=absent[each]),
                    "component": own(np.arange(1, m + 1, dtype=np.int32)),
                    "n": np.full(len(each), n),
                    "deviation": fitted.deviations(x).take(pa.array(each)),
                    "whitened": fitted.scores(x).ravel(),
                    "explained": own(explained),
                    "identity_error": np.full(len(each), error),
                    "residual": own(residual),
                }
            )

    return blocks.mapInArrow(rows, schema)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """All embeddings, eight components."""
    return whiten(table(spark, sf_dir, "embeddings"))
