"""Sparse principal components by variable projection (Erichson and others, 2018): loadings b that the data are rotated back from.

minimise 1/2 |X - X b a'|^2 + alpha |b|_1 + beta/2 |b|^2 over b and orthonormal a, by turns: a has a closed form, b takes a proximal gradient
step, which is a product and a soft threshold. X is given by its largest singular values and right vectors v, so both need v, which
stays in blocks, and small matrices: a = v p, and v'b is all that is known of b outside its blocks. alpha and beta count in units of the largest
singular value squared.

A round is one job over the blocks, which returns sums. Its tasks repeat the steps since b was last written instead of reading it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ParameterAdjusted, warn
from ..functions.shipping import ship
from ..sources.files import as_table, delete
from . import blocks, linalg

ship(__name__)

#: The published method's ridge; a round is a job, so they end earlier than the method's 1e-5 and 1,000 by default.
BETA, TOLERANCE, MAX_ROUNDS = 1e-4, 1e-4, 200
#: Rounds after which b is written again.
KEPT_STEPS = 25


@dataclass
class SparseComponents(blocks.Components):
    """Components whose loadings are sparse and of unit norm; projector: rows (k, vox, w) of the least-squares coefficients; objective by round; singular: singular values of the data."""

    projector: DataFrame | None = None
    objective: tuple[float, ...] = ()
    zeros: float = 0.0
    singular: np.ndarray | None = None


def _stepped(v: np.ndarray, b: np.ndarray, steps: list, nu: float, shrink: float, cut: float) -> np.ndarray:
    """b after proximal gradient steps."""
    for g in steps:
        b = shrink * b + nu * (v @ g)
        b = np.sign(b) * np.maximum(np.abs(b) - cut, 0.0)
    return b


def _sums(table: DataFrame, l: int, k: int, steps: list, rates: tuple) -> tuple[np.ndarray, float, float]:
    """v'b, sum of |b| and of b^2 after the steps; a task sends one row."""

    def run(batches):
        t, size, squares, some = np.zeros((l, k)), 0.0, 0.0, False
        for batch in batches:
            for v, b in zip(batch.column("data"), batch.column("b"), strict=True):
                v = np.frombuffer(v.as_buffer()).reshape(-1, l)
                x = _stepped(v, np.frombuffer(b.as_buffer()).reshape(-1, k), steps, *rates)
                t += v.T @ x
                size, squares, some = size + np.abs(x).sum(), squares + (x * x).sum(), True
        if some:
            yield pa.record_batch([pa.array([np.append(t.ravel(), [size, squares]).tobytes()], pa.binary())], names=["data"])

    total = sum(np.frombuffer(bytes(r.data)) for r in table.select("data", "b").mapInArrow(run, "data binary").collect())
    return total[:-2].reshape(l, k), float(total[-2]), float(total[-1])


def _written(table: DataFrame, l: int, k: int, steps: list, rates: tuple) -> tuple[DataFrame, str]:
    """The table with b after the steps."""

    def run(batches):
        for batch in batches:
            new = [_stepped(np.frombuffer(v.as_buffer()).reshape(-1, l), np.frombuffer(b.as_buffer()).reshape(-1, k), steps, *rates).tobytes() for v, b in zip(batch.column("data"), batch.column("b"), strict=True)]
            yield pa.record_batch([batch.column("vb"), batch.column("data"), pa.array(new, pa.binary())], names=["vb", "data", "b"])

    return as_table(table.select("vb", "data", "b").mapInArrow(run, "vb int, data binary, b binary"))


def sparse_components(df: DataFrame, n_vox: int, k: int, alpha: float, whiten: bool = False, beta: float = BETA, tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS) -> SparseComponents:
    """k sparse components of the rows over t, of the part of the data that k + OVERSAMPLE singular values hold. Ends when a round lowers the objective by less than tolerance of it."""
    spark = df.sparkSession
    s, n, mean, sd, total = blocks.decomposed(df, n_vox, k, whiten, whiten, extra=True)
    l = len(s.d)
    k = min(k, l)
    if not k:
        empty = spark.createDataFrame([], "k int, vox int, w double")
        return SparseComponents(empty, np.zeros(0), mean, sd, n, total, None, empty, singular=s.d)
    d2 = s.d**2
    a1, b1 = alpha * d2[0], beta * d2[0]
    nu = 1.0 / (d2[0] + b1)
    rates = (nu, 1.0 - nu * b1, nu * a1)
    # b starts as the first singular vectors
    table, path = _written(s.right.withColumn("b", s.right["data"]), l, l, [], rates) if l == k else _started(s.right, l, k)
    t, steps, objective = np.eye(l)[:, :k], [], []
    for _ in range(max_rounds):
        u, _, wt = np.linalg.svd(d2[:, None] * t, full_matrices=False)
        p = u @ wt
        steps.append(d2[:, None] * (p - t))
        t, size, squares = _sums(table, l, k, steps, rates)
        fit = 0.5 * (d2.sum() - 2 * np.sum(p * d2[:, None] * t) + np.sum(t * d2[:, None] * t))
        objective.append(float(fit + a1 * size + 0.5 * b1 * squares))
        if len(steps) >= KEPT_STEPS:
            (table, new), old, steps = _written(table, l, k, steps, rates), path, []
            delete(spark, old)
            path = new
        if len(objective) > 1 and objective[-2] - objective[-1] < tolerance * objective[-2]:
            break
    else:
        warn(f"the objective still falls after {max_rounds} rounds", ParameterAdjusted)
    table, new = _written(table, l, k, steps, rates)
    delete(spark, path)
    b = table.select("vb", F.col("b").alias("data"))
    # unit norm and a positive largest entry; coefficients by least squares, as sparse loadings aren't orthogonal
    r = blocks.triangle(b, k, blocks.n_blocks(n_vox))
    norm = np.linalg.norm(r, axis=0)
    unit = np.where(norm > 0, 1.0 / np.where(norm > 0, norm, 1.0), 0.0) * blocks.column_signs(b, n_vox, k)
    r = r * unit
    loadings, _ = as_table(blocks.times_small(b, np.diag(unit)))
    projector = blocks.cells_of(blocks.times_small(loadings, np.linalg.pinv(r.T @ r)), n_vox)
    found = np.linalg.norm(s.d[:, None] * t * unit, axis=0)
    basis = blocks.cells_of(loadings, n_vox)
    filled = basis.count()
    return SparseComponents(basis, found, mean, sd, n, total, loadings, projector, tuple(objective), 1.0 - filled / (n_vox * k), s.d)


def _started(right: DataFrame, l: int, k: int) -> tuple[DataFrame, str]:
    def run(batches):
        for batch in batches:
            first = [np.ascontiguousarray(np.frombuffer(x.as_buffer()).reshape(-1, l)[:, :k]).tobytes() for x in batch.column("data")]
            yield pa.record_batch([batch.column("vb"), batch.column("data"), pa.array(first, pa.binary())], names=["vb", "data", "b"])

    return as_table(right.select("vb", "data").mapInArrow(run, "vb int, data binary, b binary"))


def reconstruction_error(df: DataFrame, n_vox: int, c: SparseComponents) -> DataFrame:
    """(run_id, mse, sparsity): error of the data's least-squares fit by the components."""
    basis, projector = linalg.pack(c.basis, "vox", c.k), linalg.pack(c.projector, "vox", c.k)
    back = linalg.reconstruct(linalg.project(df, projector, "vox", c.k), basis, "vox", n_vox).withColumnRenamed("value", "fit")
    e = F.col("value") - F.col("fit")
    both = df.join(back, ["run_id", "t", "vox"], "left").withColumn("fit", F.coalesce("fit", F.lit(0.0)))
    return both.groupBy("run_id").agg(F.avg(e * e).alias("mse"), F.lit(c.zeros).alias("sparsity"))
