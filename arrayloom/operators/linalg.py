"""Products, Gram matrices and truncated decompositions over long frames.

A product with a dictionary of K components sums K columns in one aggregation: rows aren't
multiplied by K, and partial sums are taken before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, ParameterAdjusted, warn
from ..options import option
from .subset import small

#: Components summed by one aggregation; more are summed in groups of as many.
WIDTH = 64


def packed_basis(spark: SparkSession, matrix: np.ndarray, key: str) -> DataFrame:
    """(key, w array): a row of the matrix for each key, from 0."""
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(matrix)], f"{key} int, w array<double>")


def pack(basis: DataFrame, key: str, components: int) -> DataFrame:
    """(k, key, w) to (key, w array); absent weights are 0."""
    by = F.map_from_entries(F.collect_list(F.struct("k", "w")))
    return basis.groupBy(key).agg(by.alias("m")).select(key, F.transform(F.sequence(F.lit(0), F.lit(components - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("w"))


def project(df: DataFrame, basis: DataFrame, key: str, components: int) -> DataFrame:
    """Sum over key of value * w[k]: (run_id, other axis, c array<double>), other being vox or t."""
    other = "vox" if key == "t" else "t"
    rows = df.join(small(basis, 0 if components is None else _cells(basis, components)), key)
    out = None
    for start in range(0, components, WIDTH):
        ks = range(start, min(components, start + WIDTH))
        part = rows.groupBy("run_id", other).agg(*[F.sum(F.col("value") * F.get("w", F.lit(k))).alias(f"c{k}") for k in ks])
        part = part.select("run_id", other, F.array(*[f"c{k}" for k in ks]).alias(f"p{start}"))
        out = part if out is None else out.join(part, ["run_id", other])
    arrays = [c for c in out.columns if c.startswith("p")]
    return out.select("run_id", other, F.flatten(F.array(*arrays)).alias("c"))


def _cells(basis: DataFrame, components: int) -> int:
    """Cells of a packed basis if they are known from a local table, else over the limit."""
    size = int(str(basis._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size // 8


def unpacked(coef: DataFrame) -> DataFrame:
    """(run_id, vox or t, c array) to rows with k and value."""
    other = "vox" if "vox" in coef.columns else "t"
    return coef.select("run_id", other, F.posexplode("c").alias("k", "value"))


def repacked(coef: DataFrame, components: int | None = None) -> DataFrame:
    """Rows (run_id, other, k, value) to arrays in order of k."""
    other = "vox" if "vox" in coef.columns else "t"
    return coef.groupBy("run_id", other).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "value"))), lambda s: s["value"]).alias("c"))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def reconstruct(coef: DataFrame, basis: DataFrame, key: str, size: int, keep: DataFrame | None = None) -> DataFrame:
    """The product again: for every coefficient row, all values of key (or those in keep).

    Rows come from a sequence and meet their basis row in an equi-join; nothing is summed, so
    only a basis too large to broadcast makes a shuffle.
    """
    other = "vox" if "vox" in coef.columns else "t"
    if keep is not None:
        basis = basis.join(keep.select(key), key, "left_semi")
    rows = coef.withColumn(key, F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    rows = rows.join(small(basis, _cells(basis, 1)), key)
    return rows.select("run_id", "t", "vox", dot("c", "w").alias("value")) if other != key else rows


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, k, v) x (k, j, v) -> (i, j, v), as a join and a sum."""
    x, y = a.select("i", "k", F.col("v").alias("va")), b.select("k", "j", F.col("v").alias("vb"))
    return x.join(y, "k").groupBy("i", "j").agg(F.sum(F.col("va") * F.col("vb")).alias("v"))


def rows_of(df: DataFrame, n_vox: int) -> DataFrame:
    """(run_id, t, row array<double> of n_vox values); absent cells are 0."""
    entries = F.map_from_entries(F.collect_list(F.struct("vox", "value")))
    return df.groupBy("run_id", "t").agg(entries.alias("m")).select("run_id", "t", F.transform(F.sequence(F.lit(0), F.lit(n_vox - 1)), lambda v: F.coalesce(F.try_element_at("m", v), F.lit(0.0))).alias("row"))


def moments(rows: DataFrame, n_vox: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, their sum and their Gram matrix. Tasks send one partial each; n_vox is limited."""
    if n_vox > option("kernel.max_features"):
        raise DimensionMismatch(f"{n_vox} features are more than kernel.max_features: see blocks.components", "moments")

    def run(batches):
        n, total, gram = 0, np.zeros(n_vox), np.zeros((n_vox, n_vox))
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy().reshape(-1, n_vox)
                n, total = n + len(x), total + x.sum(axis=0)
                gram += x.T @ x
        yield pa.record_batch([pa.array([*range(-1, n_vox)], pa.int32()), pa.array([n, *[0] * n_vox], pa.int64()), pa.array([total.tolist(), *gram.tolist()], pa.list_(pa.float64()))], names=["i", "n", "x"])

    parts = rows.select("row").mapInArrow(run, "i int, n long, x array<double>")
    cols = parts.select("i", "n", F.posexplode("x").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    total, gram, n = np.zeros(n_vox), np.zeros((n_vox, n_vox)), 0
    t = cols.toArrow()  # (n_vox + 1) * n_vox numbers
    i, j, x = (t[c].to_numpy() for c in ("i", "j", "x"))
    total[j[i < 0]] = x[i < 0]
    gram[i[i >= 0], j[i >= 0]] = x[i >= 0]
    if len(i):
        n = int(t["n"].to_numpy()[i < 0].max())
    return n, total, gram


def signed(v: np.ndarray) -> np.ndarray:
    """Columns with their largest entry positive: decompositions become deterministic."""
    at = np.abs(v).argmax(axis=0)
    return v * np.where(v[at, np.arange(v.shape[1])] < 0, -1.0, 1.0)


class Decomposition:
    """Loadings (n_vox x k), singular values, mean and scale of the fit."""

    def __init__(self, loadings: np.ndarray, d: np.ndarray, mean: np.ndarray, scale: np.ndarray, n: int, total: float):
        self.loadings, self.d, self.mean, self.scale, self.n, self.total = loadings, d, mean, scale, n, total

    @property
    def k(self) -> int:
        return self.loadings.shape[1]


def decompose(df: DataFrame, n_vox: int, k: int, center: bool = True, scale: bool = False) -> Decomposition:
    """Principal components of the rows over t, from one pass that sums the Gram matrix; for few voxels (blocks.components takes any number)."""
    n, total, gram = moments(rows_of(df, n_vox), n_vox)
    mean = total / max(n, 1) if center else np.zeros(n_vox)
    cov = gram - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0) / max(n - 1, 1)) if scale else np.ones(n_vox)
    sd[sd == 0] = 1
    cov = cov / np.outer(sd, sd)
    most = max(1, min(n, n_vox))
    if k > most:
        warn(f"k is cut from {k} to {most}", ParameterAdjusted)
    value, vector = np.linalg.eigh(cov)
    k = min(k, most)
    order = np.argsort(-value, kind="stable")[:k]
    return Decomposition(signed(vector[:, order]), np.sqrt(np.maximum(value[order], 0)), mean, sd, n, float(np.trace(cov)))


def quantise_weights(w: np.ndarray, bits: int) -> tuple[np.ndarray, float]:
    """Signed codes up to 2^(bits-1) - 1 and their scale."""
    top = 2 ** (bits - 1) - 1
    peak = float(np.abs(w).max()) if len(w) else 0.0
    scale = peak / top if peak else 1.0
    return np.clip(np.rint(w / scale), -top, top).astype(int), scale
