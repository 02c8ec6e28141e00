"""Projection of the time axis on a basis, shrinkage of coefficients, and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidInput, warn
from ..functions import bases
from ..functions.scalar import bayes_threshold, below_to_zero, dct_value, hard, noise_sigma, normal_tail, soft, universal_threshold
from ..sources.files import as_table
from . import linalg
from .ranks import medians
from .subset import small


def dct_project(df: DataFrame, n_time: int, n_basis: int) -> DataFrame:
    """(run_id, k, vox, value): DCT-II coefficients; the basis is an expression, nothing is joined."""
    sums = df.groupBy("run_id", "vox").agg(*[F.sum(F.col("value") * dct_value(F.col("t"), F.lit(k), n_time)).alias(f"c{k}") for k in range(n_basis)])
    return sums.select("run_id", "vox", F.posexplode(F.array(*[f"c{k}" for k in range(n_basis)])).alias("k", "value")).select("run_id", "k", "vox", "value")


def dct_reconstruct(coef: DataFrame, n_time: int) -> DataFrame:
    packed = coef.groupBy("run_id", "vox").agg(F.collect_list(F.struct("k", "value")).alias("c"))
    rows = packed.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(n_time - 1))))
    return rows.select("run_id", "t", "vox", F.aggregate("c", F.lit(0.0), lambda s, x: s + x["value"] * dct_value(F.col("t"), x["k"], n_time)).alias("value"))


def project(df: DataFrame, basis: np.ndarray) -> DataFrame:
    """Coefficients (run_id, k, vox, value) on an orthonormal basis (time x component)."""
    packed = linalg.packed_basis(df.sparkSession, basis, "t")
    return linalg.unpacked(linalg.project(df, packed, "t", basis.shape[1])).select("run_id", "k", "vox", "value")


def project_least_squares(df: DataFrame, basis: np.ndarray) -> DataFrame:
    """As project for a basis that isn't orthonormal."""
    if (rank := np.linalg.matrix_rank(basis)) < basis.shape[1]:
        warn(f"the basis has rank {rank} of {basis.shape[1]}")
    return project(df, np.linalg.pinv(basis).T)


def reconstruct(coef: DataFrame, basis: np.ndarray, times=None) -> DataFrame:
    packed = linalg.packed_basis(coef.sparkSession, basis, "t")
    if times is not None:
        packed = packed.where(F.col("t").isin([int(t) for t in times]))
    return linalg.reconstruct(linalg.repacked(coef), packed, "t", basis.shape[0])


def energy_by_component(coef: DataFrame) -> DataFrame:
    return coef.groupBy("run_id", "k").agg(F.sum(F.col("value") * F.col("value")).alias("energy"))


def energy_threshold(coef: DataFrame, keep: float = 0.99) -> DataFrame:
    """Zeroes components under the energy of the last one needed for the share keep; ties stay."""
    e = energy_by_component(coef)  # a row a component
    by = Window.partitionBy("run_id").orderBy(F.desc("energy"), "k").rowsBetween(Window.unboundedPreceding, 0)
    run = e.withColumn("sum", F.sum("energy").over(by)).withColumn("total", F.sum("energy").over(Window.partitionBy("run_id")))
    least = run.where(F.col("sum") >= keep * F.col("total")).groupBy("run_id").agg(F.max("energy").alias("least"))
    kept = e.join(least, "run_id", "left").where(F.col("least").isNull() | (F.col("energy") >= F.col("least"))).select("run_id", "k", F.lit(True).alias("stays"))
    return coef.join(kept, ["run_id", "k"], "left").select("run_id", "k", "vox", F.when(F.col("stays"), F.col("value")).otherwise(0.0).alias("value"))


def _deviation(x: DataFrame) -> DataFrame:
    """(run_id, mad): the median absolute deviation from the run's median; a run may have any number of values."""
    mid = medians(x, ["run_id"], name="mid")
    # run ids are run-NN: at most 100 rows
    return medians(x.join(small(mid, 200), "run_id"), ["run_id"], F.abs(F.col("value") - F.col("mid")), "mad")


def noise_by_run(coef: DataFrame, finest: DataFrame | None = None) -> DataFrame:
    """(run_id, sigma, n): noise from the median absolute deviation of the finest coefficients, and their number."""
    x = finest if finest is not None else coef
    mad = _deviation(x)
    n = coef.groupBy("run_id").agg(F.count("*").alias("n"), F.avg(F.col("value") * F.col("value")).alias("mean_square"))
    return mad.join(n, "run_id").select("run_id", noise_sigma(F.col("mad")).alias("sigma"), "n", "mean_square")


def shrink(coef: DataFrame, kind: str, value: float | None = None, finest: DataFrame | None = None) -> DataFrame:
    """hard or soft at a value (or the universal threshold), adaptive, sure (soft, universal), bayes_shrink."""
    if kind == "none":
        return coef
    if kind == "hard" and value is not None:
        return coef.withColumn("value", below_to_zero(F.col("value"), value))
    if kind == "soft" and value is not None:
        return coef.withColumn("value", soft(F.col("value"), F.lit(float(value))))
    rows = coef.join(F.broadcast(noise_by_run(coef, finest)), "run_id")  # a row a run
    if kind == "bayes_shrink":
        thr = bayes_threshold(F.col("sigma"), F.col("mean_square"))
    elif kind in ("soft", "hard", "adaptive", "sure"):
        thr = universal_threshold(F.col("sigma"), F.col("n"))
    else:
        raise InvalidInput(f"unknown shrinkage {kind!r}", "shrink")
    new = hard(F.col("value"), thr) if kind == "hard" else soft(F.col("value"), thr)
    return rows.select(*[c for c in coef.columns if c != "value"], F.when(F.col("sigma") > 0, new).otherwise(F.col("value")).alias("value"))


def fdr_cuts(coef: DataFrame, sigma: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg over the coefficients of each run: (run_id, cut), the smallest |value| / sigma that is significant; sigma: (run_id, sigma).

    p-values fall as |value| rises, so the rank test needs, for each distinct |value|, only the number of the run's values
    at least as large: a sum within the range that it was dealt to, and the sums of the ranges before. Runs without noise or without anything significant are absent.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def p_value(z):
        return z.map(normal_tail)

    rows = coef.join(small(sigma.select("run_id", "sigma"), 2 * sigma.count()), "run_id").where("sigma > 0")
    distinct = rows.groupBy("run_id", (F.abs("value") / F.col("sigma")).alias("z")).agg(F.count("*").alias("m"))
    dealt, _ = as_table(distinct.repartitionByRange(F.col("run_id"), F.desc("z")).withColumn("part", F.spark_partition_id()))
    # a row a run and range
    sizes = dealt.groupBy("run_id", "part").agg(F.sum("m").alias("size"))
    run = Window.partitionBy("run_id")
    sizes = sizes.select("run_id", "part", (F.sum("size").over(run.orderBy("part")) - F.col("size")).alias("before"), F.sum("size").over(run).alias("total"))
    within = Window.partitionBy("run_id", "part").orderBy(F.desc("z")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.join(sizes, ["run_id", "part"]).withColumn("rank", F.sum("m").over(within) + F.col("before"))
    return ranked.where(p_value("z") <= alpha * F.col("rank") / F.col("total")).groupBy("run_id").agg(F.min("z").alias("cut"))


def fdr_by_run(coef: DataFrame, sigma: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Zeroes what isn't significant among its run's coefficients, at the run's own noise; runs without noise stay as they are."""
    known, _ = as_table(sigma.select("run_id", "sigma"))
    cuts = known.join(fdr_cuts(coef, known, alpha), "run_id", "left")
    rows = coef.join(small(cuts, 3 * known.count()), "run_id", "left")
    stays = F.coalesce(F.col("sigma") <= 0, F.lit(True)) | F.coalesce(F.abs("value") / F.col("sigma") >= F.col("cut"), F.lit(False))
    return rows.select(*[c for c in coef.columns if c != "value"], F.when(stays, F.col("value")).otherwise(0.0).alias("value"))


def fdr(coef: DataFrame, sigma: float, alpha: float = 0.05) -> DataFrame:
    """As fdr_by_run with one noise level, over the coefficients of all runs together."""
    pooled = coef.withColumn("own", F.col("run_id")).withColumn("run_id", F.lit(""))
    level = coef.sparkSession.createDataFrame([("", float(sigma))], "run_id string, sigma double")
    return fdr_by_run(pooled, level, alpha).withColumn("run_id", F.col("own")).select(*coef.columns)


def _series_kernel(df: DataFrame, schema: str, kernel) -> DataFrame:
    """Runs a numpy kernel (matrix with time in rows -> dict of arrays) on batches of whole series."""
    packed = df.groupBy("run_id", "vox").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "value"))), lambda s: s["value"]).alias("series"))

    def run(batches):
        for b in batches:
            by: dict[int, list[int]] = {}
            for i, n in enumerate(b.column(2).value_lengths().to_pylist()):
                by.setdefault(n, []).append(i)
            for at in by.values():
                part = b.take(pa.array(at))
                x = np.stack([np.array(s) for s in part.column(2).to_pylist()], axis=1)
                yield kernel(part.column(0), part.column(1), x)

    return packed.mapInArrow(run, schema)


def modwt_project(df: DataFrame, wavelet: str = "sym8", levels: int | None = None, boundary: str = "periodic") -> DataFrame:
    """(run_id, vox, band, level, t, value): details W and approximations V of every level."""

    def kernel(run_ids, vox, x):
        j = bases.modwt_levels(len(x), wavelet, levels)
        details, approx = bases.modwt(x, wavelet, j, boundary)
        n, m = details[0].shape
        bands = [("W", k, a) for k, a in enumerate(details, 1)] + [("V", k, a) for k, a in enumerate(approx, 1)]
        count = len(bands) * n
        return pa.record_batch(
            [
                pa.array(np.repeat(np.array(run_ids.to_pylist(), object), count)),
                pa.array(np.repeat(vox.to_numpy(), count), pa.int32()),
                pa.array(np.tile(np.repeat([b for b, _, _ in bands], n), m)),
                pa.array(np.tile(np.repeat(np.array([k for _, k, _ in bands], np.int32), n), m)),
                pa.array(np.tile(np.arange(n, dtype=np.int32), m * len(bands))),
                pa.array(np.stack([a for _, _, a in bands]).transpose(2, 0, 1).ravel()),
            ],
            names=["run_id", "vox", "band", "level", "t", "value"],
        )

    return _series_kernel(df, "run_id string, vox int, band string, level int, t int, value double", kernel)


def modwt_reconstruct(coef: DataFrame, n_time: int, wavelet: str = "sym8", boundary: str = "periodic") -> DataFrame:
    """The series from the details and the last approximation."""
    at = F.struct("band", "level", "t", "value")
    packed = coef.groupBy("run_id", "vox").agg(F.sort_array(F.collect_list(at)).alias("c"))

    def run(batches):
        for b in batches:
            for r, v, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                levels = max(x["level"] for x in c)
                n = len(c) // (2 * levels)
                values = np.array([x["value"] for x in c]).reshape(2, levels, n)  # V sorts before W
                x = bases.imodwt(list(values[1]), values[0][-1], wavelet)[:n_time]
                yield pa.record_batch([pa.array([r] * n_time), pa.array(np.arange(n_time, dtype=np.int32)), pa.array([v] * n_time, pa.int32()), pa.array(x)], names=["run_id", "t", "vox", "value"])

    return packed.mapInArrow(run, "run_id string, t int, vox int, value double")


def modwt_shrink(coef: DataFrame, kind: str, alpha: float = 0.05, voxels: int = 10, value: float | None = None, name: str = "value") -> DataFrame:
    """Shrinks every detail level of every series; one noise level from the finest details of the first voxels. soft and hard may have a value instead.

    With another name, the new values are a column of it beside the old ones (not for fdr).
    """
    if name != "value" and kind == "fdr":
        raise InvalidInput("fdr has no second column", "modwt_shrink")
    if kind in ("soft", "hard") and value is not None:
        new = below_to_zero(F.col("value"), value) if kind == "hard" else soft(F.col("value"), F.lit(float(value)))
        return coef.withColumn(name, F.when(F.col("band") == "W", new).otherwise(F.col("value")))
    finest = coef.where((F.col("band") == "W") & (F.col("level") == 1) & (F.col("vox") < voxels))
    if kind == "none":
        return coef.withColumn(name, F.col("value"))
    sigma = _deviation(finest).select("run_id", noise_sigma(F.col("mad")).alias("sigma"))
    if kind == "fdr":
        return fdr_by_run(coef.where("band = 'W'"), sigma, alpha).unionByName(coef.where("band = 'V'"))
    by = Window.partitionBy("run_id", "vox", "band", "level")
    rows = coef.join(F.broadcast(sigma), "run_id").withColumn("n", F.count("*").over(by)).withColumn("ms", F.avg(F.col("value") * F.col("value")).over(by))
    thr = bayes_threshold(F.col("sigma"), F.col("ms")) if kind == "bayes_shrink" else universal_threshold(F.col("sigma"), F.col("n"))
    new = hard(F.col("value"), thr) if kind == "hard" else soft(F.col("value"), thr)
    new = F.when((F.col("band") == "W") & (F.col("sigma") > 0), new).otherwise(F.col("value"))
    return rows.withColumn(name, new).select(*coef.columns, *([name] if name != "value" else []))


def denoise(df: DataFrame, n_time: int, kind: str = "dct", n_basis: int | None = None, threshold: str = "none", value: float | None = None, keep: float = 0.99, **parameters) -> tuple[DataFrame, dict]:
    """Projects, shrinks and reconstructs; also the compression ratio of the coefficients.

    The ratio is (T * V) / (K * V + T * K) per run of V voxels.
    """
    n_basis = n_basis or bases.default_components(kind, n_time, denoise=True)
    basis = bases.basis_matrix(kind, n_time, n_basis, **parameters)
    coef = project(df, basis) if kind != "bspline" else project_least_squares(df, basis)
    coef = energy_threshold(coef, keep) if threshold == "energy" else shrink(coef, threshold, value)
    k = basis.shape[1]
    voxels = df.select("vox").distinct().count()
    return reconstruct(coef, basis), {"n_basis": k, "compression_ratio": n_time * voxels / (k * voxels + n_time * k), "coefficients": coef}


def residual_stats(df: DataFrame, approx: DataFrame, coef: DataFrame) -> DataFrame:
    """By run: residual energy, its share, number and percentage of zero coefficients."""
    both = df.join(approx.withColumnRenamed("value", "fit"), ["run_id", "t", "vox"])
    d = F.col("value") - F.col("fit")
    left = both.groupBy("run_id").agg(F.sum(d * d).alias("residual_energy"), (F.sum(d * d) / F.sum(F.col("value") * F.col("value"))).alias("residual_share"))
    zeros = coef.groupBy("run_id").agg(F.count_if(F.col("value") == 0).alias("n_zero"), (100 * F.count_if(F.col("value") == 0) / F.count("*")).alias("sparsity_pct"))
    return left.join(zeros, "run_id")
