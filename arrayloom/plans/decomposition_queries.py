"""Queries on decompositions of a wide array and on matching pursuit with several atoms.

The wide array: a time point a month, a voxel a part, the value the quantity of line items shipped.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..model import ArrayFrame
from ..operators import blocks, linalg, pursuit, sparse_pca, spatial
from ..sources import archive
from ..sources.files import as_table
from . import pipeline as forms
from .archive_queries import _frame, _work
from .kernel_queries import _GAUSS, _atoms
from .pipeline import Pipeline
from .tables import query, rounded, table, volume

_SALES = "m AS (SELECT 'run-01' AS run_id, ((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1)::INT AS t, l_partkey::INT AS vox, sum(l_quantity)::DOUBLE AS value FROM lineitem GROUP BY ALL)"


def _sales(spark, sf_dir):
    """(frame, number of voxels)"""
    month = ((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1).cast("int")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.lit("run-01").alias("run_id"), month.alias("t"), F.col("l_partkey").cast("int").alias("vox")).agg(F.sum("l_quantity").cast("double").alias("value"))
    rows, _ = as_table(rows)
    return rows, int(rows.agg(F.max("vox")).first()[0]) + 1


@query(f"WITH {_SALES} SELECT count(DISTINCT t)::INT AS components, round(sum(value * value), 2) + 0.0 AS energy, true AS falling FROM m")
def svd_wide_energy(spark, sf_dir):
    """All singular values of more voxels than time points together hold the data's energy."""
    df, n_vox = _sales(spark, sf_dir)
    d = blocks.decomposed(df, n_vox, df.select("run_id", "t").distinct().count(), vectors=False)[0].d
    return rounded(spark.createDataFrame([(len(d), float((d**2).sum()), bool((np.diff(d) <= 0).all()))], "components int, energy double, falling boolean"), "energy", digits=2)


@query(f"""WITH {_SALES}, s AS (SELECT vox, sum(value) AS s, sum(value * value) AS q FROM m GROUP BY vox), n AS (SELECT count(DISTINCT t) AS n FROM m)
SELECT k::INT AS k, round(sum(q - s * s / n), 2) + 0.0 AS total, true AS within, true AS unit FROM s, n, range(6) r(k) GROUP BY k""")  # fmt: skip
def pca_wide_projection(spark, sf_dir):
    """What the data's projections on six loadings hold is what their singular values say, and loadings are orthonormal."""
    df, n_vox = _sales(spark, sf_dir)
    c = blocks.components(df, n_vox, 6)
    w = as_table(blocks.packed(c.blocks, n_vox, c.k))[0] if c.blocks is not None else linalg.pack(c.basis, "vox", c.k)
    means = w.join(c.mean.withColumnRenamed("value", "mu").hint("merge"), "vox").select("mu", F.posexplode("w").alias("k", "w")).groupBy("k").agg(F.sum(F.col("w") * F.col("mu")).alias("shift"))
    coef = linalg.unpacked(linalg.project(df, w, "vox", c.k)).join(F.broadcast(means), "k")
    x = F.col("value") - F.col("shift")
    promised = spark.createDataFrame([(k, float(d * d)) for k, d in enumerate(c.d)], "k int, promised double")
    pair = w.select("w", F.posexplode("w").alias("k", "u")).select("k", "u", F.posexplode("w").alias("j", "w")).groupBy("k", "j").agg(F.sum(F.col("w") * F.col("u")).alias("g"))
    unit = pair.groupBy("k").agg((F.max(F.abs(F.col("g") - F.when(F.col("k") == F.col("j"), 1.0).otherwise(0.0))) < 1e-9).alias("unit"))
    out = coef.groupBy("k").agg(F.sum(x * x).alias("found")).join(promised, "k").join(unit, "k")
    within = F.abs(F.col("found") - F.col("promised")) <= 1e-9 * c.total
    return rounded(out.select("k", F.lit(c.total).alias("total"), within.alias("within"), "unit"), "total", digits=2)


@query(f"WITH {_SALES} SELECT round(sum(value * value), 2) + 0.0 AS total, true AS falls, true AS sparse, true AS less FROM m")
def sparse_pca_wide(spark, sf_dir):
    """Six sparse components: the objective falls every round, loadings have zeros, and the fit holds some of the energy, but no more than six singular vectors do."""
    df, n_vox = _sales(spark, sf_dir)
    c = sparse_pca.sparse_components(df, n_vox, 6, 1e-3, tolerance=1e-3)
    best = float((c.singular[:6] ** 2).sum())
    # what the fit holds: products with loadings and with their least-squares projector, side by side
    both, _ = as_table(linalg.pack(c.basis.unionByName(c.projector.withColumn("k", F.col("k") + c.k)), "vox", 2 * c.k))
    products = linalg.project(df, both, "vox", 2 * c.k)
    held = products.agg(F.sum(linalg.dot(F.slice("c", 1, c.k), F.slice("c", c.k + 1, c.k)))).first()[0]
    row = (c.total, bool((np.diff(c.objective) <= 0).all()), c.zeros > 0, 0 < held <= best * (1 + 1e-9))
    return rounded(spark.createDataFrame([row], "total double, falls boolean, sparse boolean, less boolean"), "total", digits=2)


@query(f"""WITH {_GAUSS}, p AS (SELECT k, sum(value * w) AS p FROM w2 JOIN v USING (vox) GROUP BY k), g AS (SELECT a.k AS i, b.k AS j, sum(a.w * b.w) AS g FROM w2 a JOIN w2 b USING (vox) GROUP BY 1, 2),
one AS (SELECT k AS j, p AS x FROM p ORDER BY abs(p) DESC, k LIMIT 1), rest AS (SELECT p.k, p.p - x * coalesce(g, 0) AS r FROM p CROSS JOIN one LEFT JOIN g ON g.i = p.k AND g.j = one.j WHERE p.k <> one.j), two AS (SELECT k AS j FROM rest ORDER BY abs(r) DESC, k LIMIT 1),
s AS (SELECT one.j AS a, two.j AS b, (SELECT p FROM p WHERE k = one.j) AS pa, (SELECT p FROM p WHERE k = two.j) AS pb, coalesce((SELECT g FROM g WHERE i = one.j AND j = two.j), 0) AS g FROM one, two)
SELECT a AS k, 0::INT AS place, round((pa - g * pb) / (1 - g * g), 4) + 0.0 AS weight FROM s UNION ALL SELECT b, 1, round((pb - g * pa) / (1 - g * g), 4) + 0.0 FROM s""")  # fmt: skip
def omp_two_atoms(spark, sf_dir):
    """Matching pursuit with two atoms: their weights are the least squares of both."""
    target = volume(spark, sf_dir).select(F.lit(0).alias("component"), "vox", "value")
    return rounded(pursuit.pursue(target, _atoms(spark, sf_dir), 1e-9, 2).select("k", "place", "weight"), "weight", digits=4)


@query("SELECT k::INT AS k, true AS within FROM range(2) r(k)")
def compressed_basis_decodes(spark, sf_dir):
    """Two components of data that a radial dictionary holds, coded on it with 12 bits: what is decoded differs by 1 percent of it at most."""
    frame, dictionary = _frame(spark, sf_dir), {"sigma0": 1.0, "levels": 0}
    coef, atoms = forms.space_embed(frame, **dictionary)
    smooth = ArrayFrame(spatial.reconstruct_atoms(coef, atoms), frame.dims, frame.n_time, rank=4)
    step = {"basis_path": "00_basis/matrix", "svd_rank": 2, "omp_quant_bits": 12, "omp_tol": 1e-4} | dictionary
    path = Pipeline(smooth).pca(k=2).add_step("basis.empirical_hrbf_compressed", step).write(_work(spark))
    coded, real = archive.load_basis(spark, path, "01_basis.empirical_hrbf_compressed").withColumnRenamed("w", "c"), archive.load_basis(spark, path, "00_basis")
    both = real.join(coded, ["k", "vox"], "full").select("k", F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("c", F.lit(0.0)).alias("c"))
    left = F.sum((F.col("w") - F.col("c")) ** 2) <= 1e-4 * F.sum(F.col("w") ** 2)
    return both.groupBy("k").agg(left.alias("within"))
