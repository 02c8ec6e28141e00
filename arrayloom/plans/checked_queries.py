"""Queries on what has no closed form in SQL, as properties that SQL can state: bounds on errors, orthonormality,
identities that must hold, and figures of the input that have to come out unchanged.

Each calls the operator on the whole table; a column "within" says whether a bound holds in every row of a group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions import bases
from ..model import ArrayFrame, from_numpy, matrix, to_numpy
from ..operators import linalg, pursuit, sparse_pca, spatial, subset, temporal
from ..sources import archive, layout
from . import pipeline as forms
from .archive_queries import _frame, _work
from .kernel_queries import _COEF, _GAUSS, _atoms, _coef
from .pipeline import Pipeline
from .tables import EMBEDDING_DIMS, EMBEDDINGS, EVENTS, N_DAYS, VOLUME, embeddings, event_series, mask, query, rounded, space, table, volume

_RUNS = f"WITH {EMBEDDINGS} SELECT run_id, count(*) AS n, true AS within FROM m GROUP BY run_id"


def _agreement(df, back, bound: float):
    """By run: how many values come back, and whether all differ by at most bound."""
    # the optimiser takes what tasks return from few packed rows for small, and would broadcast it
    both = df.hint("merge").join(back.select("run_id", "t", "vox", F.col("value").alias("back")), ["run_id", "t", "vox"])
    return both.groupBy("run_id").agg(F.count("*").alias("n"), (F.max(F.abs(F.col("value") - F.col("back"))) <= bound).alias("within"))


# ---- archives ------------------------------------------------------------------------------------


@query(f"WITH {EMBEDDINGS} SELECT run_id, count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM m GROUP BY run_id")
def archive_plain_values(spark, sf_dir):
    """Without steps, the values that were written."""
    back = archive.read_archive(spark, archive.write_archive(_frame(spark, sf_dir), _work(spark)))
    return rounded(back.groupBy("run_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total")


@query(f"WITH {EMBEDDINGS} SELECT t, vox, round(value, 9) + 0.0 AS value FROM m WHERE run_id = 'run-02' AND vox IN (1, 5, 9) AND t < 300")
def archive_lazy_reader(spark, sf_dir):
    """A reader whose selection is set in two steps."""
    path = archive.write_archive(_frame(spark, sf_dir), _work(spark))
    reader = archive.read_archive(spark, path, "run-02", lazy=True)
    return rounded(reader.subset(roi=[1, 5, 9]).subset(times=range(300)).data().select("t", "vox", "value"), "value", digits=9)


@query(_RUNS)
def archive_roundtrip(spark, sf_dir):
    """All components, their projection and 12-bit codes: no value is off by more than 0.05."""
    frame = _frame(spark, sf_dir)
    path = Pipeline(frame).pca(k=64).embed().quant(bits=12, scale_scope="voxel").write(_work(spark), checksum="sha256")
    return _agreement(frame.df, archive.read_archive(spark, path), 0.05)


@query("SELECT 0::BIGINT AS issues, true AS told")
def validate_archive(spark, sf_dir):
    """A sound archive has no issues; with other values under the same name it has."""
    path = archive.write_archive(_frame(spark, sf_dir), _work(spark), ["quant"], checksum="sha256")
    sound = archive.issues_table(spark, path).agg(F.count("*").alias("issues"))
    other = archive.write_archive(_frame(spark, sf_dir), _work(spark), ["quant"], checksum="sha256")
    embeddings(spark, sf_dir).limit(1).write.mode("append").parquet(f"{other}/data/extra")
    return sound.withColumn("told", F.lit(bool(archive.validate_archive(spark, other, strict=False))))


@query(f"WITH {EVENTS} SELECT run_id, count(*) AS n, true AS within FROM m GROUP BY run_id")
def temporal_archive(spark, sf_dir):
    """Slepian coefficients through an archive give what they give in memory."""
    df = event_series(spark, sf_dir)
    frame = ArrayFrame(df, (int(df.agg(F.max("vox")).first()[0]) + 1, 1, 1), N_DAYS, rank=4)
    path = Pipeline(frame).temporal(kind="dpss", n_basis=6).write(_work(spark))
    basis = bases.basis_matrix("dpss", N_DAYS, 6)
    direct = temporal.reconstruct(temporal.project(df, basis), basis)
    here = df.select("run_id", "t", "vox").join(direct, ["run_id", "t", "vox"])
    return _agreement(here, archive.read_archive(spark, path), 1e-6)


@query("SELECT k::INT AS component, true AS within FROM range(4) r(k)")
def empirical_hrbf_compress(spark, sf_dir):
    """A basis coded on a radial dictionary: every component has atoms, with codes of 5 bits at most."""
    path = Pipeline(_frame(spark, sf_dir)).pca(k=6).add_step("basis.empirical_hrbf_compressed", {"basis_path": "00_basis/matrix", "svd_rank": 4, "sigma0": 2.0, "levels": 1}).write(_work(spark))
    codes = archive.load_dataset(spark, path, "01_basis.empirical_hrbf_compressed/hrbf_codes")
    return codes.groupBy(F.col("component").cast("int").alias("component")).agg((F.max(F.abs("q")).between(1, 15)).alias("within"))


@query("SELECT k::INT AS k, true AS within FROM range(5) r(k)")
def transfer_basis_embed(spark, sf_dir):
    """Coefficients on a basis from another archive are those on the basis itself."""
    frame = _frame(spark, sf_dir)
    source = Pipeline(frame).pca(k=5).write(_work(spark))
    path = Pipeline(frame).add_step("embed.transfer_hrbf_basis", {"source_archive": source, "source_descriptor": "00_basis"}).write(_work(spark))
    basis = linalg.pack(archive.load_basis(spark, source, "00_basis"), "vox", 5)
    direct = linalg.unpacked(linalg.project(frame.df, basis, "vox", 5)).select("run_id", "t", "k", F.col("value").alias("direct"))
    both = archive.stored_values(spark, path).withColumnRenamed("vox", "k").join(direct, ["run_id", "t", "k"])
    return both.groupBy("k").agg((F.max(F.abs(F.col("value") - F.col("direct"))) < 1e-6).alias("within"))


@query("""WITH a AS (SELECT count(*) AS n FROM part WHERE p_size > 10), b AS (SELECT (p_partkey // 50)::INT AS block, min(p_partkey) AS lo, max(p_partkey) AS hi FROM part GROUP BY 1)
SELECT block, (lo - 10)::BIGINT AS first, hi::BIGINT AS last, lo - 10 >= 1 AND hi <= (SELECT n FROM a) AS valid FROM b""")  # fmt: skip
def block_table_validate(spark, sf_dir):
    """The valid rows pass the check together; one row that isn't makes it fail."""
    kept = mask(spark, sf_dir)
    frame = ArrayFrame(volume(spark, sf_dir), space(spark, sf_dir), 1, mask=kept, rank=4)
    blocks = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 50).cast("int").alias("block")).agg((F.min("p_partkey") - 10).alias("first"), F.max("p_partkey").alias("last"))
    active = kept.count()
    valid = (F.col("first") >= 1) & (F.col("last") <= active)
    passed = archive.check_blocks(blocks.where(valid).select("first", "last"), frame).withColumn("valid", F.lit(True))
    wrong = blocks.where(~valid)
    try:
        archive.check_blocks(wrong.select("first", "last"), frame)
        found = wrong.limit(0)
    except ValidationError:
        found = wrong
    return blocks.join(passed.select(F.col("first").cast("long"), F.col("last").cast("long"), "valid").distinct(), ["first", "last"]).unionByName(found.withColumn("valid", F.lit(False))).select("block", "first", "last", "valid")


# ---- components ----------------------------------------------------------------------------------


@query(f"WITH {EMBEDDINGS}, c AS (SELECT value - avg(value) OVER (PARTITION BY vox) AS x FROM m) SELECT k::INT AS k, (SELECT round(sum(x * x), 4) + 0.0 FROM c) AS total, true AS within FROM range(1, 9) r(k)")
def pca_fit_reconstruct(spark, sf_dir):
    """Errors of reconstructions from 1 to 8 components are those that the singular values promise."""
    e = embeddings(spark, sf_dir)
    d = linalg.decompose(e, 64, 8)
    mu = e.groupBy("vox").agg(F.avg("value").alias("mu"))
    centred = e.join(subset.small(mu, 2 * 64), "vox").select("run_id", "t", "vox", (F.col("value") - F.col("mu")).alias("value"))
    basis = linalg.packed_basis(spark, d.loadings, "vox")
    coef = linalg.project(centred, basis, "vox", 8)
    energy = dict(linalg.unpacked(coef).groupBy("k").agg(F.sum(F.col("value") * F.col("value"))).collect())  # a row a component
    promised = d.total - np.cumsum(d.d**2)
    found = [d.total - sum(energy[j] for j in range(k + 1)) for k in range(8)]
    fit = linalg.reconstruct(coef, basis, "vox", 64).select("run_id", "t", "vox", F.col("value").alias("fit"))
    x = F.col("value") - F.col("fit")
    whole = centred.join(fit, ["run_id", "t", "vox"]).agg(F.sum(F.col("value") * F.col("value")).alias("total"), F.sum(x * x).alias("left"))
    close = 1e-6 * d.total
    rows = F.array(*(F.struct(F.lit(k + 1).alias("k"), F.lit(bool(abs(found[k] - promised[k]) < close)).alias("within")) for k in range(8)))
    all_ = F.abs(F.col("left") - float(promised[-1])) < close
    return rounded(whole.select("total", all_.alias("all"), F.explode(rows).alias("r")).select("r.k", "total", (F.col("r.within") & F.col("all")).alias("within")), "total", digits=4)


@query(f"WITH {EMBEDDINGS} SELECT 64::INT AS components, round(sum(value * value), 4) + 0.0 AS energy, true AS falling FROM m")
def svd_energy(spark, sf_dir):
    """All singular values together hold the data's energy, the first the most."""
    d = linalg.decompose(embeddings(spark, sf_dir), 64, 64, center=False)
    return rounded(spark.createDataFrame([(d.k, float((d.d**2).sum()), bool((np.diff(d.d) <= 1e-9).all()))], "components int, energy double, falling boolean"), "energy", digits=4)


@query(f"WITH {EMBEDDINGS} SELECT run_id, true AS within FROM m GROUP BY run_id")
def sparsepca_roundtrip(spark, sf_dir):
    """Sparse components of the full rank give the data back to 1 percent of their variance."""
    e = embeddings(spark, sf_dir)
    var = e.groupBy("run_id").agg(F.avg(F.col("value") * F.col("value")).alias("power"))
    fit = sparse_pca.reconstruction_error(e, 64, sparse_pca.sparse_components(e, 64, 64, 1e-3))
    return fit.join(var, "run_id").select("run_id", (F.col("mse") <= 0.01 * F.col("power")).alias("within"))


# ---- temporal bases --------------------------------------------------------------------------------

_IDENTITY = "SELECT i::INT AS i, j::INT AS j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM range({0}) a(i), range({0}) b(j)"


def _products(spark, basis: np.ndarray):
    """Inner products of a basis' columns, by a join on time."""
    rows = spark.createDataFrame([(t, k, float(x)) for (t, k), x in np.ndenumerate(basis)], "t int, k int, v double")
    left, right = rows.select(F.col("k").alias("i"), F.col("t").alias("k"), "v"), rows.select(F.col("t").alias("k"), F.col("k").alias("j"), "v")
    return rounded(linalg.matmul(left, right).select("i", "j", "v"), "v")


@query(_IDENTITY.format(5))
def dpss_basis(spark, sf_dir):
    return _products(spark, bases.basis_matrix("dpss", N_DAYS, 5, time_bandwidth_product=3.0))


@query(_IDENTITY.format(4))
def polynomial_basis(spark, sf_dir):
    return _products(spark, bases.basis_matrix("polynomial", N_DAYS, 4))


@query(f"WITH {EVENTS}, s AS (SELECT DISTINCT run_id, vox FROM m) SELECT run_id, k::INT AS k, vox, ((vox * 7 + k * 3) % 11)::DOUBLE AS value FROM s, range(8) r(k)")
def bspline_project(spark, sf_dir):
    """Splines of known coefficients, one a series of the table: least squares gives the coefficients back."""
    b = bases.basis_matrix("bspline", N_DAYS, 8, order=3)
    known = event_series(spark, sf_dir).select("run_id", "vox").distinct().crossJoin(spark.range(8).select(F.col("id").cast("int").alias("k")))
    coef = known.withColumn("value", ((F.col("vox") * 7 + F.col("k") * 3) % 11).cast("double"))
    return rounded(temporal.project_least_squares(temporal.reconstruct(coef, b), b).select("run_id", "k", "vox", "value"), "value")


def _dense_series(spark, sf_dir):
    """Event series with a 0 on days without events."""
    e = event_series(spark, sf_dir)
    full = e.select("run_id", "vox").distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(N_DAYS - 1))))
    return full.join(e.hint("merge"), ["run_id", "vox", "t"], "left").select("run_id", "t", "vox", F.coalesce("value", F.lit(0.0)).alias("value"))


_DENSE = f"{EVENTS}, s AS (SELECT DISTINCT run_id, vox FROM m), f AS (SELECT run_id, vox, t::INT AS t, coalesce(value, 0) AS value FROM (SELECT * FROM s, range({N_DAYS}) r(t)) g LEFT JOIN m USING (run_id, vox, t))"


@query(f"WITH {_DENSE} SELECT run_id, count(*) AS n, true AS within FROM f GROUP BY run_id")
def modwt_roundtrip(spark, sf_dir):
    """The transform and its inverse."""
    df = _dense_series(spark, sf_dir)
    return _agreement(df, temporal.modwt_reconstruct(temporal.modwt_project(df, "sym8"), N_DAYS, "sym8"), 1e-6)


@query(f"WITH {_DENSE} SELECT run_id, t, vox, round((value - lag(value, 1, last) OVER w) / 2, 6) + 0.0 AS value FROM (SELECT *, last_value(value) OVER (PARTITION BY run_id, vox ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM f) WINDOW w AS (PARTITION BY run_id, vox ORDER BY t)")
def modwt_haar_details(spark, sf_dir):
    """The finest Haar details are half the differences of neighbours, around the end."""
    c = temporal.modwt_project(_dense_series(spark, sf_dir), "haar", 1).where("band = 'W' AND level = 1")
    return rounded(c.select("run_id", "t", "vox", "value"), "value")


@query(f"WITH {_DENSE} SELECT run_id, band, level::INT AS level, count(*) AS n, true AS within FROM f, (VALUES ('W'), ('V')) b(band), range(1, {bases.modwt_levels(N_DAYS, 'haar') + 1}) r(level) GROUP BY ALL")
def modwt_bayes_shrink(spark, sf_dir):
    """Shrinking makes no detail larger and turns none round; approximations stay."""
    c = temporal.modwt_project(_dense_series(spark, sf_dir), "haar")
    both = temporal.modwt_shrink(c, "bayes_shrink", name="new")
    old, x = F.col("value"), F.col("new")
    fine = F.when(F.col("band") == "V", F.abs(old - x) < 1e-12).otherwise((F.abs(x) <= F.abs(old)) & (old * x >= 0))
    return both.groupBy("run_id", "band", "level").agg(F.count("*").alias("n"), F.min(fine).alias("within"))


#: Abramowitz and Stegun 7.1.26: the normal tail to 1.5e-7, enough to tell a rank's limit unless a value is at it.
_TAIL = "2 * 0.5 * (0.254829592 * q - 0.284496736 * q * q + 1.421413741 * q * q * q - 1.453152027 * q * q * q * q + 1.061405429 * q * q * q * q * q) * exp(-z * z / 2)"


@query(f"""WITH {_COEF}, z AS (SELECT *, abs(value) / 60.0 AS z, 1 / (1 + 0.3275911 * abs(value) / 60.0 / sqrt(2.0)) AS q FROM c), p AS (SELECT *, {_TAIL} AS p, rank() OVER (ORDER BY z DESC) AS first, count(*) OVER () AS total, count(*) OVER (ORDER BY z DESC) AS rank FROM z),
cut AS (SELECT min(z) AS cut FROM p WHERE p <= 0.05 * rank / total) SELECT run_id, count(*) AS n, count(*) FILTER (z >= cut) AS kept FROM p, cut GROUP BY run_id""")  # fmt: skip
def fdr_threshold(spark, sf_dir):
    """Coefficients that are significant at a false discovery rate of 5 percent."""
    c = temporal.fdr(_coef(spark, sf_dir), 60.0, 0.05)
    return c.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") != 0).alias("kept"))


@query(f"""WITH {_COEF}, z AS (SELECT *, abs(value) / 60.0 AS z, 1 / (1 + 0.3275911 * abs(value) / 60.0 / sqrt(2.0)) AS q FROM c), p AS (SELECT *, {_TAIL} AS p, count(*) OVER (PARTITION BY run_id) AS total, count(*) OVER (PARTITION BY run_id ORDER BY z DESC) AS rank FROM z),
cut AS (SELECT run_id, min(z) AS cut FROM p WHERE p <= 0.05 * rank / total GROUP BY run_id) SELECT p.run_id, count(*) AS n, count(*) FILTER (z >= cut) AS kept FROM p LEFT JOIN cut USING (run_id) GROUP BY p.run_id""")  # fmt: skip
def fdr_threshold_by_run(spark, sf_dir):
    """Coefficients that are significant among those of their own run."""
    coef = _coef(spark, sf_dir)
    c = temporal.fdr_by_run(coef, coef.select("run_id").distinct().withColumn("sigma", F.lit(60.0)), 0.05)
    return c.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") != 0).alias("kept"))


@query(f"WITH {_DENSE} SELECT run_id, t, vox, round(value, 5) + 0.0 AS value FROM f")
def denoise_full_basis(spark, sf_dir):
    """With all cosines and no threshold, denoising changes nothing."""
    out, _ = temporal.denoise(_dense_series(spark, sf_dir), N_DAYS, "dct", n_basis=N_DAYS)
    return rounded(out.select("run_id", "t", "vox", "value"), "value", digits=5)


@query(f"WITH {EVENTS} SELECT run_id, round(sum((value - floor(value)) ** 2), 5) AS residual_energy, round(sum((value - floor(value)) ** 2) / sum(value * value), 9) AS residual_share, count(*) FILTER (floor(value) % 7 = 0) AS n_zero FROM m GROUP BY run_id")
def residual_statistics(spark, sf_dir):
    """Residual energy and its share for values cut to whole numbers."""
    e = event_series(spark, sf_dir)
    approx = e.withColumn("value", F.floor("value").cast("double"))
    coef = e.withColumn("value", F.floor("value").cast("double") % 7)
    return rounded(rounded(temporal.residual_stats(e, approx, coef), "residual_energy", digits=5), "residual_share", digits=9).select("run_id", "residual_energy", "residual_share", "n_zero")


# ---- spaces --------------------------------------------------------------------------------------


@query(
    f"""WITH RECURSIVE {VOLUME}, u AS (SELECT vox, x, y, z FROM v WHERE p_size > 35), e AS (SELECT a.vox AS a, b.vox AS b FROM u a JOIN u b ON abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1),
r(vox, root) AS (SELECT vox, vox FROM u UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.vox WHERE r.root < e.b), f AS (SELECT vox, min(root) AS root FROM r GROUP BY vox)
SELECT (dense_rank() OVER (ORDER BY root))::INT AS component, count(*) AS voxels, 0::BIGINT AS too_near, 0::BIGINT AS uncovered FROM f GROUP BY root"""
)
def poisson_disk_invariants(spark, sf_dir):
    """By component: pairs of centres nearer than the radius, and voxels that no centre is near (none of either)."""
    m, dims = mask(spark, sf_dir, 35), space(spark, sf_dir)
    at = spatial.world(spatial.poisson_disk(m, dims, 2.0, 7), dims).select("component", *(F.col(c).alias(f"b{c}") for c in ("vox", "wx", "wy", "wz")))
    labels = spatial.label_components(m, dims).select("vox", F.col("label").alias("component"))
    near = F.expr("(wx-bwx)*(wx-bwx)+(wy-bwy)*(wy-bwy)+(wz-bwz)*(wz-bwz) < 4.0")
    own = spatial.world(labels, dims)
    pairs = own.join(at, "component").groupBy("component", "vox").agg(F.count_if(near).alias("near"), F.max(F.col("vox") == F.col("bvox")).alias("centre"))
    return pairs.groupBy("component").agg(F.count("*").alias("voxels"), F.count_if(F.col("centre") & (F.col("near") > 1)).alias("too_near"), F.count_if(F.col("near") == 0).alias("uncovered"))


@query(f"WITH {_GAUSS}, p AS (SELECT k, sum(value * w) AS c FROM w2 JOIN v USING (vox) GROUP BY k) SELECT k, round(c, 4) AS c FROM p ORDER BY abs(c) DESC LIMIT 1")
def omp_first_atom(spark, sf_dir):
    """Matching pursuit with one atom takes the one of the largest product, with that weight."""
    target = volume(spark, sf_dir).select(F.lit(0).alias("component"), "vox", "value")
    return rounded(pursuit.pursue(target, _atoms(spark, sf_dir), 1e-9, 1).select("k", F.col("weight").alias("c")), "c", digits=4)


@query(f"WITH {_GAUSS}, q AS (SELECT k, vox, w, max(abs(w)) OVER (PARTITION BY k) / 15 AS scale FROM w2) SELECT k, vox, least(greatest(round_even(w / scale, 0), -15), 15)::INT AS q FROM q")
def weight_quantise(spark, sf_dir):
    """Five-bit codes of each atom's weights."""

    def codes(rows):
        q, _ = linalg.quantise_weights(rows.w.to_numpy(), 5)
        return rows[["k", "vox"]].assign(q=q.astype(np.int32))

    return _atoms(spark, sf_dir).groupBy("k").applyInPandas(codes, "k int, vox int, q int")


@query("SELECT l::INT AS level, true AS placed, true AS unit FROM range(3) r(l)")
def hrbf_level_assembly(spark, sf_dir):
    """Every level has centres, and its atoms are of unit norm over the mask."""
    m = mask(spark, sf_dir)
    atoms, centres = spatial.hrbf_basis(m, space(spark, sf_dir), {"sigma0": 4.0, "levels": 2, "radius_factor": 2.5, "seed": 3})
    norms = atoms.groupBy("k").agg(F.sum(F.col("w") * F.col("w")).alias("norm"))
    return centres.join(norms, "k").groupBy("level").agg((F.count("*") > 0).alias("placed"), (F.max(F.abs(F.col("norm") - 1)) < 1e-9).alias("unit"))


@query("SELECT 1::BIGINT AS runs, true AS own")
def space_embed_of_an_atom(spark, sf_dir):
    """A volume of one atom of the dictionary: its own coefficient is 1, no other is larger."""
    m = mask(spark, sf_dir)
    _, atoms = forms.space_embed(ArrayFrame(volume(spark, sf_dir), space(spark, sf_dir), 1, mask=m, rank=4), sigma0=4.0, levels=1)
    one = atoms.where(F.col("k") == 0).select(F.lit("run-01").alias("run_id"), F.lit(0).alias("t"), "vox", F.col("w").alias("value"))
    c = spatial.project_atoms(one, atoms)
    first = F.max(F.when(F.col("k") == 0, F.col("value")))
    return c.agg(F.countDistinct("run_id").alias("runs"), ((F.abs(first - 1) < 1e-9) & (F.max(F.abs("value")) <= 1 + 1e-9)).alias("own"))


# ---- forms of the data and of pipelines ----------------------------------------------------------------


@query(f"WITH {EMBEDDINGS}, s(ord, t) AS (VALUES (0, 5), (1, 3), (2, 3)) SELECT 'inside' AS kind, count(*) AS n FROM m JOIN s USING (t) UNION ALL SELECT 'outside', count(*) FROM m")
def time_subset_or_all(spark, sf_dir):
    """Time points that exist are selected in order, with repeats; one that doesn't selects everything."""
    e = embeddings(spark, sf_dir)
    inside, outside = subset.select_times_or_all(e, [5, 3, 3], 10**6), subset.select_times_or_all(e, [5, -1], 10**6)
    return inside.agg(F.lit("inside").alias("kind"), F.count("*").alias("n")).unionByName(outside.agg(F.lit("outside").alias("kind"), F.count("*").alias("n")))


@query(f"WITH {EMBEDDINGS}, r AS (SELECT run_id, vox, max(value) - min(value) AS r FROM m GROUP BY 1, 2) SELECT CASE WHEN stddev_samp(r) / avg(r) > 0.1 THEN 'voxel' ELSE 'global' END AS scope FROM r")
def adaptive_scale_scope(spark, sf_dir):
    return spark.createDataFrame([(forms.adaptive_scope(_frame(spark, sf_dir), 0.1),)], "scope string")


@query("SELECT * FROM (VALUES ('compress', 0::INT, 'basis'), ('compress', 1, 'embed'), ('compress', 2, 'quant'), ('denoise', 0, 'temporal'), ('full', 0, 'temporal'), ('full', 1, 'quant')) v(kind, step, type)")
def workflow_steps(spark, sf_dir):
    frame = _frame(spark, sf_dir)
    rows = [(kind, k, s.type) for kind in ("compress", "denoise", "full") for k, s in enumerate(forms.workflow(frame, kind).steps)]
    return spark.createDataFrame(rows, "kind string, step int, type string")


@query(f"WITH {EMBEDDINGS} SELECT run_id, count(DISTINCT t) AS rows, round(sum(value), 6) + 0.0 AS total FROM m GROUP BY run_id")
def matrix_form(spark, sf_dir):
    """Rows over time as arrays."""
    x = matrix(embeddings(spark, sf_dir))
    arrays = next(c for c, t in x.dtypes if t.startswith("array"))
    return rounded(x.groupBy("run_id").agg(F.count("*").alias("rows"), F.sum(F.aggregate(F.col(arrays).cast("array<double>"), F.lit(0.0), lambda a, b: a + b)).alias("total")), "total")


@query(f"WITH {VOLUME} SELECT vox, round(value, 6) AS value FROM v WHERE z < 2")
def numpy_round_trip(spark, sf_dir):
    """A block of the volume as a dense array and back."""
    v = volume(spark, sf_dir).where(F.col("vox") < 512)
    dense = to_numpy(v, (16, 16, 2), 1, "run-01")
    back = from_numpy(spark, np.asarray(dense).reshape(16, 16, 2, 1)).df.where("value IS NOT NULL AND NOT isnan(value)")
    return rounded(back.join(v.select("vox"), "vox", "left_semi").select("vox", "value"), "value")


@query("SELECT true AS within_limit, true AS covers")
def chunk_layout(spark, sf_dir):
    """Chunks of the embeddings' array keep to the target, and blocks to the space."""
    dims = (*EMBEDDING_DIMS, table(spark, sf_dir, "embeddings").count())
    chunks = layout.guess_chunks(dims, 8, 1.0)
    block = layout.auto_block_size(EMBEDDING_DIMS, 8, 128)
    fits = all(1 <= c <= d for c, d in zip(chunks, dims, strict=True)) and int(np.prod(chunks)) * 8 <= 2**20
    return spark.createDataFrame([(fits, all(all(x >= 1 for x in v) for v in block.values()))], "within_limit boolean, covers boolean")
