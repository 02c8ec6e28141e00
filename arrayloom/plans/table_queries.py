"""Queries on tables for what earlier only unit tests saw: bases, archives without a path, reports, progress, workflows,
registered steps, and the distributed forms of operators that small inputs give to one task."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bases
from ..model import ArrayFrame, Handle, check_finite, promoted_dims
from ..operators import spatial, temporal
from ..options import Parameter, option, set_options
from ..sources import archive
from . import pipeline as forms
from . import registry
from .archive_queries import _frame, _work
from .checked_queries import _DENSE, _RUNS, _agreement, _dense_series
from .kernel_queries import _SOBEL
from .pipeline import Pipeline
from .steps import Result
from .tables import EMBEDDINGS, EVENTS, N_DAYS, ORACLES, embeddings, event_series, mask, query, rounded, space, table, volume

# ---- temporal bases --------------------------------------------------------------------------------

#: Four taps from their rule; the detail filter mirrors them.
_D4 = "g AS (SELECT [(1 + sqrt(3)) / (4 * sqrt(2)), (3 + sqrt(3)) / (4 * sqrt(2)), (3 - sqrt(3)) / (4 * sqrt(2)), (1 - sqrt(3)) / (4 * sqrt(2))] AS g)"


@query(f"""WITH {_D4}, e AS (SELECT printf('run-%02d', label + 1) AS run_id, vec_id::INT AS vox, embedding AS x FROM embeddings)
SELECT run_id, k::INT AS k, vox, round(list_sum(list_transform(range(4), lambda j: g[4 - j] * (CASE WHEN j % 2 = 0 THEN 1 ELSE -1 END) * x[(2 * k + 1 - j + 64) % 64 + 1]::DOUBLE)), 6) + 0.0 AS value FROM e, g, range(32) r(k)""")  # fmt: skip
def wavelet_d4_details(spark, sf_dir):
    """The finest details of vectors, as series over their elements, on the periodic basis of four taps."""
    turned = embeddings(spark, sf_dir).select("run_id", F.col("vox").alias("t"), F.col("t").alias("vox"), "value")
    c = temporal.project(turned, bases.basis_matrix("wavelet", 64, 64, wavelet="d4"))
    return rounded(c.where("k < 32").select("run_id", "k", "vox", "value"), "value")


@query(f"WITH {EMBEDDINGS} SELECT run_id, t AS vox, round(sum(value * value), 5) + 0.0 AS energy FROM m GROUP BY run_id, t")
def wavelet_d8_energy(spark, sf_dir):
    """All coefficients on the basis of eight taps hold the energy of each series: the basis is orthogonal."""
    turned = embeddings(spark, sf_dir).select("run_id", F.col("vox").alias("t"), F.col("t").alias("vox"), "value")
    c = temporal.project(turned, bases.basis_matrix("wavelet", 64, 64, wavelet="db8"))
    return rounded(c.groupBy("run_id", "vox").agg(F.sum(F.col("value") * F.col("value")).alias("energy")), "energy", digits=5)


@query(f"""WITH {_DENSE}, c AS (SELECT run_id, vox, sum(value) / sqrt({N_DAYS}.0) AS c0, sum(value * (t - {(N_DAYS - 1) / 2})) / sqrt({N_DAYS * (N_DAYS**2 - 1) / 12}) AS c1 FROM f GROUP BY run_id, vox)
SELECT run_id, 0::INT AS k, vox, round(c0, 6) + 0.0 AS value FROM c UNION ALL SELECT run_id, 1, vox, round(c1, 6) + 0.0 FROM c""")  # fmt: skip
def polynomial_project(spark, sf_dir):
    """Mean and slope of each series, as coefficients on orthonormal polynomials."""
    c = temporal.project(_dense_series(spark, sf_dir), bases.basis_matrix("polynomial", N_DAYS, 2))
    return rounded(c.select("run_id", "k", "vox", "value"), "value")


@query(f"""WITH {EVENTS}, n AS (SELECT run_id, count(DISTINCT t) AS n FROM m GROUP BY run_id), w AS (SELECT run_id, n, greatest(1.5, least(2.0, n / 4.0)) AS nw FROM n)
SELECT run_id, n, round(nw, 2) AS product, greatest(1, least(round_even(0.8 * floor(2 * nw), 0), floor(2 * nw), n / 2.0))::INT AS n_basis FROM w""")  # fmt: skip
def dpss_advice_by_run(spark, sf_dir):
    """Slepian parameters for the length of each run at a repetition time of two seconds."""
    rows = event_series(spark, sf_dir).groupBy("run_id").agg(F.countDistinct("t").alias("n")).collect()  # a row a run
    advice = [(r.run_id, r.n, bases.suggest_dpss(2.0, r.n, "resting")) for r in rows]
    return spark.createDataFrame([(i, n, float(a["time_bandwidth_product"]), a["n_basis"]) for i, n, a in advice], "run_id string, n long, product double, n_basis int")


# ---- archives ------------------------------------------------------------------------------------


@query(f"WITH {EMBEDDINGS} SELECT run_id, count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM m GROUP BY run_id")
def archive_without_path(spark, sf_dir):
    """An archive that is told no path is read back from where it went."""
    back = archive.read_archive(spark, archive.write_archive(_frame(spark, sf_dir)))
    return rounded(back.groupBy("run_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total")


@query(f"""WITH {EMBEDDINGS}, s AS (SELECT run_id, min(value) AS lo, max(value) AS hi, avg(value) AS mean FROM m GROUP BY run_id), p AS (SELECT run_id, mean, greatest(abs(lo - mean), abs(hi - mean)) AS reach FROM s)
SELECT (round_even((value - (mean - reach)) / (2 * reach / 15), 0))::INT AS q, count(*) AS n FROM m JOIN p USING (run_id) GROUP BY 1""")  # fmt: skip
def archive_report_histogram(spark, sf_dir):
    """The histogram of codes in a step's report, read from the archive."""
    path = archive.write_archive(_frame(spark, sf_dir), _work(spark), [("quant", {"bits": 4})])
    counts = archive.transform_report(spark, path, 0)["histogram"]
    return spark.createDataFrame([(k, n) for k, n in enumerate(counts) if n], "q int, n long")


@query("SELECT * FROM (VALUES (1::INT, 3::INT, '00_quant/quant_params', true), (2, 3, 'masks/voxels', true), (3, 3, 'scans/values', true)) v(done, of_all, name, unpublished)")
def archive_progress(spark, sf_dir):
    """What is told while an archive is written, and that none of it can be seen at its path before the end."""
    rows, path = [], _work(spark)
    frame = _frame(spark, sf_dir)
    masked = ArrayFrame(frame.df, frame.dims, frame.n_time, frame.df.select("vox").distinct(), rank=4)

    def progress(done, of_all, name):
        rows.append((done, of_all, name, not archive.files.exists(spark, path)))

    archive.write_archive(masked, path, ["quant"], progress=progress)
    names = sorted(r[2] for r in rows)
    return spark.createDataFrame([(k + 1, of_all, n, all(r[3] for r in rows)) for k, (n, of_all) in enumerate(zip(names, [r[1] for r in rows], strict=True))], "done int, of_all int, name string, unpublished boolean")


@query(f"WITH {EMBEDDINGS} SELECT count(*) AS n, 'S1' AS subject, 'embeddings' AS tool_source FROM m")
def archive_header_and_plugins(spark, sf_dir):
    """Header and plugin sections come back with the values."""
    path = archive.write_archive(_frame(spark, sf_dir), _work(spark), header={"subject": "S1"}, plugins={"tool": {"source": "embeddings"}})
    m = archive.manifest(spark, path)
    return archive.stored_values(spark, path).agg(F.count("*").alias("n")).select("n", F.lit(m["header"]["subject"]).alias("subject"), F.lit(m["plugins"]["tool"]["source"]).alias("tool_source"))


# ---- pipelines -----------------------------------------------------------------------------------


@query(_RUNS)
def workflow_compress_result(spark, sf_dir):
    """The compressing workflow with all components and 12 bits: no value is off by more than 0.05."""
    frame = _frame(spark, sf_dir)
    path = forms.workflow(frame, "compress", bits=12, k=64).write(_work(spark))
    return _agreement(frame.df, archive.read_archive(spark, path), 0.05)


@query(f"WITH {EMBEDDINGS} SELECT run_id, round(sum(value) * 3, 5) + 0.0 AS stored, round(sum(value), 5) + 0.0 AS back FROM m GROUP BY run_id")
def registered_step(spark, sf_dir):
    """A step that a user registers runs forward when written and back when read."""
    by = lambda c: c.parameters["by"]
    forward, inverse = lambda c, df: Result(df.withColumn("value", F.col("value") * by(c))), lambda c, df: df.withColumn("value", F.col("value") / by(c))
    registry.register_transform("example.times", forward, inverse, parameters={"by": Parameter(3.0)}, force=True)
    path = Pipeline(_frame(spark, sf_dir)).add_step("example.times", {}).write(_work(spark))
    stored = archive.stored_values(spark, path).groupBy("run_id").agg(F.sum("value").alias("stored"))
    back = archive.read_archive(spark, path).groupBy("run_id").agg(F.sum("value").alias("back"))
    return rounded(stored.join(back, "run_id"), "stored", "back", digits=5)


@query("SELECT count(*) AS n, 4::INT AS rank, 'series' AS first_key FROM lineitem")
def promoted_series(spark, sf_dir):
    """A series of one dimension becomes an array of four; intermediate results are found by the first name that is there."""
    price = table(spark, sf_dir, "lineitem").select(F.lit("run-01").alias("run_id"), F.col("l_linenumber").alias("t"), F.col("l_orderkey").alias("vox"), check_finite(F.col("l_extendedprice").cast("double")).alias("value"))
    key, df = Handle({"series": price}).pull_first("absent", "series")
    return df.where("value IS NOT NULL").agg(F.count("*").alias("n")).select("n", F.lit(len(promoted_dims((5,)))).alias("rank"), F.lit(key).alias("first_key"))


# ---- distributed forms ---------------------------------------------------------------------------


@query(f"WITH {_SOBEL} SELECT vox, round(value, 5) AS value FROM g")
def sobel_by_windows(spark, sf_dir):
    """The gradient's form for volumes that no task can hold."""
    return rounded(spatial.sobel_by_windows(volume(spark, sf_dir), space(spark, sf_dir)).select("vox", "value"), "value", digits=5)


@query(ORACLES["connected_components_6n"])
def connected_components_by_rounds(spark, sf_dir):
    """Components by rounds of joins, as for masks that no task can hold."""
    held = option("kernel.max_series")
    set_options({"kernel.max_series": 0})
    try:
        return spatial.label_components(mask(spark, sf_dir, 35), space(spark, sf_dir))
    finally:
        set_options({"kernel.max_series": held})


@query(f"WITH {EVENTS} SELECT run_id, count(*) AS n, round(median(value), 6) + 0.0 AS mid FROM m GROUP BY run_id")
def run_medians_by_ranges(spark, sf_dir):
    """Medians of runs by counts of ranges, as for runs that no task can hold."""
    from ..operators import ranks

    e = event_series(spark, sf_dir)
    mid = ranks.medians(e, ["run_id"], name="mid", held=10)
    return rounded(e.groupBy("run_id").agg(F.count("*").alias("n")).join(mid, "run_id"), "mid")


@query("SELECT l_orderkey * 10 + l_linenumber AS line, (row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) - 1)::BIGINT AS place FROM lineitem")
def numbered_lines(spark, sf_dir):
    """Line items numbered by price over ranges."""
    from ..operators import ranks

    lines = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("line"))
    return ranks.numbered(lines, "l_extendedprice", "l_orderkey", "l_linenumber", name="place").select("line", "place")


