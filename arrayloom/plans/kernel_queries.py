"""Bases, shrinkage, products, pyramids and neighbourhoods over the driver's tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import bases
from ..functions.scalar import dct_value
from ..operators import haar, linalg, spatial, subset, temporal
from .tables import DIMS, EMBEDDINGS, EVENTS, N_DAYS, VOLUME, embeddings, event_series, mask, query, rounded, space, volume

K = 6
_PI = "pi()"


def _dct(t: str, k: str, n: int) -> str:
    return f"CASE WHEN {k} = 0 THEN sqrt(1.0 / {n}) ELSE sqrt(2.0 / {n}) END * cos({_PI} * ({t} + 0.5) * {k} / {n})"


_COEF = f"{EVENTS}, c AS (SELECT run_id, k::INT AS k, vox, sum(value * ({_dct('t', 'k', N_DAYS)})) AS value FROM m, range({K}) b(k) GROUP BY 1, 2, 3)"


def _coef(spark, sf_dir):
    return temporal.dct_project(event_series(spark, sf_dir), N_DAYS, K)


@query(f"SELECT t::INT AS t, k::INT AS k, round({_dct('t', 'k', N_DAYS)}, 9) + 0.0 AS b FROM range({N_DAYS}) a(t), range({K}) c(k)")
def dct_basis(spark, sf_dir):
    grid = spark.range(N_DAYS * K).select(F.floor(F.col("id") / K).cast("int").alias("t"), (F.col("id") % K).cast("int").alias("k"))
    return rounded(grid.select("t", "k", dct_value(F.col("t"), F.col("k"), N_DAYS).alias("b")), "b", digits=9)


@query(f"WITH {_COEF} SELECT run_id, k, vox, round(value, 5) + 0.0 AS value FROM c")
def dct_project(spark, sf_dir):
    return rounded(_coef(spark, sf_dir), "value", digits=5)


@query(f"WITH {_COEF} SELECT run_id, t::INT AS t, vox, round(sum(value * ({_dct('t', 'k', N_DAYS)})), 5) + 0.0 AS value FROM c, range({N_DAYS}) a(t) GROUP BY 1, 2, 3")
def dct_reconstruct(spark, sf_dir):
    return rounded(temporal.dct_reconstruct(_coef(spark, sf_dir), N_DAYS), "value", digits=5)


@query(
    f"""WITH {_COEF}, e AS (SELECT run_id, k, sum(value * value) AS energy FROM c GROUP BY 1, 2), r AS (SELECT *, sum(energy) OVER (PARTITION BY run_id ORDER BY energy DESC, k) AS s, sum(energy) OVER (PARTITION BY run_id) AS total FROM e),
l AS (SELECT run_id, max(energy) AS least FROM r WHERE s >= 0.9 * total GROUP BY 1) SELECT run_id, k, vox, round(CASE WHEN energy >= least THEN value ELSE 0 END, 5) + 0.0 AS value FROM c JOIN e USING (run_id, k) JOIN l USING (run_id)"""
)
def dct_energy_threshold(spark, sf_dir):
    return rounded(temporal.energy_threshold(_coef(spark, sf_dir), 0.9), "value", digits=5)


@query(f"WITH {_COEF} SELECT run_id, k, vox, round(CASE WHEN abs(value) < 50 THEN 0 ELSE value END, 5) + 0.0 AS value FROM c")
def hard_threshold(spark, sf_dir):
    return rounded(temporal.shrink(_coef(spark, sf_dir), "hard", 50.0), "value", digits=5)


_NOISE = f"""{_COEF}, d AS (SELECT run_id, median(value) AS mid FROM c GROUP BY 1), a AS (SELECT run_id, median(abs(value - mid)) * 1.4826 / 0.6745 AS sigma FROM c JOIN d USING (run_id) GROUP BY 1),
n AS (SELECT run_id, count(*) AS n, avg(value * value) AS ms FROM c GROUP BY 1), t AS (SELECT run_id, sigma, sigma * sqrt(2 * ln(n)) AS uni, sigma * sigma / (sqrt(greatest(ms - sigma * sigma, 0)) + 1e-12) AS bay FROM a JOIN n USING (run_id))"""


def _shrunk(threshold: str, soft: bool = True) -> str:
    body = f"sign(value) * greatest(abs(value) - {threshold}, 0)" if soft else f"CASE WHEN abs(value) > {threshold} THEN value ELSE 0 END"
    return f"WITH {_NOISE} SELECT run_id, k, vox, round({body}, 4) + 0.0 AS value FROM c JOIN t USING (run_id)"


@query(_shrunk("uni"))
def soft_threshold_universal(spark, sf_dir):
    return rounded(temporal.shrink(_coef(spark, sf_dir), "soft"), "value", digits=4)


@query(_shrunk("uni", soft=False))
def hard_threshold_universal(spark, sf_dir):
    return rounded(temporal.shrink(_coef(spark, sf_dir), "hard"), "value", digits=4)


@query(_shrunk("bay"))
def bayes_shrink(spark, sf_dir):
    return rounded(temporal.shrink(_coef(spark, sf_dir), "bayes_shrink"), "value", digits=4)


def _haar_of_series(rows):
    """Haar coefficients of one series, zero-padded to a power of two, numbered from fine to coarse."""
    x = rows.sort_values("t").value.to_numpy()
    x = np.concatenate([x, np.zeros((1 << (len(x) - 1).bit_length()) - len(x))])
    parts = []
    while len(x) > 1:
        parts.append((x[1::2] - x[::2]) / np.sqrt(2))
        x = (x[::2] + x[1::2]) / np.sqrt(2)
    c = np.concatenate([*parts, x])
    return pd.DataFrame({"run_id": rows.run_id.iloc[0], "k": np.arange(len(c), dtype=np.int32), "vox": rows.vox.iloc[0], "value": c})


#: Series padded with zeros to p points, a power of two; level j has p / 2^j coefficients of 2^j points each.
_HAAR = f"""WITH {EMBEDDINGS}, d AS (SELECT run_id, (row_number() OVER (PARTITION BY run_id, vox ORDER BY t) - 1)::INT AS t, vox, value FROM m),
p AS (SELECT run_id, vox, pow(2, ceil(log2(count(*))))::INT AS p FROM d GROUP BY 1, 2),
c AS (SELECT run_id, vox, p - p // pow(2, j - 1)::INT + t // pow(2, j)::INT AS k, sum(value * CASE WHEN t // pow(2, j - 1)::INT % 2 = 0 THEN -1 ELSE 1 END) / sqrt(pow(2, j)) AS value FROM d JOIN p USING (run_id, vox), range(1, 31) r(j) WHERE pow(2, j) <= p GROUP BY run_id, vox, p, j, 3
UNION ALL SELECT run_id, vox, p - 1, sum(value) / sqrt(p) FROM d JOIN p USING (run_id, vox) GROUP BY run_id, vox, p)
SELECT run_id, k, vox, round(coalesce(value, 0), 6) + 0.0 AS value FROM (SELECT run_id, vox, unnest(range(p))::INT AS k FROM p) g LEFT JOIN c USING (run_id, vox, k)"""


@query(_HAAR, name="wavelet_haar_project_whole")
@query(_HAAR)
def wavelet_haar_project(spark, sf_dir):
    """Over whole series."""
    return rounded(embeddings(spark, sf_dir).groupBy("run_id", "vox").applyInPandas(_haar_of_series, "run_id string, k int, vox int, value double"), "value", digits=6)


#: A basis that SQL can write too: 4 cosines over the 64 elements.
def _space_basis(spark, k: int = 4):
    grid = spark.range(64 * k).select(F.floor(F.col("id") / k).cast("int").alias("vox"), (F.col("id") % k).cast("int").alias("k"))
    return linalg.pack(grid.select("vox", "k", dct_value(F.col("vox"), F.col("k"), 64).alias("w")), "vox", k)


_CENTRED = f"{EMBEDDINGS}, s AS (SELECT vox, avg(value) AS mu, stddev_samp(value) AS sd FROM m GROUP BY vox), z AS (SELECT run_id, t, vox, (value - mu) / sd AS value FROM m JOIN s USING (vox))"
_EMBED = f"{_CENTRED}, c AS (SELECT run_id, t, k::INT AS k, sum(value * ({_dct('vox', 'k', 64)})) AS value FROM z, range(4) b(k) GROUP BY 1, 2, 3)"


def _standardised(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    stats = e.groupBy("vox").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"))
    return e.join(subset.small(stats, 3 * 64), "vox").select("run_id", "t", "vox", ((F.col("value") - F.col("mu")) / F.col("sd")).alias("value")), stats


@query(f"WITH {_EMBED} SELECT run_id, t, k, round(value, 6) + 0.0 AS value FROM c")
def embed_center_scale(spark, sf_dir):
    return rounded(linalg.unpacked(linalg.project(_standardised(spark, sf_dir)[0], _space_basis(spark), "vox", 4)), "value").select("run_id", "t", "k", "value")


@query(f"WITH {_EMBED} SELECT run_id, t, vox::INT AS vox, round(sum(c.value * ({_dct('vox', 'k', 64)})) * any_value(sd) + any_value(mu), 6) + 0.0 AS value FROM c, range(10) v(vx) JOIN s ON s.vox = v.vx GROUP BY 1, 2, 3")
def embed_inverse_roi(spark, sf_dir):
    z, stats = _standardised(spark, sf_dir)
    coef = linalg.project(z, _space_basis(spark), "vox", 4)
    roi = spark.range(10).select(F.col("id").cast("int").alias("vox"))
    back = linalg.reconstruct(coef, _space_basis(spark), "vox", 64, roi).join(subset.small(stats, 192), "vox")
    return rounded(back.select("run_id", "t", "vox", (F.col("value") * F.col("sd") + F.col("mu")).alias("value")), "value")


@query(f"WITH {EMBEDDINGS} SELECT a.vox AS i, b.vox AS j, round(sum(a.value * b.value), 6) + 0.0 AS v FROM m a JOIN m b USING (t) GROUP BY 1, 2", name="gram_matrix_whole")
@query(f"WITH {EMBEDDINGS} SELECT a.vox AS i, b.vox AS j, round(sum(a.value * b.value), 6) + 0.0 AS v FROM m a JOIN m b USING (t) GROUP BY 1, 2")
def gram_matrix(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return rounded(linalg.matmul(e.select(F.col("vox").alias("i"), F.col("t").alias("k"), F.col("value").alias("v")), e.select(F.col("t").alias("k"), F.col("vox").alias("j"), F.col("value").alias("v"))), "v")


@query(f"WITH {_CENTRED} SELECT run_id, t, vox, round(value, 6) + 0.0 AS value FROM z")
def whiten_columns(spark, sf_dir):
    return rounded(_standardised(spark, sf_dir)[0], "value").select("run_id", "t", "vox", "value")


def _morton_sql(x: str, y: str, z: str) -> str:
    return " | ".join(f"((({c}::BIGINT >> {k}) & 1) << {3 * k + a})" for k in range(12) for a, c in enumerate((x, y, z)))


_CODES = f"{VOLUME}, w AS (SELECT vox, x, y, z, {_morton_sql('x', 'y', 'z')} AS morton FROM v WHERE p_size > 10)"


@query(f"WITH {_CODES} SELECT vox, x, y, z, morton::BIGINT AS morton FROM w")
def morton_codes(spark, sf_dir):
    return spatial.morton_codes(mask(spark, sf_dir), DIMS).select("vox", "x", "y", "z", "morton")


@query(f"WITH {_CODES} SELECT l::INT AS level, (morton >> (3 * l)::INT)::BIGINT AS block, count(*) AS n FROM w, range(4) r(l) GROUP BY 1, 2")
def octree_counts(spark, sf_dir):
    return spatial.octree_counts(mask(spark, sf_dir), DIMS, 3)


@query(f"WITH {VOLUME} SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM v WHERE p_size > 10")
def mask_bbox(spark, sf_dir):
    return spatial.bounding_box(mask(spark, sf_dir), DIMS)


@query(f"WITH {_CODES} SELECT DISTINCT (morton >> 3)::BIGINT AS block FROM w")
def valid_finest_blocks(spark, sf_dir):
    return haar.valid_blocks(mask(spark, sf_dir), DIMS)


_LIFT = f"""{_CODES}, a1 AS (SELECT w.vox, w.morton AS code, value FROM w JOIN v USING (vox)), b1 AS (SELECT code, value, avg(value) OVER p AS mean, count(*) OVER p AS n FROM a1 WINDOW p AS (PARTITION BY code >> 3)),
a2 AS (SELECT code >> 3 AS code, avg(value) * sqrt(count(*)) AS value FROM a1 GROUP BY 1), b2 AS (SELECT code, value, avg(value) OVER p AS mean, count(*) OVER p AS n FROM a2 WINDOW p AS (PARTITION BY code >> 3)),
det AS (SELECT 1 AS level, code, (value - mean) * sqrt(n / 8.0) AS value FROM b1 UNION ALL SELECT 2, code, (value - mean) * sqrt(n / 8.0) FROM b2), root AS (SELECT code >> 3 AS code, avg(value) * sqrt(count(*)) AS value FROM a2 GROUP BY 1)"""


def _lifted(spark, sf_dir, dims=DIMS):
    return haar.analyse(volume(spark, sf_dir), mask(spark, sf_dir), dims, 2)


@query(f"WITH {_LIFT} SELECT level::INT AS level, code::BIGINT AS code, round(value, 5) + 0.0 AS value FROM det UNION ALL SELECT 0, code, round(value, 5) + 0.0 FROM root")
def haar_forward(spark, sf_dir):
    root, detail = _lifted(spark, sf_dir)
    return rounded(detail.select("level", "code", "value").unionByName(root.select(F.lit(0).alias("level"), "code", "value")), "value", digits=5)


@query(f"WITH {VOLUME} SELECT vox, round(value, 5) AS value FROM v WHERE p_size > 10")
def haar_inverse(spark, sf_dir):
    dims = space(spark, sf_dir)
    root, detail = _lifted(spark, sf_dir, dims)
    return rounded(haar.synthesise(root, detail, mask(spark, sf_dir), dims, 2).select("vox", "value"), "value", digits=5)


@query(f"WITH {_LIFT}, sd AS (SELECT 0.1 * stddev_samp(value) AS cut FROM (SELECT value FROM root UNION ALL SELECT value FROM det WHERE level = 2)) SELECT level::INT AS level, count(*) AS n, count(*) FILTER (abs(value) < cut OR value = 0) AS zeros FROM det, sd GROUP BY level")
def haar_detail_sparsify(spark, sf_dir):
    root, detail = _lifted(spark, sf_dir)
    return haar.sparsify(root, detail, 2, "relative_to_root_std", 0.1).groupBy("level").agg(F.count("*").alias("n"), F.count_if(F.col("value") == 0).alias("zeros"))


@query(
    f"""WITH {_CODES}, p AS (SELECT 1 AS level, morton AS code, row_number() OVER (ORDER BY morton) AS pos FROM w UNION ALL SELECT 2, code, row_number() OVER (ORDER BY code) FROM (SELECT DISTINCT morton >> 3 AS code FROM w)),
b AS (SELECT DISTINCT l AS level, morton >> (3 * l)::INT AS block FROM w, range(1, 3) r(l) WHERE vox < 40) SELECT p.level::INT AS level, pos::INT AS pos, code::BIGINT AS code FROM p JOIN b ON p.level = b.level AND p.code >> 3 = b.block"""
)
def roi_detail_indices(spark, sf_dir):
    m = mask(spark, sf_dir)
    return haar.needed_details(m.where("vox < 40"), m, DIMS, 2).select("level", "pos", "code")


_GRID = """n AS (SELECT a.vox, a.x, a.y, a.z, b.value, dx, dy, dz FROM v a, (SELECT x - 1 AS dx FROM range(3) t(x)) i, (SELECT x - 1 AS dy FROM range(3) t(x)) j, (SELECT x - 1 AS dz FROM range(3) t(x)) k, v b
WHERE b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz)"""
_SOBEL = f"""{VOLUME}, {_GRID}, s AS (SELECT vox, count(*) AS c, sum(value * dx * (2 - abs(dy)) * (2 - abs(dz))) AS gx, sum(value * (2 - abs(dx)) * dy * (2 - abs(dz))) AS gy, sum(value * (2 - abs(dx)) * (2 - abs(dy)) * dz) AS gz FROM n GROUP BY vox),
g AS (SELECT vox, CASE WHEN c = 27 THEN sqrt(gx * gx + gy * gy + gz * gz) ELSE 0 END AS value FROM s)"""


@query(f"WITH {_SOBEL} SELECT vox, round(value, 5) AS value FROM g")
def sobel_magnitude(spark, sf_dir):
    return rounded(spatial.sobel(volume(spark, sf_dir), space(spark, sf_dir)).select("vox", "value"), "value", digits=5)


@query(f"WITH {_SOBEL}, t AS (SELECT 1.2 * median(abs(g.value)) AS cut FROM g JOIN v USING (vox) WHERE p_size > 10) SELECT vox, g.value > cut AS edge FROM g, t")
def edge_map(spark, sf_dir):
    g = spatial.sobel(volume(spark, sf_dir), space(spark, sf_dir))
    return spatial.edge_map(g, mask(spark, sf_dir), 1.2).select("vox", "edge")


@query(
    f"""WITH RECURSIVE {VOLUME}, u AS (SELECT vox, x, y, z FROM v WHERE p_size > 35), e AS (SELECT a.vox AS a, b.vox AS b FROM u a JOIN u b ON abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1),
r(vox, root) AS (SELECT vox, vox FROM u UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.vox WHERE r.root < e.b), f AS (SELECT vox, min(root) AS root FROM r GROUP BY vox)
SELECT vox, (dense_rank() OVER (ORDER BY root))::INT AS label FROM f"""
)
def connected_components_6n(spark, sf_dir):
    return spatial.label_components(mask(spark, sf_dir, 35), space(spark, sf_dir))


_CENTRES = [(k, 0, 5.0 * (k % 3), 4.0 * (k % 4), 1.5 * k, 2.0 if k % 2 else 3.5) for k in range(6)]
_C = "c(k, level, cx, cy, cz, sigma) AS (VALUES " + ", ".join(f"({k}, {a}, {x}, {y}, {z}, {s})" for k, a, x, y, z, s in _CENTRES) + ")"


def _centres(spark):
    return spark.createDataFrame(_CENTRES, "k int, level int, cx double, cy double, cz double, sigma double").withColumn("vox", F.lit(0))


def _atoms_sql(body: str) -> str:
    return f"""{VOLUME}, {_C}, r AS (SELECT k, vox, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) / sigma AS r FROM v, c WHERE p_size > 10),
w0 AS (SELECT k, vox, {body} AS w FROM r), w1 AS (SELECT * FROM w0 WHERE abs(w) > 1e-8), w2 AS (SELECT k, vox, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM w1)"""


_GAUSS = _atoms_sql("exp(-(r * r) / 2)")
_WENDLAND = _atoms_sql("CASE WHEN r >= 1 THEN 0 ELSE pow(1 - r, 8) * (32 * r * r * r + 25 * r * r + 8 * r + 1) END")


def _atoms(spark, sf_dir, kind="gaussian"):
    return spatial.atoms(mask(spark, sf_dir), DIMS, _centres(spark), kind)


@query(f"WITH {_GAUSS} SELECT k, vox, round(w, 8) AS w FROM w2")
def hrbf_atoms_gaussian(spark, sf_dir):
    return rounded(_atoms(spark, sf_dir), "w", digits=8)


@query(f"WITH {_WENDLAND} SELECT k, vox, round(w, 8) AS w FROM w2")
def hrbf_atoms_wendland(spark, sf_dir):
    return rounded(_atoms(spark, sf_dir, "wendland_c4"), "w", digits=8)


@query(f"WITH {_GAUSS} SELECT k, round(sum(value * w), 4) AS value FROM w2 JOIN v USING (vox) GROUP BY k")
def hrbf_project(spark, sf_dir):
    return rounded(spatial.project_atoms(volume(spark, sf_dir), _atoms(spark, sf_dir)).select("k", "value"), "value", digits=4)


@query(f"WITH {_GAUSS}, p AS (SELECT k, sum(value * w) AS c FROM w2 JOIN v USING (vox) GROUP BY k) SELECT vox, round(sum(c * w), 4) AS value FROM p JOIN w2 USING (k) GROUP BY vox")
def hrbf_reconstruct(spark, sf_dir):
    a = _atoms(spark, sf_dir)
    return rounded(spatial.reconstruct_atoms(spatial.project_atoms(volume(spark, sf_dir), a), a).select("vox", "value"), "value", digits=4)


_STUDIES = [("resting", 2.0, 300), ("resting", 1.0, 200), ("task", 1.0, 400), ("task", 2.5, 120), ("event", 1.5, 40), ("event", 0.8, 12)]


@query(
    "WITH s(study, tr, n) AS (VALUES " + ", ".join(f"('{a}', {b}, {c})" for a, b, c in _STUDIES) + """), a AS (SELECT *, CASE study WHEN 'resting' THEN CASE WHEN tr >= 2 THEN 2.0 ELSE 2.5 END WHEN 'task' THEN CASE WHEN tr >= 2 THEN 3.0 ELSE 3.5 END ELSE CASE WHEN tr >= 1.5 THEN 4.0 ELSE 4.5 END END AS w FROM s),
b AS (SELECT *, greatest(1.5, least(w, n / 4.0)) AS nw FROM a) SELECT study, tr::DOUBLE AS tr, n::INT AS n, round(nw, 2)::DOUBLE AS time_bandwidth_product, greatest(1, least(round_even(0.8 * floor(2 * nw), 0), floor(2 * nw), n / 2.0))::INT AS n_basis, round(2 * nw / (n * tr), 4)::DOUBLE AS preserved_freq FROM b"""
)
def dpss_suggest(spark, sf_dir):
    rows = [(a, b, c, *(float(s[k]) if k != "n_basis" else s[k] for k in ("time_bandwidth_product", "n_basis", "preserved_freq"))) for a, b, c in _STUDIES for s in [bases.suggest_dpss(b, c, a)]]
    return spark.createDataFrame(rows, "study string, tr double, n int, time_bandwidth_product double, n_basis int, preserved_freq double")
