"""Selection, quantisation, differences and runs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import with_coordinates
from ..operators import codecs, quant, runs, subset
from .tables import EMBEDDING_DIMS, EMBEDDINGS, EVENTS, VOLUME, embeddings, event_series, mask, query, rounded, table, volume


@query(f"WITH {EMBEDDINGS} SELECT run_id, t, vox, vox % 8 AS x, (vox // 8) % 4 AS y, vox // 32 AS z, value FROM m")
def dense_matrix_reshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_coordinates(embeddings(spark, sf_dir), EMBEDDING_DIMS).select("run_id", "t", "vox", "x", "y", "z", "value")


@query(f"WITH {EMBEDDINGS} SELECT * FROM m WHERE vox < 16 AND vox % 2 = 0")
def roi_subset(spark, sf_dir):
    roi = spark.range(8).select((F.col("id") * 2).cast("int").alias("vox"))
    return subset.select_voxels(embeddings(spark, sf_dir), roi)


@query(f"WITH {EMBEDDINGS}, s(ord, t) AS (VALUES (0, 5), (1, 3), (2, 3), (3, 11)) SELECT run_id, s.ord, t, vox, value FROM m JOIN s USING (t)")
def time_subset_ordered(spark, sf_dir):
    return subset.select_times(embeddings(spark, sf_dir), [5, 3, 3, 11])


@query(f"WITH {EMBEDDINGS} SELECT run_id, count(*) AS n, round(sum(value), 6) AS total FROM m WHERE run_id LIKE 'run-0_' GROUP BY 1")
def run_glob_select(spark, sf_dir):
    picked = subset.select_runs(embeddings(spark, sf_dir), "run-0?")
    return rounded(picked.groupBy("run_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total")


@query("WITH r AS (SELECT DISTINCT printf('run-%02d', label + 1) AS run_id FROM embeddings) SELECT run_id, run_id IN ('run-01', 'run-03', 'run-99') AS asked FROM r UNION SELECT 'run-99', TRUE WHERE FALSE")
def run_set_operations(spark, sf_dir):
    """Which of the runs are asked for: intersection and difference with the runs there are."""
    there = table(spark, sf_dir, "embeddings").select(F.format_string("run-%02d", F.col("label") + 1).alias("run_id")).distinct()
    asked = spark.createDataFrame([("run-01",), ("run-03",), ("run-99",)], "run_id string")
    both = there.intersect(asked).withColumn("asked", F.lit(True))
    return both.unionByName(there.exceptAll(asked).withColumn("asked", F.lit(False)))


@query(f"WITH {VOLUME} SELECT z, count(*) AS n, round(sum(value), 4) AS total FROM v WHERE p_size > 10 GROUP BY z")
def mask_semi_join(spark, sf_dir):
    kept = subset.select_voxels(volume(spark, sf_dir), mask(spark, sf_dir))
    return rounded(with_coordinates(kept, (16, 16, 4096)).groupBy("z").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total", digits=4)


def _codes_sql(keys: str, method: str, center: bool, bits: int, tail: str) -> str:
    top = 2**bits - 1
    if center:
        reach = "greatest(abs(lo - mu), abs(hi - mu))" if method == "range" else "3 * coalesce(sd, 0)"
        scale, offset = f"2 * ({reach}) / {top}", f"mu - ({reach})"
    elif method == "range":
        scale, offset = f"(hi - lo) / {top}", "lo"
    else:
        scale, offset = f"6 * coalesce(sd, 0) / {top}", "mu - 3 * coalesce(sd, 0)"
    return f"""WITH {EMBEDDINGS}, s AS (SELECT {keys}, min(value) AS lo, max(value) AS hi, avg(value) AS mu, stddev_samp(value) AS sd FROM m GROUP BY {keys}),
p AS (SELECT *, lo = hi OR ({scale}) = 0 AS flat FROM s), p2 AS (SELECT {keys}, flat, CASE WHEN flat THEN 1.0 ELSE {scale} END AS scale, CASE WHEN flat THEN lo ELSE {offset} END AS "offset" FROM p),
r AS (SELECT m.*, p2.scale, p2."offset", CASE WHEN flat THEN 0.0 ELSE round_even((value - p2."offset") / p2.scale, 0) END AS raw FROM m JOIN p2 USING ({keys})),
c AS (SELECT run_id, t, vox, value, scale, "offset", least(greatest(raw, 0), {top})::INT AS q, raw < 0 OR raw > {top} AS clipped FROM r)
{tail}"""


def _codes(spark, sf_dir, scope="global", bits=8, method="range", center=True):
    df = embeddings(spark, sf_dir)
    params = quant.quant_params(quant.quant_stats(df, scope), bits, method, center)
    return df, params, quant.quantise(df, params, bits)


_ALL = "SELECT run_id, t, vox, q, clipped FROM c"


@query(_codes_sql("run_id", "range", True, 8, _ALL))
def quant_global_range(spark, sf_dir):
    return _codes(spark, sf_dir)[2]


@query(_codes_sql("run_id", "sd", True, 8, _ALL))
def quant_global_sd(spark, sf_dir):
    return _codes(spark, sf_dir, method="sd")[2]


@query(_codes_sql("run_id", "range", False, 8, _ALL))
def quant_nocenter(spark, sf_dir):
    return _codes(spark, sf_dir, center=False)[2]


@query(_codes_sql("run_id, vox", "range", True, 12, _ALL))
def quant_voxel_range(spark, sf_dir):
    return _codes(spark, sf_dir, "voxel", 12)[2]


@query(_codes_sql("run_id, vox", "sd", False, 8, _ALL))
def quant_voxel_sd(spark, sf_dir):
    return _codes(spark, sf_dir, "voxel", method="sd", center=False)[2]


@query(_codes_sql("run_id", "range", True, 8, 'SELECT vox, count(*) AS n, round(avg((value - (q * scale + "offset")) * (value - (q * scale + "offset"))), 12) AS mse FROM c GROUP BY vox'))
def dequant_roundtrip_mse(spark, sf_dir):
    df, params, codes = _codes(spark, sf_dir)
    back = quant.dequantise(codes, params).withColumnRenamed("value", "back")
    d = F.col("value") - F.col("back")
    return rounded(df.join(back, ["run_id", "t", "vox"]).groupBy("vox").agg(F.count("*").alias("n"), F.avg(d * d).alias("mse")), "mse", digits=12)


@query(_codes_sql("run_id", "range", False, 6, "SELECT b.q::INT AS q, coalesce(n, 0)::BIGINT AS n FROM range(64) b(q) LEFT JOIN (SELECT q, count(*) AS n FROM c GROUP BY q) h ON h.q = b.q"))
def quant_histogram(spark, sf_dir):
    return quant.histogram(_codes(spark, sf_dir, bits=6, center=False)[2], 6)


@query(_codes_sql("run_id", "sd", True, 8, "SELECT run_id, count(*) FILTER (clipped) AS n_clipped, count(*) AS n, round(100.0 * count(*) FILTER (clipped) / count(*), 6) AS clip_pct FROM c GROUP BY run_id"))
def quant_clip_stats(spark, sf_dir):
    return rounded(quant.clip_stats(_codes(spark, sf_dir, method="sd")[2]), "clip_pct")


@query(_codes_sql("run_id", "range", True, 8, "SELECT run_id, round(10 * log10(var_samp(value) / (any_value(scale) * any_value(scale) / 12)), 6) AS snr_db FROM c GROUP BY run_id"))
def quant_snr_report(spark, sf_dir):
    df, params, _ = _codes(spark, sf_dir)
    return rounded(quant.snr(df, params), "snr_db")


@query(
    _codes_sql(
        "run_id, vox", "range", True, 8,
        """SELECT run_id, round(min(scale), 9) AS scale_min, round(max(scale), 9) AS scale_max, round(avg(scale), 9) AS scale_mean, round(stddev_pop(scale), 9) AS scale_sd,
round(min("offset"), 9) AS offset_min, round(max("offset"), 9) AS offset_max, round(avg("offset"), 9) AS offset_mean, round(stddev_pop("offset"), 9) AS offset_sd FROM (SELECT DISTINCT run_id, vox, scale, "offset" FROM c) GROUP BY run_id""",
    )
)
def quant_scale_summary(spark, sf_dir):
    s = quant.param_summary(_codes(spark, sf_dir, "voxel")[1])
    return rounded(s, *[c for c in s.columns if c != "run_id"], digits=9)


_LAG = "lag(value) OVER (PARTITION BY run_id, vox ORDER BY t)"


@query(f"WITH {EVENTS} SELECT * FROM (SELECT run_id, lag(t) OVER (PARTITION BY run_id, vox ORDER BY t) AS t, vox, round(value - {_LAG}, 6) + 0.0 AS delta FROM m) WHERE t IS NOT NULL")
def delta_forward(spark, sf_dir):
    return rounded(codecs.differences(event_series(spark, sf_dir)), "delta")


def _dense(spark, sf_dir):
    """Embeddings with time counted within a run: dense series."""
    e = embeddings(spark, sf_dir)
    return e.withColumn("t", F.row_number().over(Window.partitionBy("run_id", "vox").orderBy("t")) - 1)


_DENSE = f"{EMBEDDINGS}, d AS (SELECT run_id, (row_number() OVER (PARTITION BY run_id, vox ORDER BY t) - 1)::INT AS t, vox, value FROM m)"


@query(f"WITH {_DENSE} SELECT run_id, t, vox, round(value, 6) + 0.0 AS value FROM d")
def delta_inverse(spark, sf_dir):
    df = _dense(spark, sf_dir)
    return rounded(codecs.integrate(codecs.differences(df), codecs.first_values(df)), "value")


@query(f"WITH {_DENSE} SELECT run_id, t, vox, round(value, 6) + 0.0 AS value FROM d WHERE t IN (2, 5) AND vox < 8")
def delta_time_subset(spark, sf_dir):
    df = _dense(spark, sf_dir)
    back = codecs.integrate(codecs.differences(df), codecs.first_values(df), until=5)
    return rounded(back.where(F.col("t").isin(2, 5) & (F.col("vox") < 8)), "value")


def _coarse(spark, sf_dir):
    df = _dense(spark, sf_dir)
    p = quant.quant_params(quant.quant_stats(df), 2, "range", False)
    return quant.quantise(df, p, 2).select("run_id", "t", "vox", F.col("q").cast("double").alias("value"))


_COARSE = f"""{_DENSE}, s AS (SELECT run_id, min(value) AS lo, (max(value) - min(value)) / 3 AS scale FROM d GROUP BY run_id),
q AS (SELECT run_id, t, vox, least(greatest(round_even((value - lo) / scale, 0), 0), 3) AS value FROM d JOIN s USING (run_id)),
f AS (SELECT run_id, lag(t) OVER w AS t, vox, value - lag(value) OVER w AS delta FROM q WINDOW w AS (PARTITION BY run_id, vox ORDER BY t)), f2 AS (SELECT * FROM f WHERE t IS NOT NULL)"""


@query(
    f"""WITH {_COARSE}, o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY vox, t) - 1 AS pos, coalesce(delta <> lag(delta) OVER (PARTITION BY run_id ORDER BY vox, t), TRUE) AS starts FROM f2),
g AS (SELECT *, sum(starts::INT) OVER (PARTITION BY run_id ORDER BY pos) AS grp FROM o) SELECT run_id, min(pos)::BIGINT AS pos, count(*)::BIGINT AS length, (any_value(delta) + 0.0)::DOUBLE AS value FROM g GROUP BY run_id, grp"""
)
def delta_rle_encode(spark, sf_dir):
    runs_ = codecs.rle_encode(codecs.differences(_coarse(spark, sf_dir)))
    return runs_.select("run_id", F.col("pos").cast("long").alias("pos"), F.col("length").cast("long").alias("length"), (F.col("value") + 0.0).alias("value"))


@query(f"WITH {_COARSE} SELECT run_id, (row_number() OVER (PARTITION BY run_id ORDER BY vox, t) - 1)::BIGINT AS pos, (delta + 0.0)::DOUBLE AS value FROM f2")
def delta_rle_decode(spark, sf_dir):
    runs_ = codecs.rle_encode(codecs.differences(_coarse(spark, sf_dir)))
    return codecs.rle_decode(runs_).select("run_id", F.col("pos").cast("long").alias("pos"), (F.col("value") + 0.0).alias("value"))


@query(f"WITH {_DENSE} SELECT * FROM (SELECT run_id, t, vox, round((lead(value) OVER w - lag(value) OVER w) / 2, 6) + 0.0 AS value FROM d WINDOW w AS (PARTITION BY run_id, vox ORDER BY t)) WHERE value IS NOT NULL")
def delta_central(spark, sf_dir):
    return rounded(codecs.higher_difference(_dense(spark, sf_dir), 1, "central"), "value")


@query(
    f"""WITH {_DENSE}, a AS (SELECT run_id, t, vox, lead(value) OVER w - value AS value FROM d WINDOW w AS (PARTITION BY run_id, vox ORDER BY t)), b AS (SELECT * FROM a WHERE value IS NOT NULL),
c AS (SELECT run_id, t, vox, lead(value) OVER w - value AS value FROM b WINDOW w AS (PARTITION BY run_id, vox ORDER BY t)) SELECT run_id, t, vox, round(value, 6) + 0.0 AS value FROM c WHERE value IS NOT NULL"""
)
def delta_order2(spark, sf_dir):
    return rounded(codecs.higher_difference(_dense(spark, sf_dir), 2), "value")


@query(f"WITH {EVENTS} SELECT 'run-01' AS run_id, t, vox, round(sum(value), 6) AS value FROM m GROUP BY t, vox")
def aggregate_runs_sum(spark, sf_dir):
    return rounded(runs.aggregate_runs(event_series(spark, sf_dir), "sum"), "value")


@query(f"WITH {EVENTS} SELECT 'run-01' AS run_id, t, vox, round(avg(value), 6) AS value FROM m GROUP BY t, vox")
def aggregate_runs_mean(spark, sf_dir):
    return rounded(runs.aggregate_runs(event_series(spark, sf_dir), "mean"), "value")


@query(
    f"""WITH {EVENTS}, n AS (SELECT run_id, max(t) + 1 AS n FROM m GROUP BY run_id), o AS (SELECT run_id, sum(n) OVER (ORDER BY run_id) - n AS o FROM n)
SELECT 'run-01' AS run_id, (t + o)::INT AS t, vox, round(value, 6) AS value FROM m JOIN o USING (run_id)"""
)
def aggregate_runs_concat(spark, sf_dir):
    return rounded(runs.aggregate_runs(event_series(spark, sf_dir), "concatenate"), "value")


@query("SELECT l_returnflag AS run_id, round(avg(d), 6) AS mean_delta, count(*) AS n FROM (SELECT l_returnflag, l_extendedprice - lag(l_extendedprice) OVER (PARTITION BY l_returnflag, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS d FROM lineitem) WHERE d IS NOT NULL GROUP BY 1")
def lineitem_delta(spark, sf_dir):
    """Differences of prices along each supplier's deliveries: a large one-dimensional input."""
    w = Window.partitionBy("l_returnflag", "l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    d = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_extendedprice") - F.lag("l_extendedprice").over(w)).alias("d")).where("d IS NOT NULL")
    return rounded(d.groupBy(F.col("l_returnflag").alias("run_id")).agg(F.avg("d").alias("mean_delta"), F.count("*").alias("n")), "mean_delta")


@query(
    """WITH s AS (SELECT l_returnflag AS r, min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 4095 AS scale FROM lineitem GROUP BY 1),
c AS (SELECT l_returnflag AS r, l_extendedprice AS x, lo, scale, least(greatest(round_even((l_extendedprice - lo) / scale, 0), 0), 4095) AS q FROM lineitem JOIN s ON r = l_returnflag)
SELECT r AS run_id, count(*) AS n, sum(q)::BIGINT AS code_sum, round(max(abs(x - (q * scale + lo))), 4) AS worst FROM c GROUP BY r"""
)
def lineitem_quant(spark, sf_dir):
    """12-bit quantisation of prices by return flag, with the largest error."""
    df = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("run_id"), F.lit(0).alias("t"), F.lit(0).alias("vox"), F.col("l_extendedprice").alias("value"))
    params = quant.quant_params(quant.quant_stats(df), 12, "range", False)
    rows = df.join(subset.small(params, 400), "run_id").withColumn("q", F.least(F.greatest(quant.raw_code(F.col("value")), F.lit(0.0)), F.lit(4095.0)))
    return rounded(rows.groupBy("run_id").agg(F.count("*").alias("n"), F.sum("q").cast("long").alias("code_sum"), F.max(F.abs(F.col("value") - (F.col("q") * F.col("scale") + F.col("offset")))).alias("worst")), "worst", digits=4)
