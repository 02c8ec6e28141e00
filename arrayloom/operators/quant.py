"""Linear quantisation to b bits: statistics, codes, reconstruction and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import snr_db
from ..model import check_finite
from .subset import small


def quant_stats(df: DataFrame, scope: str = "global") -> DataFrame:
    """lo, hi, mean and sample deviation of each run, or of each voxel of each run."""
    keys = ["run_id"] if scope == "global" else ["run_id", "vox"]
    return df.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def quant_params(stats: DataFrame, bits: int = 8, method: str = "range", center: bool = True) -> DataFrame:
    """Adds scale and offset; a constant gets scale 1 and flat true."""
    levels = 2**bits - 1
    lo, hi, mean = F.col("lo"), F.col("hi"), F.col("mean")
    sd = F.coalesce(F.col("sd"), F.lit(0.0))
    if center:
        reach = F.greatest(F.abs(lo - mean), F.abs(hi - mean)) if method == "range" else 3 * sd
        scale, offset = 2 * reach / levels, mean - reach
    elif method == "range":
        scale, offset = (hi - lo) / levels, lo
    else:
        scale, offset = 6 * sd / levels, mean - 3 * sd
    flat = (scale == 0) | (lo == hi)
    return stats.select(*[c for c in stats.columns if c in ("run_id", "vox")], F.when(flat, 1.0).otherwise(scale).alias("scale"), F.when(flat, lo).otherwise(offset).alias("offset"), flat.alias("flat"))


def _attach(df: DataFrame, params: DataFrame) -> DataFrame:
    if "vox" in params.columns:
        return df.join(params, ["run_id", "vox"])
    return df.join(small(params, 100 * 4), "run_id")  # run ids are run-NN: at most 100 rows


def raw_code(value: Column) -> Column:
    """Nearest code, ties to even, before clipping."""
    return F.when(F.col("flat"), 0.0).otherwise(F.rint((value - F.col("offset")) / F.col("scale")))


def quantise(df: DataFrame, params: DataFrame, bits: int = 8) -> DataFrame:
    """(run_id, t, vox, q, clipped): codes in 0..2^bits-1, and whether they had to be clipped."""
    top = 2**bits - 1
    rows = _attach(df, params).withColumn("raw", raw_code(check_finite(F.col("value"))))
    return rows.select("run_id", "t", "vox", F.least(F.greatest("raw", F.lit(0.0)), F.lit(float(top))).cast("int").alias("q"), ((F.col("raw") < 0) | (F.col("raw") > top)).alias("clipped"))


def dequantise(codes: DataFrame, params: DataFrame, q: str = "q") -> DataFrame:
    return _attach(codes, params).select("run_id", "t", "vox", (F.col(q) * F.col("scale") + F.col("offset")).alias("value"))


def clip_stats(codes: DataFrame) -> DataFrame:
    n = F.count_if("clipped")
    return codes.groupBy("run_id").agg(n.alias("n_clipped"), F.count("*").alias("n"), (100 * n / F.count("*")).alias("clip_pct"))


def histogram(codes: DataFrame, bits: int = 8) -> DataFrame:
    """(q, count), zero counts included."""
    bins = codes.sparkSession.range(2**bits).select(F.col("id").cast("int").alias("q"))
    counts = codes.groupBy("q").agg(F.count("*").alias("n"))
    return bins.join(counts, "q", "left").select("q", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def param_summary(params: DataFrame) -> DataFrame:
    """min, max, mean and population deviation of scale and offset by run."""
    return params.groupBy("run_id").agg(*[f(c).alias(f"{c}_{n}") for c in ("scale", "offset") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("sd", F.stddev_pop))])


def snr(df: DataFrame, params: DataFrame, sample: float | None = None) -> DataFrame:
    """Decibels by run; with a voxel scope, the mean over a share of the voxels chosen by hash."""
    if "vox" not in params.columns:
        return df.groupBy("run_id").agg(F.var_samp("value").alias("v")).join(small(params, 400), "run_id").select("run_id", snr_db(F.col("v"), F.col("scale")).alias("snr_db"))
    if sample is not None:
        df = df.where(F.pmod(F.xxhash64("vox"), F.lit(10_000)) < sample * 10_000)
    by = df.groupBy("run_id", "vox").agg(F.var_samp("value").alias("v")).where("v > 0").join(params, ["run_id", "vox"])
    return by.groupBy("run_id").agg(F.avg(snr_db(F.col("v"), F.col("scale"))).alias("snr_db"))


def local(params: DataFrame) -> DataFrame:
    """Parameters of a global scope as a local table: a row a run, and there are at most 100 runs."""
    rows = params.collect()
    return params.sparkSession.createDataFrame([tuple(r) for r in rows], params.schema)


def report(df: DataFrame, params: DataFrame, codes: DataFrame, bits: int, method: str, scope: str, sample: float | None = None) -> dict:
    """The quantisation report. A few numbers a run and 2^bits counts reach the driver.

    Up to 8 bits, codes are counted by run in one pass for both the histogram and the clipping.
    """
    out: dict = {"report_version": "1.0", "bits": bits, "method": method, "scale_scope": scope, "runs": {}}
    if bits <= 8:
        counts = codes.groupBy("run_id", "q").agg(F.count("*").alias("n"), F.count_if("clipped").alias("clipped")).collect()
        hist = [0] * 2**bits
        for r in counts:
            hist[r.q] += r.n
            own = out["runs"].setdefault(r.run_id, {"n_clipped_total": 0, "n": 0})
            own["n_clipped_total"] += r.clipped
            own["n"] += r.n
        for own in out["runs"].values():
            own["clip_pct"] = 100 * own["n_clipped_total"] / own.pop("n")
    else:
        for r in clip_stats(codes).collect():
            out["runs"][r.run_id] = {"n_clipped_total": r.n_clipped, "clip_pct": r.clip_pct}
        hist = [r.n for r in histogram(codes, bits).orderBy("q").collect()]
    for r in param_summary(params).collect():
        out["runs"][r.run_id] |= {k: v for k, v in r.asDict().items() if k != "run_id"}
    for r in snr(df, params, sample).collect():
        out["runs"][r.run_id]["estimated_snr_db"] = r.snr_db
    return out | {"histogram": hist}

