"""Differences along time, and run-length coding of the difference stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def series():
    """A voxel's values in order of time."""
    return Window.partitionBy("run_id", "vox").orderBy("t")


def differences(df: DataFrame) -> DataFrame:
    """value[t+1] - value[t] at t; a series of n has n - 1."""
    return df.select("run_id", "vox", F.lag("t").over(series()).alias("t"), (F.col("value") - F.lag("value").over(series())).alias("delta")).where("t IS NOT NULL").select("run_id", "t", "vox", "delta")


def first_values(df: DataFrame) -> DataFrame:
    return df.groupBy("run_id", "vox").agg(F.min_by("value", "t").alias("value"))


def integrate(deltas: DataFrame, firsts: DataFrame | None, t0: int = 0, until: int | None = None) -> DataFrame:
    """The series again: first value plus running sum; firsts None starts from 0.

    until limits t; the filter stands below the window, which is right for a running frame.
    """
    if until is not None:
        deltas = deltas.where(F.col("t") < until)
    steps = deltas.select("run_id", "vox", (F.col("t") + 1).alias("t"), F.col("delta").alias("d"))
    if firsts is None:
        firsts = deltas.select("run_id", "vox").distinct().withColumn("value", F.lit(0.0))
    start = firsts.select("run_id", "vox", F.lit(t0).alias("t"), F.col("value").alias("d"))
    run = F.sum("d").over(series().rowsBetween(Window.unboundedPreceding, 0))
    return start.unionByName(steps).select("run_id", "t", "vox", run.alias("value"))


def higher_difference(df: DataFrame, order: int = 1, kind: str = "forward", remove_mean: bool = False) -> DataFrame:
    """Differences of an order, forward, backward or central ((x[t+1] - x[t-1]) / 2); by series."""
    if remove_mean:
        df = df.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("run_id", "vox")))
    for _ in range(order):
        step = {
            "forward": F.lead("value").over(series()) - F.col("value"),
            "backward": F.col("value") - F.lag("value").over(series()),
            "central": (F.lead("value").over(series()) - F.lag("value").over(series())) / 2,
        }[kind]
        df = df.select("run_id", "t", "vox", step.alias("value")).where("value IS NOT NULL")
    return df


def rle_encode(df: DataFrame, value: str = "delta") -> DataFrame:
    """Runs of equal values of a run's stream, voxel after voxel: (run_id, pos, length, value).

    Runs may span voxels. Within a voxel they come from a window over its series; voxels then meet
    through one row each: pos is where a run starts in the stream.
    """
    v = F.col(value)
    changed = F.coalesce((v != F.lag(v).over(series())).cast("int"), F.lit(1))
    marked = df.select("run_id", "vox", "t", v.alias("value"), F.sum(changed).over(series().rowsBetween(Window.unboundedPreceding, 0)).alias("part"))
    parts = marked.groupBy("run_id", "vox", "part").agg(F.first("value").alias("value"), F.count("*").alias("n"))
    of_voxel = parts.groupBy("run_id", "vox").agg(F.sum("n").alias("size"), F.max("part").alias("parts"), F.min_by("value", "part").alias("head"), F.max_by("value", "part").alias("tail"))
    by_run = Window.partitionBy("run_id").orderBy("vox")
    before = F.sum("size").over(by_run) - F.col("size")
    joins = F.coalesce(F.col("head") == F.lag("tail").over(by_run), F.lit(False))
    placed = of_voxel.select("run_id", "vox", before.alias("before"), joins.alias("joins"), "parts")
    # a voxel of one part that continues the last one doesn't start a run of its own
    starts = F.col("parts") - F.col("joins").cast("int")
    placed = placed.withColumn("first_run", F.sum(starts).over(by_run) - starts)
    rows = parts.join(placed, ["run_id", "vox"])
    run = F.col("first_run") + F.col("part") - F.col("joins").cast("int")
    at = F.col("before") + F.sum("n").over(Window.partitionBy("run_id", "vox").orderBy("part")) - F.col("n")
    return rows.select("run_id", run.alias("run"), at.alias("at"), "n", "value").groupBy("run_id", "run").agg(F.min("at").alias("pos"), F.sum("n").alias("length"), F.first("value").alias("value")).select("run_id", "pos", "length", "value")


def rle_decode(runs: DataFrame) -> DataFrame:
    """(run_id, pos, value): one row for each place in the stream."""
    return runs.select("run_id", F.explode(F.sequence("pos", F.col("pos") + F.col("length") - 1)).alias("pos"), "value")


def stream_to_series(stream: DataFrame, n_time: int, value: str = "delta") -> DataFrame:
    """Places of a stream back to (t, vox), n_time values a voxel; voxels are numbered from 0."""
    return stream.select("run_id", (F.col("pos") % n_time).cast("int").alias("t"), F.floor(F.col("pos") / n_time).cast("int").alias("vox"), F.col("value").alias(value))
