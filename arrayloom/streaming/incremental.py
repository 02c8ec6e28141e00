"""Differences and pre-aggregation over streams, and appending micro-batches to an archive's tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..errors import ValidationError

DELTA = "run_id string, vox int, t long, delta double"
STATE = "t long, value double"


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values("t")
    last = state.get if state.exists else None
    out = []
    for t, value in zip(rows["t"], rows["value"], strict=True):
        if last is not None and t <= last[0]:
            continue  # late: its difference has been given already
        if last is not None:
            out.append((key[0], key[1], int(last[0]), float(value - last[1])))
        last = (int(t), float(value))
    if last is not None:
        state.update(last)
    yield pd.DataFrame(out, columns=["run_id", "vox", "t", "delta"])


def stream_differences(values: DataFrame) -> DataFrame:
    """(run_id, vox, t, delta) of a stream (run_id, t, vox, value); the state is one value a voxel.

    Values come in order of t within a voxel, or are late and left out.
    """
    rows = values.select("run_id", F.col("vox").cast("int").alias("vox"), F.col("t").cast("long").alias("t"), "value")
    return rows.groupBy("run_id", "vox").applyInPandasWithState(_step, DELTA, STATE, "append", GroupStateTimeout.NoTimeout)


def stream_means(events: DataFrame, time: str = "ts", every: str = "1 hour", late: str = "2 hours", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Mean and count by window of event time; a window closes when the watermark has passed it."""
    return events.withWatermark(time, late).groupBy(F.window(time, every), *keys).agg(F.avg("value").alias("value"), F.count("*").alias("n")).select(*keys, F.col("window.start").alias("start"), "value", "n")


def append_to(stream: DataFrame, path: str, checkpoint: str, run_column: str = "run_id") -> StreamingQuery:
    """Appends each micro-batch to a table split by run; a batch that is repeated replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", run_column).parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---- quantisation over micro-batches -----------------------------------------------------------------


def collect_batches(stream: DataFrame, staging: str, checkpoint: str, scope: str = "global") -> StreamingQuery:
    """Keeps a stream (run_id, t, vox, value) and each micro-batch's statistics by run, or by voxel of a run, until commit_batches.

    Both are written under the batch's number, so a batch that is repeated replaces itself.
    """
    keys = ["run_id"] if scope == "global" else ["run_id", "vox"]

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for name, rows in (("values", batch.select("run_id", "t", "vox", "value")), ("statistics", partial_statistics(batch, keys))):
                rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{staging}/{name}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def partial_statistics(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, lo, hi, mean, m2) of some of the values; m2 is the sum of squared distances from the mean."""
    n = F.count("*")
    return values.groupBy(*keys).agg(n.alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"), (n * F.var_pop("value")).alias("m2"))


def merged_statistics(parts: DataFrame, keys: list[str]) -> DataFrame:
    """quant_stats of all values from the partial statistics of disjoint parts: (keys, lo, hi, mean, sd)."""
    whole = parts.groupBy(*keys).agg(F.sum("n").alias("all"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("centre"))
    apart = F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("centre")) ** 2)
    sd = F.when(F.first("all") > 1, F.sqrt(apart / (F.first("all") - 1)))
    return parts.join(whole, keys).groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("centre").alias("mean"), sd.alias("sd"))


def commit_batches(spark: SparkSession, staging: str, path: str, dims: tuple[int, int, int], n_time: int, **parameters) -> str:
    """The archive of all collected values, quantised in a second pass with the merged statistics; its catalog says that it was streamed."""
    from ..model import ArrayFrame
    from ..sources.archive import write_archive

    keys = ["run_id", "vox"] if parameters.get("scale_scope") == "voxel" else ["run_id"]
    read = lambda name: spark.read.parquet(f"{staging}/{name}").drop("batch")
    found = read("statistics")
    if "vox" in found.columns and keys == ["run_id"]:
        raise ValidationError("statistics were collected by voxel", "commit_batches")
    if "vox" not in found.columns and len(keys) == 2:
        raise ValidationError("statistics were collected by run", "commit_batches")
    frame = ArrayFrame(read("values"), dims, n_time, rank=4)
    return write_archive(frame, path, [("quant", parameters)], statistics=merged_statistics(found, keys))
