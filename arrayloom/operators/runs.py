"""Combining runs: sum, mean, or end to end in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidInput
from ..options import option
from .subset import small


def aggregate_runs(df: DataFrame, op: str = "sum", run_id: str | None = None) -> DataFrame:
    """One run (run_id, t, vox, value) of all; a concatenation shifts t by the lengths of earlier runs."""
    name = F.lit(run_id or option("defaults.run_id"))
    if op in ("sum", "mean"):
        f = F.sum if op == "sum" else F.avg
        return df.groupBy("t", "vox").agg(f("value").alias("value")).select(name.alias("run_id"), "t", "vox", "value")
    if op != "concatenate":
        raise InvalidInput(f"unknown operation {op!r}", "aggregate_runs")
    length = df.groupBy("run_id").agg((F.max("t") + 1).alias("n"))  # a row a run
    offset = length.select("run_id", (F.sum("n").over(Window.orderBy("run_id")) - F.col("n")).alias("offset"))
    return df.join(small(offset, 200), "run_id").select(name.alias("run_id"), (F.col("t") + F.col("offset")).cast("int").alias("t"), "vox", "value")
