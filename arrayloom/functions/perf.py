"""How long the gradient kernel takes here, and which form of it a volume would get."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import SparkSession

from ..options import option, set_options
from .kernels import sobel_magnitude


def gradient_form(dims) -> str:
    """volume where a volume goes whole to a task, windows where it is too large for that."""
    return "volume" if int(np.prod(dims)) <= option("kernel.max_series") else "windows"


def use_kernels(enable: bool = True) -> None:
    """Whether small volumes and masks go to numpy kernels; without, the distributed forms are used for any size."""
    set_options({"kernel.max_series": 4_000_000 if enable else 0})


def time_kernel(size: int, repeats: int = 3) -> float:
    """Seconds of the kernel alone on a cube, the best of some runs."""
    v = np.random.default_rng(size).random((size, size, size))
    best = float("inf")
    for _ in range(repeats):
        began = time.perf_counter()
        sobel_magnitude(v)
        best = min(best, time.perf_counter() - began)
    return best


def time_query(spark: SparkSession, size: int) -> float:
    """Seconds of the Spark operator on a cube, its result sent to the no-op sink."""
    from pyspark.sql import functions as F

    from ..operators.spatial import sobel

    v = spark.range(size**3).select(F.lit("run-01").alias("run_id"), F.lit(0).alias("t"), F.col("id").cast("int").alias("vox"), F.sin(F.col("id") / 7.0).alias("value"))
    began = time.perf_counter()
    sobel(v, (size, size, size)).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def benchmark(spark: SparkSession, sizes=(16, 32, 48, 64)) -> list[dict[str, float]]:
    return [{"size": n, "kernel_s": time_kernel(n), "query_s": time_query(spark, n)} for n in sizes]
