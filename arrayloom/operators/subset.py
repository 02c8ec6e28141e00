"""Selection: voxels of a region, time points in order, runs by glob."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, InvalidInput, warn
from ..model import ArrayFrame, glob_pattern
from ..options import option


def small(df: DataFrame, cells: int) -> DataFrame:
    """Broadcast a side whose number of cells is known and within the engine's limit."""
    return F.broadcast(df) if cells <= option("broadcast.max_cells") else df


def roi_table(frame: ArrayFrame, roi) -> DataFrame:
    """(vox) of a boolean array, a list of voxels or a DataFrame with vox."""
    if isinstance(roi, DataFrame):
        return roi.select("vox").distinct()
    roi = np.asarray(roi)
    if roi.dtype == bool:
        if roi.size != frame.n_vox or (roi.ndim == 3 and roi.shape != frame.dims):
            raise DimensionMismatch(f"a region of {roi.shape} on a space of {frame.dims}", "roi_table")
        roi = np.flatnonzero(roi.ravel(order="F"))
    elif not np.issubdtype(roi.dtype, np.integer):
        raise InvalidInput("a region is boolean or a list of voxel numbers", "roi_table")
    return frame.df.sparkSession.createDataFrame([(int(v),) for v in np.unique(roi)], "vox int")


def select_voxels(df: DataFrame, roi: DataFrame) -> DataFrame:
    return df.join(roi.select("vox"), "vox", "left_semi").select(df.columns)


def select_times(df: DataFrame, times: Iterable[int]) -> DataFrame:
    """Time points in the order given, repeats included: adds ord, the place in the list."""
    rows = [(k, int(t)) for k, t in enumerate(times)]
    at = df.sparkSession.createDataFrame(rows, "ord int, t int")
    return df.join(small(at, 2 * len(rows)), "t").select("run_id", "ord", "t", "vox", "value")


def select_times_within(df: DataFrame, times: Iterable[int], n_time: int) -> DataFrame:
    """As select_times, dropping points that don't exist."""
    return select_times(df, [t for t in times if 0 <= t < n_time])


def select_times_or_all(df: DataFrame, times: Iterable[int], n_time: int) -> DataFrame:
    """As select_times; if a point doesn't exist, a warning and everything."""
    times = list(times)
    if any(not 0 <= t < n_time for t in times):
        warn("time points out of bounds: nothing is selected")
        return df
    return select_times(df, times)


def select_runs(df: DataFrame, patterns: str | list[str]) -> DataFrame:
    patterns = [patterns] if isinstance(patterns, str) else patterns
    return df.where(F.col("run_id").rlike("|".join(glob_pattern(p) for p in patterns)))


def masked(frame: ArrayFrame) -> DataFrame:
    return frame.df if frame.mask is None else select_voxels(frame.df, frame.mask)
