"""The data model: dense arrays of several runs as rows (run_id, t, vox, value).

vox = x + y*nx + z*nx*ny, 0-based; t counts from 0. Everything is a lazy DataFrame.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ContractError, DimensionMismatch, InvalidInput, Overwritten, RunIdError, ValidationError, warn
from .options import option

LONG = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("t", T.IntegerType()), T.StructField("vox", T.IntegerType()), T.StructField("value", T.DoubleType())])
RUN_ID = re.compile(r"^run-[0-9]{2}$")


def run_name(number: int) -> str:
    return f"run-{number:02d}"


def check_run_id(run_id: str) -> str:
    if not isinstance(run_id, str) or "/" in run_id or not RUN_ID.match(run_id):
        raise RunIdError(f"run id {run_id!r} isn't of the form run-NN", "check_run_id")
    return run_id


def glob_pattern(pattern: str) -> str:
    """A regular expression for a glob of * and ?."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def resolve_run_ids(patterns: str | Iterable[str] | None, available: Iterable[str]) -> list[str]:
    """Runs in the order of the patterns that name them, each once; no pattern: the first run."""
    runs = sorted(available)
    if patterns is None:
        return runs[:1]
    out: list[str] = []
    for p in [patterns] if isinstance(patterns, str) else patterns:
        matched = [r for r in runs if re.match(glob_pattern(p), r)] if "*" in p or "?" in p else [r for r in runs if r == p]
        out += [r for r in matched if r not in out]
    return out


# ---- coordinates -------------------------------------------------------------------------------


def vox_of(x: Column, y: Column, z: Column, dims: tuple[int, int, int]) -> Column:
    return (x + y * dims[0] + z * (dims[0] * dims[1])).cast("int")


def x_of(vox: Column, dims) -> Column:
    return (vox % dims[0]).cast("int")


def y_of(vox: Column, dims) -> Column:
    return (F.floor(vox / dims[0]) % dims[1]).cast("int")


def z_of(vox: Column, dims) -> Column:
    return F.floor(vox / (dims[0] * dims[1])).cast("int")


def with_coordinates(df: DataFrame, dims) -> DataFrame:
    v = F.col("vox")
    return df.withColumns({"x": x_of(v, dims), "y": y_of(v, dims), "z": z_of(v, dims)})


def promoted_dims(dims: Iterable[int]) -> tuple[int, ...]:
    """Up to four dimensions, padded with 1: the last of the given ones is time."""
    dims = tuple(int(d) for d in dims)
    if not 1 <= len(dims) <= 4 or any(d < 0 for d in dims):
        raise ValidationError(f"an array has 1 to 4 dimensions, not {dims}", "promoted_dims")
    return dims + (1,) * (4 - len(dims))


#: Least rank of an array by the first step's type.
MIN_RANK = {"delta": 1, "quant": 1, "quant_refactored": 1, "basis": 2, "embed": 2}


def min_rank(type: str | None, masked: bool = False) -> int:
    rank = MIN_RANK.get(type, 3) if type else 1
    return max(rank, 3) if masked else rank


@dataclass(frozen=True)
class Space:
    """Geometry of a volume: voxel sizes and origin, and an affine of 16 numbers by row."""

    dims: tuple[int, int, int]
    spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    transform: tuple[float, ...] = ()

    def header(self) -> dict[str, Any]:
        affine = self.transform or tuple(np.diag([*self.spacing, 1.0]).ravel().tolist())
        return {"dims": list(self.dims), "spacing": list(self.spacing), "origin": list(self.origin), "transform": list(affine)}


@dataclass(frozen=True)
class ArrayFrame:
    """A long frame with the size of its space, of its time axis, and an optional mask (vox)."""

    df: DataFrame
    dims: tuple[int, int, int]
    n_time: int
    mask: DataFrame | None = None
    space: Space | None = None
    rank: int = 4

    @property
    def n_vox(self) -> int:
        return self.dims[0] * self.dims[1] * self.dims[2]

    def with_df(self, df: DataFrame) -> ArrayFrame:
        return replace(self, df=df)

    def voxels(self) -> DataFrame:
        """vox, x, y, z, in_mask; without a mask all voxels are in it."""
        spark = self.df.sparkSession
        v = with_coordinates(spark.range(self.n_vox).select(F.col("id").cast("int").alias("vox")), self.dims)
        if self.mask is None:
            return v.withColumn("in_mask", F.lit(True))
        return v.join(self.mask.select("vox", F.lit(True).alias("m")), "vox", "left").withColumn("in_mask", F.coalesce("m", F.lit(False))).drop("m")


def from_numpy(spark: SparkSession, arrays: np.ndarray | dict[str, np.ndarray] | list[np.ndarray], mask: np.ndarray | None = None, space: Space | None = None) -> ArrayFrame:
    """An ArrayFrame of one array or several runs of the same shape; the last dimension is time.

    Meant for small inputs; a large one is a table of rows from the start.
    """
    if isinstance(arrays, np.ndarray):
        arrays = {option("defaults.run_id"): arrays}
    elif not isinstance(arrays, dict):
        arrays = {run_name(k): a for k, a in enumerate(arrays, 1)}
    for r in arrays:
        check_run_id(r)
    shapes = {a.shape for a in arrays.values()}
    if len({s[:-1] for s in shapes}) > 1:
        raise DimensionMismatch(f"runs differ in shape: {shapes}", "from_numpy")
    rank = len(next(iter(shapes)))
    if rank == 3 and mask is not None and mask.shape == next(iter(shapes)):
        arrays = {r: a[..., None] for r, a in arrays.items()}
    rows = []
    for r, a in arrays.items():
        lead = (*a.shape[:-1], 1, 1, 1)[:3] if a.ndim > 1 else (1, 1, 1)
        flat = np.asarray(a, float).reshape((int(np.prod(lead)), a.shape[-1]), order="F")
        v, t = np.meshgrid(np.arange(flat.shape[0]), np.arange(flat.shape[1]), indexing="ij")
        rows += zip([r] * flat.size, t.ravel().tolist(), v.ravel().tolist(), flat.ravel().tolist(), strict=True)
    a = next(iter(arrays.values()))
    dims = (*a.shape[:-1], 1, 1, 1)[:3] if a.ndim > 1 else (1, 1, 1)
    masked = None
    if mask is not None:
        mask = np.asarray(mask)
        if mask.ndim != 3 or mask.dtype != bool:
            raise InvalidInput("a mask is a 3-D boolean array", "from_numpy:mask")
        if mask.shape != dims:
            raise DimensionMismatch(f"mask {mask.shape} and data {dims} differ", "from_numpy:mask")
        masked = spark.createDataFrame([(int(i),) for i in np.flatnonzero(mask.ravel(order="F"))], "vox int")
    return ArrayFrame(spark.createDataFrame(rows, LONG), tuple(dims), max(x.shape[-1] for x in arrays.values()), masked, space, rank)


def to_numpy(frame: DataFrame, dims, n_time: int, run_id: str | None = None) -> np.ndarray:
    """A small array back on the driver: dims + (n_time,); absent cells are NaN."""
    df = frame.where(F.col("run_id") == run_id) if run_id else frame
    out = np.full((int(np.prod(dims)), n_time), np.nan)
    cells = df.select("vox", "t", "value").toArrow()
    out[cells["vox"].to_numpy(), cells["t"].to_numpy()] = cells["value"].to_numpy()
    return out.reshape((*dims, n_time), order="F")


def matrix(frame: DataFrame, by: str = "t") -> DataFrame:
    """Packed rows: (run_id, t, row) by vox, or (run_id, vox, series) by time."""
    other, name = ("vox", "row") if by == "t" else ("t", "series")
    packed = F.transform(F.sort_array(F.collect_list(F.struct(other, "value"))), lambda s: s["value"])
    return frame.groupBy("run_id", by).agg(packed.alias(name))


def check_finite(value: Column) -> Column:
    """The value; null, NaN and infinities raise an error when they are met."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("non-finite value"))).otherwise(value)


@dataclass(frozen=True)
class Handle:
    """Named intermediate results; every change makes a new handle."""

    stash: dict[str, Any] = field(default_factory=dict)
    meta: dict[str, Any] = field(default_factory=dict)
    run_ids: tuple[str, ...] = ()

    def get_inputs(self, *keys: str) -> list[Any]:
        if missing := [k for k in keys if k not in self.stash]:
            raise ContractError(f"missing: {', '.join(missing)}; there are {', '.join(sorted(self.stash)) or 'none'}", "Handle.get_inputs")
        return [self.stash[k] for k in keys]

    def pull_first(self, *keys: str) -> tuple[str, Any]:
        """The first key that is there, with its value."""
        for k in keys:
            if k in self.stash:
                return k, self.stash[k]
        raise ContractError(f"none of {', '.join(keys)} is there", "Handle.pull_first")

    def has(self, key: str) -> bool:
        return key in self.stash

    def updated(self, new: dict[str, Any] | None = None, without: Iterable[str] = ()) -> Handle:
        kept = {k: v for k, v in self.stash.items() if k not in set(without)}
        for k in set(new or {}) & set(kept):
            warn(f"{k} is replaced", Overwritten)
        return replace(self, stash=kept | (new or {}))

    def with_meta(self, **meta: Any) -> Handle:
        return replace(self, meta=self.meta | meta)
