"""The steps that an archive is made of: each turns a long frame into another, and back.

A frame is always (run_id, t, vox, value). A step on time puts its component number in t, one on space in vox.
What a step needs to be undone is in its parameters and in the datasets that it names.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import ContractError, DataQuality, DuplicateKey, InvalidInput, MaskMismatch, NotSupported, StepError, StepReturnError, ValidationError, warn
from ..functions import bases
from ..model import ArrayFrame
from ..operators import blocks, codecs, haar, linalg, pursuit, quant, ranks, runs, spatial, temporal
from ..operators.sparse_pca import sparse_components
from ..options import STEPS, Parameter, option
from ..sources.files import as_table
from .registry import get_transform, register_transform


@dataclass(frozen=True)
class Dataset:
    """A table of an archive: role names its use; dtype the logical type of its values."""

    df: DataFrame
    role: str
    dtype: str = "float64"


@dataclass
class Result:
    """What a forward step returns."""

    df: DataFrame
    datasets: dict[str, Dataset] = field(default_factory=dict)
    parameters: dict[str, Any] = field(default_factory=dict)
    report: str | None = None


@dataclass(frozen=True)
class Context:
    """What a step may look at. load(path) gives a dataset of this or an earlier step."""

    spark: SparkSession
    name: str
    index: int
    parameters: dict[str, Any]
    frame: ArrayFrame
    n_time: int
    n_vox: int
    load: Callable[[str], DataFrame]
    roi: DataFrame | None = None
    times: tuple[int, ...] | None = None
    statistics: DataFrame | None = None

    def path(self, *parts: str) -> str:
        return "/".join([self.name, *parts])

    def mask(self) -> DataFrame:
        if self.frame.mask is not None:
            return self.frame.mask
        return self.spark.range(self.frame.n_vox).select(F.col("id").cast("int").alias("vox"))


class StepBuilder:
    """Collects what a forward step returns, with checks; for steps defined by users."""

    def __init__(self, context: Context):
        self.context, self._sets, self._parameters, self._report = context, {}, {}, None

    def parameter(self, name: str, kind: type | tuple[type, ...] | None = None, low: float | None = None, high: float | None = None, choices: tuple = ()) -> Any:
        """A parameter's value, checked."""
        value = self.context.parameters.get(name)
        Parameter(None, choices, low, high, kind, required=True).check(name, value)
        return value

    def dataset(self, name: str, df: DataFrame, role: str, dtype: str = "float64") -> StepBuilder:
        """Adds a table under the step's own folder."""
        path = self.context.path(name)
        if path in self._sets:
            raise DuplicateKey(f"two datasets {path}", "StepBuilder.dataset", self.context.index)
        self._sets[path] = Dataset(df, role, dtype)
        return self

    def store(self, **parameters: Any) -> StepBuilder:
        """Parameters that the inverse needs."""
        self._parameters |= parameters
        return self

    def report(self, text: str) -> StepBuilder:
        self._report = text
        return self

    def result(self, df: DataFrame) -> Result:
        return Result(df, self._sets, self._parameters, self._report)


def run_step(direction: str, type: str, context: Context, df: DataFrame):
    """Looks the step up, runs it and says where a failure came from."""
    f = getattr(get_transform(type, direction), direction)
    try:
        out = f(context, df)
    except (NotSupported, ValidationError, ContractError) as e:
        e.step, e.type = context.index, type
        raise
    except Exception as e:
        raise StepError(f"{direction} of {type} failed: {e}", f"run_step:{direction}", context.index, type) from e
    if not isinstance(out, Result if direction == "forward" else DataFrame):
        raise StepReturnError(f"{direction} of {type} returned {out.__class__.__name__}", f"run_step:{direction}", context.index, type)
    return out


# ---- quant -----------------------------------------------------------------------------------------


def _quant_forward(c: Context, df: DataFrame) -> Result:
    p = dict(c.parameters)
    if p["scale_scope"] == "voxel" and c.frame.rank < 4:
        warn("a voxel scope needs time and space; the scope is global", DataQuality)
        p["scale_scope"] = "global"
    stats = quant.quant_stats(df, p["scale_scope"]) if c.statistics is None else c.statistics
    params = quant.quant_params(stats, p["bits"], p["method"], p["center"])
    if p["scale_scope"] == "global":
        params = quant.local(params)
    codes = quant.quantise(df, params, p["bits"])
    report = quant.report(df, params, codes, p["bits"], p["method"], p["scale_scope"], p["snr_sample_frac"] if p["scale_scope"] == "voxel" else None)
    if p["scale_scope"] == "global":
        worst = max((r["clip_pct"] for r in report["runs"].values()), default=0.0)
        if worst > option("quant.clip_abort_pct") and not p["allow_clip"]:
            raise InvalidInput(f"{worst:.2f} % of the values would be clipped", "quant:clip")
        if worst > option("quant.clip_warn_pct"):
            warn(f"{worst:.2f} % of the values are clipped", DataQuality)
    out = codes.select("run_id", "t", "vox", F.col("q").cast("double").alias("value"))
    dtype = "uint8" if p["bits"] <= 8 else "uint16"
    return Result(out, {c.path("quant_params"): Dataset(params, "quant_params")}, p | {"dtype": dtype}, json.dumps(report))


def _quant_inverse(c: Context, df: DataFrame) -> DataFrame:
    return quant.dequantise(df, c.load(c.path("quant_params")), "value")


# ---- delta -----------------------------------------------------------------------------------------


def _swapped(df: DataFrame, axis: int) -> DataFrame:
    return df.select("run_id", F.col("vox").alias("t"), F.col("t").alias("vox"), "value") if axis == 1 else df


def _delta_forward(c: Context, df: DataFrame) -> Result:
    p = c.parameters
    if p["order"] != 1:
        raise NotSupported("differences of an order above 1 aren't part of the format", "delta:order")
    if p["coding_method"] == "range_coded":
        raise NotSupported("range coding isn't implemented", "delta:coding_method")
    df = _swapped(df, p["axis"])
    deltas = codecs.differences(df)
    sets = {}
    if p["reference_value_storage"] == "first_value_verbatim":
        sets[c.path("first_values")] = Dataset(codecs.first_values(df), "first_values")
    if p["coding_method"] == "rle":
        r = codecs.rle_encode(deltas)
        out = r.select("run_id", F.col("length").cast("int").alias("t"), F.col("pos").cast("int").alias("vox"), "value")
        sets[c.path("voxels")] = Dataset(df.select("vox").distinct(), "voxel_order")
    else:
        out = deltas.select("run_id", "t", "vox", F.col("delta").alias("value"))
    return Result(out, sets, {"n": c.n_vox if p["axis"] == 1 else c.n_time})


def _delta_inverse(c: Context, df: DataFrame) -> DataFrame:
    p, n = c.parameters, c.parameters["n"]
    if p["coding_method"] == "rle":
        stream = codecs.rle_decode(df.select("run_id", F.col("vox").alias("pos"), F.col("t").alias("length"), "value"))
        order = ranks.numbered(c.load(c.path("voxels")).select("vox"), "vox", name="place")
        d = codecs.stream_to_series(stream, max(1, n - 1)).withColumnRenamed("vox", "place")
        deltas = d.join(order, "place").select("run_id", "t", "vox", "delta")
    else:
        deltas = df.select("run_id", "t", "vox", F.col("value").alias("delta"))
    firsts = c.load(c.path("first_values")) if p["reference_value_storage"] == "first_value_verbatim" else None
    until = max(c.times) if c.times and p["axis"] != 1 else None
    return _swapped(codecs.integrate(deltas, firsts, until=until), p["axis"])


# ---- bases and embeddings ----------------------------------------------------------------------------


def _vector(spark: SparkSession, x: np.ndarray) -> DataFrame:
    return spark.createDataFrame(list(enumerate(map(float, x))), "vox int, value double")


def _basis_forward(c: Context, df: DataFrame) -> Result:
    p = c.parameters
    if p["method"] != "pca":
        raise NotSupported(f"basis method {p['method']} isn't implemented", "basis:method")
    d = blocks.components(df, c.n_vox, p["k"], p["center"], p["scale"])
    sets = {c.path("matrix"): Dataset(d.basis, "basis_matrix")}
    if p["center"]:
        sets[c.path("center")] = Dataset(d.mean, "center")
    if p["scale"]:
        sets[c.path("scale")] = Dataset(d.scale, "scale")
    return Result(df, sets, {"k": d.k})


def _same(c: Context, df: DataFrame) -> DataFrame:
    return df


def _column(c: Context, key: str) -> DataFrame | None:
    return c.load(c.parameters[key]) if c.parameters.get(key) else None


def _embed(c: Context, df: DataFrame, basis: DataFrame, k: int) -> DataFrame:
    x = F.col("value")
    for key, how in (("center_data_with", "-"), ("scale_data_with", "/")):
        if (side := _column(c, key)) is not None:
            df = df.join(linalg.small(side.withColumnRenamed("value", "s"), 2 * c.n_vox), "vox")
            x = x - F.col("s") if how == "-" else x / F.col("s")
            df = df.withColumn("value", x).drop("s")
            x = F.col("value")
    return linalg.unpacked(linalg.project(df, linalg.pack(basis, "vox", k), "vox", k)).select("run_id", "t", F.col("k").alias("vox"), "value")


def _unembed(c: Context, df: DataFrame, basis: DataFrame, k: int, n_vox: int) -> DataFrame:
    coef = linalg.repacked(df.select("run_id", "t", F.col("vox").alias("k"), "value"))
    out = linalg.reconstruct(coef, linalg.pack(basis, "vox", k), "vox", n_vox, c.roi)
    for key, how in (("scale_data_with", "*"), ("center_data_with", "+")):
        if (side := _column(c, key)) is not None:
            out = out.join(linalg.small(side.withColumnRenamed("value", "s"), 2 * n_vox), "vox")
            out = out.select("run_id", "t", "vox", (F.col("value") * F.col("s") if how == "*" else F.col("value") + F.col("s")).alias("value"))
    return out


def _components(basis: DataFrame) -> int:
    return int(basis.agg(F.max("k")).first()[0] or 0) + 1


def _embed_forward(c: Context, df: DataFrame) -> Result:
    basis = c.load(c.parameters["basis_path"])
    k = _components(basis)
    return Result(_embed(c, df, basis, k), {}, {"n_components": k, "n_vox": c.n_vox})


def _embed_inverse(c: Context, df: DataFrame) -> DataFrame:
    return _unembed(c, df, c.load(c.parameters["basis_path"]), c.parameters["n_components"], c.parameters["n_vox"])


# ---- sparse PCA --------------------------------------------------------------------------------------


def _sparsepca_forward(c: Context, df: DataFrame) -> Result:
    p = c.parameters
    d = sparse_components(df, c.n_vox, p["k"], p["alpha"], p["whiten"])
    sets = {c.path("basis"): Dataset(d.basis, "basis_matrix"), c.path("d"): Dataset(_vector(c.spark, d.d), "singular_values")}
    own = {"k": d.k, "n_vox": c.n_vox, "backend": "variable_projection"}
    if p["whiten"]:
        sets |= {c.path("center"): Dataset(d.mean, "center"), c.path("scale"): Dataset(d.scale, "scale")}
        own |= {"center_data_with": c.path("center"), "scale_data_with": c.path("scale")}
    inner = replace(c, parameters=p | own, load=lambda path: sets[path].df if path in sets else c.load(path))
    return Result(_embed(inner, df, d.projector, d.k), sets, own)


def _sparsepca_inverse(c: Context, df: DataFrame) -> DataFrame:
    return _unembed(c, df, c.load(c.path("basis")), c.parameters["k"], c.parameters["n_vox"])


# ---- temporal ------------------------------------------------------------------------------------------


def _temporal_basis(p: dict, n_time: int) -> np.ndarray:
    n = min(p["n_basis"], n_time)
    return bases.basis_matrix(p["kind"], n_time, n, order=p["order"], wavelet=p["wavelet"], time_bandwidth_product=p["time_bandwidth_product"], knot_spacing_method=p["knot_spacing_method"])


def _temporal_forward(c: Context, df: DataFrame) -> Result:
    p = dict(c.parameters)
    if p["kind"].startswith("modwt"):
        name = {"modwt": "sym8"}.get(p["kind"], p["kind"].removeprefix("modwt_"))
        levels = bases.modwt_levels(c.n_time, name, p.get("levels"))
        coef = temporal.modwt_project(df, name, levels)
        if p["threshold_type"] in ("energy", "adaptive"):
            raise NotSupported(f"threshold {p['threshold_type']} isn't defined for wavelet levels", "temporal:threshold_type")
        if p["threshold_type"] != "none":
            coef = temporal.modwt_shrink(coef, p["threshold_type"], p["fdr_alpha"], value=p.get("threshold_value"))
        place = (F.when(F.col("band") == "W", 0).otherwise(levels) + F.col("level") - 1) * c.n_time + F.col("t")
        return Result(coef.select("run_id", place.cast("int").alias("t"), "vox", "value"), {}, {"levels": levels, "wavelet": name, "n_time": c.n_time})
    b = _temporal_basis(p, c.n_time)
    coef = temporal.project_least_squares(df, b) if p["kind"] == "bspline" else temporal.project(df, b)
    kind = p["threshold_type"]
    if kind == "energy":
        coef = temporal.energy_threshold(coef, p["keep_energy"])
    elif kind == "fdr":
        coef = temporal.fdr_by_run(coef, temporal.noise_by_run(coef), p["fdr_alpha"])
    else:
        coef = temporal.shrink(coef, kind, p.get("threshold_value"))
    rows = [(t, [float(x) for x in r]) for t, r in enumerate(b)]
    sets = {c.path("basis"): Dataset(c.spark.createDataFrame(rows, "t int, w array<double>"), "temporal_basis")}
    if p["kind"] == "bspline":
        sets[c.path("knots")] = Dataset(_vector(c.spark, bases.bspline_knots(c.n_time, b.shape[1], p["order"])), "knots")
    return Result(coef.select("run_id", F.col("k").alias("t"), "vox", "value"), sets, {"n_basis": b.shape[1], "n_time": c.n_time})


def _temporal_inverse(c: Context, df: DataFrame) -> DataFrame:
    p = c.parameters
    if p["kind"].startswith("modwt"):
        n, levels = p["n_time"], p["levels"]
        band = F.floor(F.col("t") / n)
        coef = df.select("run_id", "vox", F.when(band < levels, "W").otherwise("V").alias("band"), (band % levels + 1).cast("int").alias("level"), (F.col("t") % n).cast("int").alias("t"), "value")
        return temporal.modwt_reconstruct(coef, n, p["wavelet"])
    basis = c.load(c.path("basis"))
    if c.times:
        basis = basis.where(F.col("t").isin([int(t) for t in c.times]))
    coef = linalg.repacked(df.select("run_id", "vox", F.col("t").alias("k"), "value"))
    return linalg.reconstruct(coef, basis, "t", p["n_time"]).select("run_id", "t", "vox", "value")


# ---- runs ------------------------------------------------------------------------------------------------


def _aggregate_forward(c: Context, df: DataFrame) -> Result:
    included = [r.run_id for r in df.select("run_id").distinct().orderBy("run_id").collect()]  # at most 100
    return Result(runs.aggregate_runs(df, c.parameters["agg_op"]), {}, {"runs_included": included, "orig_dims": list(c.frame.dims)})


# ---- radial bases ------------------------------------------------------------------------------------------


def _geometry(c: Context) -> dict:
    s = c.frame.space
    return {"spacing": s.spacing, "origin": s.origin} if s else {}


def _edges(c: Context, df: DataFrame) -> DataFrame | None:
    e = c.parameters.get("edge_adaptive")
    if not e:
        return None
    if e.get("source", "self_mean") == "structural_path":
        volume = c.load(e["structural_path"])
        if affine := e.get("affine"):  # from voxels of the array to voxels of the volume
            volume = spatial.resample(volume, tuple(e["structural_dims"]), c.frame.dims, np.array(affine, float).reshape(4, 4))
        g = spatial.sobel(volume, c.frame.dims)
    else:
        g = spatial.sobel(spatial.self_mean(df), c.frame.dims)
    return spatial.edge_map(g, c.mask(), e.get("edge_thresh_k", option("edge.thresh_k"))).groupBy("vox").agg(F.max("edge").alias("edge"))


def _hrbf(c: Context, df: DataFrame | None = None):
    p = c.parameters
    centres = None
    if p.get("centres_path"):
        centres = c.load(p["centres_path"])
    return spatial.hrbf_basis(c.mask(), c.frame.dims, p, centres=centres, edges=_edges(c, df) if df is not None else None, **_geometry(c))


def _hrbf_forward(c: Context, df: DataFrame) -> Result:
    atoms, centres = _hrbf(c, df)
    k = centres.count()
    inside = df.join(c.mask(), "vox", "left_semi")
    coef = spatial.project_atoms(inside, atoms).select("run_id", "t", F.col("k").cast("int").alias("vox"), "value")
    sets = {c.path("centres"): Dataset(centres, "hrbf_centres")}
    if c.parameters.get("store_dense_matrix"):
        sets[c.path("matrix")] = Dataset(atoms, "basis_matrix")
    return Result(coef, sets, {"k_actual": k, "mask_hash": spatial.mask_hash(c.mask())})


def _hrbf_inverse(c: Context, df: DataFrame) -> DataFrame:
    if (stored := c.parameters.get("mask_hash")) and stored != spatial.mask_hash(c.mask()):
        if option("read.strict_mask_hash_validation"):
            raise ValidationError("the mask isn't the one the archive was made with", "hrbf:mask_hash")
        warn("the mask isn't the one the archive was made with", MaskMismatch)
    inner = replace(c, parameters=c.parameters | {"centres_path": c.path("centres")})
    atoms, _ = _hrbf(inner)
    if c.roi is not None:
        atoms = atoms.join(c.roi.select("vox"), "vox", "left_semi")
    return spatial.reconstruct_atoms(df.select("run_id", "t", F.col("vox").alias("k"), "value"), atoms)


def _project_forward(c: Context, df: DataFrame) -> Result:
    out = _hrbf_forward(c, df)
    return Result(out.df, {c.path("centres"): out.datasets[c.path("centres")]}, out.parameters)


# ---- Haar pyramid ----------------------------------------------------------------------------------------


def _haar_forward(c: Context, df: DataFrame) -> Result:
    p = c.parameters
    root, detail = haar.analyse(df, c.mask(), c.frame.dims, p["levels"])
    detail = haar.sparsify(root, detail, p["levels"], p["detail_threshold_type"], p["detail_threshold_value"])
    rows = root.select("run_id", "t", F.lit(0).alias("level"), "code", "value").unionByName(detail)
    places = rows.select("level", "code").distinct()
    places = ranks.numbered(places, "level", "code", name="vox").withColumn("vox", F.col("vox").cast("int"))
    out = rows.join(places, ["level", "code"]).select("run_id", "t", "vox", "value")
    out = out.repartitionByRange("run_id", "vox").sortWithinPartitions("run_id", "vox", "t")
    return Result(out, {c.path("places"): Dataset(places, "coefficient_places"), c.path("valid_blocks"): Dataset(haar.valid_blocks(c.mask(), c.frame.dims), "valid_blocks", "int64")}, {"morton_hash": spatial.morton_hash(c.mask(), c.frame.dims)})


def _haar_inverse(c: Context, df: DataFrame) -> DataFrame:
    levels, dims, mask, places = c.parameters["levels"], c.frame.dims, c.mask(), c.load(c.path("places"))
    if c.roi is not None:
        places, _ = as_table(places.join(haar.needed_coefficients(c.roi, mask, dims, levels), ["level", "code"], "left_semi"))
        # places are in Z-order, and so are the files: what a region needs is in few ranges, one a level, which the scan can skip the rest by
        spans = places.groupBy("level").agg(F.min("vox").alias("first"), F.max("vox").alias("last")).collect()
        inside = F.lit(False)
        for r in spans:
            inside = inside | F.col("vox").between(r["first"], r["last"])
        df = df.where(inside)
    rows = df.join(places, "vox")
    root = rows.where("level = 0").select("run_id", "t", "code", "value")
    detail = rows.where("level > 0").select("run_id", "t", "level", "code", "value")
    return haar.synthesise(root, detail, mask, dims, levels, c.roi)


# ---- compressed and transferred bases -------------------------------------------------------------------


def _empirical_forward(c: Context, df: DataFrame) -> Result:
    """Codes the rows of a stored basis on an analytic dictionary; the data pass through.

    The basis is left vectors times singular values times right vectors; values times right vectors are coded by matching pursuit.
    """
    p = c.parameters
    basis = c.load(p["basis_path"])
    k = _components(basis)
    rows = basis.select(F.lit("basis").alias("run_id"), F.col("k").alias("t"), "vox", F.col("w").alias("value"))
    tiles, n, row_blocks, _, _, _ = blocks.prepared(rows, c.n_vox, False, False)
    s = blocks.singular(tiles, c.n_vox, n, min(p["svd_rank"], k, c.n_vox), row_blocks)
    m = max(1, int((s.d > 1e-12).sum()))
    left = blocks.left_cells(tiles, s, c.n_vox, row_blocks).where(F.col("component") < m)
    scaled = blocks.cells_of(blocks.times_small(s.right, np.diag(s.d)[:, :m]), c.n_vox)
    targets = scaled.select(F.col("k").alias("component"), "vox", F.col("w").alias("value"))
    atoms, centres = _hrbf(c)
    found = pursuit.pursue(targets, atoms, p["omp_tol"], p["omp_sparsity_limit"])
    top = 2 ** (p["omp_quant_bits"] - 1) - 1
    peak = F.max(F.abs("weight")).over(Window.partitionBy("component"))  # at most omp_sparsity_limit rows
    scale = F.when(F.col("peak") > 0, F.col("peak") / top).otherwise(1.0)
    codes = found.withColumn("peak", peak).withColumn("scale", scale).select("component", "k", F.rint(F.col("weight") / F.col("scale")).cast("int").alias("q"), "scale")
    return Result(df, {c.path("hrbf_codes"): Dataset(codes, "hrbf_codes", "int8"), c.path("left"): Dataset(left, "left_vectors"), c.path("centres"): Dataset(centres, "hrbf_centres")}, {"svd_rank": m})


def decode_empirical(c: Context) -> DataFrame:
    """(k, vox, w): the basis that the codes stand for."""
    inner = replace(c, parameters=c.parameters | {"centres_path": c.path("centres")})
    atoms, _ = _hrbf(inner)
    codes = c.load(c.path("hrbf_codes")).select("component", F.col("k").alias("atom"), (F.col("q") * F.col("scale")).alias("c"))
    rows = codes.join(atoms.withColumnRenamed("k", "atom"), "atom").groupBy("component", "vox").agg(F.sum(F.col("c") * F.col("w")).alias("x"))
    return rows.join(c.load(c.path("left")), "component").groupBy("k", "vox").agg(F.sum(F.col("u") * F.col("x")).alias("w"))


def _transfer_forward(c: Context, df: DataFrame) -> Result:
    from ..sources.archive import load_basis

    basis = load_basis(c.spark, c.parameters["source_archive"], c.parameters["source_descriptor"])
    k = _components(basis)
    return Result(_embed(c, df, basis, k), {}, {"n_components": k, "n_vox": c.n_vox})


def _transfer_inverse(c: Context, df: DataFrame) -> DataFrame:
    from ..sources.archive import load_basis

    basis = load_basis(c.spark, c.parameters["source_archive"], c.parameters["source_descriptor"])
    return _unembed(c, df, basis, c.parameters["n_components"], c.parameters["n_vox"])


def _register() -> None:
    table = {
        "quant": (_quant_forward, _quant_inverse, "compression", "", 1, ("roi", "time")),
        "quant_refactored": (_quant_forward, _quant_inverse, "compression", "", 1, ("roi", "time")),
        "delta": (_delta_forward, _delta_inverse, "compression", "t", 1, ("roi", "time")),
        "basis": (_basis_forward, _same, "dimensionality", "", 2, ("roi", "time")),
        "embed": (_embed_forward, _embed_inverse, "dimensionality", "vox", 2, ("roi", "time")),
        "embed.pca": (_embed_forward, _embed_inverse, "dimensionality", "vox", 2, ("roi", "time")),
        "embed.hrbf_analytic": (_embed_forward, _embed_inverse, "dimensionality", "vox", 2, ("roi", "time")),
        "temporal": (_temporal_forward, _temporal_inverse, "temporal", "t", 3, ("roi", "time")),
        "sparsepca": (_sparsepca_forward, _sparsepca_inverse, "dimensionality", "vox", 3, ("roi", "time")),
        "aggregate_runs": (_aggregate_forward, _same, "utility", "run", 3, ("roi", "time")),
        "spat.hrbf": (_hrbf_forward, _hrbf_inverse, "spatial", "vox", 3, ("roi", "time")),
        "spat.hrbf_project": (_project_forward, _hrbf_inverse, "spatial", "vox", 3, ("roi", "time")),
        "spat.haar_octwave": (_haar_forward, _haar_inverse, "spatial", "vox", 3, ("roi", "time")),
        "basis.empirical_hrbf_compressed": (_empirical_forward, _same, "dimensionality", "", 3, ()),
        "embed.transfer_hrbf_basis": (_transfer_forward, _transfer_inverse, "dimensionality", "vox", 3, ("roi", "time")),
    }
    for type, (f, i, category, changes, rank, caps) in table.items():
        register_transform(type, f, i, category=category, changes=changes, min_rank=rank, capabilities=caps, force=True)
    assert set(table) == set(STEPS)


_register()
