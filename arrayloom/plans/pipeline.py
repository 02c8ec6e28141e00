"""A fluent pipeline of steps over an array, verbs and templates for it, and a facade with defaults."""

from __future__ import annotations

import copy
import json
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import EngineError, InvalidParameters, StepError, ValidationError, warn
from ..model import ArrayFrame
from ..options import default_parameters, merged, resolve_parameters
from ..sources.archive import Reader, Step, plan, read_archive, step_name, write_archive
from .registry import get_transform

_verbs: dict[str, str] = {}
_templates: dict[str, Callable[..., Pipeline]] = {}


class Pipeline:
    """An ordered list of steps and the array they are for. Verbs return the pipeline itself."""

    def __init__(self, frame: ArrayFrame | None = None):
        self.frame = frame
        self.steps: list[Step] = []

    # -- building ----------------------------------------------------------------------------------

    def set_input(self, frame: ArrayFrame) -> Pipeline:
        self.frame = frame
        return self

    def add_step(self, type: str, parameters: dict[str, Any] | None = None, at: int | None = None) -> Pipeline:
        given = {k: v for k, v in (parameters or {}).items() if v is not None}
        step = Step(type, resolve_parameters(type, given, strict=False, checked=False))
        self.steps.insert(len(self.steps) if at is None else at, step)
        return self

    def _index(self, which: int | str) -> int:
        """Place of a step by number (from 0, negative from the end) or by type (its last one)."""
        if isinstance(which, int):
            if not -len(self.steps) <= which < len(self.steps):
                raise ValidationError(f"no step {which} of {len(self.steps)}", "Pipeline")
            return which % len(self.steps)
        found = [k for k, s in enumerate(self.steps) if s.type == which]
        if not found:
            raise ValidationError(f"no step of type {which!r}", "Pipeline")
        return found[-1]

    def get_step(self, which: int | str) -> Step:
        return self.steps[self._index(which)]

    def modify_step(self, which: int | str, **parameters: Any) -> Pipeline:
        """Sets parameters; None sets one back to its default."""
        k = self._index(which)
        s = self.steps[k]
        new = dict(s.parameters)
        defaults = default_parameters(s.type)
        for name, value in parameters.items():
            if value is None:
                new.pop(name, None)
                if name in defaults:
                    new[name] = defaults[name]
            else:
                new[name] = value
        self.steps[k] = Step(s.type, resolve_parameters(s.type, new, strict=False, checked=False))
        return self

    def remove_step(self, which: int | str) -> Pipeline:
        del self.steps[self._index(which)]
        return self

    def insert_step(self, type: str, parameters: dict[str, Any] | None = None, *, before: int | str | None = None, after: int | str | None = None) -> Pipeline:
        if (before is None) == (after is None):
            raise ValidationError("say either before or after", "Pipeline.insert_step")
        return self.add_step(type, parameters, self._index(before) if before is not None else self._index(after) + 1)

    def validate(self, strict: bool = False) -> list[str]:
        """Problems of the steps' parameters; strict raises on any."""
        issues = []
        for k, s in enumerate(self.steps):
            try:
                get_transform(s.type)
                resolve_parameters(s.type, s.parameters)
            except EngineError as e:
                issues.append(f"step {k} ({s.type}): {e}")
        if issues and strict:
            raise InvalidParameters("; ".join(issues), "Pipeline.validate")
        return issues

    # -- verbs -------------------------------------------------------------------------------------

    def quant(self, **p: Any) -> Pipeline:
        return self.add_step("quant", p)

    def delta(self, **p: Any) -> Pipeline:
        return self.add_step("delta", p)

    def temporal(self, **p: Any) -> Pipeline:
        return self.add_step("temporal", p)

    def pca(self, **p: Any) -> Pipeline:
        return self.add_step("basis", {"method": "pca"} | p)

    def sparsepca(self, **p: Any) -> Pipeline:
        return self.add_step("sparsepca", p)

    def hrbf(self, **p: Any) -> Pipeline:
        return self.add_step("spat.hrbf", p)

    def haar(self, **p: Any) -> Pipeline:
        return self.add_step("spat.haar_octwave", p)

    def aggregate_runs(self, **p: Any) -> Pipeline:
        return self.add_step("aggregate_runs", p)

    def embed(self, basis_path: str | None = None, **p: Any) -> Pipeline:
        """Projects on the basis of the step before, unless a path is given."""
        if basis_path is None:
            if not self.steps or not self.steps[-1].type.startswith(("basis", "spat.hrbf")):
                raise ValidationError("the step before makes no basis and no basis_path is given", "Pipeline.embed")
            last = self.steps[-1]
            name = step_name(len(self.steps) - 1, last.type)
            basis_path = f"{name}/matrix"
            if last.type == "basis":
                p = {"center_data_with": f"{name}/center" if last.parameters.get("center", True) else None, "scale_data_with": f"{name}/scale" if last.parameters.get("scale") else None} | p
        return self.add_step("embed", {"basis_path": basis_path} | p)

    def __getattr__(self, verb: str):
        if verb in _verbs:
            return lambda **p: self.add_step(_verbs[verb], p)
        raise AttributeError(verb)

    def apply_template(self, name: str, /, *args: Any, **overrides: Any) -> Pipeline:
        """Adds a template's steps. Overrides name a step and a parameter, as quant__bits=6 or quant={"bits": 6}."""
        if name not in _templates:
            raise ValidationError(f"no template {name!r}; there are {', '.join(sorted(_templates))}", "apply_template")
        own = {k: v for k, v in overrides.items() if "__" not in k and not isinstance(v, dict)}
        start = len(self.steps)
        _templates[name](self, *args, **own)
        for key, value in overrides.items():
            if "__" in key:
                step, parameter = key.split("__", 1)
                changes = {parameter: value}
            elif isinstance(value, dict):
                step, changes = key, value
            else:
                continue
            step = step.replace("hrbf", "spat.hrbf") if step == "hrbf" else "basis" if step == "pca" else step
            at = next((k for k in range(len(self.steps) - 1, start - 1, -1) if self.steps[k].type == step), None)
            if at is None:
                raise ValidationError(f"the template has no step {step!r}", "apply_template")
            self.modify_step(at, **changes)
        return self

    # -- looking at it -----------------------------------------------------------------------------

    def diagram(self, engine: str = "dot") -> str:
        """The steps as a graph: dot, or ascii."""
        boxes = ["input", *[f"{k} {s.type}\n{_short(s.parameters)}" for k, s in enumerate(self.steps)], "archive"]
        if engine == "ascii":
            return "\n  |\n".join(b.replace("\n", " ") for b in boxes)
        if engine not in ("dot", "grViz"):
            raise ValidationError(f"unknown engine {engine!r}", "Pipeline.diagram")
        label = lambda b: json.dumps(b)
        lines = [f"  n{k} [label={label(b)}];" for k, b in enumerate(boxes)] + [f"  n{k} -> n{k + 1};" for k in range(len(boxes) - 1)]
        return "digraph pipeline {\n  rankdir=LR;\n" + "\n".join(lines) + "\n}"

    def __repr__(self) -> str:
        return f"<Pipeline of {len(self.steps)} steps: {', '.join(s.type for s in self.steps) or 'none'}>"

    def explain(self) -> str:
        """The physical plan of what would be stored."""
        df = plan(self._input(), self.steps).datasets["scans/values"][0].df
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")

    # -- running -----------------------------------------------------------------------------------

    def _input(self) -> ArrayFrame:
        if self.frame is None:
            raise ValidationError("the pipeline has no input", "Pipeline")
        return self.frame

    def write(self, path: str | None = None, **options: Any) -> str:
        try:
            return write_archive(self._input(), path, self.steps, **options)
        except EngineError as e:
            if e.step is not None:
                raise StepError(f"pipeline failed in step {e.step}: {e}", "Pipeline.write", e.step, e.type) from e
            raise


def _short(p: dict) -> str:
    shown = {k: v for k, v in p.items() if v is not None}
    text = ", ".join(f"{k}={v}" for k, v in list(shown.items())[:4])
    return text + (", ..." if len(shown) > 4 else "")


def as_pipeline(frame: ArrayFrame) -> Pipeline:
    return Pipeline(frame)


def register_verb(type: str, name: str | None = None, force: bool = False) -> str:
    """Makes a step type a verb of pipelines; without a name its letters and digits make one."""
    if not isinstance(type, str) or not type:
        raise ValidationError("a step type is a non-empty string", "register_verb")
    name = name or re.sub(r"[^A-Za-z0-9]+", "_", type)
    if name in _verbs and not force:
        warn(f"verb {name!r} is already registered")
    else:
        _verbs[name] = type
    return name


def verbs() -> dict[str, str]:
    return dict(_verbs)


def register_template(name: str, build: Callable[..., Any], force: bool = False) -> None:
    """A function (pipeline, ...) that adds steps becomes a template."""
    if name in _templates and not force:
        warn(f"template {name!r} is already registered")
    else:
        _templates[name] = build


def templates() -> list[str]:
    return sorted(_templates)


register_template("compact", lambda p, k=20, bits=8: p.pca(k=k).embed().quant(bits=bits))
register_template("smooth", lambda p, n_basis=20, bits=8: p.temporal(kind="dct", n_basis=n_basis).quant(bits=bits))


class Facade:
    """Reads and writes with defaults for steps; remembers the last path written."""

    def __init__(self, spark: SparkSession):
        self.spark, self._defaults, self.last_path = spark, {}, None

    def set_defaults(self, **by_type: dict[str, Any]) -> Facade:
        self._defaults = merged(self._defaults, by_type)
        return self

    def write(self, frame: ArrayFrame, path: str | None = None, steps=(), **options: Any) -> str:
        from ..sources.archive import as_steps

        full = [Step(s.type, merged(self._defaults.get(s.type, {}), s.parameters)) for s in as_steps(steps)]
        self.last_path = write_archive(frame, path, full, **options)
        return self.last_path

    def write_pipeline(self, pipeline: Pipeline, path: str | None = None, **options: Any) -> str:
        self.last_path = pipeline.write(path, **options)
        return self.last_path

    def read(self, path: str | None = None, **options: Any) -> DataFrame | Reader:
        path = path or self.last_path
        if path is None:
            raise ValidationError("no path, and nothing was written", "Facade.read")
        return read_archive(self.spark, path, **options)


def workflow(frame: ArrayFrame, kind: str = "full", tr: float = 2.0, study_type: str = "resting", bits: int = 8, k: int = 20) -> Pipeline:
    """A usual pipeline: denoise (Slepian in time), compress (components and codes), or full (both)."""
    from ..functions.bases import suggest_dpss

    if kind not in ("compress", "denoise", "full"):
        raise ValidationError(f"unknown workflow {kind!r}", "workflow")
    p = Pipeline(frame)
    if kind in ("denoise", "full"):
        s = suggest_dpss(tr, frame.n_time, study_type)
        p.temporal(kind="dpss", n_basis=s["n_basis"], time_bandwidth_product=s["time_bandwidth_product"])
    if kind == "compress":
        p.pca(k=k).embed()
    if kind in ("compress", "full"):
        p.quant(bits=bits)
    return p


# ---- short forms ---------------------------------------------------------------------------------------


def quantize_data(frame: ArrayFrame, **parameters: Any) -> tuple[DataFrame, DataFrame]:
    """(codes, params) of one quant step."""
    from ..operators import quant

    p = resolve_parameters("quant", parameters)
    params = quant.quant_params(quant.quant_stats(frame.df, p["scale_scope"]), p["bits"], p["method"], p["center"])
    return quant.quantise(frame.df, params, p["bits"]), params


def dequantize_data(codes: DataFrame, params: DataFrame) -> DataFrame:
    from ..operators import quant

    return quant.dequantise(codes, params)


def sparse_pca(frame: ArrayFrame, k: int = 50, alpha: float = 1e-3, whiten: bool = False):
    from ..operators.sparse_pca import sparse_components

    return sparse_components(frame.df, frame.n_vox, k, alpha, whiten)


def space_centres(frame: ArrayFrame, **parameters: Any) -> DataFrame:
    """Centres of a radial dictionary over the frame's mask."""
    from ..operators import spatial

    p = resolve_parameters("spat.hrbf", parameters)
    s = frame.space
    geometry = {"spacing": s.spacing, "origin": s.origin} if s else {}
    return spatial.hrbf_centres(frame.voxels().where("in_mask").select("vox"), frame.dims, p["sigma0"], p["levels"], p["radius_factor"], p["num_extra_fine_levels"], p["seed"], **geometry)


def space_embed(frame: ArrayFrame, **parameters: Any) -> tuple[DataFrame, DataFrame]:
    """(coefficients, atoms) on a radial dictionary."""
    from ..operators import spatial

    p = resolve_parameters("spat.hrbf", parameters)
    atoms, _ = spatial.hrbf_basis(frame.voxels().where("in_mask").select("vox"), frame.dims, p)
    return spatial.project_atoms(frame.df, atoms), atoms


def space_reconstruct(coefficients: DataFrame, atoms: DataFrame) -> DataFrame:
    from ..operators import spatial

    return spatial.reconstruct_atoms(coefficients, atoms)


def adaptive_scope(frame: ArrayFrame, most: float = 0.5) -> str:
    """voxel where ranges differ much between voxels (coefficient of variation), else global."""
    from pyspark.sql import functions as F

    ranges = frame.df.groupBy("run_id", "vox").agg((F.max("value") - F.min("value")).alias("r"))
    cv = ranges.agg((F.stddev_samp("r") / F.avg("r")).alias("cv")).first().cv
    return "voxel" if cv is not None and cv > most else "global"


def copy_of(p: Pipeline) -> Pipeline:
    out = Pipeline(p.frame)
    out.steps = copy.deepcopy(p.steps)
    return out
