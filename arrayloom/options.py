"""Engine options, and the parameters of every step with their defaults and rules."""

from __future__ import annotations

import copy
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from .errors import InvalidParameters, NoMethod

#: Option names and defaults that archives and callers rely on.
DEFAULTS: dict[str, Any] = {
    "write.compression_level": 0,
    "write.chunk_target_mib": 1,
    "write.file_line_limit": 50,
    "read.file_line_limit": 1000,
    "read.strict_mask_hash_validation": False,
    "memory.target_slab_bytes": 64e6,
    "quant.clip_warn_pct": 0.5,
    "quant.clip_abort_pct": 5.0,
    "quant.snr_sample_frac": 0.01,
    "quant.bits_min": 1,
    "quant.bits_max": 16,
    "quant": {},
    "delta": {},
    "basis.pca": {},
    "basis.default_keep_energy": 0.99,
    "temporal.polynomial_order": 3,
    "temporal.bspline_order": 3,
    "temporal.wavelet_type": "db4",
    "temporal.dpss_nw": 4,
    "poisson.radius_factor": 2.5,
    "poisson.density_factor": 1.5,
    "edge.thresh_k": 3.0,
    "numeric.tolerance": 1e-7,
    "paths.scans_root": "/scans/",
    "paths.transforms_root": "/transforms/",
    "paths.temporal_root": "/temporal/",
    "paths.metadata_root": "/metadata/",
    "defaults.run_id": "run-01",
    "defaults.input_key": "input",
    "defaults.origin_label": "global",
    # limits of this engine: what may be broadcast or held by one task
    "broadcast.max_cells": 4_000_000,
    "kernel.max_features": 256,
    "kernel.max_series": 4_000_000,
    # singular values: largest change, in units of the largest value, that ends the rounds, and their number at most
    "svd.tolerance": 1e-10,
    "svd.max_rounds": 40,
}

_options: dict[str, Any] = copy.deepcopy(DEFAULTS)


def options(*names: str, **changes: Any) -> dict[str, Any]:
    """Options by name (all without a name); keyword arguments set some, dots written as two underscores."""
    for k, v in changes.items():
        _options[k.replace("__", ".")] = v
    return {k: copy.deepcopy(_options.get(k)) for k in names} if names else copy.deepcopy(_options)


def option(name: str) -> Any:
    return _options[name]


def set_options(values: Mapping[str, Any]) -> None:
    _options.update(values)


def reset_options() -> None:
    _options.clear()
    _options.update(copy.deepcopy(DEFAULTS))


@dataclass(frozen=True)
class Parameter:
    """A step's parameter: default, allowed values or range; required has no default."""

    default: Any = None
    choices: tuple = ()
    low: float | None = None
    high: float | None = None
    kind: type | tuple[type, ...] | None = None
    required: bool = False

    def check(self, name: str, value: Any) -> None:
        where = f"parameter {name}"
        if value is None:
            if self.required:
                raise InvalidParameters(f"{name} is required", where)
            return
        if self.choices and value not in self.choices:
            raise InvalidParameters(f"{name} is {value!r}, not one of {', '.join(map(repr, self.choices))}", where)
        if self.kind and (not isinstance(value, self.kind) or (isinstance(value, bool) and self.kind in (int, (int, float)))):
            raise InvalidParameters(f"{name} has the wrong type: {value!r}", where)
        if self.low is not None and value < self.low or self.high is not None and value > self.high:
            raise InvalidParameters(f"{name} is {value}, outside {self.low} to {self.high}", where)


NUMBER = (int, float)
_HRBF = {
    "sigma0": Parameter(6.0, kind=NUMBER, low=1e-9),
    "levels": Parameter(3, kind=int, low=0),
    "radius_factor": Parameter(2.5, kind=NUMBER, low=1e-9),
    "kernel_type": Parameter("gaussian", choices=("gaussian", "wendland_c4")),
    "kernel_type_fine_levels": Parameter("wendland_c4", choices=("gaussian", "wendland_c4")),
    "num_extra_fine_levels": Parameter(0, kind=int, low=0),
    "num_fine_levels_alt_kernel": Parameter(0, kind=int, low=0),
    "seed": Parameter(1, kind=int),
    "edge_adaptive": Parameter(kind=dict),
}

#: Step type -> parameters. Fixed values where they are defaults that users of the format rely on.
STEPS: dict[str, dict[str, Parameter]] = {
    "quant": {
        "bits": Parameter(8, kind=int, low=1, high=16),
        "method": Parameter("range", choices=("range", "sd")),
        "center": Parameter(True, kind=bool),
        "scale_scope": Parameter("global", choices=("global", "voxel")),
        "allow_clip": Parameter(False, kind=bool),
        "snr_sample_frac": Parameter(0.01, kind=NUMBER, low=0, high=1),
    },
    "delta": {
        "order": Parameter(1, kind=int, low=1),
        "axis": Parameter(-1, choices=(-1, 1, 2)),
        "coding_method": Parameter("none", choices=("none", "rle", "range_coded")),
        "reference_value_storage": Parameter("first_value_verbatim", choices=("first_value_verbatim", "reconstruct_from_deltas")),
    },
    "basis": {
        "method": Parameter("pca", choices=("pca", "ica", "nmf")),
        "k": Parameter(20, kind=int, low=1),
        "center": Parameter(True, kind=bool),
        "scale": Parameter(False, kind=bool),
        "storage_order": Parameter("component_x_voxel", choices=("component_x_voxel", "voxel_x_component")),
    },
    "embed": {"basis_path": Parameter(kind=str, required=True), "center_data_with": Parameter(kind=str), "scale_data_with": Parameter(kind=str)},
    "temporal": {
        "kind": Parameter("dct", kind=str),
        "n_basis": Parameter(20, kind=int, low=0),
        "order": Parameter(3, kind=int, low=1),
        "knot_spacing_method": Parameter("equidistant", choices=("equidistant", "quantile")),
        "time_bandwidth_product": Parameter(3.0, kind=NUMBER, low=1e-9),
        "n_tapers": Parameter(1, kind=int, low=1),
        "wavelet": Parameter("db4", kind=str),
        "scope": Parameter("global", choices=("global", "voxelwise")),
        "threshold_type": Parameter("none", choices=("none", "soft", "hard", "energy", "adaptive", "bayes_shrink", "sure", "fdr")),
        "threshold_value": Parameter(kind=NUMBER, low=0),
        "keep_energy": Parameter(0.99, kind=NUMBER, low=0, high=1),
        "noise_estimator": Parameter("mad", choices=("mad", "bayes", "std")),
        "robust_lifting": Parameter(False, kind=bool),
        "fdr_alpha": Parameter(0.05, kind=NUMBER, low=0, high=1),
        "levels": Parameter(kind=int, low=1, high=10),
    },
    "sparsepca": {
        "k": Parameter(50, kind=int, low=1),
        "alpha": Parameter(1e-3, kind=NUMBER, low=0),
        "whiten": Parameter(False, kind=bool),
        "seed": Parameter(42, kind=int),
        "storage_order": Parameter("component_x_voxel", choices=("component_x_voxel", "voxel_x_component")),
    },
    "aggregate_runs": {"agg_op": Parameter("sum", choices=("sum", "mean", "concatenate"))},
    "spat.hrbf": _HRBF | {"centres_path": Parameter(kind=str), "sigma_vec_path": Parameter(kind=str), "store_dense_matrix": Parameter(False, kind=bool)},
    "spat.hrbf_project": dict(_HRBF),
    "spat.haar_octwave": {
        "levels": Parameter(kind=int, low=1, required=True),
        "z_order_seed": Parameter(42, kind=int),
        "detail_threshold_type": Parameter("none", choices=("none", "absolute", "relative_to_root_std")),
        "detail_threshold_value": Parameter(0.005, kind=NUMBER, low=0),
    },
    "basis.empirical_hrbf_compressed": _HRBF
    | {
        "basis_path": Parameter(kind=str, required=True),
        "svd_rank": Parameter(120, kind=int, low=1),
        "omp_tol": Parameter(0.01, kind=NUMBER, low=0),
        "omp_sparsity_limit": Parameter(32, kind=int, low=1),
        "omp_quant_bits": Parameter(5, kind=int, low=2, high=16),
    },
    "embed.transfer_hrbf_basis": {"source_archive": Parameter(kind=str, required=True), "source_descriptor": Parameter(kind=str, required=True), "center_data_with": Parameter(kind=str), "scale_data_with": Parameter(kind=str)},
}
STEPS["quant_refactored"] = STEPS["quant"]
STEPS["embed.pca"] = STEPS["embed.hrbf_analytic"] = STEPS["embed"]


@dataclass
class Schema:
    """Parameters of user-defined steps, added by register_parameters()."""

    steps: dict[str, dict[str, Parameter]] = field(default_factory=lambda: dict(STEPS))


_schema = Schema()


def register_parameters(type: str, parameters: dict[str, Parameter]) -> None:
    _schema.steps[type] = parameters


def default_parameters(type: str) -> dict[str, Any]:
    if type not in _schema.steps:
        raise NoMethod(f"no parameters are known for step type {type!r}", "default_parameters")
    return {k: copy.deepcopy(p.default) for k, p in _schema.steps[type].items() if p.default is not None}


def merged(base: Mapping[str, Any], *more: Mapping[str, Any]) -> dict[str, Any]:
    """Deep merge; a None set explicitly stays."""
    out = copy.deepcopy(dict(base))
    for m in more:
        for k, v in m.items():
            out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else copy.deepcopy(v)
    return out


def resolve_parameters(type: str, given: Mapping[str, Any] | None = None, strict: bool = True, checked: bool = True) -> dict[str, Any]:
    """Defaults, then options under the step's type, then what is given.

    Names are always checked; values unless checked is false; strict also wants the required ones.
    """
    known = _schema.steps.get(type)
    if known is None:
        raise NoMethod(f"no step type {type!r}", "resolve_parameters", type=type)
    given = {k: v for k, v in (given or {}).items()}
    if unknown := [k for k in given if k not in known]:
        raise InvalidParameters(f"unknown parameters of {type}: {', '.join(unknown)}", "resolve_parameters", type=type)
    out = merged(default_parameters(type), _options.get(type) or {}, given)
    for k, p in known.items():
        if checked and (strict or out.get(k) is not None):
            p.check(k, out.get(k))
    return out
