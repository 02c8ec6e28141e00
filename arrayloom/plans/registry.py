"""Registered step types with their capabilities, and checks and scaffolds for new ones."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from importlib.metadata import entry_points
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import MissingMethod, NoMethod, ValidationError, warn
from ..options import Parameter, default_parameters, register_parameters


@dataclass(frozen=True)
class Transform:
    """forward(context, frame) -> Result; inverse(context, frame) -> frame. Either may be absent."""

    type: str
    forward: Callable | None
    inverse: Callable | None
    category: str = "general"
    capabilities: tuple[str, ...] = ()
    changes: str = ""  # axes that stop being the array's own: t, vox, run
    min_rank: int = 1
    added: str = field(default_factory=lambda: datetime.datetime.now(datetime.UTC).isoformat())


_types: dict[str, Transform] = {}

#: Entry points of this group are functions without arguments that register a package's step types.
GROUP = "arrayloom.steps"
_loaded: set[tuple[str, str]] = set()


def load_packages(group: str = GROUP) -> dict[str, list[str]]:
    """Calls the installed packages' functions that haven't been called yet: the step types that each brought, by entry point.

    A type that is registered already stays as it is, with a warning, also if the package forces its own; a package that fails is warned of and left out.
    """
    out = {}
    for point in sorted(entry_points(group=group), key=lambda e: (e.name, e.value)):
        if (point.name, point.value) in _loaded:
            continue
        _loaded.add((point.name, point.value))
        before = dict(_types)
        try:
            point.load()()
        except Exception as e:  # whatever a package does wrong, the others work
            _types.clear()
            _types.update(before)
            warn(f"package {point.name} ({point.value}) can't be used: {e}")
            continue
        if taken := [t for t in before if _types.get(t) is not before[t]]:
            warn(f"package {point.name} brings step types that are registered already: {', '.join(taken)}")
            _types.update({t: before[t] for t in taken})
        out[point.name] = sorted(set(_types) - set(before))
    return out


def register_transform(type: str, forward: Callable | None = None, inverse: Callable | None = None, *, parameters: dict[str, Parameter] | None = None, force: bool = False, **facts: Any) -> Transform:
    if not type or not isinstance(type, str):
        raise ValidationError("a step type is a non-empty string", "register_transform")
    if type in _types and not force:
        warn(f"step type {type!r} is already registered")
        return _types[type]
    _types[type] = Transform(type, forward, inverse, **facts)
    if parameters is not None:
        register_parameters(type, parameters)
    return _types[type]


def get_transform(type: str, direction: str | None = None) -> Transform:
    if type not in _types:
        load_packages()
    t = _types.get(type)
    if t is None or (direction and getattr(t, direction) is None):
        raise NoMethod(f"no {direction or 'transform'} for step type {type!r}", "get_transform", type=type)
    return t


def is_registered(type: str) -> bool:
    return type in _types


def list_transforms(category: str | None = None, capability: str | None = None) -> list[str]:
    return sorted(t.type for t in _types.values() if (category is None or t.category == category) and (capability is None or capability in t.capabilities))


def capabilities(type: str) -> dict[str, bool]:
    t = get_transform(type)
    return {"forward": t.forward is not None, "inverse": t.inverse is not None} | {c: True for c in t.capabilities}


def remove_transform(type: str) -> None:
    _types.pop(type, None)


def transform_info(type: str) -> dict[str, Any]:
    t = get_transform(type)
    return {"type": t.type, "category": t.category, "min_rank": t.min_rank, "added": t.added, "defaults": default_parameters(type), **capabilities(type)}


def transform_summary(spark: SparkSession) -> DataFrame:
    rows = [(t.type, t.category, t.forward is not None, t.inverse is not None, t.min_rank, sorted(t.capabilities)) for t in sorted(_types.values(), key=lambda t: t.type)]
    return spark.createDataFrame(rows, "type string, category string, forward boolean, inverse boolean, min_rank int, capabilities array<string>")


def check_implementation(type: str) -> list[str]:
    """What is missing for a type to be used in both directions."""
    t = _types.get(type)
    if t is None:
        return [f"{type} isn't registered"]
    out = [f"{type} has no {d}" for d in ("forward", "inverse") if getattr(t, d) is None]
    try:
        default_parameters(type)
    except NoMethod:
        out.append(f"{type} has no parameters")
    return out


def missing_types(types: list[str], policy: str = "installed") -> list[str]:
    """Types without an inverse. Policy none raises; the others warn, and such steps are skipped."""
    if policy not in ("installed", "none", "prompt"):
        raise ValidationError(f"unknown policy {policy!r}", "missing_types")
    if any(t not in _types for t in types):
        load_packages()
    out = [t for t in types if not (t in _types and _types[t].inverse)]
    if out and policy == "none":
        raise NoMethod(f"no inverse for {', '.join(out)}", "missing_types")
    if out:
        warn(f"steps without an inverse are skipped: {', '.join(out)}", MissingMethod)
    return out


def scaffold(type: str) -> str:
    """Source of a module that registers a new step type."""
    name = re.sub(r"[^A-Za-z0-9]+", "_", type)
    if is_registered(type):
        warn(f"step type {type!r} is already registered")
    return f'''"""Step {type}."""

from arrayloom.options import Parameter
from arrayloom.plans.registry import register_transform
from arrayloom.plans.steps import Context, Result

PARAMETERS = {{"strength": Parameter(1.0, kind=(int, float), low=0)}}


def forward_{name}(context: Context, frame):
    return Result(frame)


def inverse_{name}(context: Context, frame):
    return frame


register_transform("{type}", forward_{name}, inverse_{name}, parameters=PARAMETERS)
'''
