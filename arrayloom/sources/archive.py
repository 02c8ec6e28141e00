"""Self-describing archives: a folder of Parquet tables, step descriptors and a manifest.

    _manifest.json            format, sizes, runs, header, plugins, checksum
    transforms/NN_type.json   a descriptor a step; NN_type_report.json where a step reports
    catalog/                  a row a dataset
    data/<dataset>/           Parquet; the array itself is split by run_id

Nothing is seen under the target path before everything is written: files go to a folder beside it that is
then renamed. Reading is lazy; the region and the times asked for are filters on the scans where steps allow.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArchiveExists, ClosedReader, ContractError, DescriptorError, DuplicateKey, Float16Unsupported, InvalidInput, JsonParseError, MissingAttribute, MissingPath, SequenceError, ValidationError, warn
from ..model import LONG, ArrayFrame, Space, check_run_id, min_rank, resolve_run_ids
from ..operators import subset
from ..options import option, resolve_parameters
from ..plans.registry import get_transform, missing_types
from ..plans.steps import Context, Dataset, run_step
from . import files

FORMAT = "arrayloom archive v1"
DESCRIPTOR = re.compile(r"^(\d+)_([A-Za-z0-9._]+)\.json$")
CATALOG = "path string, role string, producer string, origin string, step_index int, params_json string, payload_key string, write_mode string, write_mode_effective string, dtype string"
DTYPES = ("float64", "float32", "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64")


@dataclass(frozen=True)
class Step:
    """A step as asked for: its type and the parameters given."""

    type: str
    parameters: dict[str, Any]


def as_steps(steps: Sequence) -> list[Step]:
    """Steps from Step objects, types, or (type, parameters) pairs."""
    out = []
    for s in steps:
        if isinstance(s, Step):
            out.append(s)
        else:
            out.append(Step(s, {}) if isinstance(s, str) else Step(s[0], dict(s[1])))
    return out


def step_name(index: int, type: str) -> str:
    return f"{index:02d}_{type}"


def dataset_folder(path: str) -> str:
    return f"data/{path.strip('/')}"


# ---- writing -----------------------------------------------------------------------------------------


@dataclass
class Plan:
    """What a write will do, before it does it: descriptors and datasets in order."""

    frame: ArrayFrame
    descriptors: list[dict]
    datasets: dict[str, tuple[Dataset, str, int]]
    reports: dict[str, str]

    def catalog(self, spark: SparkSession, mode: str = "eager") -> DataFrame:
        rows = []
        for path, (d, producer, index) in self.datasets.items():
            params = json.dumps(self.descriptors[index]["params"]) if 0 <= index < len(self.descriptors) else "{}"
            rows.append((path, d.role, producer, option("defaults.origin_label"), index, params, path, mode, "eager", d.dtype))
        return spark.createDataFrame(rows, CATALOG)


def plan(frame: ArrayFrame, steps: Sequence = (), statistics: DataFrame | None = None) -> Plan:
    """Runs the steps forward. Frames stay lazy; a step that fits something runs its own small jobs. statistics of the frame's values spare the first step its own."""
    steps = as_steps(steps)
    if steps and frame.rank < (need := min_rank(steps[0].type, frame.mask is not None)):
        raise InvalidInput(f"{steps[0].type} needs {need} dimensions, not {frame.rank}", "plan")
    for r in [x.run_id for x in frame.df.select("run_id").distinct().limit(101).collect()]:
        check_run_id(r)
    spark = frame.df.sparkSession
    df = subset.masked(frame)
    out = Plan(frame, [], {}, {})
    n_time, n_vox = frame.n_time, frame.n_vox

    def load(path: str) -> DataFrame:
        if path not in out.datasets:
            raise ContractError(f"no earlier step made {path}", "plan:load")
        return out.datasets[path][0].df

    previous = option("defaults.input_key")
    for index, s in enumerate(steps):
        p = resolve_parameters(s.type, s.parameters, strict=False)
        name = step_name(index, s.type)
        context = Context(spark, name, index, p, frame, n_time, n_vox, load, statistics=statistics if index == 0 else None)
        result = run_step("forward", s.type, context, df)
        p = p | result.parameters
        for path, d in result.datasets.items():
            if path in out.datasets:
                raise DuplicateKey(f"two datasets {path}", "plan", index, s.type)
            out.datasets[path] = (d, s.type, index)
        if result.report:
            out.reports[name] = result.report
        outputs = f"{s.type}_s{index}_out"
        out.descriptors.append({"type": s.type, "version": "1.0", "inputs": [previous], "outputs": [outputs], "params": p, "datasets": [{"path": k, "role": d.role} for k, d in result.datasets.items()]})
        df, previous = result.df, outputs
        if "vox" in get_transform(s.type).changes:
            n_vox = int(p.get("k_actual") or p.get("n_components") or p.get("k") or n_vox)
        if s.type == "aggregate_runs" and p["agg_op"] == "concatenate":
            n_time = (df.agg(F.max("t")).first()[0] or 0) + 1
    role, dtype = ("raw_data", "float64") if not steps else ("payload", out.descriptors[-1]["params"].get("dtype", "float64"))
    out.datasets["scans/values"] = (Dataset(df, role, dtype), steps[-1].type if steps else "core", len(steps) - 1)
    return out


def write_archive(frame: ArrayFrame, path: str | None = None, steps: Sequence = (), *, header: dict | None = None, plugins: dict | None = None, block_table: DataFrame | None = None, checksum: str = "none", overwrite: bool = False, progress=None, options: dict | None = None, statistics: DataFrame | None = None) -> str:
    """Writes an archive and returns its path. Without a path it goes to the shared folder
    until the driver ends.

    options go to the Parquet writer (compression, maxRecordsPerFile). With statistics, which micro-batches left, the catalog's mode is stream.
    """
    spark = frame.df.sparkSession
    path = path or files.work_path(spark, "archive")
    if files.exists(spark, path):
        if not overwrite:
            raise ArchiveExists(f"{path} is there already", "write_archive")
        files.delete(spark, path)
    for name in plugins or {}:
        if "/" in name or not name:
            raise ValidationError(f"plugin name {name!r} has a slash or is empty", "write_archive:plugins")
    p = plan(frame, steps, statistics)
    if frame.mask is not None:
        p.datasets["masks/voxels"] = (Dataset(frame.mask.select("vox"), "mask", "int32"), "core", -1)
    if block_table is not None:
        p.datasets["spatial/block_table"] = (Dataset(check_blocks(block_table, frame), "block_table", "int32"), "core", -1)
    temporary = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    try:
        for k, (name, (d, _, _)) in enumerate(p.datasets.items()):
            writer = d.df.write.options(**(options or {}))
            writer = writer.partitionBy("run_id") if name == "scans/values" else writer
            writer.parquet(f"{temporary}/{dataset_folder(name)}")
            if progress:
                progress(k + 1, len(p.datasets), name)
        p.catalog(spark, "eager" if statistics is None else "stream").coalesce(1).write.parquet(f"{temporary}/catalog")
        for index, d in enumerate(p.descriptors):
            files.write_text(spark, f"{temporary}/transforms/{step_name(index, d['type'])}.json", json.dumps(d, indent=1))
        for name, text in p.reports.items():
            files.write_text(spark, f"{temporary}/transforms/{name}_report.json", text)
        manifest = {
            "format": FORMAT, "creator": "arrayloom", "required_transforms": [], "dims": list(frame.dims), "n_time": frame.n_time, "rank": frame.rank,
            "header": (frame.space.header() if frame.space else {}) | (header or {}), "plugins": plugins or {}, "masked": frame.mask is not None,
        }
        if checksum == "sha256":
            manifest["checksum"] = checksum_of(spark, temporary)
        elif checksum != "none":
            raise ValidationError(f"unknown checksum {checksum!r}", "write_archive:checksum")
        files.write_text(spark, f"{temporary}/_manifest.json", json.dumps(manifest, indent=1))
        if not files.move(spark, temporary, path):
            raise ArchiveExists(f"{path} couldn't be put in place", "write_archive")
    except BaseException:
        files.delete(spark, temporary)
        raise
    return path


def check_blocks(blocks: DataFrame, frame: ArrayFrame) -> DataFrame:
    """The block table, if all its values are whole numbers from 1 to the number of active voxels."""
    active = frame.n_vox if frame.mask is None else frame.mask.count()
    bad = None
    for c in blocks.columns:
        x = F.col(c)
        wrong = x.isNull() | (x < 1) | (x > active) | (x != F.floor(x))
        bad = wrong if bad is None else bad | wrong
    if bad is None or not blocks.where(bad).isEmpty():
        raise ValidationError(f"block coordinates must be whole numbers from 1 to {active}", "check_blocks")
    return blocks.select(*[F.col(c).cast("int").alias(c) for c in blocks.columns])


def checksum_of(spark: SparkSession, path: str) -> str:
    """sha256 over the names and hashes of all files but the manifest."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"/((?:data|transforms|catalog)/.*)$", 1)
    rows = f.select(name.alias("name"), F.sha2("content", 256).alias("h")).where("name != ''").orderBy("name").collect()  # a row a file
    return hashlib.sha256("".join(f"{r.name} {r.h}\n" for r in rows).encode()).hexdigest()


# ---- reading -----------------------------------------------------------------------------------------


def manifest(spark: SparkSession, path: str) -> dict:
    if not files.exists(spark, f"{path}/_manifest.json"):
        raise MissingPath(f"{path} is no archive", "manifest")
    return _json(files.read_text(spark, f"{path}/_manifest.json"), "manifest")


def _json(text: str, where: str) -> dict:
    try:
        return json.loads(text)
    except ValueError as e:
        raise JsonParseError(f"not JSON: {e}", where) from e


def discover_descriptors(found: list[str]) -> list[tuple[int, str, str]]:
    """(index, type, name) in order, from the names in a folder; reports are left out."""
    out = []
    for name in found:
        if name.endswith("_report.json") or name.startswith("."):
            continue
        m = DESCRIPTOR.match(name)
        if not m:
            raise DescriptorError(f"{name} isn't a descriptor's name", "discover_descriptors")
        out.append((int(m[1]), m[2], name))
    out.sort()
    if [i for i, _, _ in out] != list(range(len(out))):
        raise SequenceError(f"descriptors are numbered {[i for i, _, _ in out]}, not from 0 on", "discover_descriptors")
    return out


def descriptors(spark: SparkSession, path: str) -> list[dict]:
    out = []
    for index, type, name in discover_descriptors(files.names(spark, f"{path}/transforms")):
        d = _json(files.read_text(spark, f"{path}/transforms/{name}"), name)
        out.append({"index": index, "name": name} | d | {"type": d.get("type", type)})
    return out


def run_ids(spark: SparkSession, path: str) -> list[str]:
    """Runs in the archive, from the names of its partitions."""
    found = files.names(spark, f"{path}/{dataset_folder('scans/values')}")
    return sorted(n.removeprefix("run_id=") for n in found if n.startswith("run_id="))


def load_dataset(spark: SparkSession, path: str, name: str) -> DataFrame:
    folder = f"{path}/{dataset_folder(name)}"
    if not files.exists(spark, folder):
        raise MissingPath(f"no dataset {name} in {path}", "load_dataset")
    return spark.read.parquet(folder)


def stored_values(spark: SparkSession, path: str) -> DataFrame:
    folder = f"{path}/{dataset_folder('scans/values')}"
    if not run_ids(spark, path):
        return spark.createDataFrame([], LONG)
    # partition values would be guessed as other types than the string they are
    return spark.read.schema("t int, vox int, value double, run_id string").parquet(folder).select("run_id", "t", "vox", "value")


def frame_of(spark: SparkSession, path: str, m: dict | None = None) -> ArrayFrame:
    """Sizes, mask and geometry of an archive, with its stored values."""
    m = m or manifest(spark, path)
    h = m["header"]
    space = Space(tuple(m["dims"]), tuple(h["spacing"]), tuple(h["origin"]), tuple(h.get("transform", ()))) if "spacing" in h else None
    mask = load_dataset(spark, path, "masks/voxels") if m.get("masked") else None
    return ArrayFrame(stored_values(spark, path), tuple(m["dims"]), m["n_time"], mask, space, m.get("rank", 4))


def changed_axes(d: dict) -> set[str]:
    """Axes of the array that a step's output no longer has as they were."""
    if d["type"] == "delta" and d["params"].get("axis") == 1:
        return {"vox", "t"}  # the frame is turned: its series run through space
    return set(get_transform(d["type"]).changes.split())


def _output(df: DataFrame, dtype: str) -> DataFrame:
    if dtype == "float16":
        raise Float16Unsupported("half precision isn't a column type", "read_archive:output_dtype")
    if dtype == "float32":
        return df.withColumn("value", F.col("value").cast("float"))
    if dtype != "float64":
        raise ValidationError(f"unknown output type {dtype!r}", "read_archive:output_dtype")
    return df


def read_archive(spark: SparkSession, path: str, run_id=None, roi=None, times: Sequence[int] | None = None, *, lazy: bool = False, validate: bool = False, allow_plugins: str = "installed", output_dtype: str = "float64", all_runs: bool = True):
    """The array of an archive as a lazy frame (run_id, t, vox, value); with times also ord, the place in them.

    run_id: names or globs; None: all runs (all_runs) or the first. lazy gives a Reader.
    """
    if lazy:
        return Reader(spark, path, run_id, roi, times, allow_plugins, output_dtype)
    if validate:
        validate_archive(spark, path, strict=True)
    m = manifest(spark, path)
    frame = frame_of(spark, path, m)
    steps = descriptors(spark, path)
    skipped = set(missing_types([d["type"] for d in steps], allow_plugins))
    df = frame.df
    there = run_ids(spark, path)
    if run_id is not None or not all_runs:
        wanted = resolve_run_ids(run_id, there)
        if not wanted:
            raise InvalidInput(f"no run matches {run_id!r}; there are {', '.join(there)}", "read_archive")
        df = df.where(F.col("run_id").isin(wanted))
    region = subset.roi_table(frame, roi) if roi is not None else None
    points = [int(t) for t in times] if times is not None else None
    kept = [d for d in steps if d["type"] not in skipped]
    moved = {a for d in kept for a in changed_axes(d)}
    if region is not None and "vox" not in moved and not any(d["params"].get("coding_method") == "rle" for d in kept):
        df = subset.select_voxels(df, region)
    if points is not None and "t" not in moved:
        df = df.where(F.col("t").isin(points or [-1]))
    for place in range(len(kept) - 1, -1, -1):
        d = kept[place]
        # a step may use the selection where no step before it has changed what the axis means
        before = {a for e in kept[:place] for a in changed_axes(e)}
        own_region, own_times = None if "vox" in before else region, tuple(points) if points and "t" not in before else None
        context = Context(spark, step_name(d["index"], d["type"]), d["index"], d["params"], frame, m["n_time"], frame.n_vox, lambda name: load_dataset(spark, path, name), own_region, own_times)
        df = run_step("inverse", d["type"], context, df)
    if region is not None:
        df = subset.select_voxels(df, region)
    if points is not None:
        df = subset.select_times(df, points)
    return _output(df, output_dtype)


class Reader:
    """A handle on an archive; data() is planned once for a selection and kept until another is set."""

    def __init__(self, spark, path, run_id=None, roi=None, times=None, allow_plugins="installed", output_dtype="float64"):
        self._spark, self._path, self._plugins, self._dtype = spark, path, allow_plugins, output_dtype
        found = run_ids(spark, path)
        runs = resolve_run_ids(run_id, found)
        if len(runs) > 1:
            warn(f"several runs match; the reader takes {runs[0]}")
        self.run_id = runs[0] if runs else None
        self._selection: dict[str, Any] = {"roi": roi, "times": times}
        self._data: DataFrame | None = None
        self._open = True
        manifest(spark, path)

    def _check(self) -> None:
        if not self._open:
            raise ClosedReader("the reader is closed", "Reader")

    def subset(self, roi=None, times=None) -> Reader:
        self._check()
        new = {"roi": roi if roi is not None else self._selection["roi"], "times": times if times is not None else self._selection["times"]}
        self._drop()
        self._selection = new
        return self

    def data(self) -> DataFrame:
        self._check()
        if self._data is None:
            self._data = read_archive(self._spark, self._path, self.run_id, **self._selection, allow_plugins=self._plugins, output_dtype=self._dtype).persist()
        return self._data

    def _drop(self) -> None:
        if self._data is not None:
            self._data.unpersist()
        self._data = None

    def close(self) -> None:
        self._drop()
        self._open = False

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def __repr__(self) -> str:
        return f"<Reader {self._path} {self.run_id} {'open' if self._open else 'closed'}>"


def load_basis(spark: SparkSession, path: str, descriptor: str) -> DataFrame:
    """(k, vox, w) of the basis that a step of an archive made: stored, analytic or coded."""
    from ..plans import steps

    name = descriptor.removesuffix(".json")
    for d in descriptors(spark, path):
        if d["name"].removesuffix(".json") == name:
            break
    else:
        raise MissingPath(f"no descriptor {descriptor} in {path}", "load_basis")
    frame = frame_of(spark, path)
    context = Context(spark, name, d["index"], d["params"], frame, frame.n_time, frame.n_vox, lambda n: load_dataset(spark, path, n))
    if d["type"] == "basis.empirical_hrbf_compressed":
        return steps.decode_empirical(context)
    for s in d["datasets"]:
        if s["role"] == "basis_matrix":
            return load_dataset(spark, path, s["path"])
    if d["type"].startswith("spat.hrbf"):
        return steps._hrbf(replace(context, parameters=d["params"] | {"centres_path": context.path("centres")}))[0]
    raise MissingPath(f"{descriptor} has no basis", "load_basis")


def transform_report(spark: SparkSession, path: str, step: int | str) -> dict:
    """The report that a step left, by index or name."""
    for d in descriptors(spark, path):
        name = d["name"].removesuffix(".json")
        if step in (d["index"], name, d["name"]):
            file = f"{path}/transforms/{name}_report.json"
            if not files.exists(spark, file):
                raise MissingPath(f"{name} has no report", "transform_report")
            return _json(files.read_text(spark, file), file)
    raise MissingPath(f"no step {step!r} in {path}", "transform_report")


# ---- validation ----------------------------------------------------------------------------------------


def missing_datasets(catalog: DataFrame, present: DataFrame) -> DataFrame:
    """Rows of a catalog whose path isn't among those present (path)."""
    return catalog.join(present.select("path"), "path", "left_anti")


def validate_archive(spark: SparkSession, path: str, strict: bool = True, checksum: bool = True) -> list[str]:
    """Problems of an archive; strict raises on any.

    Manifest, checksum, descriptors and their parameters, and for every dataset that it is there, has
    rows, and, where it has values, some that are neither null nor 0.
    """
    issues: list[str] = []
    try:
        m = manifest(spark, path)
    except (MissingPath, JsonParseError) as e:
        m, issues = {}, [str(e)]
    if m and m.get("format") != FORMAT:
        issues.append(f"format is {m.get('format')!r}")
    for key in ("creator", "required_transforms", "dims", "n_time"):
        if m and key not in m:
            issues.append(f"the manifest lacks {key}")
            warn(f"the manifest lacks {key}", MissingAttribute)
    if m and checksum and m.get("checksum") and m["checksum"] != checksum_of(spark, path):
        issues.append("the checksum doesn't fit the files")
    try:
        steps = descriptors(spark, path)
    except DescriptorError as e:
        steps, issues = [], [*issues, str(e)]
    for d in steps:
        for key in ("type", "params", "datasets", "inputs", "outputs"):
            if key not in d:
                issues.append(f"{d['name']} lacks {key}")
        try:
            from ..options import STEPS

            known = STEPS.get(d["type"])
            if known:
                resolve_parameters(d["type"], {k: v for k, v in d.get("params", {}).items() if k in known})
        except ValidationError as e:
            issues.append(f"{d['name']}: {e}")
    if m and not files.exists(spark, f"{path}/catalog"):
        issues.append("the catalog is missing")
    elif m:
        for r in spark.read.parquet(f"{path}/catalog").collect():  # a row a dataset
            folder = f"{path}/{dataset_folder(r.path)}"
            if not files.exists(spark, folder):
                issues.append(f"dataset {r.path} is missing")
                continue
            if r.dtype not in DTYPES:
                issues.append(f"dataset {r.path} has the type {r.dtype!r}")
            df = stored_values(spark, path) if r.path == "scans/values" else spark.read.parquet(folder)
            if "value" in df.columns and m.get("n_time") and 0 not in m["dims"]:
                f = df.agg(F.count("*").alias("n"), F.count_if(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") != 0)).alias("some")).first()
                if f.n and not f.some and r.role not in ("center", "quant_params", "first_values"):
                    issues.append(f"dataset {r.path} has no values but 0")
    if issues and strict:
        raise ValidationError("; ".join(issues), "validate_archive")
    return issues


def issues_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in validate_archive(spark, path, strict=False)], "issue string")


#: Other names of the same operations.
compress, open_archive = write_archive, read_archive
