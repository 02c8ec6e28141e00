import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrayloom import errors, model, options
from arrayloom.operators import haar
from arrayloom.plans import pipeline, registry
from arrayloom.plans.steps import Result
from arrayloom.sources import archive, files, layout


@pytest.fixture
def frame(spark):
    return model.from_numpy(spark, np.random.default_rng(1).normal(size=(2, 2, 2, 6)))


def values(df, frame, run="run-01"):
    return model.to_numpy(df, frame.dims, frame.n_time, run)


def source(frame):
    return values(frame.df, frame)


STEPS = {
    "none": [],
    "quant": [("quant", {"bits": 12})],
    "quant voxel": [("quant", {"bits": 12, "scale_scope": "voxel"})],
    "delta": ["delta"],
    "delta rle": [("delta", {"coding_method": "rle"})],
    "delta space": [("delta", {"axis": 1})],
    "delta then quant": ["delta", ("quant", {"bits": 16})],
    "basis": [("basis", {"k": 3})],
    "pca": [("basis", {"k": 6, "scale": True}), ("embed", {"basis_path": "00_basis/matrix", "center_data_with": "00_basis/center", "scale_data_with": "00_basis/scale"})],
    "sparsepca": [("sparsepca", {"k": 6, "alpha": 0.0, "whiten": True})],
    "dct": [("temporal", {"kind": "dct", "n_basis": 6})],
    "modwt": [("temporal", {"kind": "modwt_db8", "n_basis": 6})],
    "wavelet-free polynomial": [("temporal", {"kind": "polynomial", "n_basis": 6})],
    "haar": [("spat.haar_octwave", {"levels": 1})],
    "haar then quant": [("spat.haar_octwave", {"levels": 2}), ("quant", {"bits": 16})],
    "dct, delta, quant": [("temporal", {"kind": "dct", "n_basis": 6}), "delta", ("quant", {"bits": 16})],
}


@pytest.mark.parametrize("name", STEPS)
def test_round_trip(spark, frame, tmp_path, name):
    path = archive.write_archive(frame, str(tmp_path / "a"), STEPS[name], checksum="sha256")
    assert np.allclose(values(archive.read_archive(spark, path), frame), source(frame), atol=5e-3 if "quant" in name else 1e-6)
    got = archive.read_archive(spark, path, roi=[0, 2, 4, 6], times=[1, 4]).toPandas()
    assert len(got) == 8 and set(got.vox) == {0, 2, 4, 6}
    for r in got.itertuples():
        x = source(frame)[r.vox % 2, r.vox // 2 % 2, r.vox // 4, r.t]
        assert r.value == pytest.approx(x, abs=5e-3) and r.ord == {1: 0, 4: 1}[r.t]
    assert archive.validate_archive(spark, path) == []


def test_times_repeat_in_order(spark, frame, tmp_path):
    path = archive.write_archive(frame, str(tmp_path / "a"), ["delta"])
    got = archive.read_archive(spark, path, roi=[3], times=[5, 0, 5]).orderBy("ord").toPandas()
    assert got.t.tolist() == [5, 0, 5]


def test_masked_archives(spark, tmp_path):
    mask = np.zeros((4, 4, 4), bool)
    mask[:2, :2, :2] = mask[2:, 2:, 3:] = True
    x = np.random.default_rng(2).normal(size=(4, 4, 4, 3))
    f = model.from_numpy(spark, x, mask, model.Space((4, 4, 4), (2.0, 2.0, 2.0)))
    for k, steps in enumerate(([("spat.haar_octwave", {"levels": 2})], [])):
        path = archive.write_archive(f, str(tmp_path / str(k)), steps)
        got = values(archive.read_archive(spark, path), f)
        assert np.allclose(got[mask], x[mask]) and np.isnan(got[~mask]).all()
    path = archive.write_archive(f, str(tmp_path / "h"), [("spat.hrbf", {"sigma0": 4.0, "levels": 1, "seed": 3})])
    df = archive.read_archive(spark, path)
    assert df.select("vox").distinct().count() <= mask.sum() and df.count()
    assert archive.manifest(spark, path)["header"]["spacing"] == [2.0, 2.0, 2.0]
    assert archive.load_basis(spark, path, "00_spat.hrbf").count()
    d = archive.descriptors(spark, path)[0]
    assert d["params"]["k_actual"] >= 2 and len(d["params"]["mask_hash"]) == 64


def test_runs_and_globs(spark, tmp_path):
    f = model.from_numpy(spark, {f"run-0{k}": np.full((2, 1, 1, 3), float(k)) for k in (3, 1, 2)})
    path = archive.write_archive(f, str(tmp_path / "a"))
    assert archive.run_ids(spark, path) == ["run-01", "run-02", "run-03"]
    assert archive.read_archive(spark, path, ["run-02", "run-03"]).select("run_id").distinct().count() == 2
    assert archive.read_archive(spark, path, all_runs=False).select("run_id").distinct().first()[0] == "run-01"
    assert archive.read_archive(spark, path, "run-*").count() == 18
    with pytest.raises(errors.InvalidInput):
        archive.read_archive(spark, path, "run-77")
    agg = archive.write_archive(f, str(tmp_path / "b"), [("aggregate_runs", {"agg_op": "mean"})])
    assert {r.value for r in archive.read_archive(spark, agg).collect()} == {2.0}
    assert archive.descriptors(spark, agg)[0]["params"]["runs_included"] == ["run-01", "run-02", "run-03"]


def test_reader(spark, tmp_path):
    f = model.from_numpy(spark, {f"run-0{k}": np.full((2, 1, 1, 3), float(k)) for k in (1, 2)})
    path = archive.write_archive(f, str(tmp_path / "a"), ["quant"])
    with pytest.warns(errors.EngineWarning):
        r = archive.read_archive(spark, path, "run-*", lazy=True)
    assert r.run_id == "run-01" and r.data() is r.data()
    one = r.data()
    assert r.subset(roi=[1]).data().count() == 3 and r.data() is not one
    r.close()
    r.close()
    with pytest.raises(errors.ClosedReader):
        r.data()


def test_blocks_header_plugins(spark, frame, tmp_path):
    blocks = spark.createDataFrame([(1, 1), (2, 8)], "start int, end int")
    path = archive.write_archive(frame, str(tmp_path / "a"), header={"note": "x"}, plugins={"mine": {"a": 1}}, block_table=blocks)
    assert archive.load_dataset(spark, path, "spatial/block_table").count() == 2
    m = archive.manifest(spark, path)
    assert m["header"] == {"note": "x"} and m["plugins"] == {"mine": {"a": 1}} and m["required_transforms"] == []
    for bad in ([(1, 9)], [(0, 1)], [(1, None)]):
        with pytest.raises(errors.ValidationError):
            archive.write_archive(frame, str(tmp_path / "b"), block_table=spark.createDataFrame(bad, "start int, end int"))
    with pytest.raises(errors.ValidationError):
        archive.write_archive(frame, str(tmp_path / "b"), plugins={"a/b": 1})
    with pytest.raises(errors.ArchiveExists):
        archive.write_archive(frame, path)
    assert not [n for n in files.names(spark, str(tmp_path)) if n.endswith(".tmp")]
    archive.write_archive(frame, path, overwrite=True)


def test_validation_finds_damage(spark, frame, tmp_path):
    path = archive.write_archive(frame, str(tmp_path / "a"), ["quant"], checksum="sha256")
    d = archive.descriptors(spark, path)[0]
    d["params"]["bits"] = 99
    files.write_text(spark, f"{path}/transforms/00_quant.json", json.dumps(d))
    found = archive.validate_archive(spark, path, strict=False)
    assert any("checksum" in x for x in found) and any("bits" in x for x in found)
    files.delete(spark, f"{path}/data/00_quant/quant_params")
    assert any("missing" in x for x in archive.validate_archive(spark, path, strict=False))
    with pytest.raises(errors.ValidationError):
        archive.read_archive(spark, path, validate=True)
    files.write_text(spark, f"{path}/transforms/00_quant.json", "{")
    assert any("JSON" in x for x in archive.validate_archive(spark, path, strict=False))
    assert archive.validate_archive(spark, str(tmp_path / "nothing"), strict=False)


def test_reports(spark, frame, tmp_path):
    path = archive.write_archive(frame, str(tmp_path / "a"), ["delta", ("quant", {"bits": 4})])
    r = archive.transform_report(spark, path, 1)
    assert sum(r["histogram"]) == 40 and r["runs"]["run-01"]["n_clipped_total"] == 0 and r["bits"] == 4
    assert archive.transform_report(spark, path, "01_quant") == r
    with pytest.raises(errors.MissingPath):
        archive.transform_report(spark, path, 0)


def test_discovery():
    names = ["01_b.c.json", "00_a.json", "00_a_report.json"]
    assert [x[:2] for x in archive.discover_descriptors(names)] == [(0, "a"), (1, "b.c")]
    for bad in (["00_a.json", "02_b.json"], ["01_a.json"]):
        with pytest.raises(errors.SequenceError):
            archive.discover_descriptors(bad)
    with pytest.raises(errors.DescriptorError):
        archive.discover_descriptors(["x_a.json"])
    assert archive.discover_descriptors([]) == []


def test_degenerate_arrays(spark, tmp_path):
    for k, shape in enumerate([(1, 1, 1, 1), (0, 0, 0, 0)]):
        f = model.from_numpy(spark, np.ones(shape))
        path = archive.write_archive(f, str(tmp_path / str(k)))
        assert archive.read_archive(spark, path).count() == int(np.prod(shape))
        assert archive.validate_archive(spark, path) == []


def test_errors_name_the_step(spark, frame, tmp_path):
    for steps in ([("basis", {"method": "ica"})], ["delta", ("delta", {"coding_method": "range_coded"})], [("delta", {"order": 2})]):
        with pytest.raises(errors.NotSupported) as e:
            archive.write_archive(frame, str(tmp_path / "a"), steps)
        assert e.value.step == len(steps) - 1
    with pytest.raises(errors.ContractError):
        archive.write_archive(frame, str(tmp_path / "a"), [("embed", {"basis_path": "nowhere"})])
    with pytest.raises(errors.NoMethod):
        archive.write_archive(frame, str(tmp_path / "a"), ["nothing"])
    with pytest.raises(errors.InvalidParameters):
        archive.write_archive(frame, str(tmp_path / "a"), [("quant", {"bit": 3})])
    with pytest.raises(errors.InvalidInput):
        archive.write_archive(model.from_numpy(spark, np.ones(4)), str(tmp_path / "a"), ["temporal"])
    with pytest.raises(errors.Float16Unsupported):
        archive.read_archive(spark, archive.write_archive(frame), output_dtype="float16")
    x = np.concatenate([np.zeros(80), np.full(20, 9.0), [1e4]])
    with pytest.raises(errors.StepError):
        pipeline.Pipeline(model.from_numpy(spark, np.where(np.arange(40) % 9, 0.0, np.arange(40)))).quant(method="sd", bits=1).add_step("quant", {"method": "sd"}).add_step("embed", {"basis_path": "x"}).write(str(tmp_path / "z"))
    assert len(x) == 101


def test_own_step_and_policy(spark, frame, tmp_path):
    registry.register_transform("double", lambda c, df: Result(df.withColumn("value", F.col("value") * c.parameters["by"])), lambda c, df: df.withColumn("value", F.col("value") / c.parameters["by"]), parameters={"by": options.Parameter(2.0)}, category="test", force=True)
    assert registry.is_registered("double") and "double" in registry.list_transforms("test") and registry.check_implementation("double") == []
    path = archive.write_archive(frame, str(tmp_path / "a"), ["double", "quant"])
    assert np.allclose(values(archive.read_archive(spark, path), frame), source(frame), atol=0.05)
    assert registry.transform_summary(spark).where("type = 'double'").count() == 1
    registry.remove_transform("double")
    with pytest.warns(errors.MissingMethod):
        twice = values(archive.read_archive(spark, path), frame)
    assert np.allclose(twice, 2 * source(frame), atol=0.1)
    with pytest.raises(errors.NoMethod):
        archive.read_archive(spark, path, allow_plugins="none")
    compile(registry.scaffold("my.step"), "x", "exec")
    registry.register_transform("bad", lambda c, df: 1, parameters={}, force=True)
    with pytest.raises(errors.StepReturnError):
        archive.write_archive(frame, str(tmp_path / "b"), ["bad"])
    registry.remove_transform("bad")


def test_pipeline_object(spark, frame, tmp_path):
    p = pipeline.as_pipeline(frame).pca(k=5).embed().quant(bits=6)
    assert [s.type for s in p.steps] == ["basis", "embed", "quant"] and p.get_step(1).parameters["basis_path"] == "00_basis/matrix"
    p.modify_step("quant", bits=9)
    assert p.get_step("quant").parameters["bits"] == 9
    p.modify_step("quant", bits=None)
    assert p.get_step(-1).parameters["bits"] == 8
    p.insert_step("delta", before="quant").remove_step("delta")
    assert p.validate() == [] and p.diagram().count("->") == 4 and "quant" in p.diagram("ascii")
    p.modify_step("quant", bits=99)
    assert len(p.validate()) == 1
    with pytest.raises(errors.InvalidParameters):
        p.validate(strict=True)
    with pytest.raises(errors.ValidationError):
        pipeline.Pipeline(frame).embed()
    with pytest.raises(errors.ValidationError):
        pipeline.Pipeline().write()
    f = pipeline.Facade(spark).set_defaults(quant={"bits": 3})
    f.write(frame, str(tmp_path / "a"), ["quant"])
    assert archive.descriptors(spark, f.last_path)[0]["params"]["bits"] == 3 and f.read().count() == 48
    t = pipeline.Pipeline(frame).apply_template("compact", k=4, quant__bits=5)
    assert t.get_step("quant").parameters["bits"] == 5 and t.get_step("basis").parameters["k"] == 4
    name = pipeline.register_verb("spat.haar_octwave", force=True)
    assert name == "spat_haar_octwave" and getattr(pipeline.Pipeline(frame), name)(levels=1).steps[0].type == "spat.haar_octwave"
    for kind in ("compress", "denoise", "full"):
        assert pipeline.workflow(frame, kind, k=3).steps
    codes, params = pipeline.quantize_data(frame, bits=12)
    assert np.allclose(values(pipeline.dequantize_data(codes, params), frame), source(frame), atol=1e-2)
    assert pipeline.adaptive_scope(frame) in ("global", "voxel")


def test_transferred_and_coded_bases(spark, frame, tmp_path):
    a = pipeline.Pipeline(frame).pca(k=6).write(str(tmp_path / "a"))
    b = pipeline.Pipeline(frame).add_step("embed.transfer_hrbf_basis", {"source_archive": a, "source_descriptor": "00_basis"}).write(str(tmp_path / "b"))
    x = source(frame).reshape((8, 6), order="F")
    assert archive.read_archive(spark, b).count() == 48
    u = np.linalg.svd(x - x.mean(axis=1, keepdims=True))[0][:, :5]
    got = values(archive.read_archive(spark, b), frame).reshape((8, 6), order="F")
    assert np.allclose(u.T @ got, u.T @ x, atol=1e-6)
    c = pipeline.Pipeline(frame).pca(k=3).add_step("basis.empirical_hrbf_compressed", {"basis_path": "00_basis/matrix", "sigma0": 1.0, "levels": 1, "omp_quant_bits": 12, "omp_tol": 1e-6}).write(str(tmp_path / "c"))
    coded = archive.load_basis(spark, c, "01_basis.empirical_hrbf_compressed").toPandas()
    real = archive.load_basis(spark, c, "00_basis").toPandas()
    both = real.merge(coded, on=["k", "vox"], suffixes=("", "_c"))
    assert len(both) and np.abs(both.w - both.w_c).mean() < np.abs(both.w).mean()


def test_layout():
    assert layout.auto_block_size((64, 64, 30), 8, 64e6) == {"slab": (64, 64, 1), "iterate": (1, 1, 30)}
    assert layout.auto_block_size((64, 64, 3), 8, 64 * 16 * 8)["slab"] == (64, 16, 1)
    c = layout.guess_chunks((256, 256, 100), 8, 1)
    assert np.prod(c) * 8 <= 2**20
    assert np.prod(layout.reduce_chunks((100, 100), 8, 1000)) * 8 <= 1000


def test_options():
    options.options(quant__clip_warn_pct=1.0)
    assert options.option("quant.clip_warn_pct") == 1.0
    options.set_options({"quant": {"bits": 5}})
    assert options.resolve_parameters("quant")["bits"] == 5 and options.resolve_parameters("quant", {"bits": 7})["bits"] == 7
    options.reset_options()
    assert options.resolve_parameters("quant")["bits"] == 8
    assert options.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": None}}) == {"a": {"b": None, "c": 2}}
    with pytest.raises(errors.InvalidParameters):
        options.resolve_parameters("temporal", {"threshold_type": "x"})


def test_selection_reaches_the_scan(spark, frame, tmp_path):
    path = archive.write_archive(frame, str(tmp_path / "a"), ["quant"])
    df = archive.read_archive(spark, path, "run-01", times=[2])
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "PushedFilters" in text and "In(t, [2])" in text or "EqualTo(t,2)" in text
    assert "PartitionFilters" in text and "run-01" in text


def test_step_builder(spark, frame, tmp_path):
    from arrayloom.plans.steps import StepBuilder

    def forward(c, df):
        by = StepBuilder(c).parameter("by", (int, float), low=0.1)
        return StepBuilder(c).dataset("used", df.limit(1), "sample").store(kept=by * 2).result(df.withColumn("value", F.col("value") * by))

    registry.register_transform("times", forward, lambda c, df: df.withColumn("value", F.col("value") * 2 / c.parameters["kept"]), parameters={"by": options.Parameter(3.0), "kept": options.Parameter()}, force=True)
    path = archive.write_archive(frame, str(tmp_path / "a"), ["times"])
    assert np.allclose(values(archive.read_archive(spark, path), frame), source(frame)) and archive.load_dataset(spark, path, "00_times/used").count() == 1
    with pytest.raises(errors.InvalidParameters):
        archive.write_archive(frame, str(tmp_path / "b"), [("times", {"by": 0.0})])
    registry.remove_transform("times")


def test_edges_from_a_stored_volume(spark, tmp_path):
    x = np.zeros((6, 6, 6, 2))
    x[3:, :, :, :] = 5.0
    f = model.from_numpy(spark, x)
    registry.register_transform("volume", lambda c, df: Result(df, {"structure": __import__("arrayloom.plans.steps", fromlist=["Dataset"]).Dataset(df.where("t = 0"), "structure")}), lambda c, df: df, parameters={}, force=True)
    p = {"sigma0": 2.0, "levels": 0, "edge_adaptive": {"source": "structural_path", "structural_path": "structure", "edge_thresh_k": 0.5, "density_factor": 2.0}}
    path = archive.write_archive(f, str(tmp_path / "a"), ["volume", ("spat.hrbf", p)])
    plain = archive.write_archive(f, str(tmp_path / "b"), [("spat.hrbf", {"sigma0": 2.0, "levels": 0})])
    k = [archive.descriptors(spark, q)[-1]["params"]["k_actual"] for q in (path, plain)]
    assert k[0] > k[1]
    registry.remove_transform("volume")


def test_kernels_can_be_switched_off():
    from arrayloom.functions import perf

    assert perf.gradient_form((64, 64, 64)) == "volume"
    perf.use_kernels(False)
    assert perf.gradient_form((2, 2, 2)) == "windows"
    perf.use_kernels(True)
    assert perf.time_kernel(16, 1) > 0


def test_packages_bring_steps(tmp_path, monkeypatch):
    """Installed packages are found by their entry points; one that fails or takes a type that is there is warned of."""
    (tmp_path / "toysteps.py").write_text(
        "from arrayloom.plans.registry import register_transform\n"
        "same = lambda c, df: df\n"
        "def good():\n    register_transform('toy.same', same, same, parameters={})\n"
        "def clash():\n    register_transform('quant', same, same, parameters=None, force=True)\n    register_transform('toy.other', same, same, parameters={})\n"
        "def bad():\n    register_transform('toy.half', same, same, parameters={})\n    raise ImportError('no such thing')\n"
    )
    info = tmp_path / "toysteps-1.0.dist-info"
    info.mkdir()
    (info / "METADATA").write_text("Metadata-Version: 2.1\nName: toysteps\nVersion: 1.0\n")
    (info / "entry_points.txt").write_text("[arrayloom.steps]\na = toysteps:good\nb = toysteps:clash\nc = toysteps:bad\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    quant = registry.get_transform("quant")
    with pytest.warns(UserWarning) as told:
        assert registry.is_registered("toy.same") is False
        assert registry.get_transform("toy.same").forward is not None
    text = " ".join(str(w.message) for w in told)
    assert "registered already: quant" in text and "no such thing" in text
    assert registry.get_transform("quant") is quant and registry.is_registered("toy.other") and not registry.is_registered("toy.half")
    assert registry.load_packages() == {}
    for t in ("toy.same", "toy.other"):
        registry.remove_transform(t)


def test_regions_of_pyramids_skip_most_of_the_files(spark, tmp_path):
    """A small region of a Haar archive gives its values from a small share of the stored rows."""
    dims = (32, 32, 32)
    x = np.random.default_rng(21).normal(size=(*dims, 2))
    frame = model.from_numpy(spark, x)
    path = pipeline.Pipeline(frame).add_step("spat.haar_octwave", {"levels": 3}).write(str(tmp_path / "p"), options={"parquet.block.size": 4096, "parquet.page.size": 1024, "parquet.block.size.row.check.min": 10, "maxRecordsPerFile": 2000})
    roi = [0, 1, 32, 33]
    got = archive.read_archive(spark, path, roi=roi)
    assert {(r.t, r.vox): pytest.approx(r.value) for r in got.collect()} == {(t, v): x[v % 32, v // 32 % 32, v // 1024, t] for t in (0, 1) for v in roi}

    stored = archive.stored_values(spark, path)
    part = stored.where("vox BETWEEN 64 AND 80")
    assert part.count() and "PushedFilters: [IsNotNull(vox), GreaterThanOrEqual(vox,64), LessThanOrEqual(vox,80)]" in part._jdf.queryExecution().executedPlan().toString()
    files = {r.f for r in stored.withColumn("f", F.input_file_name()).select("f").distinct().collect()}
    # the files that hold any of a region's coefficients are few, as places are in Z-order
    places = archive.load_dataset(spark, path, "00_spat.haar_octwave/places")
    some = places.join(haar.needed_coefficients(spark.createDataFrame([(v,) for v in roi], "vox int"), frame.voxels().select("vox"), dims, 3), ["level", "code"], "left_semi")
    hit = {r.f for r in stored.withColumn("f", F.input_file_name()).join(some.select("vox"), "vox", "left_semi").select("f").distinct().collect()}
    assert len(files) > 20 and len(hit) * 4 <= len(files)
