import numpy as np
import pytest
from pyspark.sql import functions as F

from arrayloom import errors, model, options
from arrayloom.functions import bases
from arrayloom.operators import codecs, haar, linalg, quant, runs, spatial, subset, temporal


def back(df, dims, n, run="run-01"):
    return model.to_numpy(df, dims, n, run)


def ball(r):
    g = np.arange(-r, r + 1)
    return sum(a**2 for a in np.meshgrid(g, g, g, indexing="ij")) <= r * r


# ---- model ---------------------------------------------------------------------------------------


def test_column_major_order(spark):
    a = np.arange(1, 41, dtype=float).reshape((2, 2, 2, 5), order="F")
    f = model.from_numpy(spark, a)
    assert f.dims == (2, 2, 2) and f.n_time == 5
    r = f.df.where("vox = 3 and t = 2").first()
    assert r.value == 1 + 3 + 2 * 8
    assert (back(f.df, f.dims, 5) == a).all()
    v = model.with_coordinates(f.df, f.dims).where("vox = 6").first()
    assert (v.x, v.y, v.z) == (0, 1, 1)


def test_promotion_and_masks(spark):
    assert model.promoted_dims((3, 4)) == (3, 4, 1, 1)
    with pytest.raises(errors.ValidationError):
        model.promoted_dims((1, 1, 1, 1, 1))
    assert ball(1).sum() == 7
    f = model.from_numpy(spark, np.ones((3, 3, 3, 2)), ball(1))
    assert subset.masked(f).count() == 14
    with pytest.raises(errors.DimensionMismatch):
        model.from_numpy(spark, np.ones((2, 2, 2, 2)), ball(1))
    with pytest.raises(errors.InvalidInput):
        model.from_numpy(spark, np.ones((3, 3, 3, 2)), ball(1).astype(float))
    assert model.min_rank("quant") == 1 and model.min_rank("embed") == 2 and model.min_rank("temporal") == 3 and model.min_rank("quant", True) == 3


def test_run_ids():
    runs_ = ["run-03", "run-01", "run-02"]
    assert model.resolve_run_ids(None, runs_) == ["run-01"]
    assert model.resolve_run_ids(["run-02", "run-0*"], runs_) == ["run-02", "run-01", "run-03"]
    assert model.resolve_run_ids("run-0?", runs_) == ["run-01", "run-02", "run-03"]
    assert model.resolve_run_ids("run-9", runs_) == []
    for bad in ("run-1", "x", "run-01/a", "run-001"):
        with pytest.raises(errors.RunIdError):
            model.check_run_id(bad)


def test_handle_is_immutable():
    h = model.Handle({"input": 1})
    g = h.updated({"x": 2})
    assert not h.has("x") and g.get_inputs("input", "x") == [1, 2] and g.pull_first("y", "x") == ("x", 2)
    with pytest.raises(errors.ContractError):
        g.get_inputs("nothing")
    with pytest.warns(errors.Overwritten):
        g.updated({"x": 3})
    assert not g.updated(without=["x"]).has("x")


# ---- selection -------------------------------------------------------------------------------------


def test_times_keep_order_and_repeats(spark):
    f = model.from_numpy(spark, np.arange(10.0)[None])
    got = subset.select_times(f.df, [5, 3, 3, 9]).orderBy("ord").toPandas()
    assert got.value.tolist() == [5, 3, 3, 9]
    assert subset.select_times_within(f.df, [-1, 2, 99], 10).count() == 1
    with pytest.warns(errors.EngineWarning):
        assert subset.select_times_or_all(f.df, [2, 99], 10).count() == 10


def test_regions(spark):
    f = model.from_numpy(spark, np.arange(16.0).reshape((2, 2, 2, 2), order="F"))
    roi = np.zeros((2, 2, 2), bool)
    roi[0, 0, 0] = roi[1, 1, 1] = True
    assert sorted(r.vox for r in subset.roi_table(f, roi).collect()) == [0, 7]
    assert subset.select_voxels(f.df, subset.roi_table(f, [1, 1, 3])).count() == 4
    with pytest.raises(errors.DimensionMismatch):
        subset.roi_table(f, np.ones(9, bool))
    assert subset.select_runs(f.df, "run-*").count() == 16


# ---- quantisation ------------------------------------------------------------------------------------


@pytest.mark.parametrize("scope", ["global", "voxel"])
@pytest.mark.parametrize("method", ["range", "sd"])
@pytest.mark.parametrize("center", [True, False])
def test_quantisation_against_numpy(spark, scope, method, center):
    a = np.random.default_rng(1).normal(size=(3, 2, 2, 9))
    f = model.from_numpy(spark, a)
    p = quant.quant_params(quant.quant_stats(f.df, scope), 8, method, center)
    q = quant.quantise(f.df, p, 8)
    x = a.reshape((12, 9), order="F")
    x = x if scope == "voxel" else x.reshape(1, -1)
    mu, sd, lo, hi = x.mean(1), x.std(1, ddof=1), x.min(1), x.max(1)
    if center:
        reach = np.maximum(abs(lo - mu), abs(hi - mu)) if method == "range" else 3 * sd
        scale, offset = 2 * reach / 255, mu - reach
    else:
        lo, hi = (lo, hi) if method == "range" else (mu - 3 * sd, mu + 3 * sd)
        scale, offset = (hi - lo) / 255, lo
    want = np.clip(np.rint((x - offset[:, None]) / scale[:, None]), 0, 255)
    got = back(q.withColumn("value", F.col("q").cast("double")), f.dims, 9).reshape((12, 9), order="F")
    assert (got == want.reshape(12, 9)).all()
    err = back(quant.dequantise(q, p), f.dims, 9) - a
    assert np.abs(err).max() <= scale.max() / 2 + 1e-9 or method == "sd"


def test_constant_and_clipping(spark):
    f = model.from_numpy(spark, np.full(10, 5.0))
    p = quant.quant_params(quant.quant_stats(f.df))
    q = quant.quantise(f.df, p)
    assert p.first().scale == 1 and q.agg(F.max("q"), F.count_if("clipped")).first() == (0, 0)
    x = np.array([0.0] * 98 + [5, -5])
    g = model.from_numpy(spark, x)
    r = quant.clip_stats(quant.quantise(g.df, quant.quant_params(quant.quant_stats(g.df), 8, "sd"))).first()
    assert (r.n_clipped, r.clip_pct) == (2, 2.0)
    h = quant.histogram(quant.quantise(g.df, quant.quant_params(quant.quant_stats(g.df), 4), 4), 4)
    assert h.count() == 16 and h.agg(F.sum("n")).first()[0] == 100


def test_values_must_be_finite(spark):
    f = model.from_numpy(spark, np.array([1.0, np.nan, 3.0]))
    with pytest.raises(Exception, match="non-finite"):
        quant.quantise(f.df, quant.quant_params(quant.quant_stats(f.df))).collect()


# ---- differences -------------------------------------------------------------------------------------


@pytest.mark.parametrize("shape", [(5,), (1,), (2, 5), (5, 1, 1, 4), (2, 2, 2, 6), (1, 1)])
def test_differences_round_trip(spark, shape):
    a = np.random.default_rng(2).integers(0, 3, shape).astype(float)
    f = model.from_numpy(spark, a)
    d = codecs.differences(f.df)
    assert d.count() == f.n_vox * (f.n_time - 1)
    got = back(codecs.integrate(d, codecs.first_values(f.df)), f.dims, f.n_time)
    assert np.allclose(got, a.reshape((*f.dims, f.n_time), order="F"))
    r = codecs.rle_encode(d)
    flat = np.diff(a.reshape((-1, f.n_time), order="F"), axis=1).ravel()
    want = [(k, v) for k, v in enumerate(flat)]
    assert [(x.pos, x.value) for x in codecs.rle_decode(r).orderBy("pos").collect()] == want
    if len(flat):
        starts = np.flatnonzero(np.diff(flat, prepend=np.nan) != 0)
        assert [x.pos for x in r.orderBy("pos").collect()] == starts.tolist()


def test_prefix_of_a_series(spark):
    f = model.from_numpy(spark, np.arange(12.0).reshape(2, 6) ** 2)
    got = codecs.integrate(codecs.differences(f.df), codecs.first_values(f.df), until=3)
    assert got.agg(F.max("t"), F.count("*")).first() == (3, 8)
    assert codecs.integrate(codecs.differences(f.df), None).where("t = 0").agg(F.sum("value")).first()[0] == 0


def test_higher_differences(spark):
    x = np.random.default_rng(4).normal(size=9)
    f = model.from_numpy(spark, x)
    get = lambda df: [r.value for r in df.orderBy("t").collect()]
    assert np.allclose(get(codecs.higher_difference(f.df, 2)), np.diff(x, 2))
    assert np.allclose(get(codecs.higher_difference(f.df, 1, "central")), (x[2:] - x[:-2]) / 2)
    assert np.allclose(get(codecs.higher_difference(f.df, 1, "backward", True)), np.diff(x))


def test_runs(spark):
    three = {f"run-0{k}": np.full((2, 2, 2, 3), float(k)) for k in (1, 2, 3)}
    f = model.from_numpy(spark, three)
    s = runs.aggregate_runs(f.df, "sum")
    assert s.count() == 24 and {r.value for r in s.collect()} == {6.0}
    assert {r.value for r in runs.aggregate_runs(f.df.where("run_id < 'run-03'"), "mean").collect()} == {1.5}
    c = runs.aggregate_runs(f.df, "concatenate")
    assert c.count() == 72 and c.agg(F.max("t")).first()[0] == 8
    with pytest.raises(errors.InvalidInput):
        runs.aggregate_runs(f.df, "median")


# ---- bases -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind,n,k", [("dct", 30, 7), ("polynomial", 25, 5), ("dpss", 32, 5), ("wavelet", 16, 16)])
def test_bases_are_orthonormal(kind, n, k):
    b = bases.basis_matrix(kind, n, k)
    assert np.allclose(b.T @ b, np.eye(b.shape[1]), atol=1e-9)


def test_filters_are_orthonormal():
    for name in ("haar", "db4", "d6", "db8", "sym8", "coif6"):
        g = bases.scaling_filter(name)
        for s in range(0, len(g), 2):
            assert g[: len(g) - s] @ g[s:] == pytest.approx(float(s == 0), abs=1e-9)
        assert bases.wavelet_filter(g) @ g == pytest.approx(0, abs=1e-12)
    assert bases.scaling_filter("db4").tolist() == pytest.approx([0.4829629131445341, 0.8365163037378079, 0.2241438680420134, -0.1294095225512604])


def test_bsplines_sum_to_one():
    b = bases.basis_matrix("bspline", 40, 9, order=3)
    assert np.allclose(b.sum(axis=1), 1) and np.linalg.matrix_rank(b) == 9
    with pytest.raises(errors.ValidationError):
        bases.basis_matrix("bspline", 40, 3, order=3)


def test_dpss_rules():
    b = bases.basis_matrix("dpss", 64, 6, time_bandwidth_product=3.0)
    assert (b[0] >= 0).all()
    for bad in ({"time_bandwidth_product": 40.0}, {"time_bandwidth_product": 2.0}):
        with pytest.raises(errors.ValidationError):
            bases.basis_matrix("dpss", 64, 6, **bad)
    with pytest.raises(errors.NoMethod):
        bases.basis_matrix("unknown", 4, 2)
    with pytest.raises(errors.ValidationError):
        bases.basis_matrix("wavelet", 12, 12)


def test_own_basis():
    @bases.temporal_basis("ones")
    def ones(n_time, n_basis, **_):
        return np.full((n_time, 1), n_time**-0.5)

    assert bases.basis_matrix("ones", 9, 1).sum() == pytest.approx(3)


def test_temporal_round_trip(spark):
    x = np.random.default_rng(1).normal(size=(4, 1, 1, 10))
    f = model.from_numpy(spark, x)
    for b in (bases.basis_matrix("dct", 10, 10), bases.basis_matrix("polynomial", 10, 10)):
        c = temporal.project(f.df, b)
        assert np.allclose(back(temporal.reconstruct(c, b), f.dims, 10), x, atol=1e-6)
    assert np.allclose(back(temporal.dct_reconstruct(temporal.dct_project(f.df, 10, 10), 10), f.dims, 10), x)
    s = bases.basis_matrix("bspline", 10, 6, order=3)
    r = back(temporal.reconstruct(temporal.project_least_squares(f.df, s), s), f.dims, 10) - x
    assert np.abs(r.reshape(4, 10) @ s).max() < 1e-8


@pytest.mark.parametrize("name", ["haar", "sym8", "coif6", "db8"])
def test_modwt_round_trip(spark, name):
    x = np.random.default_rng(3).normal(size=(3, 1, 1, 37))
    f = model.from_numpy(spark, x)
    c = temporal.modwt_project(f.df, name)
    assert np.allclose(back(temporal.modwt_reconstruct(c, 37, name), f.dims, 37), x, atol=1e-8)


def test_shrinkage(spark):
    w = np.concatenate([np.random.default_rng(5).normal(size=60), [30.0, -25.0]])
    c = spark.createDataFrame([("run-01", k, 0, float(v)) for k, v in enumerate(w)], "run_id string, k int, vox int, value double")
    get = lambda df: np.array([r.value for r in df.orderBy("k").collect()])
    sigma = np.median(np.abs(w - np.median(w))) * 1.4826 / 0.6745
    thr = sigma * np.sqrt(2 * np.log(len(w)))
    assert np.allclose(get(temporal.shrink(c, "soft")), np.sign(w) * np.maximum(abs(w) - thr, 0))
    assert np.allclose(get(temporal.shrink(c, "hard")), w * (abs(w) > thr))
    bay = sigma**2 / (np.sqrt(max((w**2).mean() - sigma**2, 0)) + 1e-12)
    assert np.allclose(get(temporal.shrink(c, "bayes_shrink")), np.sign(w) * np.maximum(abs(w) - bay, 0))
    assert np.allclose(get(temporal.shrink(c, "hard", 1.0)), np.where(abs(w) < 1, 0, w))
    from statistics import NormalDist

    p = np.array([2 * NormalDist().cdf(-abs(v)) for v in w])
    rank = np.sort(p)
    hit = np.flatnonzero(rank <= 0.05 * np.arange(1, len(w) + 1) / len(w))
    assert np.allclose(get(temporal.fdr(c, 1.0, 0.05)), np.where(p <= rank[hit.max()], w, 0))
    assert (get(temporal.fdr(c, 1e6, 0.05)) == 0).all()


def test_energy_threshold(spark):
    c = spark.createDataFrame([("run-01", k, 0, v) for k, v in enumerate([10.0, 5.0, 5.0, 0.1])], "run_id string, k int, vox int, value double")
    assert [r.value for r in temporal.energy_threshold(c, 0.8).orderBy("k").collect()] == [10, 5, 5, 0]


def test_dpss_advice():
    s = bases.suggest_dpss(2.0, 300)
    assert s["time_bandwidth_product"] == 2.0 and s["n_basis"] == 3
    assert bases.suggest_dpss(1.0, 400, "task")["time_bandwidth_product"] == 3.5
    assert bases.suggest_dpss(1.0, 400, "custom", max_freq=0.5)["time_bandwidth_product"] == 6.0
    with pytest.raises(errors.ValidationError):
        bases.suggest_dpss(1.0, 400, "custom")


# ---- linear algebra ------------------------------------------------------------------------------------


def test_decomposition_is_numpys(spark):
    x = np.random.default_rng(6).normal(size=(12, 5))
    f = model.from_numpy(spark, x.T.reshape((5, 1, 1, 12)))
    d = linalg.decompose(f.df, 5, 3)
    z = x - x.mean(axis=0)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(d.d, s[:3]) and np.allclose(abs(d.loadings), abs(vt[:3].T)) and np.allclose(d.mean, x.mean(axis=0))
    with pytest.warns(errors.ParameterAdjusted):
        assert linalg.decompose(f.df, 5, 30).k == 5
    basis = linalg.packed_basis(spark, d.loadings, "vox")
    c = linalg.project(f.df, basis, "vox", 3)
    got = np.array([r.c for r in c.orderBy("t").collect()])
    assert np.allclose(got, x @ d.loadings)
    again = back(linalg.reconstruct(c, basis, "vox", 5), f.dims, 12)
    assert np.allclose(again.reshape(5, 12), (x @ d.loadings @ d.loadings.T).T)


def test_wide_projection_is_summed_in_groups(spark):
    x = np.random.default_rng(7).normal(size=(3, 1, 1, 4))
    f = model.from_numpy(spark, x)
    b = np.random.default_rng(8).normal(size=(4, 150))
    got = linalg.project(f.df, linalg.packed_basis(spark, b, "t"), "t", 150).orderBy("vox").collect()
    assert np.allclose([r.c for r in got], x.reshape(3, 4) @ b)


def test_weight_codes():
    q, scale = linalg.quantise_weights(np.array([1.0, -0.5, 0.25]), 5)
    assert q.tolist() == [15, -8, 4] and scale == pytest.approx(1 / 15)


# ---- space -------------------------------------------------------------------------------------------


def table(spark, mask):
    return spark.createDataFrame([(int(v),) for v in np.flatnonzero(mask.ravel(order="F"))], "vox int")


def boxes():
    m = np.zeros((5, 5, 5), bool)
    m[:2, :2, :2] = m[3:5, 3:5, 3:5] = True
    return m


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_components(spark, limit):
    options.set_options({"kernel.max_series": limit})
    try:
        m = boxes()
        got = {r.vox: r.label for r in spatial.label_components(table(spark, m), m.shape).collect()}
        assert len(got) == 16 and set(got.values()) == {1, 2} and got[0] == 1
        r = np.random.default_rng(10).random((6, 5, 4)) < 0.45
        got = {x.vox: x.label for x in spatial.label_components(table(spark, r), r.shape).collect()}
        flat = r.ravel(order="F")
        seen, label = {}, 0
        for v in np.flatnonzero(flat):
            if v in seen:
                continue
            label += 1
            todo = [v]
            while todo:
                p = todo.pop()
                if p in seen:
                    continue
                seen[p] = label
                x, y, z = p % 6, p // 6 % 5, p // 30
                for dx, dy, dz in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)):
                    a, b, c = x + dx, y + dy, z + dz
                    if 0 <= a < 6 and 0 <= b < 5 and 0 <= c < 4 and r[a, b, c]:
                        todo.append(a + 6 * b + 30 * c)
        assert got == {int(k): v for k, v in seen.items()}
    finally:
        options.reset_options()


def test_morton_order(spark):
    full = np.ones((2, 2, 2), bool)
    codes = spatial.morton_codes(table(spark, full), (2, 2, 2)).orderBy("morton").collect()
    assert [r.vox for r in codes] == list(range(8))
    assert spatial.morton_hash(table(spark, full), (2, 2, 2)).startswith("sha1:")
    assert spatial.morton_codes(table(spark, ~full), (2, 2, 2)).count() == 0


@pytest.mark.parametrize("mask", [np.ones((2, 2, 2), bool), np.array([1, 0, 0, 0, 0, 0, 0, 1], bool).reshape((2, 2, 2)), boxes(), ball(1), ball(3)])
@pytest.mark.parametrize("levels", [1, 2, 3])
def test_haar_round_trip(spark, mask, levels):
    x = np.random.default_rng(11).normal(size=(*mask.shape, 3))
    f = model.from_numpy(spark, x, mask)
    inside = subset.masked(f)
    v = table(spark, mask)
    root, detail = haar.analyse(inside, v, mask.shape, levels)
    got = back(haar.synthesise(root, detail, v, mask.shape, levels), mask.shape, 3)
    assert np.allclose(got[mask], x[mask], atol=1e-6)
    if levels == 1:
        n = haar.block_sizes(v, mask.shape, 1)
        energy = detail.join(n.select("block", "n"), detail.code.bitwiseAND(-8) / 8 == n.block).agg(F.sum(F.col("value") ** 2 * 8 / F.col("n"))).first()[0] + root.agg(F.sum(F.col("value") ** 2)).first()[0]
        assert energy == pytest.approx((x[mask] ** 2).sum())


def test_details_of_a_region(spark):
    m = boxes()
    roi = np.zeros_like(m)
    roi[:2, :2, :2] = True
    got = haar.needed_details(table(spark, roi), table(spark, m), m.shape, 2).toPandas()
    assert sorted(got[got.level == 1].pos) == list(range(1, 9))
    assert 1 in got[got.level == 2].pos.tolist()


def test_sobel(spark):
    a = np.random.default_rng(12).normal(size=(6, 5, 4))
    f = model.from_numpy(spark, a[..., None])
    got = back(spatial.sobel(f.df, f.dims), f.dims, 1)[..., 0]
    want = np.zeros_like(a)
    s, d = np.array([1, 2, 1.0]), np.array([-1, 0, 1.0])
    for x in range(1, 5):
        for y in range(1, 4):
            for z in range(1, 3):
                c = a[x - 1 : x + 2, y - 1 : y + 2, z - 1 : z + 2]
                g = [np.einsum("ijk,i,j,k", c, *w) for w in ((d, s, s), (s, d, s), (s, s, d))]
                want[x, y, z] = np.sqrt(sum(v * v for v in g))
    assert np.allclose(got, want)
    assert np.allclose(back(spatial.sobel_by_windows(f.df, f.dims), f.dims, 1)[..., 0], want)
    holes = f.df.where("vox NOT IN (37, 38, 70)")  # neighbours of a hole have no gradient
    a_, b_ = (back(x, f.dims, 1)[..., 0] for x in (spatial.sobel(holes, f.dims), spatial.sobel_by_windows(holes, f.dims)))
    assert np.allclose(a_, b_, equal_nan=True) and 0 < (np.nan_to_num(a_) > 0).sum() < (want > 0).sum()
    e = spatial.edge_map(spatial.sobel(f.df, f.dims), k=0.0)
    assert e.where("edge").count() == (want > 0).sum()


def test_poisson_disk(spark):
    full = np.ones((5, 5, 5), bool)
    once, again = (sorted(r.vox for r in spatial.poisson_disk(table(spark, full), (5, 5, 5), 2.0, 42).collect()) for _ in range(2))
    assert once == again and len(once) > 1
    at = np.array([(v % 5, v // 5 % 5, v // 25) for v in once], float)
    gaps = np.linalg.norm(at[:, None] - at, axis=2)
    assert gaps[~np.eye(len(at), dtype=bool)].min() >= 2
    every = np.array([(v % 5, v // 5 % 5, v // 25) for v in range(125)], float)
    assert np.linalg.norm(every[:, None] - at, axis=2).min(axis=1).max() < 2  # nothing more fits
    assert spatial.poisson_disk(table(spark, np.ones((2, 2, 2), bool)), (2, 2, 2), 5.0, 1).count() == 1
    two = np.zeros((4, 4, 4), bool)
    two[:1, :1, :1] = two[3:, 3:, 3:] = True
    assert {r.component for r in spatial.poisson_disk(table(spark, two), (4, 4, 4), 9.0, 1).collect()} == {1, 2}


@pytest.mark.parametrize("kind", ["gaussian", "wendland_c4"])
def test_atoms(spark, kind):
    full = np.ones((4, 5, 6), bool)
    c = spark.createDataFrame([(0, 0, 9, 1.0, 2.0, 3.0, 2.0), (1, 1, 9, 3.0, 0.0, 0.5, 1.0)], "k int, level int, vox int, cx double, cy double, cz double, sigma double")
    got = {(r.k, r.vox): r.w for r in spatial.atoms(table(spark, full), full.shape, c, kind).collect()}
    for k, centre, sigma in ((0, (1, 2, 3), 2.0), (1, (3, 0, 0.5), 1.0)):
        at = np.array([(v % 4, v // 4 % 5, v // 20) for v in range(120)], float)
        r = np.linalg.norm(at - np.array(centre), axis=1) / sigma
        w = np.exp(-r * r / 2) if kind == "gaussian" else np.where(r < 1, (1 - np.minimum(r, 1)) ** 8 * (32 * r**3 + 25 * r**2 + 8 * r + 1), 0)
        w = np.where(abs(w) > 1e-8, w, 0)
        w = w / np.linalg.norm(w)
        assert np.allclose([got.get((k, v), 0.0) for v in range(120)], w, atol=1e-9)


def test_finer_levels_reconstruct_better(spark):
    full = np.ones((5, 5, 5), bool)
    x = np.random.default_rng(13).normal(size=(5, 5, 5, 2))
    f = model.from_numpy(spark, x)
    v = table(spark, full)
    sizes = []
    for extra in (0, 2):
        atoms, centres = spatial.hrbf_basis(v, (5, 5, 5), options.resolve_parameters("spat.hrbf", {"sigma0": 2.0, "levels": 0, "num_extra_fine_levels": extra}))
        sizes.append(centres.count())
        assert spatial.reconstruct_atoms(spatial.project_atoms(f.df, atoms), atoms).count() == 250
    assert sizes[1] > sizes[0]
