"""Decompositions of wide arrays, sparse components, matching pursuit, ranks and centres, against numpy and plain Python."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrayloom import errors, model, options
from arrayloom.operators import blocks, pursuit, ranks, sparse_pca, spatial, temporal


@pytest.fixture
def narrow_limit():
    """Every array counts as wide, in small tiles."""
    before = blocks.TILE_ROWS, blocks.TILE_COLUMNS
    options.set_options({"kernel.max_features": 0})
    blocks.TILE_ROWS, blocks.TILE_COLUMNS = 5, 7
    yield
    blocks.TILE_ROWS, blocks.TILE_COLUMNS = before
    options.reset_options()


def frame(spark, x):
    """x (time, voxel) as a long frame."""
    return model.from_numpy(spark, x.T.reshape((x.shape[1], 1, 1, len(x)))).df


def dense(cells, k, n):
    out = np.zeros((n, k))
    for r in cells.collect():
        out[r.vox, r.k] = r.w
    return out


# ---- principal components --------------------------------------------------------------------------


@pytest.mark.parametrize(("center", "scale"), [(True, False), (False, False), (True, True)])
def test_components_are_numpys(spark, narrow_limit, center, scale):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(33, 24)) * np.linspace(1, 5, 24) + 3
    z = x - x.mean(axis=0) if center else x
    z = z / x.std(axis=0, ddof=1) if scale else z
    c = blocks.components(frame(spark, x), 24, 4, center, scale)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    w = dense(c.basis, 4, 24)
    assert np.allclose(c.d, s[:4], rtol=1e-9) and np.allclose(np.abs(w.T @ vt[:4].T), np.eye(4), atol=1e-6)
    assert (np.take_along_axis(w, np.abs(w).argmax(axis=0)[None], 0) > 0).all()
    assert c.total == pytest.approx((z**2).sum()) and c.n == 33
    if center:
        assert np.allclose([r.value for r in c.mean.orderBy("vox").collect()], x.mean(axis=0))
    if scale:
        assert np.allclose([r.value for r in c.scale.orderBy("vox").collect()], x.std(axis=0, ddof=1))


def test_absent_cells_are_zero(spark, narrow_limit):
    """Time points that are absent don't count; cells that are absent at a time point that isn't are 0, also when centred."""
    x = np.random.default_rng(2).normal(size=(20, 9)) + 1
    x[::3, 4] = 0
    x[7] = 0
    df = frame(spark, x).where("value <> 0")
    rows = np.delete(x, 7, axis=0)
    c = blocks.components(df, 9, 3)
    assert c.n == 19 and np.allclose(c.d, np.linalg.svd(rows - rows.mean(axis=0))[1][:3])


def test_ranks_below_the_number_of_components(spark, narrow_limit):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(15, 2)) @ rng.normal(size=(2, 12))
    c = blocks.components(frame(spark, x), 12, 6, center=False)
    assert c.k == 2 and np.allclose(c.d, np.linalg.svd(x)[1][:2])
    with pytest.warns(errors.ParameterAdjusted):
        assert blocks.components(frame(spark, rng.normal(size=(5, 12))), 12, 30, center=False).k == 5
    assert blocks.components(frame(spark, np.zeros((4, 3))), 3, 2).k == 0


def test_fifty_thousand_voxels(spark):
    """A known spectrum, with options as they are; loadings stay in tables."""
    rng = np.random.default_rng(4)
    n, v, k = 40, 50_000, 5
    s = np.array([100.0, 60.0, 30.0, 10.0, 5.0, *np.linspace(1, 0.1, 15)])
    x = np.linalg.qr(rng.normal(size=(n, 20)))[0] * s @ np.linalg.qr(rng.normal(size=(v, 20)))[0].T
    t, vox = np.divmod(np.arange(n * v), v)
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"run_id": "run-01", "t": t.astype(np.int32), "vox": vox.astype(np.int32), "value": x.ravel()}))
    c = blocks.components(df, v, k, center=False)
    assert np.allclose(c.d, s[:k], rtol=1e-6, atol=0)
    assert c.total == pytest.approx((s**2).sum())


# ---- sparse components -----------------------------------------------------------------------------


def planted(seed=5, n=200, v=60):
    """Three components of overlapping strength on ten voxels each, and noise."""
    rng = np.random.default_rng(seed)
    w = np.zeros((v, 3))
    for k in range(3):
        w[15 * k : 15 * k + 10, k] = 1 / np.sqrt(10)
    scores = np.linalg.qr(rng.normal(size=(n, 3)))[0] * np.array([100.1, 100.0, 99.9])
    return scores @ w.T + 0.3 * rng.normal(size=(n, v)), w


def test_planted_sparse_basis(spark, narrow_limit):
    x, w = planted()
    c = sparse_pca.sparse_components(frame(spark, x), 60, 3, 0.02)
    got = dense(c.basis, 3, 60)
    assert np.allclose(np.linalg.norm(got, axis=0), 1)
    # voxel by voxel: what was planted is found, and nothing else
    match = np.abs(got.T @ w)
    assert sorted(match.argmax(axis=1)) == [0, 1, 2] and match.max(axis=1).min() > 0.98
    found = got[:, np.argsort(match.argmax(axis=1))] != 0
    assert (found == (w != 0)).all()
    # singular vectors mix components of nearly the same strength, so no threshold on them parts these
    v = np.linalg.svd(x, full_matrices=False)[2][:3].T
    assert np.abs(v.T @ w).max(axis=1).min() < 0.95
    assert len(c.objective) > 2 and (np.diff(c.objective) <= 0).all()


def test_sparse_objective_is_that_of_numpy(spark, narrow_limit):
    """The first rounds against the published steps on whole arrays."""
    x = np.random.default_rng(6).normal(size=(30, 11))
    alpha, k = 1e-2, 2
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    b, a1, b1 = vt[:k].T.copy(), alpha * s[0] ** 2, sparse_pca.BETA * s[0] ** 2
    nu, want = 1 / (s[0] ** 2 + b1), []
    for _ in range(30):
        u, _, w = np.linalg.svd(x.T @ (x @ b), full_matrices=False)
        a = u @ w
        b = b + nu * (x.T @ (x @ a - x @ b) - b1 * b)
        b = np.sign(b) * np.maximum(np.abs(b) - nu * a1, 0)
        want.append(0.5 * ((x - x @ b @ a.T) ** 2).sum() + a1 * np.abs(b).sum() + 0.5 * b1 * (b**2).sum())
    c = sparse_pca.sparse_components(frame(spark, x), 11, k, alpha, tolerance=0, max_rounds=30)
    # max_rounds may end earlier, where rounding lets the objective rise
    assert np.allclose(c.objective, want[: len(c.objective)], rtol=1e-9) and len(c.objective) >= 20


def test_sparse_fit_is_least_squares(spark, narrow_limit):
    x, _ = planted(8, 40, 50)
    c = sparse_pca.sparse_components(frame(spark, x), 50, 3, 0.02)
    w = dense(c.basis, 3, 50)
    want = ((x - x @ np.linalg.pinv(w).T @ w.T) ** 2).mean()
    r = sparse_pca.reconstruction_error(frame(spark, x), 50, c).first()
    assert r.mse == pytest.approx(want) and r.sparsity == pytest.approx((w == 0).mean())


# ---- matching pursuit ------------------------------------------------------------------------------


def brute(target, atoms, tolerance, limit):
    """Least squares from scratch after every atom."""
    left, active, weights = target.copy(), [], np.zeros(0)
    while len(active) < limit and left @ left > (tolerance**2) * (target @ target):
        c = np.abs(atoms @ left)
        c[active] = -1
        if c.max() <= 1e-12:
            break
        active.append(int(c.argmax()))
        d = atoms[active].T
        weights = np.linalg.lstsq(d, target, rcond=None)[0]
        left = target - d @ weights
    return active, weights


@pytest.mark.parametrize(("tolerance", "limit"), [(1e-9, 6), (0.3, 30)])
def test_pursuit_is_brute_force(spark, tolerance, limit):
    rng = np.random.default_rng(9)
    d = rng.normal(size=(40, 30)) * (rng.random((40, 30)) < 0.4)
    targets = np.vstack([rng.normal(size=(4, 30)), 3 * d[4] - 2 * d[11], np.zeros(30)])
    cells = lambda x, *names: spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in itertools.product(*map(range, x.shape)) if x[i, j]], f"{names[0]} int, vox int, {names[1]} double")
    rows = pursuit.pursue(cells(targets, "component", "value"), cells(d, "k", "w"), tolerance, limit).collect()
    for c in range(len(targets)):
        mine = sorted((r.place, r.k, r.weight) for r in rows if r.component == c)
        active, weights = brute(targets[c], d, tolerance, limit)
        assert [k for _, k, _ in mine] == active and np.allclose([w for _, _, w in mine], weights)
    assert len({r.component for r in rows}) == 5


def test_dependent_atoms(spark):
    """An atom that others already span isn't taken."""
    atoms = spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0), (2, 1, 1.0)], "k int, vox int, w double")
    target = spark.createDataFrame([(0, 0, 2.0), (0, 1, 1.0), (0, 2, 5.0)], "component int, vox int, value double")
    assert [(r.k, r.weight) for r in pursuit.pursue(target, atoms, 1e-9, 5).orderBy("place").collect()] == [(0, 2.0), (2, 1.0)]


# ---- ranks -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("held", [1, 10, 10**6])
def test_medians(spark, held):
    rng = np.random.default_rng(10)
    groups = {"a": rng.normal(size=501), "b": rng.normal(size=200) * 1e9, "c": np.full(77, 2.5), "d": np.repeat([1.0, 9.0], 40), "e": np.array([3.0]), "f": np.exp(rng.normal(size=333) * 20), "g": np.round(rng.normal(size=400), 1)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("z", None)]
    df = spark.createDataFrame(rows, "g string, value double").repartition(3)
    got = {r.g: r.median for r in ranks.medians(df, ["g"], held=held).collect() if r.median is not None}
    assert got.keys() == groups.keys()
    for g, x in groups.items():
        assert got[g] == pytest.approx(np.median(x), rel=1e-12), g


def test_numbers_in_order(spark):
    values = np.random.default_rng(11).permutation(5000)
    df = spark.createDataFrame([(int(v), "x", 1) for v in values], "v int, part string, offset int")
    numbered = ranks.numbered(df, "v", name="n", start=1)
    assert {(r.v, r.n) for r in numbered.collect()} == {(v, v + 1) for v in range(5000)}
    assert numbered.columns == ["v", "part", "offset", "n"]
    assert ranks.numbered(df.limit(0), "v").count() == 0
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_noise_of_large_runs(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=300), 5 * rng.normal(size=301)])
    rows = [("run-01" if i < 300 else "run-02", 0, i, float(v)) for i, v in enumerate(x)]
    c = spark.createDataFrame(rows, "run_id string, k int, vox int, value double")
    before = {r.run_id: r.sigma for r in temporal.noise_by_run(c).collect()}
    monkeypatch.setattr(temporal.medians, "__defaults__", ("value", "median", 20))
    after = {r.run_id: r.sigma for r in temporal.noise_by_run(c).collect()}
    assert after == pytest.approx(before, rel=1e-12) and after["run-02"] > 3 * after["run-01"]


# ---- centres ---------------------------------------------------------------------------------------


def one_by_one(rows, radius, density):
    """The rule itself: voxels in order, each against all that were taken."""
    taken = []
    for r in sorted(rows, key=lambda r: (r.order, r.vox)):
        reach = radius / density if r.edge else radius
        if all(r.label != q.label or (r.x - q.x) ** 2 + (r.y - q.y) ** 2 + (r.z - q.z) ** 2 >= reach**2 for q in taken):
            taken.append(r)
    return {(r.vox, r.label) for r in taken}


@pytest.mark.parametrize(("radius", "density"), [(2.0, 1.0), (3.5, 1.5), (1.0, 2.0), (2.5, 0.5)])
def test_centres_are_those_of_the_rule(spark, radius, density):
    """A mask over several blocks, with edges: rounds over blocks give what the rule gives voxel by voxel."""
    dims, rng = (80, 6, 40), np.random.default_rng(13)
    vox = np.flatnonzero(rng.random(80 * 6 * 40) < 0.25)
    voxels = spark.createDataFrame([(int(v),) for v in vox], "vox int")
    edges = voxels.withColumn("edge", F.col("vox") % 3 == 0)
    labels = model.with_coordinates(spatial.label_components(voxels, dims), dims).withColumn("order", F.xxhash64(F.lit(7), "label", "vox")).join(edges, "vox")
    got = {(r.vox, r.component) for r in spatial.poisson_disk(voxels, dims, radius, 7, edges, density).collect()}
    assert got == one_by_one(labels.collect(), radius, density)


def test_hash_of_parts_is_that_of_the_whole(spark):
    import hashlib

    dims = (8, 8, 8)
    voxels = spark.range(0, 512, 3).select(F.col("id").cast("int").alias("vox"))
    order = [r.vox + 1 for r in spatial.morton_codes(voxels, dims).orderBy("morton").collect()]
    assert spatial.morton_hash(voxels, dims) == "sha1:" + hashlib.sha1(np.array(order, "<i4").tobytes()).hexdigest()


@pytest.mark.parametrize(("center", "scale"), [(False, False), (True, False), (True, True)])
def test_few_rows_are_decomposed_at_once(spark, center, scale):
    x = np.random.default_rng(31).normal(size=(9, 300)) + 1.0
    x[:, 7] = 0.0
    s, n, mean, sd, total = blocks.decomposed(frame(spark, x), 300, 4, center, scale)
    y = x - x.mean(axis=0) if center else x
    y = y / np.where(x.std(axis=0, ddof=1) > 0, x.std(axis=0, ddof=1), 1) if scale else y
    u, d, vt = np.linalg.svd(y, full_matrices=False)
    assert n == 9 and s.rounds == 0 and np.allclose(s.d, d[:4]) and np.isclose(total, (y * y).sum())
    v = np.zeros((300, 4))
    for r in blocks.packed(s.right, 300, 4).collect():
        v[r.vox] = r.w
    assert np.allclose(v.T @ v, np.eye(4), atol=1e-12) and np.allclose(np.abs(v.T @ vt[:4].T), np.eye(4), atol=1e-9)
    assert (v[np.abs(v).argmax(axis=0), range(4)] > 0).all()
    if center:
        assert np.allclose([r.value for r in mean.orderBy("vox").collect()], x.mean(axis=0)[[r.vox for r in mean.select("vox").orderBy("vox").collect()]])
    assert (sd is not None) == scale
    assert np.allclose(blocks.decomposed(frame(spark, x), 300, 9, center, scale, vectors=False)[0].d, d[d > d[0] * 1e-13])
