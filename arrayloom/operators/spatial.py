"""Voxel neighbourhoods: Z-order, components, gradients, edges, Poisson-disk centres, radial atoms."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidInput, warn
from ..functions.kernels import sobel_magnitude
from ..functions.scalar import kernel, morton, morton_bits
from ..functions.shipping import ship
from ..model import with_coordinates
from ..options import option
from ..sources.files import as_table
from .graph import connected_components
from .ranks import medians, numbered
from .subset import small

ship(__name__)

# ---- order and hashes ----------------------------------------------------------------------------


def morton_codes(voxels: DataFrame, dims) -> DataFrame:
    """Adds x, y, z and morton to (vox)."""
    v = with_coordinates(voxels, dims)
    return v.withColumn("morton", morton(F.col("x"), F.col("y"), F.col("z"), morton_bits(dims)))


def bounding_box(voxels: DataFrame, dims) -> DataFrame:
    v = with_coordinates(voxels, dims)
    return v.agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def octree_counts(voxels: DataFrame, dims, levels: int) -> DataFrame:
    """(level, block, n): occupied voxels by block of 2^level; block is the Morton code without its last digits."""
    codes = morton_codes(voxels, dims)
    rows = codes.select("morton", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    return rows.groupBy("level", F.expr("shiftright(morton, 3 * level)").alias("block")).agg(F.count("*").alias("n"))


def morton_hash(voxels: DataFrame, dims) -> str:
    """sha1 of the voxels' 1-based numbers as 32-bit little-endian integers in Z-order.

    Numbers are put in order by Spark and come to the driver one partition after the other; it holds no more than one.
    """
    import hashlib

    def packed(batches):
        for b in batches:
            yield pa.record_batch([pa.array([(b.column(0).to_numpy() + 1).astype("<i4").tobytes()], pa.binary())], names=["data"])

    out = hashlib.sha1()
    for row in morton_codes(voxels, dims).orderBy("morton").select("vox").mapInArrow(packed, "data binary").toLocalIterator():
        out.update(row.data)
    return "sha1:" + out.hexdigest()


def mask_hash(voxels: DataFrame) -> str:
    """sha256 over the mask: an order-free sum of row hashes would collide more easily, so blocks are hashed in order."""
    import hashlib

    block = F.floor(F.col("vox") / 65536)
    parts = voxels.groupBy(block.alias("b")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_set("vox")), lambda v: v.cast("string")), ","), 256).alias("h"))
    return hashlib.sha256("".join(f"{r.b}:{r.h};" for r in parts.orderBy("b").collect()).encode()).hexdigest()


# ---- components ----------------------------------------------------------------------------------


def neighbour_pairs(voxels: DataFrame, dims) -> DataFrame:
    """(a, b): voxels that share a face, a < b; three equi-joins, one an axis."""
    v = with_coordinates(voxels.select("vox"), dims)
    n = v.select(F.col("vox").alias("b"))
    steps = F.array(F.when(F.col("x") < dims[0] - 1, F.lit(1)), F.when(F.col("y") < dims[1] - 1, F.lit(dims[0])), F.when(F.col("z") < dims[2] - 1, F.lit(dims[0] * dims[1])))
    pairs = v.select(F.col("vox").alias("a"), F.explode(F.array_compact(steps)).alias("step")).select("a", (F.col("a") + F.col("step")).alias("b"))
    return pairs.join(n, "b", "left_semi").select("a", "b")


def label_components(voxels: DataFrame, dims) -> DataFrame:
    """(vox, label): components of 6-connected voxels, numbered from 1 in order of their first voxel.

    A mask of up to kernel.max_series voxels is labelled by one task; a larger one by rounds of joins.
    """
    if voxels.select("vox").limit(option("kernel.max_series") + 1).count() <= option("kernel.max_series"):
        return voxels.select("vox").distinct().coalesce(1).mapInArrow(lambda batches: _labelled(batches, dims), "vox int, label int")
    found = connected_components(neighbour_pairs(voxels, dims))
    rooted = voxels.select("vox").join(found.withColumnRenamed("v", "vox"), "vox", "left").select("vox", F.coalesce("c", "vox").alias("root"))
    roots = rooted.select("root").distinct()
    return rooted.join(numbered(roots, "root", name="label", start=1), "root").select("vox", F.col("label").cast("int").alias("label"))


def _labelled(batches, dims):
    """Smallest-neighbour labels with pointer jumping, over whole arrays."""
    vox = np.sort(np.concatenate([b.column(0).to_numpy() for b in batches] or [np.empty(0, np.int32)])).astype(np.int64)
    steps = []
    for step, room in ((1, vox % dims[0] < dims[0] - 1), (dims[0], vox // dims[0] % dims[1] < dims[1] - 1), (dims[0] * dims[1], np.ones(len(vox), bool))):
        to = np.searchsorted(vox, vox + step)
        hit = room & (to < len(vox))
        hit[hit] = vox[to[hit]] == vox[hit] + step
        steps.append((np.flatnonzero(hit), to[hit]))
    label = np.arange(len(vox))
    while True:
        new = label.copy()
        for a, b in steps:
            np.minimum.at(new, label[a], label[b])
            np.minimum.at(new, label[b], label[a])
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    number = np.unique(label, return_inverse=True)[1] + 1 if len(vox) else label
    yield pa.record_batch([pa.array(vox, pa.int32()), pa.array(number, pa.int32())], names=["vox", "label"])


# ---- gradients -----------------------------------------------------------------------------------


def sobel(df: DataFrame, dims) -> DataFrame:
    """Gradient magnitude of 3-D Sobel filters: (run_id, t, vox, value) for every voxel there is.

    It is 0 where one of the 26 neighbours is absent. Volumes of up to kernel.max_series cells go whole to a task,
    each (run, time) on its own; larger ones are filtered by windows along the axes.
    """
    return _sobel_volumes(df, dims) if int(np.prod(dims)) <= option("kernel.max_series") else sobel_by_windows(df, dims)


def _sobel_volumes(df: DataFrame, dims) -> DataFrame:
    packed = df.groupBy("run_id", "t").agg(F.collect_list("vox").alias("vox"), F.collect_list("value").alias("value"))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                at, x = (b.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (2, 3))
                volume = np.full(int(np.prod(dims)), np.nan)
                volume[at] = x
                out = sobel_magnitude(volume.reshape(dims, order="F")).ravel(order="F")[at]
                yield pa.record_batch([pa.array([b.column(0)[i].as_py()] * len(at), pa.string()), pa.array(np.full(len(at), b.column(1)[i].as_py(), np.int32)), pa.array(at, pa.int32()), pa.array(out)], names=["run_id", "t", "vox", "value"])

    return packed.mapInArrow(run, "run_id string, t int, vox int, value double")


def sobel_by_windows(df: DataFrame, dims) -> DataFrame:
    """As sobel. The filters are separable: one pass along each axis smooths (1, 2, 1) and differentiates
    (-1, 0, 1), as a window over lines of that axis, so no row is copied to its 26 neighbours."""
    v = with_coordinates(df, dims)

    def along(axis: str, columns: dict[str, tuple[str, str]]):
        others = [c for c in "xyz" if c != axis]
        w = Window.partitionBy("run_id", "t", *others).orderBy(axis)
        near = (F.lag(axis).over(w) == F.col(axis) - 1) & (F.lead(axis).over(w) == F.col(axis) + 1)
        out = {}
        for name, (source, how) in columns.items():
            back, ahead, here = F.lag(source).over(w), F.lead(source).over(w), F.col(source)
            out[name] = F.when(near, back + 2 * here + ahead if how == "smooth" else ahead - back)
        return out

    # slopes skip the middle cell; sums that don't tell whether it was there
    v = v.withColumns(along("x", {"sx": ("value", "smooth"), "dx": ("value", "slope")}))
    v = v.withColumns(along("y", {"gx": ("dx", "smooth"), "gy": ("sx", "slope"), "gz": ("sx", "smooth")}))
    v = v.withColumns(along("z", {"a": ("gx", "smooth"), "b": ("gy", "smooth"), "c": ("gz", "slope"), "all": ("gz", "smooth")}))
    size = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c"))
    return v.select("run_id", "t", "vox", F.when(F.col("all").isNotNull(), F.coalesce(size, F.lit(0.0))).otherwise(0.0).alias("value"))


def edge_map(gradient: DataFrame, voxels: DataFrame | None = None, k: float = 3.0) -> DataFrame:
    """(run_id, t, vox, edge): gradients above k times their median over the voxels of the mask."""
    # read again in every round of the medians
    gradient, _ = as_table(gradient)
    inside = gradient if voxels is None else gradient.join(voxels.select("vox"), "vox", "left_semi")
    mid = medians(inside, ["run_id", "t"], F.abs("value"), "mid")
    return gradient.join(mid, ["run_id", "t"]).select("run_id", "t", "vox", (F.col("value") > k * F.col("mid")).alias("edge"))


def self_mean(df: DataFrame) -> DataFrame:
    """Mean over time of every voxel, as a volume at t = 0."""
    return df.groupBy("run_id", "vox").agg(F.avg("value").alias("value")).select("run_id", F.lit(0).alias("t"), "vox", "value")


def resample(volume: DataFrame, dims, target, affine: np.ndarray) -> DataFrame:
    """Nearest voxel of a volume at every voxel of a target space; affine maps target to source indices."""
    spark = volume.sparkSession
    grid = with_coordinates(spark.range(int(np.prod(target))).select(F.col("id").cast("int").alias("vox")), target)
    at = [F.rint(sum((F.col(c) * float(affine[r, k]) for k, c in enumerate("xyz")), F.lit(float(affine[r, 3])))).cast("int") for r in range(3)]
    inside = (at[0].between(0, dims[0] - 1)) & (at[1].between(0, dims[1] - 1)) & (at[2].between(0, dims[2] - 1))
    source = grid.where(inside).select("vox", (at[0] + at[1] * dims[0] + at[2] * dims[0] * dims[1]).alias("src"))
    return source.join(volume.withColumnRenamed("vox", "src"), "src").select("run_id", "t", "vox", "value")


# ---- centres and atoms ---------------------------------------------------------------------------


def poisson_disk(voxels: DataFrame, dims, radius: float, seed: int, edges: DataFrame | None = None, density: float = 1.0) -> DataFrame:
    """(vox, component): centres no closer than radius voxels to each other within a component of the mask.

    Voxels come in the order of a hash of seed, component and voxel; each is taken unless a taken one is
    nearer than the radius (on edge voxels radius / density). A component always gets a centre.

    A voxel waits for those before it that are near, for no others. So space is cut into blocks, each with a margin as wide as the
    radius, and a round decides in each block all voxels that wait for none outside it; few rounds are left to do, as the order is random.
    """
    labels = label_components(voxels, dims)
    rows = with_coordinates(labels, dims).withColumn("order", F.xxhash64(F.lit(seed), "label", "vox"))
    rows = rows.withColumn("edge", F.lit(False)) if edges is None else rows.join(edges.select("vox", "edge"), "vox", "left").withColumn("edge", F.coalesce("edge", F.lit(False)))
    margin = math.ceil(max(radius, radius / density))
    size = max(32, min(4 * margin, 128))
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - margin) / size), F.floor((F.col(c) + margin) / size)).cast("array<int>"))
    schema = "vox int, label int, x int, y int, z int, order long, edge boolean, taken boolean"

    def decide(key, pdf):
        return _decided(pdf, np.array(key), size, margin, radius, density)

    live, _ = as_table(rows.select("vox", "label", "x", "y", "z", "order", "edge", F.lit(False).alias("taken")))
    while not live.where("NOT taken").isEmpty():
        dealt = live.select("*", near("x").alias("bx")).select("*", near("y").alias("by")).select("*", near("z").alias("bz"))
        new = dealt.groupBy("bx", "by", "bz").applyInPandas(decide, schema)
        live, _ = as_table(live.where("taken").unionByName(new))
    return live.select("vox", F.col("label").alias("component"))


def _decided(pdf, block: np.ndarray, size: int, margin: int, radius: float, density: float):
    """The block's own undecided voxels that are taken now, or wait for one that another block decides."""
    names = ["vox", "label", "x", "y", "z", "order", "edge", "taken"]
    xyz = pdf[["x", "y", "z"]].to_numpy()
    mine = (xyz // size == block).all(axis=1) & ~pdf["taken"].to_numpy()
    if not mine.any():
        return pdf.iloc[:0][names]
    order = np.lexsort((pdf["vox"].to_numpy(), pdf["order"].to_numpy()))
    pdf, xyz, mine = pdf.iloc[order], xyz[order], mine[order]
    at = xyz - xyz.min(axis=0) + margin
    shape = tuple(at.max(axis=0) + margin + 1)
    place = tuple(at.T)
    label, reach = np.zeros(shape, np.int32), np.zeros(shape)
    label[place] = pdf["label"]
    reach[place] = np.where(pdf["edge"], radius / density, radius) ** 2
    covered, waiting = np.zeros(shape, bool), np.zeros(shape, bool)
    d = np.arange(-margin, margin + 1) ** 2
    distance = d[:, None, None] + d[:, None] + d
    stays, taken = [], pdf["taken"].to_numpy().copy()
    for i, (p, own, done) in enumerate(zip(map(tuple, at.tolist()), mine.tolist(), taken.tolist(), strict=True)):
        if covered[p] and not done:
            continue
        around = tuple(slice(c - margin, c + margin + 1) for c in p)
        if own:
            stays.append(i)
            taken[i] = done = not (waiting[around] & (label[around] == label[p]) & (distance < reach[p])).any()
        if done:
            covered[around] |= (label[around] == label[p]) & (distance < reach[around])
        else:
            waiting[p] = True
    return pdf.assign(taken=taken).iloc[stays][names]


def level_scales(sigma0: float, levels: int, radius_factor: float, extra: int = 0) -> list[tuple[int, float, float]]:
    """(level, sigma, radius in mm): sigma halves at every level."""
    return [(j, sigma0 / 2**j, radius_factor * sigma0 / 2**j) for j in range(levels + extra + 1)]


def world(voxels: DataFrame, dims, spacing=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0)) -> DataFrame:
    """Adds wx, wy, wz in mm."""
    v = with_coordinates(voxels, dims)
    return v.withColumns({f"w{c}": F.col(c) * float(spacing[k]) + float(origin[k]) for k, c in enumerate("xyz")})


def hrbf_centres(voxels: DataFrame, dims, sigma0: float = 6.0, levels: int = 3, radius_factor: float = 2.5, num_extra_fine_levels: int = 0, seed: int = 1, spacing=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0), edges: DataFrame | None = None, density: float = 1.5, **_) -> DataFrame:
    """(k, level, vox, cx, cy, cz, sigma): Poisson-disk centres of every level, numbered from 0."""
    out = None
    for level, sigma, radius in level_scales(sigma0, levels, radius_factor, num_extra_fine_levels):
        at = poisson_disk(voxels, dims, radius / (sum(spacing) / 3), seed + level, edges, density).select(F.lit(level).alias("level"), "vox", F.lit(sigma).alias("sigma"))
        out = at if out is None else out.unionByName(at)
    placed = numbered(out, "level", "vox", name="k")
    return world(placed, dims, spacing, origin).select(F.col("k").cast("int").alias("k"), "level", "vox", F.col("wx").alias("cx"), F.col("wy").alias("cy"), F.col("wz").alias("cz"), "sigma")


def atoms(voxels: DataFrame, dims, centres: DataFrame, kernel_type: str = "gaussian", spacing=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0), fine_kernel: str = "wendland_c4", alt_from: int | None = None, least: float = 1e-8, normalise: bool = True) -> DataFrame:
    """(k, vox, w): kernels around centres, cut at 1e-8 and of unit norm over the mask.

    For each sigma, space is cut into cells as wide as its kernels reach; a centre meets the voxels of its own and the
    26 cells around it in an equi-join, so no voxel meets a centre that is much too far.
    """
    centres, _ = as_table(centres)
    reach = {"gaussian": math.sqrt(-2 * math.log(least)), "wendland_c4": 1.0}
    sizes = {r.sigma: r["count"] for r in centres.groupBy("sigma").count().collect()}  # a row a level
    if not sizes:
        raise InvalidInput("there are no centres", "atoms")
    wide = max(reach[kernel_type], reach[fine_kernel] if alt_from is not None else 0.0)
    at = lambda c: F.floor(F.col(c) / (F.col("sigma") * wide)).cast("int")
    v = world(voxels.select("vox"), dims, spacing, origin).select("vox", "wx", "wy", "wz", F.explode(F.array(*map(F.lit, sorted(sizes)))).alias("sigma"))
    v = v.withColumns({"gx": at("wx"), "gy": at("wy"), "gz": at("wz")})
    c = centres
    for g, w in (("gx", "cx"), ("gy", "cy"), ("gz", "cz")):
        c = c.withColumn(g, F.explode(F.sequence(at(w) - 1, at(w) + 1)))
    both = v.join(c.drop("vox"), ["sigma", "gx", "gy", "gz"])
    r = F.sqrt(sum(((F.col(f"w{a}") - F.col(f"c{a}")) * (F.col(f"w{a}") - F.col(f"c{a}")) for a in "xyz"), F.lit(0.0))) / F.col("sigma")
    w = kernel(r, kernel_type)
    if alt_from is not None:
        w = F.when(F.col("level") >= alt_from, kernel(r, fine_kernel)).otherwise(w)
    out = both.select("k", "vox", w.alias("w")).where(F.abs("w") > least)
    if normalise:
        norm = out.groupBy("k").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        out = out.join(small(norm, 2 * sum(sizes.values())), "k").select("k", "vox", (F.col("w") / F.col("norm")).alias("w"))
    return out


def hrbf_basis(voxels: DataFrame, dims, parameters: dict, spacing=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0), centres: DataFrame | None = None, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(atoms, centres) for a step's parameters; finer levels may have another kernel."""
    p = dict(parameters)
    for name in ("use_anisotropic_atoms", "include_derivative_atoms", "centre_steering", "use_differential_encoding"):
        if p.get(name):
            warn(f"{name} isn't implemented and is ignored")
    if centres is None:
        density = (p.get("edge_adaptive") or {}).get("density_factor", 1.5)
        centres = hrbf_centres(voxels, dims, p["sigma0"], p["levels"], p["radius_factor"], p.get("num_extra_fine_levels", 0), p["seed"], spacing, origin, edges, density)
    alt = p.get("num_fine_levels_alt_kernel", 0)
    alt_from = p["levels"] - alt + 1 if alt else None
    return atoms(voxels, dims, centres, p.get("kernel_type", "gaussian"), spacing, origin, p.get("kernel_type_fine_levels", "wendland_c4"), alt_from), centres


def project_atoms(df: DataFrame, basis: DataFrame) -> DataFrame:
    """Coefficients (run_id, t, k, value): products with sparse atoms, joined on the voxel."""
    return df.join(basis, "vox").groupBy("run_id", "t", "k").agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def reconstruct_atoms(coef: DataFrame, basis: DataFrame) -> DataFrame:
    return coef.join(basis, "k").groupBy("run_id", "t", "vox").agg(F.sum(F.col("value") * F.col("w")).alias("value"))

