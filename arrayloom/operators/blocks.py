"""Matrices in blocks, their products, orthonormal columns and singular values, for arrays of any width.

A wide matrix (rows are time points of runs, columns voxels) is a table of tiles: run_id, tb, vb, data. A tall matrix of l columns is a
table of blocks of its rows, keyed by vb or by (run_id, tb). data holds doubles, row by row; what a last block lacks is 0.

Columns are made orthonormal without a Gram matrix: tasks reduce their blocks to one triangle each, triangles are
stacked and reduced in a tree, and the columns are multiplied by the inverse of the last one (twice, which is as good as
Householder reflections on all rows). Only matrices of l x l numbers come to the driver.

Few rows (FEW_ROWS) need no range finder: the transposed matrix is a tall one of as many columns, and its triangle has all singular values.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ParameterAdjusted, warn
from ..functions.shipping import ship
from ..options import option
from ..sources.files import as_table, delete
from . import linalg
from .subset import small

ship(__name__)

TILE_ROWS, TILE_COLUMNS = 64, 2048
#: Bytes of partial sums that a task holds before it passes them on.
HELD_BYTES = 64_000_000
#: Triangles that one task stacks.
FAN = 16
OVERSAMPLE = 10
#: Up to so many rows, all of a voxel are in one block.
FEW_ROWS = 256
#: A Krylov space has up to so many times the columns it starts with.
SPACE = 12

_TILE = "run_id string, tb int, vb int, data binary"
_ROWS, _COLUMNS = ("run_id", "tb"), ("vb",)
_KEY_TYPES = {"run_id": pa.string(), "tb": pa.int32(), "vb": pa.int32()}


def tile_width(n_vox: int) -> int:
    return min(TILE_COLUMNS, n_vox)


def n_blocks(n_vox: int) -> int:
    return -(-n_vox // tile_width(n_vox))


# ---- tiles -----------------------------------------------------------------------------------------


def tiles(df: DataFrame, n_vox: int) -> DataFrame:
    """(run_id, t, vox, value) as tiles; absent cells are 0."""
    height, width = TILE_ROWS, tile_width(n_vox)

    def tile(key, table):
        out = np.zeros(height * width)
        out[table["at"].to_numpy()] = table["value"].to_numpy()
        return pa.table([[k.as_py()] for k in key] + [[out.tobytes()]], schema=pa.schema([*_KEY_TYPES.items(), ("data", pa.binary())]))

    at = (F.col("t") % height * width + F.col("vox") % width).cast("int")
    keyed = df.select("run_id", F.floor(F.col("t") / height).cast("int").alias("tb"), F.floor(F.col("vox") / width).cast("int").alias("vb"), at.alias("at"), F.col("value").cast("double").alias("value"))
    return keyed.groupBy("run_id", "tb", "vb").applyInArrow(tile, _TILE)


def column_moments(df: DataFrame, rows: int) -> DataFrame:
    """(vox, mean, m2) over all rows, absent cells being 0; m2 is the sum of squared distances from the mean."""
    c = df.groupBy("vox").agg(F.count("*").alias("c"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    mean = F.col("c") * F.col("m") / rows
    m2 = F.col("c") * (F.col("v") + (F.col("m") - mean) ** 2) + (rows - F.col("c")) * mean**2
    return c.select("vox", mean.alias("mean"), m2.alias("m2"))


def standardised(a: DataFrame, df: DataFrame, columns: DataFrame, n_vox: int) -> DataFrame:
    """Tiles less columns' mean, over their scale; time points that df doesn't have stay 0. columns: (vox, mean, scale)."""
    height, width = TILE_ROWS, tile_width(n_vox)

    def of_block(key, table):
        both = np.zeros((2, width))
        both[1] = 1.0
        for k, c in enumerate(("mean", "scale")):
            both[k, table["at"].to_numpy()] = table[c].to_numpy()
        return pa.table([[key[0].as_py()], [both.tobytes()]], schema=pa.schema([("vb", pa.int32()), ("columns", pa.binary())]))

    at = (F.col("vox") % width).cast("int").alias("at")
    of_columns = columns.select(F.floor(F.col("vox") / width).cast("int").alias("vb"), at, "mean", "scale").groupBy("vb").applyInArrow(of_block, "vb int, columns binary")
    here = df.select("run_id", F.floor(F.col("t") / height).cast("int").alias("tb"), (F.col("t") % height).cast("int").alias("r")).distinct()
    here = here.groupBy("run_id", "tb").agg(F.collect_list("r").alias("here"))

    def apply(batches):
        for b in batches:
            data = []
            for x, both, rows in zip(b.column("data"), b.column("columns"), b.column("here").to_pylist(), strict=True):
                x = np.frombuffer(x.as_buffer()).reshape(height, width)
                mean, scale = np.frombuffer(both.as_buffer()).reshape(2, width)
                out = np.zeros((height, width))
                out[rows] = (x[rows] - mean) / scale
                data.append(out.tobytes())
            yield pa.record_batch([b.column(c) for c in ("run_id", "tb", "vb")] + [pa.array(data, pa.binary())], names=["run_id", "tb", "vb", "data"])

    joined = a.join(small(of_columns, 2 * n_vox), "vb").join(here, ["run_id", "tb"])
    return joined.select("run_id", "tb", "vb", "data", "columns", "here").mapInArrow(apply, _TILE)


# ---- products --------------------------------------------------------------------------------------


def _flushed(keys, totals: dict):
    """The sums so far as a batch."""
    if totals:
        columns = [pa.array([k[i] for k in totals], _KEY_TYPES[c]) for i, c in enumerate(keys)]
        yield pa.record_batch([*columns, pa.array([x.tobytes() for x in totals.values()], pa.binary())], names=[*keys, "data"])


def _schema(keys) -> str:
    kinds = {"run_id": "string", "tb": "int", "vb": "int"}
    return ", ".join(f"{k} {kinds[k]}" for k in keys) + ", data binary"


def _summed(partial: DataFrame, keys: tuple, parts: int) -> DataFrame:
    """Adds up partial blocks as they stream in; a task holds the blocks that are dealt to it."""

    def add(batches):
        totals = {}
        for b in batches:
            for *key, data in zip(*(b.column(c).to_pylist() for c in keys), b.column("data"), strict=True):
                x = np.frombuffer(data.as_buffer())
                if (k := tuple(key)) in totals:
                    totals[k] += x
                else:
                    totals[k] = x.copy()
        yield from _flushed(keys, totals)

    return partial.repartition(parts, *keys).mapInArrow(add, _schema(keys))


def product(a: DataFrame, side: DataFrame, n_vox: int, l: int, transposed: bool = False, blocks: int = 1, cells: int | None = None) -> DataFrame:
    """Tiles times blocks keyed by vb; or, transposed, times blocks keyed by (run_id, tb). Tasks add up what falls to one block before the shuffle.

    blocks: about how many the result has; cells: how many numbers the side has, if that is known: it is broadcast within broadcast.max_cells.
    """
    height, width = TILE_ROWS, tile_width(n_vox)
    keys, on = (_COLUMNS, _ROWS) if transposed else (_ROWS, _COLUMNS)

    def multiply(batches):
        totals, size = {}, 0
        for b in batches:
            for *key, x, y in zip(*(b.column(c).to_pylist() for c in keys), b.column("data"), b.column("side"), strict=True):
                x = np.frombuffer(x.as_buffer()).reshape(height, width)
                z = (x.T if transposed else x) @ np.frombuffer(y.as_buffer()).reshape(-1, l)
                if (k := tuple(key)) in totals:
                    totals[k] += z
                else:
                    totals[k], size = z, size + z.nbytes
                if size > HELD_BYTES:
                    yield from _flushed(keys, totals)
                    totals, size = {}, 0
        yield from _flushed(keys, totals)

    side = side.withColumnRenamed("data", "side")
    joined = a.join(side if cells is None else small(side, cells), list(on)).select(*keys, "data", "side")
    held = blocks * (width if transposed else height) * l * 8
    return _summed(joined.mapInArrow(multiply, _schema(keys)), keys, max(1, -(-held // HELD_BYTES)))


def times_small(blocks: DataFrame, m: np.ndarray) -> DataFrame:
    """Every block times one small matrix."""
    keys = [c for c in blocks.columns if c != "data"]

    def run(batches):
        for b in batches:
            data = [(np.frombuffer(x.as_buffer()).reshape(-1, m.shape[0]) @ m).tobytes() for x in b.column("data")]
            yield pa.record_batch([*(b.column(c) for c in keys), pa.array(data, pa.binary())], names=[*keys, "data"])

    return blocks.mapInArrow(run, _schema(keys))


def triangle(blocks: DataFrame, l: int, count: int, after: np.ndarray | None = None) -> np.ndarray:
    """R of the QR decomposition of all rows (times a small matrix): triangles of tasks, reduced in a tree. count: how many blocks there are."""

    def reduce(batches, m=None):
        r = None
        for b in batches:
            for data in b.column("data"):
                x = np.frombuffer(data.as_buffer()).reshape(-1, l if m is None else m.shape[0])
                x = x if m is None else x @ m
                r = np.linalg.qr(x if r is None else np.vstack([r, x]), mode="r")
        if r is not None:
            yield pa.record_batch([pa.array([r.tobytes()], pa.binary())], names=["data"])

    width = l
    rs = blocks.select("data").mapInArrow(lambda batches: reduce(batches, after), "data binary")
    while count > FAN:
        count = -(-count // FAN)
        rs = rs.repartition(count).mapInArrow(reduce, "data binary")
    rows = [np.frombuffer(bytes(r.data)).reshape(-1, width) for r in rs.collect()]  # at most FAN triangles, or one a task
    return np.linalg.qr(np.vstack(rows), mode="r") if rows else np.zeros((0, width))


def orthonormal(blocks: DataFrame, l: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(m, s): blocks @ m has orthonormal columns, in falling order of the singular values s. Directions of no size are left out."""
    _, s, wt = np.linalg.svd(triangle(blocks, l, count))
    keep = s > (s[0] if len(s) else 0) * 1e-13
    s, m = s[keep], wt[keep].T / s[keep]
    if not len(s):
        return m, s
    # what rounding took from orthogonality in the first step is put right by a second
    r = triangle(blocks, len(s), count, after=m)
    return m @ np.linalg.inv(r * np.sign(np.diag(r))[:, None]), s


def random_rows(a: DataFrame, l: int, seed: int) -> DataFrame:
    """Normal numbers for every row of the tiles, as blocks; the same for the same seed."""

    def run(batches):
        for b in batches:
            for run_id, tb in zip(b.column("run_id").to_pylist(), b.column("tb").to_pylist(), strict=True):
                x = np.random.default_rng([seed, zlib.crc32(run_id.encode()), tb]).standard_normal((TILE_ROWS, l))
                yield from _flushed(_ROWS, {(run_id, tb): x})

    return a.select("run_id", "tb").distinct().mapInArrow(run, _schema(_ROWS))


def cells_of(blocks: DataFrame, n_vox: int) -> DataFrame:
    """Blocks keyed by vb as rows (k, vox, w), without zeros."""
    width = tile_width(n_vox)

    def run(batches):
        for b in batches:
            for vb, data in zip(b.column("vb").to_pylist(), b.column("data"), strict=True):
                x = np.frombuffer(data.as_buffer()).reshape(width, -1)
                v, k = np.nonzero(x)
                yield pa.record_batch([pa.array(k, pa.int32()), pa.array(v + vb * width, pa.int32()), pa.array(x[v, k])], names=["k", "vox", "w"])

    return blocks.select("vb", "data").mapInArrow(run, "k int, vox int, w double")


def packed(blocks: DataFrame, n_vox: int, l: int) -> DataFrame:
    """Blocks keyed by vb as rows (vox, w array), without those that are zero."""
    width = tile_width(n_vox)

    def run(batches):
        for b in batches:
            for vb, data in zip(b.column("vb").to_pylist(), b.column("data"), strict=True):
                x = np.frombuffer(data.as_buffer()).reshape(-1, l)
                v = np.flatnonzero(x.any(axis=1))
                w = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * l), pa.array(x[v].ravel()))
                yield pa.record_batch([pa.array(v + vb * width, pa.int32()), w], names=["vox", "w"])

    return blocks.select("vb", "data").mapInArrow(run, "vox int, w array<double>")


def column_signs(blocks: DataFrame, n_vox: int, l: int) -> np.ndarray:
    """-1 for columns whose largest entry is negative (ties: the first voxel), else 1."""
    width = tile_width(n_vox)

    def run(batches):
        vox, w = np.zeros(l, np.int64), np.zeros(l)
        for b in batches:
            for vb, data in zip(b.column("vb").to_pylist(), b.column("data"), strict=True):
                x = np.frombuffer(data.as_buffer()).reshape(-1, l)
                at = np.abs(x).argmax(axis=0)
                v, at = x[at, np.arange(l)], at + vb * width
                better = (np.abs(v) > np.abs(w)) | ((np.abs(v) == np.abs(w)) & (at < vox))
                vox, w = np.where(better, at, vox), np.where(better, v, w)
        some = np.flatnonzero(w)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(vox[some], pa.int32()), pa.array(w[some])], names=["k", "vox", "w"])

    found = blocks.select("vb", "data").mapInArrow(run, "k int, vox int, w double")  # l rows a task
    largest = found.groupBy("k").agg(F.max(F.struct(F.abs("w").alias("a"), (-F.col("vox")).alias("v"), "w")).alias("m"))
    out = np.ones(l)
    for r in largest.select("k", "m.w").collect():  # a row a column
        out[r.k] = -1.0 if r.w < 0 else 1.0
    return out


# ---- singular values ------------------------------------------------------------------------------


@dataclass
class Singular:
    """Right singular vectors as blocks keyed by vb, singular values, what was iterated."""

    right: DataFrame
    d: np.ndarray
    rounds: int


def _beside(left: DataFrame, right: DataFrame, keys: tuple, l: int, r: int) -> DataFrame:
    """The columns of two tall matrices side by side."""

    def run(batches):
        for b in batches:
            data = [np.hstack([np.frombuffer(x.as_buffer()).reshape(-1, l), np.frombuffer(y.as_buffer()).reshape(-1, r)]).tobytes() for x, y in zip(b.column("data"), b.column("more"), strict=True)]
            yield pa.record_batch([*(b.column(c) for c in keys), pa.array(data, pa.binary())], names=[*keys, "data"])

    return left.join(right.withColumnRenamed("data", "more"), list(keys)).select(*keys, "data", "more").mapInArrow(run, _schema(keys))


def _less(z: DataFrame, basis: DataFrame, l: int, width: int, m: np.ndarray) -> DataFrame:
    """z - basis @ m, both keyed by vb."""

    def run(batches):
        for b in batches:
            data = [(np.frombuffer(x.as_buffer()).reshape(-1, l) - np.frombuffer(y.as_buffer()).reshape(-1, width) @ m).tobytes() for x, y in zip(b.column("data"), b.column("more"), strict=True)]
            yield pa.record_batch([b.column("vb"), pa.array(data, pa.binary())], names=["vb", "data"])

    return z.join(basis.withColumnRenamed("data", "more"), "vb").select("vb", "data", "more").mapInArrow(run, "vb int, data binary")


def _cross(basis: DataFrame, z: DataFrame, width: int, l: int) -> np.ndarray:
    """basis' @ z; tasks send a matrix of width x l each."""

    def run(batches):
        total = None
        for b in batches:
            for x, y in zip(b.column("data"), b.column("more"), strict=True):
                part = np.frombuffer(x.as_buffer()).reshape(-1, width).T @ np.frombuffer(y.as_buffer()).reshape(-1, l)
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["data"])

    both = basis.join(z.withColumnRenamed("data", "more"), "vb").select("data", "more").mapInArrow(run, "data binary")
    return sum((np.frombuffer(bytes(r.data)).reshape(width, l) for r in both.collect()), np.zeros((width, l)))


def singular(a: DataFrame, n_vox: int, n_rows: int, k: int, row_blocks: int, seed: int = 42, extra: bool = False) -> Singular:
    """The k largest singular values of staged tiles and their right vectors, by a randomised range finder with a block Krylov space.

    k + OVERSAMPLE random columns go through the matrix and back. What is new of them joins an orthonormal basis, on which the best
    values are read off, until none of the k changes by more than svd.tolerance of the largest, or the basis holds all there is. A basis of
    SPACE times as many columns is cut back to its best. With extra, as many values as columns started are returned, of which the k first have settled.
    """
    spark, most, old = a.sparkSession, min(n_rows, n_vox), []
    l, nb = min(k + OVERSAMPLE, most), n_blocks(n_vox)

    def table(df):
        df, path = as_table(df)
        old.append(path)
        return df

    # in the space of the rows from the start: with as many columns as rows, that is all of it
    start = table(product(a, table(random_rows(a, l, seed)), n_vox, l, transposed=True, blocks=nb, cells=row_blocks * TILE_ROWS * l))
    m, s = orthonormal(start, l, nb)
    x = table(times_small(start, m))
    basis, images, w, width, new, rounds, d = x, None, None, 0, len(s), 0, np.zeros(0)
    for rounds in range(1, option("svd.max_rounds") + 1 if new else 1):
        y = table(product(a, x, n_vox, new, blocks=row_blocks, cells=n_vox * new))
        basis, images = (x, y) if images is None else (table(_beside(basis, x, _COLUMNS, width, new)), table(_beside(images, y, _ROWS, width, new)))
        width += new
        last = d if rounds > 1 else None
        _, d, wt = np.linalg.svd(triangle(images, width, row_blocks))
        w = wt[: len(d)].T
        if width >= most or not d[0] or (last is not None and len(d) >= k and np.abs(d[:k] - last[:k]).max(initial=0) <= option("svd.tolerance") * d[0]):
            break
        z = table(product(a, y, n_vox, new, transposed=True, blocks=nb, cells=row_blocks * TILE_ROWS * new))
        # twice, as what rounding leaves of the basis in the first step would grow
        c = _cross(basis, z, width, new)
        c = c + _cross(basis, _less(z, basis, new, width, c), width, new)
        rest = table(_less(z, basis, new, width, c))
        m, s = orthonormal(rest, new, nb)
        # directions of rounding errors alone are no news
        m = m[:, s > 1e-11 * d[0] ** 2]
        if not m.shape[1]:
            break
        x, held = table(times_small(rest, m)), new
        new = min(m.shape[1], most - width)
        if new < m.shape[1]:
            x = table(times_small(x, np.eye(m.shape[1])[:, :new]))
        if width + held > SPACE * l and len(d) > l:
            basis, images = table(times_small(basis, w[:, :l])), table(times_small(images, w[:, :l]))
            width, d, w = l, d[:l], np.eye(l)
    else:
        if rounds:
            warn(f"singular values still change after {rounds} rounds", ParameterAdjusted)
    rank = int((d > d[0] * 1e-13).sum()) if len(d) else 0
    k = min(l if extra else k, rank)
    x = times_small(basis, w[:, :k]) if k else basis.limit(0)
    x = times_small(x, np.diag(column_signs(x, n_vox, k))) if k else x
    right, _ = as_table(x)
    for path in old:
        delete(spark, path)
    return Singular(right, d[:k], rounds)


def left_cells(a: DataFrame, s: Singular, n_vox: int, row_blocks: int) -> DataFrame:
    """(k, component, u): left singular vectors of tiles of one run, k being the row."""
    l = len(s.d)
    inverse = np.diag(np.where(s.d > 0, 1.0 / np.where(s.d > 0, s.d, 1.0), 0.0))
    y = times_small(product(a, s.right, n_vox, l, blocks=row_blocks, cells=n_vox * l), inverse)

    def run(batches):
        for b in batches:
            for tb, data in zip(b.column("tb").to_pylist(), b.column("data"), strict=True):
                x = np.frombuffer(data.as_buffer()).reshape(-1, l)
                r, c = np.nonzero(x)
                yield pa.record_batch([pa.array(r + tb * TILE_ROWS, pa.int32()), pa.array(c, pa.int32()), pa.array(x[r, c])], names=["k", "component", "u"])

    return y.select("tb", "data").mapInArrow(run, "k int, component int, u double")


@dataclass
class Components:
    """Loadings as rows (k, vox, w), singular values, columns' (vox, value) mean and scale, rows of the data, their sum of squares."""

    basis: DataFrame
    d: np.ndarray
    mean: DataFrame | None
    scale: DataFrame | None
    n: int
    total: float
    blocks: DataFrame | None = None

    @property
    def k(self) -> int:
        return len(self.d)


def cells_table(spark: SparkSession, loadings: np.ndarray) -> DataFrame:
    """(k, vox, w) of a small array of loadings (vox x k)."""
    v, k = np.nonzero(loadings)
    return spark.createDataFrame(list(zip(k.tolist(), v.tolist(), loadings[v, k].tolist(), strict=True)), "k int, vox int, w double")


def _vector(spark: SparkSession, x: np.ndarray) -> DataFrame:
    return spark.createDataFrame(list(enumerate(map(float, x))), "vox int, value double")


def prepared(df: DataFrame, n_vox: int, center: bool, scale: bool):
    """Staged tiles, standardised if asked for: (tiles, rows, blocks of rows, mean, scale, sum of squares)."""
    rows = df.select("run_id", "t").distinct()
    n = rows.count()
    blocks = rows.select("run_id", F.floor(F.col("t") / TILE_ROWS)).distinct().count()
    columns, _ = as_table(column_moments(df, max(n, 1)))
    sd = F.sqrt(F.col("m2") / max(n - 1, 1)) if scale else F.lit(1.0)
    columns = columns.select("vox", (F.col("mean") if center else F.lit(0.0)).alias("mean"), F.when(sd > 0, sd).otherwise(1.0).alias("scale"), "m2", F.col("mean").alias("m"))
    squares = F.col("m2") + (F.lit(0.0) if center else n * F.col("m") ** 2)
    total = columns.agg(F.sum(squares / F.col("scale") ** 2)).first()[0] or 0.0
    a = tiles(df, n_vox)
    if center or scale:
        raw, path = as_table(a)
        a, _ = as_table(standardised(raw, df, columns, n_vox))
        delete(df.sparkSession, path)
    else:
        a, _ = as_table(a)
    of = lambda name: columns.select("vox", F.col(name).alias("value"))
    return a, n, max(blocks, 1), of("mean") if center else None, of("scale") if scale else None, float(total)


def _of_few_rows(df: DataFrame, n_vox: int, rows: list[tuple[str, int]], center: bool, scale: bool) -> tuple[DataFrame, DataFrame]:
    """The transposed matrix, standardised if asked for, as staged blocks keyed by vb of a column a row; and (vox, mean, scale) of the voxels there are, with its share of the sum of squares."""
    n, width = len(rows), tile_width(n_vox)

    def block(key, table):
        at = table["at"].to_numpy()
        x = np.zeros((width, n))
        x[at, table["row"].to_numpy()] = table["value"].to_numpy()
        mean = x.mean(axis=1, keepdims=True)
        m2 = ((x - mean) ** 2).sum(axis=1, keepdims=True)
        sd = np.sqrt(m2 / max(n - 1, 1)) if scale else np.ones((width, 1))
        sd[sd == 0] = 1.0
        squares = (m2 + (0.0 if center else n * mean**2)) / sd**2
        if center:
            x -= mean
        columns = np.hstack([mean, sd, squares])
        there = np.unique(at)
        cells = [there.astype("<i4").tobytes(), columns[there].tobytes()]
        return pa.table([[key[0].as_py()], [(x / sd if scale else x).tobytes()], *([c] for c in cells)], schema=pa.schema([("vb", pa.int32()), *((c, pa.binary()) for c in ("data", "there", "columns"))]))

    def spread(batches):
        for b in batches:
            for vb, there, columns in zip(b.column("vb").to_pylist(), b.column("there"), b.column("columns"), strict=True):
                c = np.frombuffer(columns.as_buffer()).reshape(-1, 3).T
                vox = np.frombuffer(there.as_buffer(), "<i4") + vb * width
                yield pa.record_batch([pa.array(vox, pa.int32()), *map(pa.array, c)], names=["vox", "mean", "scale", "squares"])

    place = df.sparkSession.createDataFrame([(r, t, i) for i, (r, t) in enumerate(rows)], "run_id string, t int, row int")
    cells = df.join(F.broadcast(place), ["run_id", "t"])  # FEW_ROWS rows
    cells = cells.select(F.floor(F.col("vox") / width).cast("int").alias("vb"), (F.col("vox") % width).cast("int").alias("at"), "row", F.col("value").cast("double").alias("value"))
    staged, _ = as_table(cells.groupBy("vb").applyInArrow(block, "vb int, data binary, there binary, columns binary"))
    return staged.select("vb", "data"), staged.select("vb", "there", "columns").mapInArrow(spread, "vox int, mean double, scale double, squares double")


def decomposed(df: DataFrame, n_vox: int, k: int, center: bool = False, scale: bool = False, extra: bool = False, vectors: bool = True):
    """(singular values and vectors, rows, mean, scale, sum of squares) of the rows over t, standardised if asked for; extra as in singular.

    Few rows are decomposed at once by the triangle of the transposed matrix, more by the range finder; without vectors, right is None for few rows. df is
    read a few times: it should be a table.
    """
    some = df.select("run_id", "t").distinct().limit(FEW_ROWS + 1).collect()
    if not 0 < len(some) <= min(FEW_ROWS, n_vox):
        a, n, row_blocks, mean, sd, total = prepared(df, n_vox, center, scale)
        return singular(a, n_vox, n, cut_components(k, n, n_vox), row_blocks, extra=extra), n, mean, sd, total
    n, nb = len(some), n_blocks(n_vox)
    k = cut_components(k, n, n_vox)
    tall, columns = _of_few_rows(df, n_vox, sorted((r.run_id, r.t) for r in some), center, scale)
    total = columns.agg(F.sum("squares")).first()[0] or 0.0
    if vectors:
        m, d = orthonormal(tall, n, nb)
    else:
        d = np.linalg.svd(triangle(tall, n, nb), compute_uv=False)
        d = d[d > d[0] * 1e-13]
    k = min(k + OVERSAMPLE if extra else k, len(d))
    right = None
    if vectors:
        x = times_small(tall, m[:, :k]) if k else tall.limit(0)
        right, _ = as_table(times_small(x, np.diag(column_signs(x, n_vox, k))) if k else x)
    of = lambda name: columns.select("vox", F.col(name).alias("value"))
    return Singular(right, d[:k], 0), n, of("mean") if center else None, of("scale") if scale else None, float(total)


def cut_components(k: int, n: int, n_vox: int) -> int:
    most = max(1, min(n, n_vox))
    if k > most:
        warn(f"k is cut from {k} to {most}", ParameterAdjusted)
    return min(k, most)


def components(df: DataFrame, n_vox: int, k: int, center: bool = True, scale: bool = False) -> Components:
    """Principal components of the rows over t, for any number of voxels.

    Up to kernel.max_features voxels one pass sums the Gram matrix, which then is small; more take the range finder.
    """
    spark = df.sparkSession
    if n_vox <= option("kernel.max_features"):
        d = linalg.decompose(df, n_vox, k, center, scale)
        return Components(cells_table(spark, d.loadings), d.d, _vector(spark, d.mean) if center else None, _vector(spark, d.scale) if scale else None, d.n, d.total)
    s, n, mean, sd, total = decomposed(df, n_vox, k, center, scale)
    return Components(cells_of(s.right, n_vox), s.d, mean, sd, n, total, s.right)
