"""Orthogonal matching pursuit of many targets over a dictionary in a table.

Batch-OMP (Rubinstein, Zibulevsky and Elad, 2008): products of targets and atoms are taken once. A round corrects them by the Gram matrix' columns of
the atoms that are in use, takes the largest for every target by partial aggregation, and adds a row to the target's Cholesky
factor. A column of the Gram matrix is computed when its atom is first taken, as a join on the voxel: the dictionary is never dense, and whole in no task.

What comes to the driver are the atoms taken, their products and factors: at most targets x limit^2 numbers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import as_table, delete, work_path

#: Products up to this and pivots up to this share of an atom's norm count as zero.
LEAST = 1e-12
_GRAM = "j int, k int, g double"


@dataclass
class _Fit:
    """Atoms taken for one target, their products with it, factor of their Gram matrix, weights."""

    energy: float
    atoms: list[int] = field(default_factory=list)
    products: list[float] = field(default_factory=list)
    factor: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: float = 0.0

    def add(self, atom: int, left: float, gram: dict[tuple[int, int], float]) -> bool:
        """Takes one more atom, whose product with what is left is given; False if it depends on those before."""
        g = np.array([gram.get((atom, k), 0.0) for k in self.atoms])
        n, own = len(self.atoms), gram[atom, atom]
        row = np.linalg.solve(self.factor, g) if n else np.zeros(0)
        pivot = own - row @ row
        if pivot <= LEAST * own:
            return False
        factor = np.zeros((n + 1, n + 1))
        factor[:n, :n], factor[n, :n], factor[n, n] = self.factor, row, np.sqrt(pivot)
        self.atoms.append(atom)
        self.products.append(left + float(g @ self.weights))
        self.factor = factor
        self.weights = np.linalg.solve(factor.T, np.linalg.solve(factor, np.array(self.products)))
        self.left = self.energy - float(self.weights @ np.array(self.products))
        return True


def _rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A table of what the driver holds; it is small."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def pursue(targets: DataFrame, atoms: DataFrame, tolerance: float, limit: int) -> DataFrame:
    """targets(component, vox, value) and atoms(k, vox, w) -> (component, k, place, weight), place being the order of taking, from 0.

    A target ends when what is left of it is tolerance of its norm or less, with limit atoms, or where no atom has a product left. Of atoms
    with the same product the first is taken. Targets of zeros have no atoms.
    """
    spark = targets.sparkSession
    atoms, atoms_path = as_table(atoms.select("k", "vox", "w"))
    products, products_path = as_table(targets.join(atoms, "vox").groupBy("component", "k").agg(F.sum(F.col("value") * F.col("w")).alias("a")))
    fits = {r.component: _Fit(r.e, left=r.e) for r in targets.groupBy("component").agg(F.sum(F.col("value") ** 2).alias("e")).collect()}  # a row a target
    live = {c for c, f in fits.items() if f.energy > 0}
    # the Gram matrix' columns so far, a batch of files a round
    gram_path, known = work_path(spark, "gram"), set()
    for _ in range(limit):
        live = {c for c in live if fits[c].left > tolerance**2 * fits[c].energy}
        if not live:
            break
        now = products.join(_rows(spark, [(c,) for c in sorted(live)], "component int"), "component", "left_semi")
        used = [(c, k, float(w)) for c in live for k, w in zip(fits[c].atoms, fits[c].weights, strict=True)]
        if used:
            taken = _rows(spark, used, "component int, j int, x double")
            fitted = spark.read.schema(_GRAM).parquet(gram_path).join(taken, "j").select("component", "k", (-F.col("x") * F.col("g")).alias("a"))
            now = now.unionByName(fitted).groupBy("component", "k").agg(F.sum("a").alias("a")).join(taken.select("component", F.col("j").alias("k")), ["component", "k"], "left_anti")
        best = now.groupBy("component").agg(F.max(F.struct(F.abs("a").alias("size"), (-F.col("k")).alias("first"), "a")).alias("m"))
        chosen = {r.component: (-r.first, r.a) for r in best.select("component", "m.first", "m.a", "m.size").where(F.col("size") > LEAST).collect()}
        live &= set(chosen)
        if new := {k for k, _ in chosen.values()} - known:
            mine = atoms.join(_rows(spark, [(k,) for k in sorted(new)], "k int"), "k", "left_semi").select(F.col("k").alias("j"), "vox", F.col("w").alias("u"))
            mine.join(atoms, "vox").groupBy("j", "k").agg(F.sum(F.col("u") * F.col("w")).alias("g")).write.mode("append").parquet(gram_path)
            known |= new
        if not live:
            break
        pairs = {(chosen[c][0], k) for c in live for k in [*fits[c].atoms, chosen[c][0]]}
        gram = {(r.j, r.k): r.g for r in spark.read.schema(_GRAM).parquet(gram_path).join(_rows(spark, sorted(pairs), "j int, k int"), ["j", "k"], "left_semi").collect()}
        live = {c for c in live if fits[c].add(*chosen[c], gram)}
    for path in (atoms_path, products_path, gram_path):
        delete(spark, path)
    rows = [(c, k, place, float(w)) for c, f in sorted(fits.items()) for place, (k, w) in enumerate(zip(f.atoms, f.weights, strict=True))]
    return spark.createDataFrame(rows, "component int, k int, place int, weight double")
