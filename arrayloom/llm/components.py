"""Connected components of an edge table by repeated contraction; labels stay in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table, drop_folder, skew_join


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (v, c): c is the smallest vertex reachable from v; only vertices with an edge.

    In each round every vertex hooks onto the first vertex of its closed neighbourhood, and the edges are
    relabelled. First is by turns the smallest, which takes in stars at once, and by an order drawn anew by hash, in
    which a constant share of the vertices goes in a round, also in long chains. Only whether edges are left comes to the driver.
    """
    live, path = as_table(edges.select("a", "b").where("a != b").distinct())
    labels, k, old = None, 0, [path]

    def table(df):
        df, path = as_table(df)
        old.append(path)
        return df

    while labels is None or not live.isEmpty():
        both = live.select(F.col("a").alias("v"), F.col("b").alias("u")).union(live.select(F.col("b"), F.col("a")))
        rank = lambda x: F.struct((F.xxhash64(x, F.lit(k)) if k % 2 else F.lit(0)).cast("long").alias("r"), F.col(x).alias("c"))  # noqa: E731, B023
        hook = table(both.groupBy("v").agg(F.min(rank("u")).alias("m")).select("v", F.least("m", rank("v"))["c"].alias("c")))
        if labels is None:
            labels = hook
        else:
            step = hook.select(F.col("v").alias("c"), F.col("c").alias("c2"))
            labels = table(skew_join(labels, step, "c").select("v", F.coalesce("c2", "c").alias("c")))
        left = skew_join(live, hook.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a", "inner")
        both = skew_join(left, hook.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b", "inner")
        live = table(both.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).where("a != b").distinct())
        k += 1
    least = labels.groupBy("c").agg(F.min("v").alias("least"))
    out, _ = as_table(skew_join(labels, least, "c", "inner").select("v", F.col("least").alias("c")))
    for path in old:
        drop_folder(path)
    return out
