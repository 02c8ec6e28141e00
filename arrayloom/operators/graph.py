"""Connected components of an edge table, by contraction in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import as_table, delete


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (v, c), c the smallest vertex of v's component; vertices without an edge are absent.

    Every vertex hooks onto the first of itself and its neighbours, edges are relabelled, and again until none
    is left. First is by turns the smallest, which takes in stars at once, and by an order drawn anew by hash, in which a
    constant share of the vertices goes in a round, also in long chains. Only whether any edge is left comes to the driver.
    """
    (live, path), labels, k = as_table(edges.select("a", "b").where("a != b").distinct()), None, 0
    old = [path]

    def table(df):
        df, path = as_table(df)
        old.append(path)
        return df

    while labels is None or not live.isEmpty():
        drawn = lambda x: F.struct((F.xxhash64(x, F.lit(k)) if k % 2 else F.lit(0)).cast("long").alias("r"), F.col(x).alias("c"))  # noqa: E731, B023
        ends = live.select(F.col("a").alias("v"), F.col("b").alias("u")).union(live.select("b", "a"))
        hook = table(ends.groupBy("v").agg(F.min(drawn("u")).alias("m")).select("v", F.least("m", drawn("v"))["c"].alias("c")))
        if labels is None:
            labels = hook
        else:
            further = hook.select(F.col("v").alias("c"), F.col("c").alias("c2"))
            labels = table(labels.join(further, "c", "left").select("v", F.coalesce("c2", "c").alias("c")))
        a, b = (hook.select(F.col("v").alias(x), F.col("c").alias(f"c{x}")) for x in "ab")
        moved = live.join(a, "a").join(b, "b")
        live = table(moved.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).where("a != b").distinct())
        k += 1
    least = labels.groupBy("c").agg(F.min("v").alias("least"))
    out, _ = as_table(labels.join(least, "c").select("v", F.col("least").alias("c")))
    for path in old:
        delete(edges.sparkSession, path)
    return out
