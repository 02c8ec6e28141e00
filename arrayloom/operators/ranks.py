"""Order over whole tables without a task that sees it all: numbers in order, and exact medians of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import as_table
from .subset import small

#: A group of no more values than this is sorted by one task.
HELD_VALUES = 100_000
#: Ranges that an interval is cut into in a round.
RANGES = 1024


def numbered(df: DataFrame, *by: str, name: str = "n", start: int = 0) -> DataFrame:
    """Adds each row's place in the order of `by`, from start: rows are dealt out by range, counted, and numbered from the sum of the ranges before.

    Rows should differ in `by`; equal ones are numbered in any order. The dealt rows are written, as dealing them again might cut elsewhere.
    """
    part = "part"
    while part in df.columns:
        part += "_"
    dealt, _ = as_table(df.repartitionByRange(*by).withColumn(part, F.spark_partition_id()))
    sizes = {r[0]: r["count"] for r in dealt.groupBy(part).count().collect()}  # a row a partition
    offsets, total = [], start
    for p in sorted(sizes):
        offsets.append((p, total))
        total += sizes[p]
    offset = "offset"
    while offset in df.columns:
        offset += "_"
    table = df.sparkSession.createDataFrame(offsets, f"{part} int, {offset} long")
    place = F.row_number().over(Window.partitionBy(part).orderBy(*by)) - 1 + F.col(offset)
    return dealt.join(F.broadcast(table), part).withColumn(name, place).drop(part, offset)


def medians(df: DataFrame, keys: list[str], value="value", name: str = "median", held: int = HELD_VALUES) -> DataFrame:
    """(keys, name): the exact median by group, the mean of both middle values if there are two. Nulls don't count; values are finite.

    Small groups are aggregated as usual. For large ones an interval that holds the wanted rank is cut into ranges, whose values are
    counted with partial sums; the range with the rank is the next interval, until its values are one or few. A round takes all groups.
    """
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, value.cast("double").alias("v")).where("v IS NOT NULL")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("inside"), F.min("v").alias("low"), F.max("v").alias("high"))
    plain = lambda x: x.groupBy(*keys).agg(F.median("v").alias(name))
    if sizes.where(F.col("inside") > held).isEmpty():
        return plain(rows)
    large, _ = as_table(sizes.where(F.col("inside") > held))
    groups = large.count()
    few = plain(rows.join(small(large.select(*keys), groups * len(keys)), keys, "left_anti"))
    ranks = F.array_distinct(F.array(F.floor((F.col("inside") - 1) / 2), F.floor(F.col("inside") / 2)))
    live = large.select(*keys, F.posexplode(ranks).alias("which", "rank"), "low", "high", "inside")
    state, found = [*keys, "which", "rank", "low", "high", "inside"], None
    while True:
        live, _ = as_table(live.select(*state))
        # an interval of one value, or of few enough for one task, ends here
        over = (F.col("inside") <= held) | (F.col("low") == F.col("high"))
        ended, live = live.where(over), live.where(~over)
        inside = rows.join(small(ended.where("low < high"), 6 * groups), keys).where(F.col("v").between(F.col("low"), F.col("high")))
        one = ended.where("low = high").select(*keys, "which", F.col("low").alias("v"))
        chosen = inside.groupBy(*keys, "which").agg(F.sort_array(F.collect_list("v")).alias("all"), F.first("rank").alias("rank")).select(*keys, "which", F.get("all", F.col("rank").cast("int")).alias("v"))
        found = one.unionByName(chosen) if found is None else found.unionByName(one).unionByName(chosen)
        if live.isEmpty():
            break
        cut = rows.join(small(live, 6 * groups), keys).where(F.col("v").between(F.col("low"), F.col("high")))
        cut = cut.withColumn("range", F.width_bucket("v", "low", "high", F.lit(RANGES)))
        counts = cut.groupBy(*keys, "which", "rank", "range").agg(F.count("*").alias("inside"), F.min("v").alias("low"), F.max("v").alias("high"))
        # at most RANGES + 1 rows a group
        before = F.sum("inside").over(Window.partitionBy(*keys, "which").orderBy("range")) - F.col("inside")
        live = counts.withColumn("before", before).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("inside"))).withColumn("rank", F.col("rank") - F.col("before"))
    return few.unionByName(found.groupBy(*keys).agg(F.avg("v").alias(name)))
