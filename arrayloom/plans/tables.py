"""The driver's tables as arrays, and a registry of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Days in events, and the least size of the volume that part keys are laid out in (16 x 16 x as many as there are, see space). Z-order
#: codes that SQL shows have 12 bits an axis, which is this size; beyond it they recur.
N_DAYS = 30
DIMS = (16, 16, 4096)
#: Embeddings of 64 numbers as a space of 8 x 4 x 2.
EMBEDDING_DIMS = (8, 4, 2)


def query(sql: str | None = None, name: str | None = None):
    """Registers a query (spark, sf_dir) -> DataFrame under its function's name, with SQL if it has any."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run a label, a time point a vector, a voxel an element."""
    e = table(spark, sf_dir, "embeddings").select(F.format_string("run-%02d", F.col("label") + 1).alias("run_id"), F.col("vec_id").cast("int").alias("t"), F.posexplode("embedding").alias("vox", "x"))
    return e.select("run_id", "t", "vox", F.col("x").cast("double").alias("value"))


EMBEDDINGS = """m AS (SELECT printf('run-%02d', label + 1) AS run_id, vec_id::INT AS t, (i - 1)::INT AS vox, embedding[i]::DOUBLE AS value
FROM (SELECT label, vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""

#: Event types in the order of their runs.
EVENT_RUNS = ("click", "error", "purchase", "signup", "view")


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run an event type, a time point a day, a voxel a user; the value is the day's mean."""
    e = table(spark, sf_dir, "events").select("event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("t"), F.col("user_id").cast("int").alias("vox"), "value")
    run = F.lit("run-06")
    for k, name in enumerate(EVENT_RUNS, 1):
        run = F.when(F.col("event_type") == name, f"run-{k:02d}").otherwise(run)
    return e.groupBy(run.alias("run_id"), "t", "vox").agg(F.avg("value").alias("value"))


EVENTS = (
    "m AS (SELECT CASE event_type "
    + " ".join(f"WHEN '{n}' THEN 'run-{k:02d}'" for k, n in enumerate(EVENT_RUNS, 1))
    + " ELSE 'run-06' END AS run_id, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS t, user_id::INT AS vox, avg(value) AS value FROM events GROUP BY 1, 2, 3)"
)


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retail prices by part key, as one volume."""
    p = table(spark, sf_dir, "part")
    return p.select(F.lit("run-01").alias("run_id"), F.lit(0).alias("t"), F.col("p_partkey").cast("int").alias("vox"), F.col("p_retailprice").alias("value"))


VOLUME = "v AS (SELECT p_partkey::INT AS vox, (p_partkey % 16)::INT AS x, ((p_partkey // 16) % 16)::INT AS y, (p_partkey // 256)::INT AS z, p_retailprice AS value, p_size FROM part)"


def space(spark: SparkSession, sf_dir: str) -> tuple[int, int, int]:
    """The size of the volume: DIMS, or more layers if there are more parts."""
    last = table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] or 0
    return (*DIMS[:2], max(DIMS[2], last // (DIMS[0] * DIMS[1]) + 1))


def mask(spark: SparkSession, sf_dir: str, over: int = 10) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_size") > over).select(F.col("p_partkey").cast("int").alias("vox"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles at a number of decimals, without negative zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in columns})
