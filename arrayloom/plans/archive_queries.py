"""Archives end to end over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ArrayFrame
from ..sources import archive, files
from .array_queries import _codes_sql
from .pipeline import Pipeline
from .tables import EMBEDDING_DIMS, embeddings, query, rounded


def _work(spark: SparkSession) -> str:
    """A folder for a query's archive, where the cluster shares one."""
    return files.work_path(spark, "archive")


def _frame(spark, sf_dir) -> ArrayFrame:
    df = embeddings(spark, sf_dir)
    n = df.agg(F.max("t")).first()[0] + 1
    return ArrayFrame(df, EMBEDDING_DIMS, n, rank=4)


@query(_codes_sql("run_id", "range", True, 8, 'SELECT vox, count(*) AS n, round(avg((value - (q * scale + "offset")) * (value - (q * scale + "offset"))), 12) AS mse FROM c WHERE vox < 16 AND t < 200 GROUP BY vox'))
def archive_region_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantise, write, read voxels under 16 at times under 200, and compare with the source."""
    frame = _frame(spark, sf_dir)
    path = archive.write_archive(frame, _work(spark), [("quant", {"bits": 8})])
    back = archive.read_archive(spark, path, roi=list(range(16)), times=range(200)).select("run_id", "t", "vox", F.col("value").alias("back"))
    d = F.col("value") - F.col("back")
    both = frame.df.join(back, ["run_id", "t", "vox"])
    return rounded(both.groupBy("vox").agg(F.count("*").alias("n"), F.avg(d * d).alias("mse")), "mse", digits=12)


@query(
    """SELECT * FROM (VALUES (0::INT, 'delta', 'delta_s0_out'), (1::INT, 'quant', 'quant_s1_out')) v(step_index, type, output)"""
)
def descriptor_discovery(spark, sf_dir):
    path = Pipeline(_frame(spark, sf_dir)).delta().quant(bits=10, allow_clip=True).write(_work(spark))
    return spark.createDataFrame([(d["index"], d["type"], d["outputs"][0]) for d in archive.descriptors(spark, path)], "step_index int, type string, output string")


@query("""SELECT * FROM (VALUES ('00_quant/quant_params', 'quant_params')) v(path, role)""")
def catalog_missing_datasets(spark, sf_dir):
    """What an archive's catalog names beyond the values themselves."""
    path = archive.write_archive(_frame(spark, sf_dir), _work(spark), ["quant"])
    catalog = spark.read.parquet(f"{path}/catalog")
    present = spark.createDataFrame([("scans/values",)], "path string")
    return archive.missing_datasets(catalog, present).select("path", "role")


@query("SELECT 'digraph' AS kind, 3::INT AS edges")
def pipeline_diagram(spark, sf_dir):
    text = Pipeline().pca(k=5).quant(bits=6).diagram()
    return spark.createDataFrame([(text.split()[0], text.count("->"))], "kind string, edges int")
