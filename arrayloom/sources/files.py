"""Small files beside the tables, through Spark's own file systems: any path that Spark reads works."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import MissingPath


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there."""
    p, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    f = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(f)).decode()
    finally:
        f.close()


def move(spark: SparkSession, source: str, target: str) -> bool:
    a, fs = _path(spark, source)
    return fs.rename(a, _path(spark, target)[0])


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; in local mode, where none is named, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named is None and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise MissingPath("spark.checkpoint.dir names no shared folder", "shared_folder")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="arrayloom-"))
    return (named or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def work_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; what is there is deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"

    def drop():
        try:
            delete(spark, path)
        except Exception:  # the session may have ended first; then the folder's owner cleans up
            pass

    atexit.register(drop)
    return path


def as_table(df: DataFrame) -> tuple[DataFrame, str]:
    """A written table in the shared folder, and its path.

    For loops: unlike a checkpoint it has the size of its files as statistics, not the product of
    the sizes of all joins before it.
    """
    path = work_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
