"""What the corpus operators share: table access, staging, skew-safe joins, worker shipping."""

from __future__ import annotations

import atexit
import ctypes
import os
import sys
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these bytes; ``bytes.split()`` cuts at exactly them.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def ship(module: str) -> None:
    """Send a module's functions to workers by value: executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one only in local mode, where none is named (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="arrayloom-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def staged(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def file_system(folder: str):
    """The pyarrow file system of a folder, and the folder's path in it."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(folder))


def drop_folder(folder: str) -> None:
    system, path = file_system(folder)
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)


def as_table(df: DataFrame) -> tuple[DataFrame, str]:
    """A written table in the shared folder, and its path; it is deleted when the driver ends.

    For loops: unlike a checkpoint it has the size of its files as statistics, not the product of
    the sizes of all joins before it.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    atexit.register(drop_folder, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def let(value: Column, body) -> Column:
    """Bind an array or scalar once; a plain alias inside a lambda is evaluated for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Equi-join whose left side may hold very many rows of one key; right has a row per key.

    The derived second key makes both sides arrive through exchanges of the join's own, which
    adaptive execution can split where a key is hot (it can't where an aggregate's
    partitioning is reused). It is all but always false, so that it takes no room in a shuffle.
    """
    tag = F.xxhash64(F.col(key)) == F.lit(17)
    return left.withColumn("_tag", tag).join(right.withColumn("_tag", tag), [key, "_tag"], how).drop("_tag")


#: A table is sent to all executors only if it takes no more bytes than this.
BROADCAST_BYTES = 32_000_000


def bounded_broadcast(table: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A staged table, marked for broadcasting if its measured size allows; else left to a shuffle join.

    Only the sum of its rows' sizes comes to the driver.
    """
    size = table.select(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 32)).first()[0] or 0
    return F.broadcast(table) if size <= limit else table


def worker_cache(name: str, make):
    """Something dear to build, kept for later tasks of the same Python worker."""
    kept = sys.__dict__.setdefault("_arrayloom_kept", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: workers wait for the next one, beside the JVM that has to share with them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tokenizer_path(name: str) -> str:
    """Where a vocabulary file of the installed collection is, on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def in_blocks(batches, budget: int):
    """Slices of Arrow batches whose texts have about budget bytes; a longer text makes its own."""
    for b in batches:
        start = size = 0
        for k, t in enumerate(b.column(1)):
            size += len(t.as_py() or "")
            if size >= budget:
                yield b.slice(start, k + 1 - start)
                start, size = k + 1, 0
        if start < b.num_rows:
            yield b.slice(start)
