"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, skew_join, staged

#: translate() with these two alphabets lower-cases A-Z only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case; where all is ASCII, lower() does the same and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _digests(docs: DataFrame, prefix_chars: int, full: bool) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), lowered(text).alias("t"))
    digest = F.sha2("t", 256) if full else F.lit(None).cast("string")
    return rows.select("doc_id", F.octet_length("t").cast("long").alias("n"), F.xxhash64(F.substring("t", 1, prefix_chars)).alias("prefix_hash"), digest.alias("text_sha256"))


def exact_dedup(docs: DataFrame, prefix_chars: int = 256, digest_all: bool = True) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are after lower-casing A-Z; of equal ones the row with the
    largest doc_id stays. Only documents that share length and prefix hash with another are
    grouped by the full hash, so most rows never enter that shuffle. With digest_all the digest of
    every row is part of the result and is taken while the row is read; without it, full
    texts are read for the survivors alone and text_sha256 is null for the rest.

    Null text counts as empty. Repeated rows of the kept doc_id all stay (they are one
    document); a null doc_id stays only where a group has no other id. An empty table gives
    no rows. Other columns are ignored.
    """
    rows = staged(_digests(docs, prefix_chars, digest_all))
    lengths = rows.groupBy("n").count().where("count > 1").select("n")
    by_length = skew_join(rows, lengths, "n", "left_semi")
    prefixes = by_length.groupBy("n", "prefix_hash").count().where("count > 1").select("n", "prefix_hash")
    if digest_all:
        pair = F.struct("n", "prefix_hash")
        survivors = skew_join(by_length.withColumn("p", pair), prefixes.select(pair.alias("p")), "p", "left_semi").drop("p")
    else:
        keys = ["n", "prefix_hash"]
        ids = by_length.join(prefixes, keys, "left_semi").select("doc_id").distinct()
        a, b = docs.select(F.col("doc_id").cast("long"), "text").alias("a"), ids.alias("b")
        some = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), "left_semi")
        survivors = staged(_digests(some, prefix_chars, True)).join(prefixes, keys, "left_semi")
        rows = rows.join(prefixes, keys, "left_anti").unionByName(survivors)
    groups = survivors.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    out = skew_join(rows, groups, "text_sha256")
    keep = F.coalesce("keep_id", "doc_id")
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256
FROM d JOIN g ON d.h = g.h
"""
