"""The corpus pipeline: cleaning, line and near-duplicate removal, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from arrayloom.llm.common import documents, shared_dir
from arrayloom.llm.line_dedup import line_dedup_stage
from arrayloom.llm.near_dedup import near_dedup_stage
from arrayloom.llm.packing import packing_stage
from arrayloom.llm.quality import quality_stage
from arrayloom.llm.secrets import secrets_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("secret_scan", secrets_stage),
    ("packing", packing_stage),
]

#: Repeated runs of lines and tokenizers aren't expressible in SQL. The operators have tests of their own; no test
#: compares the whole pipeline with a brute-force version yet.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are a table in the shared folder."""
    docs = documents(spark, sf_dir)
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
