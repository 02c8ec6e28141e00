"""The queries that have SQL, against it, over the smallest tables."""

import duckdb
import pytest

from arrayloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_and_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    sql, query = con.sql(registry.ORACLES[name]), registry.QUERIES[name](spark, SF)
    columns = sorted(sql.columns)
    assert sorted(query.columns) == columns
    want = sql.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall()
    got = [tuple(r) for r in query.select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_contracts(spark):
    """Columns that the queries without SQL promise, one row a document (packing: a row a piece)."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    promised = {
        "op2_kneser_ney": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
        "op4_line_dedup": {"doc_id": "bigint", "n_removed": "bigint", "text": "string"},
        "op5_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op8_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    }
    for name, columns in promised.items():
        df = registry.QUERIES[name](spark, SF)
        assert {k: v for k, v in df.dtypes if k in columns} == columns
        assert df.count() == docs
    pieces = registry.QUERIES["op6_packing"](spark, SF)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(pieces.columns)
    lm = registry.QUERIES["op2_kneser_ney"](spark, SF).where("held_out").toPandas()
    assert lm.score.sum() > lm.base_score.sum()
