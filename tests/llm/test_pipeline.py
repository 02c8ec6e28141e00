import corpus_pipeline
from pyspark.sql import functions as F
from tests_llm_tools import prose


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in names}
    assert set(entry.oracle_sql()) <= set(names)


def test_stages_hold_together(spark, tmp_path):
    """Each stage against its own definition on the smallest tables; the last gives every kept document's tokens."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if name != "packing":
            assert out.columns == columns
            assert out.count() <= before and out.where(F.char_length("text") != F.col("n_chars")).count() == 0
            before = out.count()
        else:
            assert out.select("doc_id").distinct().count() == docs.count()
        docs = out


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").agg(F.sum("length")).first()[0] > 0


def test_run_without_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_named_like_the_stages_own(make, spark):
    """Columns come back as they went in, whatever they are called."""
    names = ["_s", "_t", "_q", "_key", "_cut", "text_key", "is_cut", "verdict_", "found_spans", "new_text", "Text_Key", "removed", "b", "a"]
    text, other = ("\n".join(f"{prose(seed + k, 14, 5000).capitalize()}." for k in range(9)) for seed in (300, 400))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = make([(1, text), (2, other)])
        for c in names:
            if c.lower() not in {x.lower() for x in docs.columns}:
                docs = docs.withColumn(c, F.lit(f"own {c}"))
        got = stage(spark, docs, "")
        assert got.columns == docs.columns, name
        assert got.count() == 2, name
        for r in got.collect():
            assert all(r[c] == f"own {c}" for c in docs.columns if c.startswith("_") or c in ("is_cut", "verdict_", "new_text")), name
