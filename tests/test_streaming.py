import numpy as np
import pandas as pd
import pytest

from arrayloom import errors
from arrayloom.model import ArrayFrame
from arrayloom.sources import archive
from arrayloom.streaming import incremental


def test_differences_over_micro_batches(spark, tmp_path):
    schema = "run_id string, t int, vox int, value double"
    src = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame([("run-01", 2 * k + j, v, float((2 * k + j) ** 2 + v)) for j in range(2) for v in range(2)], schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = incremental.stream_differences(spark.readStream.schema(schema).parquet(str(src)))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values(["vox", "t"])
    assert got.t.tolist() == [0, 1, 2, 3, 4] * 2 and got.delta.tolist() == [1.0, 3.0, 5.0, 7.0, 9.0] * 2


def test_means_and_append(spark, tmp_path):
    rows = pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 00:10", "2024-01-01 00:50", "2024-01-01 05:00", "2024-01-01 09:00"]), "event_type": "view", "value": [1.0, 3.0, 5.0, 7.0]})
    spark.createDataFrame(rows).withColumnRenamed("event_type", "run_id").write.parquet(str(tmp_path / "in"))
    means = incremental.stream_means(spark.readStream.schema("ts timestamp, run_id string, value double").parquet(str(tmp_path / "in")), keys=("run_id",))
    q = incremental.append_to(means, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("start").toPandas()
    assert got.value.tolist()[:1] == [2.0] and got.n.tolist()[:1] == [2]


@pytest.mark.parametrize(("scope", "method"), [("global", "range"), ("voxel", "sd")])
def test_batches_and_one_batch_give_the_same_archive(spark, tmp_path, scope, method):
    rng = np.random.default_rng(3)
    schema = "run_id string, t int, vox int, value double"
    rows = [(f"run-0{r}", t, v, float(rng.normal() * r + v)) for r in (1, 2) for t in range(12) for v in range(8)]
    src = str(tmp_path / "in")
    for k in range(4):
        spark.createDataFrame(rows[k::4], schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        incremental.collect_batches(stream, str(tmp_path / "staging"), str(tmp_path / "cp"), scope).awaitTermination(120)
    p = {"bits": 10, "scale_scope": scope, "method": method, "allow_clip": True}
    streamed = incremental.commit_batches(spark, str(tmp_path / "staging"), str(tmp_path / "a"), (2, 2, 2), 12, **p)
    whole = archive.write_archive(ArrayFrame(spark.createDataFrame(rows, schema), (2, 2, 2), 12, rank=4), str(tmp_path / "b"), [("quant", p)])
    a, b = ({(r.run_id, r.t, r.vox): r.value for r in archive.stored_values(spark, x).collect()} for x in (streamed, whole))
    assert a == b and len(a) == len(rows)
    keys = ["run_id", "vox"] if scope == "voxel" else ["run_id"]
    a, b = (archive.load_dataset(spark, x, "00_quant/quant_params").toPandas().sort_values(keys).reset_index(drop=True) for x in (streamed, whole))
    assert np.allclose(a.scale, b.scale, rtol=1e-12) and np.allclose(a.offset, b.offset, rtol=1e-12)
    assert {r.write_mode for r in spark.read.parquet(f"{streamed}/catalog").collect()} == {"stream"} != {r.write_mode for r in spark.read.parquet(f"{whole}/catalog").collect()}


def test_a_repeated_batch_counts_once(spark, tmp_path):
    """What a failed batch has left is replaced when it runs again: the checkpoint is lost, batch 0 comes twice."""
    schema = "run_id string, t int, vox int, value double"
    src = str(tmp_path / "in")
    spark.createDataFrame([("run-01", t, 0, float(t)) for t in range(5)], schema).write.parquet(src)
    for k in range(2):
        incremental.collect_batches(spark.readStream.schema(schema).parquet(src), str(tmp_path / "s"), str(tmp_path / f"cp{k}")).awaitTermination(120)
    parts = spark.read.parquet(str(tmp_path / "s" / "statistics"))
    assert parts.count() == 1 and parts.first().n == 5
    with pytest.raises(errors.ValidationError):
        incremental.commit_batches(spark, str(tmp_path / "s"), str(tmp_path / "a"), (1, 1, 1), 5, scale_scope="voxel")
