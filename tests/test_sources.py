import numpy as np
import pytest

from quillon.sources.vecfiles import read_bin, read_vecs, to_binary16, write_bin, write_vecs
from quillon.streaming.ingest import answer, ingest


@pytest.mark.parametrize("kind,column", [("f", "array<float>"), ("i", "array<int>"), ("b", "array<smallint>")])
def test_round_trips(spark, tmp_path, kind, column):
    rows = [(i, [i % 7, i % 5, 3]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, vec array<int>").selectExpr("id", f"cast(vec as {column}) as vec").repartition(3)
    path = str(tmp_path / "x")
    assert write_vecs(df, path + ".vecs", kind) == 50
    assert [(r["id"], list(r["vec"])) for r in read_vecs(spark, path + ".vecs", kind).orderBy("id").collect()] == rows
    assert write_bin(df, path + ".bin", kind) == 50
    assert [(r["id"], list(r["vec"])) for r in read_bin(spark, path + ".bin", kind, 7).orderBy("id").collect()] == rows


def test_damaged_file(spark, tmp_path):
    p = tmp_path / "bad.fbin"
    p.write_bytes(np.array([2, 3], "<i4").tobytes() + b"\0" * 20)
    with pytest.raises(Exception, match="header"):
        read_bin(spark, str(p)).collect()


def test_half_precision(spark):
    df = spark.createDataFrame([([1.0, 0.5],)], "v array<double>")
    assert np.frombuffer(df.select(to_binary16("v")).first()[0], "<f2").tolist() == [1.0, 0.5]
    assert np.frombuffer(df.select(to_binary16("v", "bf16")).first()[0], "<u2").tolist() == [0x3F80, 0x3F00]


def test_streams(spark, tmp_path):
    rows = [(i, [float(i % 3), 1.0]) for i in range(30)]
    spark.createDataFrame(rows, "id long, vec array<double>").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, vec array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest(stream, np.array([[0.0, 1.0], [2.0, 1.0]]), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 30 and got.select("batch").distinct().count() == 3
    assert {r["cid"] for r in got.where("vec[0] = 2").collect()} == {1}
    spark.createDataFrame([(0, [2.0, 1.0])], "qid long, qvec array<double>").write.parquet(str(tmp_path / "q"))
    queries = spark.readStream.schema("qid long, qvec array<double>").parquet(str(tmp_path / "q"))
    answer(queries, got.select("id", "vec"), 2, str(tmp_path / "a"), str(tmp_path / "ck2")).awaitTermination()
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "a")).orderBy("rank").collect()] == [2, 5]
