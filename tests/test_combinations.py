"""Additive codes, combined indexes, stored indexes, SQL functions and the offline job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.functions.sql import register
from quillon.operators import evaluate, exact, graph
from quillon.operators.additive import AdditiveQuantizer
from quillon.operators.ivfpq import IvfPqIndex, PqIvfIndex
from quillon.operators.multi import MultiIndex, TwoLevelCodes, random_search, split_search
from quillon.operators.pq import ProductQuantizer
from quillon.plans import offline
from quillon.sources import indexes

DATA = "/root/testdata/sf0.001/embeddings.parquet"


@pytest.fixture(scope="module")
def base(spark):
    return spark.read.parquet(DATA).where("vec_id >= 50").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec")).cache()


@pytest.fixture(scope="module")
def asks(spark):
    return spark.read.parquet(DATA).where("vec_id < 10").select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("qvec")).cache()


def ids(df):
    return {(r["qid"], r["rank"]): r["id"] for r in df.collect()}


def test_additive_codes_improve(base):
    x = np.array([r["vec"] for r in base.orderBy("id").collect()])
    plain = AdditiveQuantizer.train(base, 4, 16, 2)
    loss = lambda q: float(((x - q.decode_of(q.codes_of(x))) ** 2).sum())
    beam, local = AdditiveQuantizer(plain.books, 8), AdditiveQuantizer(plain.books, 8, 3)
    assert loss(beam) <= loss(plain) and loss(local) <= loss(beam)
    sliced = AdditiveQuantizer.train(base, 2, 16, 2, slices=2)
    assert sliced.books.shape == (4, 16, 64) and loss(sliced) < float((x**2).sum())
    assert sliced.decode(sliced.encode(base)).count() == len(x)


def test_combined_indexes(base, asks):
    truth = exact.knn_join(base, asks, 5)
    assert ids(MultiIndex.build(base, 3, 2).search(asks, 5, 9)) == ids(truth)
    assert ids(split_search(base, asks, 5, [10, 54])) == ids(truth)
    assert random_search(base, asks, 5).count() == 50
    two = TwoLevelCodes.build(base, 4, 8, 16, fine_m=8, iterations=2)
    x = {r["id"]: np.array(r["vec"]) for r in base.collect()}
    loss = lambda refined: sum(float(((x[r["id"]] - np.array(r["vec"])) ** 2).sum()) for r in two.decode(refined).collect())
    assert loss(True) < loss(False)
    assert two.search(asks, 5).count() == 50


def test_stored_indexes(spark, base, asks, tmp_path):
    pq = ProductQuantizer.train(base, 8, 16, 1)
    codes = pq.encode(base)
    indexes.save_pq(f"{tmp_path}/pq", pq, codes)
    again, stored = indexes.load_pq(spark, f"{tmp_path}/pq")
    assert ids(again.search(stored, asks, 5)) == ids(pq.search(codes, asks, 5))
    ivf = IvfPqIndex.build(base, 4, 8, 8, 2, 1)
    indexes.save_ivfpq(f"{tmp_path}/ivfpq", ivf)
    assert ids(indexes.load_ivfpq(spark, f"{tmp_path}/ivfpq", nlist=4).search(asks, 5, 2)) == ids(ivf.search(asks, 5, 2))
    coded = PqIvfIndex.build(base, 4, 8, 16, 1, 2)
    indexes.save_pqivf(f"{tmp_path}/pqivf", coded)
    assert ids(indexes.load_pqivf(spark, f"{tmp_path}/pqivf").search(base, asks, 5, 2, 30)) == ids(coded.search(base, asks, 5, 2, 30))
    g = graph.GraphIndex.build(base, 8, 40, shards=2)
    indexes.save_graph(f"{tmp_path}/graph", g)
    assert ids(indexes.load_graph(spark, f"{tmp_path}/graph").search(asks, 5)) == ids(g.search(asks, 5))
    with pytest.raises(ValueError):
        indexes.load_graph(spark, f"{tmp_path}/graph", m=9)


def test_sql_functions_and_codes(spark):
    assert "vec_l2" in register(spark)
    r = spark.sql("SELECT vec_l2(array(1D, 2D), array(3D, 2D)) a, vec_cosine(array(1D, 0D), array(0D, 2D)) b, vec_cosine(array(0D), array(1D)) c").first()
    assert (r["a"], r["b"], r["c"]) == (4.0, 1.0, None)
    df = spark.createDataFrame([([1, 0, 1] + [0] * 30 + [1],)], "b array<int>")
    assert df.select(V.unpacked(V.packed(F.col("b"), 34), 34)).first()[0] == [1, 0, 1] + [0] * 30 + [1]
    assert df.select(V.differing(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(3)))).first()[0] == 1


def test_offline_job(base, asks):
    twice = base.unionByName(base.where("id < 60").withColumn("id", F.col("id") + 9000))
    r = offline.run(twice, asks, 4, 4, 5, iterations=2)
    assert (r.rows, r.distinct, r.nlist) == (460, 450, 4) and r.consistent and r.recall == 1.0
    assert evaluate.intersection(r.results, exact.knn_join(twice, asks, 5), 5).first()[0] == 1.0
