"""Invariants of exact and indexed search, clustering, mutation, evaluation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import cluster, evaluate, exact, graph, mutate, transforms
from quillon.operators.factory import code_size, index_factory
from quillon.operators.ivf import IvfIndex, load_or_build
from quillon.operators.ivfpq import IvfPqIndex
from quillon.operators.pq import ProductQuantizer

DATA = "/root/testdata/sf0.001/embeddings.parquet"


@pytest.fixture(scope="module")
def base(spark):
    return spark.read.parquet(DATA).where("vec_id >= 50").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label").cache()


@pytest.fixture(scope="module")
def asks(spark):
    return spark.read.parquet(DATA).where("vec_id < 20").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")).cache()


def ids(df):
    return {(r["qid"], r["rank"]): r["id"] for r in df.collect()}


@pytest.fixture(scope="module")
def truth(base, asks):
    return exact.knn_join(base, asks, 10).cache()


def test_flat_against_numpy(base, asks, truth):
    b = {r["id"]: np.array(r["vec"]) for r in base.collect()}
    for q in asks.collect():
        d = sorted((float(((v - np.array(q["qvec"])) ** 2).sum()), i) for i, v in b.items())[:10]
        assert [i for _, i in d] == [ids(truth)[q["qid"], k] for k in range(1, 11)]


def test_query_blocks_and_ties(spark, base, asks, truth):
    assert ids(exact.knn_join(base, asks, 10, block_bytes=3 * 64 * 8)) == ids(truth)
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in (7, 3, 9, 1)], "id long, vec array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, qvec array<double>")
    assert [r["id"] for r in exact.knn_join(same, q, 2).orderBy("rank").collect()] == [1, 3]
    assert exact.knn_join(same.where("id < 5"), q, 5).count() == 2
    assert exact.knn_join(same.where("id < 0"), q, 5).count() == 0
    assert exact.knn_join(same, q.where("qid > 0"), 5).count() == 0


def test_range_is_strict_and_filters(spark):
    b = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [2.0])], "id long, vec array<double>")
    q = spark.createDataFrame([(0, [0.0])], "qid long, qvec array<double>")
    assert {r["id"] for r in exact.range_join(b, q, 1.0).collect()} == {1}
    assert {r["id"] for r in exact.epsilon_search(b, q, 1.0, 5).collect()} == {1, 2}
    assert [r["id"] for r in exact.knn_join(b, q, 2, where=F.col("id") != 1).orderBy("rank").collect()] == [2, 3]
    with pytest.raises(ValueError):
        exact.refine(exact.knn_join(b, q, 1), b, q, 1, 0.5)


def test_exhaustive_limits_equal_flat(base, asks, truth):
    index = IvfIndex.build(base, 8, 3)
    assert ids(index.search(asks, 10, 8)) == ids(truth)
    pq = ProductQuantizer.train(base, 8, 16, 2)
    assert ids(pq.search_reranked(pq.encode(base), base, asks, 10, 500)) == ids(truth)
    coded = IvfPqIndex.build(base, 8, 8, 8, 2, 2)
    assert ids(coded.search(asks, 10, 8, 500, base)) == ids(truth)


def test_recall_grows_with_probes(base, asks, truth):
    index = IvfIndex.build(base, 8, 3)
    got = [evaluate.recall_at_k(index.search(asks, 10, p), truth, 10).agg(F.avg("recall")).first()[0] for p in (1, 2, 4, 8)]
    assert got == sorted(got) and got[-1] == 1.0


def test_graph(base, asks, truth):
    g = graph.GraphIndex.build(base, 16, 200, shards=2)
    found = g.search(asks, 10, 100)
    assert evaluate.recall_at_k(found, truth, 10).agg(F.avg("recall")).first()[0] >= 0.95
    bad = g.check().first()
    assert (bad["self_links"], bad["repeated"], bad["too_many"], bad["unknown"]) == (0, 0, 0, 0)
    odd = g.search(asks, 10, 100, where=F.col("id") % 2 == 1)
    assert all(r["id"] % 2 == 1 for r in odd.collect()) and odd.count() == 200


def test_navigating_graph(base, asks, truth):
    found = graph.navigating_search(base, asks, 10, 16, 60, 80, shards=2)
    assert evaluate.recall_at_k(found, truth, 10).agg(F.avg("recall")).first()[0] >= 0.95


def test_kmeans_runs(base):
    c, loss = cluster.kmeans(base, 8, 5, redo=2, per_centroid=40)
    assert c.shape == (8, 64) and loss[-1] <= loss[0]
    assert (cluster.kmeans(base, 4, 2, whole_numbers=True)[0] % 1 == 0).all()
    with pytest.raises(ValueError):
        cluster.kmeans(base, 1000)


def test_nn_descent_recall(base):
    true, got = graph.knn_graph(base, 5), graph.nn_descent(base, 5, rounds=3)
    n = got.select("id", "nbr").join(true.select("id", "nbr"), ["id", "nbr"]).count()
    assert n / true.count() >= 0.8


def test_empty_clusters(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], "id long, vec array<double>")
    for policy in cluster.EMPTY_POLICIES:
        c, _ = cluster.lloyd(same, cluster.seeds(same, 2), 3, empty=policy)
        assert not np.isnan(c).any()
    c, _ = cluster.lloyd(same, cluster.seeds(same, 2), 3)
    assert c.tolist() == [[1.0, 2.0], [1.0, 2.0]]
    assert [r["n"] for r in cluster.list_sizes(cluster.assign(same, c), 2).orderBy("cid").collect()] == [3, 0]
    with pytest.raises(ValueError):
        cluster.lloyd(same, c, empty="other")


def test_modes_tie_goes_to_lowest(spark):
    codes = spark.createDataFrame([(0, [c]) for c in (1, 1, 0, 0)], "cid int, code array<int>")
    assert cluster.modes(codes).first()["code"] == 0


def test_clustering_variants(base):
    assert cluster.two_level(base, 2, 3, 2).shape == (6, 64)
    assert cluster.progressive(base, 4, [8, 64], 2).shape == (4, 64)
    _, loss = cluster.lloyd(base, cluster.seeds(base, 8), 5)
    assert loss == sorted(loss, reverse=True)


def test_save_and_load(spark, base, asks, tmp_path):
    path = str(tmp_path / "ivf")
    index = load_or_build(spark, path, base, 8, 2)
    again = IvfIndex.load(spark, path, nlist=8)
    assert ids(again.search(asks, 5, 3)) == ids(index.search(asks, 5, 3))
    with pytest.raises(ValueError):
        IvfIndex.load(spark, path, nlist=9)
    plan = again.lists.where("cid = 1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cid" in plan


def test_factory(base, asks, truth):
    for text, least in (("Flat", 1.0), ("L2norm,Flat", 1.0), ("RR64,Flat", 1.0), ("PCA64,Flat", 0.99), ("Pad70,IVF8,Flat", 0.99), ("SQ8", 0.9), ("SQ4,RFlat", 0.9), ("PQ8x4,RFlat", 0.3), ("RaBitQ,RFlat", 0.3), ("LSH64t,RFlat", 0.3)):
        got = index_factory(text).build(base, iterations=2).search(asks, 10, nprobe=8)
        assert evaluate.recall_at_k(got, truth, 10).agg(F.avg("recall")).first()[0] >= least, text
    assert code_size("IVF8,PQ16", 64) == 16 and code_size("Flat", 64) == 256 and code_size("SQ4", 64) == 32
    with pytest.raises(ValueError):
        index_factory("Unknown12")


def test_transforms(base):
    r = transforms.random_rotation(64)
    np.testing.assert_allclose(r.a @ r.a.T, np.eye(64), atol=1e-9)
    x = np.random.default_rng(0).normal(size=(3, 64))
    np.testing.assert_allclose((x @ r.a.T + r.b) @ r.reverse().a.T + r.reverse().b, x, atol=1e-9)
    white = transforms.moments(transforms.pca(base, 8, -0.5).apply(base.select("id", "vec")))
    np.testing.assert_allclose(white[2], np.eye(8), atol=1e-6)
    assert [b.shape for b in transforms.residual_codebooks(base, 2, 4, 2)] == [(4, 64), (4, 64)]


def test_mutation(spark, base):
    b = base.select("id", "vec")
    new = spark.createDataFrame([(50, [0.0] * 64), (9999, [1.0] * 64)], "id long, vec array<float>")
    assert mutate.upsert(b, new).count() == b.count() + 1
    assert mutate.update_vectors(b, new).where("id = 50").first()["vec"] == [0.0] * 64
    marks = spark.createDataFrame([(60,)], "id long")
    with pytest.raises(ValueError):
        mutate.mark_deleted(marks, marks, b)
    with pytest.raises(ValueError):
        mutate.reconstruct(b, spark.createDataFrame([(-1,)], "id long"))
    assert mutate.unmark_deleted(marks, marks).count() == 0
    shard = spark.range(10).select(mutate.shard_of(10, 3, F.col("id")).alias("s")).groupBy("s").count().orderBy("s").collect()
    assert [r["count"] for r in shard] == [3, 3, 4]


def test_evaluation(spark):
    found = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3)], "qid long, rank int, id long")
    truth = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 3, 4), (1, 1, 5)], "qid long, rank int, id long")
    got = {r["qid"]: r["recall"] for r in evaluate.recall_at_k(found, truth, 3).collect()}
    assert got == {0: pytest.approx(2 / 3), 1: 0.0}
    empty, some = found.where("qid < 0"), found.where("qid = 0")
    q = spark.createDataFrame([(0,)], "qid long")
    row = lambda a, b: tuple(evaluate.range_precision_recall(a, b, q).select("precision", "recall").first())
    assert row(empty, empty) == (1.0, 1.0) and row(some, empty) == (0.0, 0.0) and row(empty, some) == (1.0, 0.0) and row(some, some) == (1.0, 1.0)
