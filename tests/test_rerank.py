"""Re-ranking in place against brute force, graphs built by comparing, lists of pairs read in place."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions.metrics import l2_pairs, l2_table, metric
from quillon.operators import graph, pq, rerank
from quillon.operators.topk import top_k

DATA = "/root/testdata/sf0.001/embeddings.parquet"


@pytest.mark.parametrize("keep", [4, 37, 90, 500])
def test_in_place_equals_brute_force(spark, monkeypatch, keep):
    monkeypatch.setattr(rerank, "BLOCK_QUERIES", 3)  # several blocks
    rng = random.Random(keep)
    vec = lambda d: [float(rng.randint(0, 3)) / 7 for _ in range(d)]  # noqa: E731  many ties
    rows = [(i * 3, vec(5), vec(2)) for i in range(200)]
    asks = [(i, vec(5), vec(2)) for i in (-5, 0, 7, 9, 11)]
    table = spark.createDataFrame(rows, "id long, vec array<double>, coded array<double>").repartition(5)
    q = spark.createDataFrame(asks, "qid long, qvec array<double>, cvec array<double>")

    def scores(c):  # rows whose first coded number is the query's are not asked
        kernel = metric("l1").kernel

        def cost(batch):
            x = np.array(batch["coded"].to_pylist())
            return np.where(c[:, :1] == x[:, 0][None], np.nan, kernel(c, x))

        return cost

    got = rerank.knn_reranked(table, scores, keep, q.select("qid", "qvec"), 4, q.select("qid", F.col("cvec").alias("qvec")))
    want = []
    for qid, v, c in asks:
        near = sorted((float(np.abs(np.array(c) - np.array(y)).sum()), i, x) for i, x, y in rows if y[0] != c[0])[:keep]
        best = sorted((float(l2_pairs(np.array([v]), np.array([x]))[0]), i) for _, i, x in near)[:4]
        want += [(qid, r + 1, i, d) for r, (d, i) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert rerank.knn_reranked(table.limit(0), scores, keep, q.select("qid", "qvec"), 4).collect() == [] == rerank.knn_reranked(table, scores, keep, q.limit(0).select("qid", "qvec"), 4).collect()


def test_registered_searches_find_the_same_without_listing_candidates(spark, monkeypatch):
    from quillon.operators import additive, factory, ivfpq, multi
    from quillon.plans.queries import QUERIES

    names = ("pq_reranked", "ivfpq_per_list", "pqivf", "local_search_quantizer", "two_level_codes", "factory_opq_ivfpq", "factory_pca_sq8", "factory_itq_lsh")
    found = lambda: {n: sorted(map(tuple, QUERIES[n](spark, "/root/testdata/sf0.001").collect())) for n in names}
    listed, calls = found(), []
    real = rerank.knn_reranked
    for module in (additive, factory, ivfpq, multi, pq):
        monkeypatch.setattr(module, "LISTED", 0)
        monkeypatch.setattr(module, "knn_reranked", lambda *a, **b: calls.append(1) or real(*a, **b))
    assert found() == listed and len(calls) == len(names)


def test_graph_is_built_with_few_kernel_calls_and_finds_the_nearest():
    rng = np.random.default_rng(2)
    x, calls = rng.normal(size=(900, 16)), []
    plain = metric("l2").kernel
    g = graph.SmallWorld(x, graph.node_levels(np.arange(900), 8), 8, lambda a, b: calls.append(1) or plain(a, b))
    g.fill(40)
    assert len(calls) < 4 * 900
    assert all(len(own) == len(set(own)) <= (8 if lev else 16) and n not in own for lev, links in enumerate(g.links) for n, own in links.items())
    assert all(set(links) == set(np.flatnonzero(g.levels >= lev).tolist()) for lev, links in enumerate(g.links))
    true = np.argsort(plain(x[::9], x), axis=1)[:, :10]
    assert np.mean([len({n for _, n in g.search(v, 10, 60)} & set(t.tolist())) for v, t in zip(x[::9], true)]) >= 9.5
    same = graph.SmallWorld(np.ones((300, 2)), np.zeros(300, int), 4, plain)  # copies only
    same.fill(10)
    assert len(same.search(np.ones(2), 10, 20)) == 10
    none = graph.SmallWorld(np.zeros((0, 2)), np.zeros(0, int), 4, plain)
    none.fill(10)
    assert none.search(np.ones(2), 3, 5) == []


def test_pairs_of_lists_are_read_in_place(spark):
    from quillon.operators.multi import MultiIndex

    base = spark.read.parquet(DATA).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    asks = base.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    index = MultiIndex.build(base, 4, 2)
    got = index.search(asks, 10, 7)
    pairs = index.probes(asks, 7).join(asks, "qid").join(index.lists, "cid")
    want = top_k(pairs.select("qid", "id", metric("l2").column(F.col("qvec"), F.col("vec")).alias("dist")), 10).select("qid", "rank", "id", "dist")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    x = np.random.default_rng(0).normal(size=(7, 5))
    assert (l2_table(x[:3], x) == [l2_pairs(np.repeat(v[None], 7, 0), x) for v in x[:3]]).all()
