import random

import numpy as np
from pyspark.sql import functions as F

from quillon.functions.metrics import metric
from quillon.operators import exact
from quillon.operators.topk import top_k


def joined(candidates, base, queries, k):
    m = metric("l2")
    both = candidates.select("qid", "id").distinct().join(base, "id").join(queries, "qid")
    return top_k(both.select("qid", "id", m.column(F.col("qvec"), F.col("vec")).alias("dist")), k).select("qid", "rank", "id", "dist")


def test_among_shuffles_pairs_without_vectors_and_equals_the_join(spark, monkeypatch):
    monkeypatch.setattr(exact, "CELLS", 400)  # several blocks
    rng = random.Random(3)
    vec = lambda: [float(rng.randint(0, 3)) / 7 for _ in range(6)]  # noqa: E731  many ties
    rows = [(i * 3, vec()) for i in range(90)] + [(3, vec())]
    base = spark.createDataFrame(rows, "id long, vec array<double>")
    queries = spark.createDataFrame([(-5, vec()), (0, vec()), (7, vec()), (9, vec())], "qid long, qvec array<double>")
    pairs = [(rng.choice([-5, 0, 7, 8]), rng.randrange(300)) for _ in range(500)] + [(0, 3)] * 3
    candidates = spark.createDataFrame(pairs, "qid long, id long")
    got = exact.knn_among(candidates, base, queries, 12)
    want = joined(candidates, base, queries, 12)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Join" not in got._jdf.queryExecution().toString()
    empty = candidates.limit(0)
    assert exact.knn_among(empty, base, queries, 3).collect() == [] == exact.knn_among(candidates, base.limit(0), queries, 3).collect() == exact.knn_among(candidates, base, queries.limit(0), 3).collect()


def test_navigating_takes_the_same_nearest():
    from quillon.operators.graph import navigating

    rng = np.random.default_rng(1)
    x, ids = rng.integers(0, 3, (60, 3)).astype(float), np.arange(60) * 7
    kernel = metric("l2").kernel
    g, _ = navigating(x, ids, 60, 9, kernel)
    g.heuristic = False
    for i in range(60):
        row = kernel(x[i][None], x)[0]
        near = [int(j) for j in np.lexsort((ids, row))[:10] if j != i][:9]
        assert g.links[0][i][:1] == near[:1]


def test_a_stated_number_of_shards_does_not_make_them_larger(spark, monkeypatch):
    from quillon.operators import graph

    monkeypatch.setattr(graph, "SHARD_ROWS", 10)
    base = spark.range(45).selectExpr("id", "array(cast(id AS double), 1D) AS vec")
    built = graph.GraphIndex.build(base, 4, 8, shards=2).rows
    assert built.select("shard").distinct().count() == 5
    assert graph.shard_count(base, 7) == 7
