"""One-dimensional search and clustering beside brute force."""

import itertools

import numpy as np
import pytest

from quillon.operators import onedim


def brute(x, weight, k):
    """The least loss over all ways to cut the sorted values into at most k intervals."""
    best = np.inf
    for m in range(min(k, len(x))):
        for cuts in itertools.combinations(range(1, len(x)), m):
            edges = [0, *cuts, len(x)]
            loss = 0.0
            for i, j in zip(edges, edges[1:]):
                mean = np.average(x[i:j], weights=weight[i:j])
                loss += (weight[i:j] * (x[i:j] - mean) ** 2).sum()
            best = min(best, loss)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_intervals_are_optimal(seed):
    r = np.random.default_rng(seed)
    x = np.unique(r.integers(0, 60, r.integers(1, 12)).astype(float))
    weight = r.integers(1, 6, len(x)).astype(float)
    for k in (1, 2, 3, 4, 20):
        starts = onedim.optimal_starts(x, weight, k)
        assert starts[0] == 0 and (np.diff(starts) > 0).all() and len(starts) <= k
        loss = 0.0
        for i, j in zip(starts, [*starts[1:], len(x)]):
            loss += (weight[i:j] * (x[i:j] - np.average(x[i:j], weights=weight[i:j])) ** 2).sum()
        assert loss == pytest.approx(brute(x, weight, k), abs=1e-9)


def test_clusters_of_a_table(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 1.0, 2.0, 10.0, 11.0, 11.0, None, float("nan")]], "x double")
    rows = [tuple(r) for r in onedim.cluster(df, 2).orderBy("cid").collect()]
    assert [r[:2] for r in rows] == [(0, 3), (1, 3)] and rows[1][3:5] == (10.0, 11.0)
    assert onedim.cluster(df, 9).count() == 4
    assert onedim.cluster(df.where("x > 99"), 2).count() == 0
    with pytest.raises(ValueError):
        onedim.cluster(df, 2, max_values=3)


def test_search_beside_brute_force(spark):
    r = np.random.default_rng(5)
    x = r.integers(0, 40, 300).astype(float)
    q = np.array([-3.0, 0.0, 17.0, 17.5, 39.0, 80.0])
    base = spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(x)] + [(900, None), (901, float("nan"))], "id long, x double").repartition(5)
    asks = spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(q)] + [(99, None)], "qid long, x double")
    got = {(a["qid"], a["rank"]): (a["id"], a["dist"]) for a in onedim.nearest(base, asks, 7).collect()}
    want = {}
    for i, v in enumerate(q):
        for rank, (d, j) in enumerate(sorted((abs(v - y), j) for j, y in enumerate(x))[:7]):
            want[i, rank + 1] = (j, d)
    assert got == want


def test_search_of_few_and_no_rows(spark):
    base = spark.createDataFrame([(1, 2.0), (2, 5.0)], "id long, x double")
    asks = spark.createDataFrame([(7, 4.0)], "qid long, x double")
    assert [(a["rank"], a["id"]) for a in onedim.nearest(base, asks, 5).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert onedim.nearest(base.limit(0), asks, 5).count() == 0
    assert onedim.nearest(base, asks.limit(0), 5).count() == 0
