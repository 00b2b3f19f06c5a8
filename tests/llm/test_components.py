import random

import pytest

from quillon.llm.common import bitmap, in_bitmap
from quillon.llm.components import components


def brute(edges):
    comp = {n: n for e in edges for n in e if e[0] != e[1]}
    while True:
        new = dict(comp)
        for a, b in edges:
            if a != b:
                new[a] = new[b] = min(new[a], new[b])
        if new == comp:
            return comp
        comp = new


@pytest.mark.parametrize("at_once", [0, 1 << 18])
@pytest.mark.parametrize("kind", ["random", "path", "star", "loops", "none"])
def test_components_by_either_way(spark, kind, at_once):
    rng = random.Random(5)
    ids = [rng.randrange(-(2**63), 2**63) for _ in range(30)]
    edges = {
        "random": [(rng.choice(ids), rng.choice(ids)) for _ in range(20)],
        "path": list(zip(ids[:8], ids[1:8])),
        "star": [(ids[0], x) for x in ids] * 2,
        "loops": [(x, x) for x in ids],
        "none": [],
    }[kind]
    got = components(spark.createDataFrame(edges, "a long, b long"), at_once=at_once)
    assert got.dtypes == [("node", "bigint"), ("comp", "bigint")]
    assert sorted((r["node"], r["comp"]) for r in got.collect()) == sorted(brute(edges).items())


def test_few_edges_start_no_rounds(spark, monkeypatch):
    """Each round writes a file a partition to the shared folder; few edges need none."""
    import quillon.llm.components as module

    cuts = []
    monkeypatch.setattr(module, "cut", lambda df: cuts.append(1) or df)
    assert components(spark.createDataFrame([(1, 2), (3, 2)], "a long, b long")).count() == 3 and not cuts


def test_bitmap_comes_as_columns(spark, monkeypatch):
    """Python rows of a full bitmap would take hundreds of MB of the driver."""
    monkeypatch.setattr(type(spark.range(1)), "toPandas", None)
    monkeypatch.setattr(type(spark.range(1)), "collect", None)
    values = spark.range(50_000).selectExpr("xxhash64(id) AS v")
    bits = bitmap(values, "v")
    v = values.toArrow()["v"].to_numpy()
    assert in_bitmap(bits, v).all() and in_bitmap(bits, v + 1).mean() < 0.2
    assert not in_bitmap(bitmap(values.where("v is null"), "v"), v).any()
