"""Coded inverted files, preassigned lists, searches without queries or rows, stored indexes, the Pareto front."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import evaluate, exact, graph
from quillon.operators.cluster import list_sizes
from quillon.operators.factory import code_size, index_factory
from quillon.operators.ivf import IvfIndex, load_or_build
from quillon.operators.ivfcodes import TRAIN, CodedIvf, DirectCodec, HalfCodec, OneBitCodec, ScalarCodec, SignCodec, SpectralCodec, binary_ivf
from quillon.operators.ivfpq import IvfPqIndex
from quillon.operators.pq import ProductQuantizer

D = 16


@pytest.fixture(scope="module")
def base(spark):
    x = np.random.default_rng(1).normal(size=(300, D))
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>").repartition(3).cache()


@pytest.fixture(scope="module")
def asks(base):
    return base.where("id % 30 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec")).cache()


def recall(found, base, asks, k=10):
    return evaluate.recall_at_k(found, exact.knn_join(base, asks, k), k).agg(F.avg("recall")).first()[0]


def test_codecs_pack_and_unpack():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (50, 13))
    for bits, size in ((8, 13), (6, 10), (4, 7)):
        c = ScalarCodec([-1.0] * 13, [2.0] * 13, bits)
        codes = c.encode(x)
        assert codes.shape == (50, size) == (50, c.size(13)) and codes.dtype == np.uint8
        assert np.abs(c.decode(codes) - x).max() <= 1.0 / ((1 << bits) - 1) + 1e-9
    assert np.array_equal(HalfCodec().decode(HalfCodec().encode(x)), x.astype("<f2").astype(float))
    assert np.abs(HalfCodec(True).decode(HalfCodec(True).encode(x)) / x - 1).max() < 2**-8
    whole = rng.integers(0, 256, (20, 5)).astype(float)
    assert np.array_equal(DirectCodec().decode(DirectCodec().encode(whole)), whole)
    assert np.array_equal(DirectCodec(True).decode(DirectCodec(True).encode(whole - 128)), whole - 128)
    s = SignCodec([0.0] * 13)
    assert np.array_equal(s.scores(x[:3], s.encode(x)), ((x[:3, None] >= 0) != (x[None] >= 0)).sum(2))
    p = SpectralCodec([0.0] * 13, 0.5)
    parity = np.floor(x * 4).astype(int) % 2
    assert np.array_equal(p.scores(x[:3], p.encode(x)), (parity[:3, None] != parity[None]).sum(2))
    o = OneBitCodec([0.1] * 13)
    codes, r, y = o.encode(x), x - 0.1, x[:4] - 0.1
    dp = (r * r).sum(1) * np.sqrt(13) / np.abs(r).sum(1)
    want = (r * r).sum(1)[None] + (y * y).sum(1)[:, None] - 2 * y @ (np.where(r > 0, 1, -1) * (dp / np.sqrt(13))[:, None]).T
    assert np.allclose(o.scores(x[:4], codes), want, atol=1e-4)


@pytest.mark.parametrize("codec,floor", [("SQ8", 0.95), ("SQ6", 0.9), ("SQ4", 0.7), ("SQfp16", 0.99), ("SQbf16", 0.9), ("RaBitQ", 0.3)])
def test_coded_lists(base, asks, codec, floor):
    for by_residual in (True, False):
        index = CodedIvf.build(base, 8, codec, 3, by_residual)
        assert recall(index.search(asks, 10, 8), base, asks) >= floor
        assert index.lists.select(F.length("code")).distinct().count() == 1
    assert code_size(f"IVF8,{codec}", D) == index.lists.select(F.length("code")).first()[0]
    near = index.reconstruct().join(base.withColumnRenamed("vec", "own"), "id").select(F.sqrt(F.aggregate(F.zip_with("vec", "own", lambda a, b: (a - b) ** 2), F.lit(0.0), lambda s, x: s + x)).alias("e"))
    assert near.agg(F.avg("e")).first()[0] < 3.0


def test_factory_and_store(spark, base, asks, tmp_path):
    assert set(TRAIN) >= {"SQ8", "SQfp16", "RaBitQ"}
    found = index_factory("IVF8,SQ8,RFlat").build(base, iterations=2).search(asks, 10, nprobe=8)
    assert recall(found, base, asks) == 1.0
    assert index_factory("BIVF8").build(base, iterations=2).search(asks, 5, nprobe=8).count() == 50
    index = CodedIvf.build(base, 8, "SQ6", 2)
    index.save(str(tmp_path / "i"))
    again = CodedIvf.load(spark, str(tmp_path / "i"), nlist=8)
    assert sorted(map(tuple, again.search(asks, 5, 4).collect())) == sorted(map(tuple, index.search(asks, 5, 4).collect()))
    with pytest.raises(ValueError):
        CodedIvf.load(spark, str(tmp_path / "i"), nlist=9)


def test_preassigned_lists(base, asks):
    index = IvfIndex.build(base, 8, 3)
    probes = index.probes(asks, 3).select("qid", "cid")
    rows = lambda df: sorted((r["qid"], r["id"], round(r["dist"], 9)) for r in df.collect())
    assert rows(index.search(asks, 5, 0, assigned=probes)) == rows(index.search(asks, 5, 3))
    assert rows(index.range_search(asks, 20.0, 0, assigned=probes)) == rows(index.range_search(asks, 20.0, 3))
    assert rows(index.search(asks, 5, 0, assigned=probes.limit(0))) == []
    coded = CodedIvf(index.centroids, CodedIvf.build(base, 8, "SQ8", centroids=index.centroids).lists, CodedIvf.build(base, 8, "SQ8", centroids=index.centroids).codec, True)
    assert rows(coded.search(asks, 5, 0, assigned=probes)) == rows(coded.search(asks, 5, 3))


def test_binary_lists(base, asks):
    index = binary_ivf(base, 8, 3)
    bits = asks.withColumn("qvec", F.transform("qvec", lambda x: (x >= 0).cast("double")))
    got = {(r["qid"], r["rank"]): r["dist"] for r in index.search(bits, 3, 8).collect()}
    x = {r["id"]: np.array(r["vec"]) >= 0 for r in base.collect()}
    for q in (0, 30, 270):
        want = sorted((int((x[q] != y).sum()), i) for i, y in x.items())[:3]
        assert [got[q, r] for r in (1, 2, 3)] == [w for w, _ in want]
    assert list_sizes(index.lists, 8).agg(F.sum("n")).first()[0] == 300


def test_searches_without_queries_and_with_few_rows(spark, base, asks):
    none = asks.limit(0)
    q = ProductQuantizer.train(base, 4, 4, 1)
    codes = q.encode(base)
    searches = {
        "knn": lambda a: exact.knn_join(base, a, 5),
        "range": lambda a: exact.range_join(base, a, 5.0),
        "multi": lambda a: exact.multi_vector_search(base.withColumn("doc", F.col("id") % 7), a, 3),
        "pq": lambda a: q.search(codes, a, 5),
        "ivf": lambda a: IvfIndex.build(base, 4, 1).search(a, 5, 2),
        "ivfpq": lambda a: IvfPqIndex.build(base, 4, 4, 4, 1, 1, per_list=False).search(a, 5, 2),
        "coded": lambda a: CodedIvf.build(base, 4, "SQ8", 1).search(a, 5, 2),
        "graph": lambda a: graph.GraphIndex.build(base, 4, 10, shards=1).search(a, 5, 10),
        "navigating": lambda a: graph.navigating_search(base, a, 5, 4, 10, 10, shards=1),
    }
    for name, search in searches.items():
        out = search(none)
        assert out.count() == 0 and "dist" in out.columns, name
    few = base.where("id < 3")
    assert exact.knn_join(few, asks, 5).count() == 30
    assert exact.knn_join(base.limit(0), asks, 5).count() == 0
    assert IvfIndex.build(few, 2, 1).search(asks, 5, 2).count() == 30


def test_load_or_build_keeps_what_it_cannot_read(spark, base, tmp_path):
    path = str(tmp_path / "ivf")
    assert load_or_build(spark, path, base, 4, 1).nlist == 4
    before = sorted(p.name for p in (tmp_path / "ivf" / "lists").rglob("*.parquet"))
    load_or_build(spark, path, base, 4, 1)
    assert sorted(p.name for p in (tmp_path / "ivf" / "lists").rglob("*.parquet")) == before  # loaded
    assert load_or_build(spark, path, base.where("id < 200"), 4, 1).lists.count() == 200  # other rows: built anew
    assert load_or_build(spark, path, base, 5, 1).nlist == 5
    for f in (tmp_path / "ivf" / "centroids").glob("*.parquet"):
        f.write_bytes(b"broken")
    left = sorted(p.name for p in (tmp_path / "ivf" / "lists").rglob("*.parquet"))
    with pytest.raises(Exception):  # noqa: B017
        load_or_build(spark, path, base, 5, 1)
    assert sorted(p.name for p in (tmp_path / "ivf" / "lists").rglob("*.parquet")) == left


def test_pareto(spark):
    rng = random.Random(4)
    points = [(rng.randint(0, 60), float(rng.randint(0, 80))) for _ in range(400)]
    got = {(r["perf"], r["cost"]) for r in evaluate.pareto(spark.createDataFrame(points, "perf int, cost double").repartition(5)).collect()}
    assert got == {(p, c) for p, c in points if not any(d <= c and q >= p and (q, d) != (p, c) for q, d in points)}
    assert evaluate.pareto(spark.createDataFrame([], "perf int, cost double")).collect() == []


def test_registered_indexes_find_nine_of_ten(spark):
    from quillon.plans.queries import index_recalls

    got = {r["name"]: r["recall"] for r in index_recalls(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) > 10 and all(r >= 0.9 for r in got.values()), got
