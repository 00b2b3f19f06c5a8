"""Hand-computed metrics and vector functions: Column expressions and kernels must agree."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.functions.metrics import METRICS, distance
from quillon.operators import codecs

X, Y = [1.0, 2.0, 3.0], [2.0, 0.0, 3.0]
WANT = {"l2": 5, "ip": 11, "ip1": -10, "l1": 3, "linf": 2, "lp3": 9, "braycurtis": 3 / 11, "canberra": 4 / 3, "jaccard": 4 / 7, "abs_ip": 11}


@pytest.mark.parametrize("name", sorted(WANT))
def test_metric(spark, name):
    row = spark.createDataFrame([(X, Y)], "x array<double>, y array<double>").select(distance(name, "x", "y").alias("d")).first()
    assert row["d"] == pytest.approx(WANT[name])
    assert METRICS[name].kernel(np.array([X]), np.array([Y, X]))[0, 0] == pytest.approx(WANT[name])


@pytest.mark.parametrize("name", sorted(METRICS))
def test_kernels_agree_with_columns(spark, name):
    rng = np.random.default_rng(1)
    a, b = np.abs(rng.normal(size=(6, 5))) / 4, np.abs(rng.normal(size=(6, 5))) / 4
    b[0] = a[0]
    a[1] = 0
    rows = [(x.tolist(), y.tolist()) for x, y in zip(a, b)]
    got = [r[0] for r in spark.createDataFrame(rows, "x array<double>, y array<double>").select(distance(name, "x", "y")).collect()]
    want = [METRICS[name].kernel(x[None], y[None])[0, 0] for x, y in zip(a, b)]
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_missing_values(spark):
    df = spark.createDataFrame([([1.0, math.nan, 3.0], [2.0, 5.0, math.nan])], "x array<double>, y array<double>")
    assert df.select(distance("nan_euclidean", "x", "y")).first()[0] == pytest.approx(3.0)
    assert METRICS["nan_euclidean"].kernel(np.array([[1, np.nan, 3]]), np.array([[2, 5, np.nan]]))[0, 0] == pytest.approx(3.0)
    assert math.isnan(METRICS["gower"].kernel(np.array([[1.0, 0.5]]), np.array([[-1.0, 0.5]]))[0, 0])


def test_bits(spark):
    df = spark.createDataFrame([([0, 1, 0, 1] + [0] * 30, [0, 1, 1, 0] + [0] * 29 + [1])], "a array<int>, b array<int>")
    r = df.select(V.hamming(V.packed(F.col("a"), 34), V.packed(F.col("b"), 34)).alias("h"), V.packed(F.col("b"), 34).alias("w")).first()
    assert r["h"] == 3 and r["w"] == [0b0110, 2]


def test_vector_arithmetic(spark):
    df = spark.createDataFrame([(X,)], "x array<double>")
    r = df.select(V.normalised(F.col("x")), V.remapped(F.col("x"), [2, -1]), V.padded(F.col("x"), 5), V.subspace(F.col("x"), 1, 1), V.plus(F.col("x"), F.col("x"), -2.0), V.normalised(F.array(F.lit(0.0)))).first()
    assert r[0] == pytest.approx([v / math.sqrt(14) for v in X]) and r[1] == [3.0, 0.0] and r[2] == [*X, 0.0, 0.0] and r[3] == [2.0] and r[4] == [-1.0, -2.0, -3.0] and r[5] == [0.0]


def test_scalar_quantizer(spark):
    base = spark.createDataFrame([(0, [0.0, 5.0]), (1, [1.0, 5.0]), (2, [0.5, 5.0])], "id long, vec array<double>")
    q = codecs.ScalarQuantizer.train(base, 8)
    got = {r["id"]: (r["c"], r["d"]) for r in base.select("id", q.encode("vec").alias("c")).withColumn("d", q.decode("c")).collect()}
    assert got[0][0] == [0, 0] and got[1][0] == [255, 0] and got[2][0] == [127, 0]
    assert got[2][1] == pytest.approx([127.5 / 255, 5.0])
    one = base.select(codecs.rowwise_decode(codecs.rowwise_encode("vec")).alias("v")).first()[0]
    assert one == pytest.approx([5 * 0.5 / 255, 5 * 255.5 / 255])
