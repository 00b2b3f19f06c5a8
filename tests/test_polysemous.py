"""Annealed numbers of codewords."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators.pq import ProductQuantizer, annealed

DATA = "/root/testdata/sf0.001/embeddings.parquet"


def cost(distances, number):
    """The objective, written apart from the operator."""
    k = len(distances)
    pairs = list(itertools.permutations(range(k), 2))
    d = np.array([distances[i, j] for i, j in pairs])
    plain = np.array([bin(i ^ j).count("1") for i, j in pairs], float)
    target = (d - d.mean()) / d.std() * plain.std() + plain.mean()
    have = np.array([bin(int(number[i]) ^ int(number[j])).count("1") for i, j in pairs], float)
    return float((0.5**target * (target - have) ** 2).sum())


def spaced(k, seed):
    x = np.random.default_rng(seed).normal(size=(k, 3))
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


@pytest.mark.parametrize("seed", range(4))
def test_four_codewords_get_the_best_numbers(seed):
    d = spaced(4, seed)
    assert cost(d, annealed(d, 4000, seed)) == pytest.approx(min(cost(d, p) for p in itertools.permutations(range(4))))


def test_numbers_are_a_permutation_and_cost_less():
    d = spaced(32, 1)
    number = annealed(d)
    assert sorted(number) == list(range(32)) and cost(d, number) < 0.8 * cost(d, np.arange(32))
    assert (annealed(d) == number).all()


def test_defined_cases():
    assert (annealed(np.zeros((8, 8))) == np.arange(8)).all()  # equal codewords
    assert (annealed(spaced(2, 0)) == np.arange(2)).all() and (annealed(np.zeros((1, 1))) == [0]).all()
    with pytest.raises(ValueError):
        annealed(spaced(6, 0))


def test_codes_stand_for_the_same_vectors_and_the_filter_keeps_more_of_the_near(spark):
    base = spark.read.parquet(DATA).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    asks = base.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    plain = ProductQuantizer.train(base, 8, 16, 3)
    new = plain.polysemous()
    x = np.array([r["vec"] for r in base.limit(50).collect()])
    assert np.allclose(plain.decode_of(plain.codes_of(x)), new.decode_of(new.codes_of(x)))
    whole = {(r["qid"], r["id"]) for r in plain.search(plain.encode(base), asks, 10).collect()}
    kept = [len(whole & {(r["qid"], r["id"]) for r in q.search(q.encode(base), asks, 10, max_hamming=12).collect()}) for q in (plain, new)]
    assert kept[1] > kept[0]
