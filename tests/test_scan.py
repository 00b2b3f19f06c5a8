"""The exact scan a tile at a time: bounded memory, equal results."""

import numpy as np
import pyarrow as pa

from quillon.functions.metrics import Metric, metric
from quillon.operators import exact


def test_scan_holds_few_distances_at_a_time():
    r = np.random.default_rng(0)
    q, x = r.integers(0, 3, (3000, 4)).astype(float), r.integers(0, 3, (5000, 4)).astype(float)  # many ties
    x[7] = np.nan
    ids, asked = r.permutation(5000).astype(np.int64), []

    def kernel(a, b):
        asked.append(len(a) * len(b))
        return metric("l2").kernel(a, b)

    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "vec"])
    got = pa.Table.from_batches(exact._scan(np.arange(3000), q, Metric("l2", None, kernel), 5)(iter([batch.slice(0, 3), batch.slice(3)])))
    assert max(asked) <= exact.CELLS
    d = metric("l2").kernel(q, x)
    for i in range(0, 3000, 97):
        order = np.lexsort((ids, d[i]))[:5]
        own = got.filter(pa.array(got["qid"].to_numpy() == i))
        assert own["id"].to_pylist() == ids[order].tolist() and np.allclose(own["dist"].to_numpy(), d[i][order])


def test_capped_range_orders_equal_rows_by_id(spark):
    """Every row is at distance 0 to itself, whatever the matrix product rounds to."""
    x = np.random.default_rng(1).normal(size=(400, 64))
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    asks = base.selectExpr("id as qid", "vec as qvec")
    got = exact.capped_range(base, asks, 1e-3, 300).collect()
    assert [(r["qid"], r["id"], r["dist"]) for r in got] == [(i, i, 0.0) for i in range(300)]
    exactly = float(sum((a - b) * (a - b) for a, b in zip(x[0], x[1])))  # from left to right
    assert [r["dist"] for r in exact.range_join(base.where("id = 1"), asks.where("qid = 0"), exactly, inclusive=True).collect()] == [exactly]
    assert exact.range_join(base.where("id = 1"), asks.where("qid = 0"), exactly).count() == 0


def test_code_sums_are_not_rounded_before_they_are_compared(spark):
    """Rounding to 9 digits first would show 0.123457 for 0.1234564997, and take the lower id of two sums that differ in the tenth digit."""
    from quillon.operators.pq import ProductQuantizer

    pq = ProductQuantizer(np.sqrt(np.array([[[0.1234564997], [0.1234564996]]])))
    codes = spark.createDataFrame([(1, bytearray([0])), (2, bytearray([1])), (3, bytearray([1]))], "id long, code binary")
    asks = spark.createDataFrame([(0, [0.0])], "qid long, qvec array<double>")
    for most in (None, 9):
        got = pq.search(codes, asks, 3, max_hamming=most).orderBy("rank").collect()
        assert [r["id"] for r in got] == [2, 3, 1]
        assert [round(r["dist"], 6) for r in got] == [0.123456] * 3
