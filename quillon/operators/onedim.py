"""Exact search and exact clustering of one-dimensional values.

Search sorts each Arrow batch and looks queries up in it, so a batch of n rows costs
(n + queries * k) log n instead of n * queries; k rows a query and task are shuffled.

Clustering is the optimal split of the sorted values into intervals by dynamic
programming.  Spark counts equal values first; only distinct values with their counts
reach the driver, at most MAX_VALUES of them, else it raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.exact import query_blocks
from quillon.operators.topk import top_k, union

#: Distinct values that the driver takes for clustering.
MAX_VALUES = 1 << 20


def _beside(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the k rows from its value upwards and the k below, as (distances, ids); missing rows are infinite."""
    cost, who = np.full((len(q), 2 * k), np.inf), np.zeros((len(q), 2 * k), np.int64)
    step = np.arange(k)
    for side, sign in enumerate((1.0, -1.0)):
        order = np.lexsort((ids, sign * x))  # away from the query; equal values by id
        v = sign * x[order]
        at = np.searchsorted(v, sign * q, "left" if side == 0 else "right")[:, None] + step
        ok = at < len(v)
        at = np.minimum(at, len(v) - 1)
        own = slice(side * k, side * k + k)
        cost[:, own] = np.where(ok, np.abs(v[at] - sign * q[:, None]), np.inf)
        who[:, own] = ids[order][at]
    return cost, who


def nearest(base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, rank, id, dist): the k nearest of base(id, x) for each of queries(qid, x), ties by id.

    Null and NaN values are no neighbours and have none.
    """
    real = F.col("x").isNotNull() & ~F.isnan("x")
    rows = base.withColumn("x", F.col("x").cast("double")).where(real).select(F.col("id").cast("long").alias("id"), "x")
    asked = queries.withColumn("x", F.col("x").cast("double")).where(real).select("qid", F.array("x").alias("qvec"))
    parts = []
    for qids, q in query_blocks(asked):

        def run(batches: Iterator[pa.RecordBatch], qids=qids, q=q[:, 0]) -> Iterator[pa.RecordBatch]:
            cost, who = np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                c, w = _beside(batch.column(1).to_numpy(), batch.column(0).to_numpy(), q, k)
                cost, who = np.concatenate([cost, c], 1), np.concatenate([who, w], 1)
                best = np.lexsort((who, cost), axis=1)[:, :k]
                cost, who = np.take_along_axis(cost, best, 1), np.take_along_axis(who, best, 1)
            i, j = np.nonzero(np.isfinite(cost))
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(qids[i]), pa.array(who[i, j]), pa.array(cost[i, j])], names=["qid", "id", "dist"])

        parts.append(rows.mapInArrow(run, "qid long, id long, dist double"))
    return top_k(union(parts, rows.sparkSession), k).select("qid", "rank", "id", "dist")


def optimal_starts(x: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Where each of at most k intervals of the sorted values x starts, for the least weighted squared deviation.

    The best start of the last interval never moves left as its end moves right, so the
    ends are settled by halves: a pass over all middles of a level costs about n.
    """
    n = len(x)
    y = x - np.average(x, weights=weight)
    w, s, q = (np.concatenate([[0.0], np.cumsum(v)]) for v in (weight, weight * y, weight * y * y))

    def spread(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        t = s[j + 1] - s[i]
        return np.maximum(q[j + 1] - q[i] - t * t / (w[j + 1] - w[i]), 0.0)

    cost = spread(np.zeros(n, int), np.arange(n))
    back = [np.zeros(n, np.int64)]
    for _ in range(1, k):
        before = np.concatenate([[0.0], cost])
        cost, start = np.zeros(n), np.zeros(n, np.int64)
        lo, hi, first, last = (np.array([v]) for v in (0, n - 1, 0, n - 1))
        while len(lo):
            mid = (lo + hi) // 2
            size = np.minimum(mid, last) - first + 1
            head = np.cumsum(size) - size
            i = np.arange(int(size.sum())) - np.repeat(head - first, size)
            total = before[i] + spread(i, np.repeat(mid, size))
            least = np.minimum.reduceat(total, head)
            hit = np.flatnonzero(total == np.repeat(least, size))
            cut = i[hit[np.searchsorted(hit, head)]]
            cost[mid], start[mid] = least, cut
            lo, hi, first, last = (np.concatenate(p) for p in ((lo, mid + 1), (mid - 1, hi), (first, cut), (cut, last)))
            open_ = lo <= hi
            lo, hi, first, last = lo[open_], hi[open_], first[open_], last[open_]
        back.append(start)
    starts, end = [], n - 1
    for start in reversed(back):
        if end < 0:
            break
        starts.append(int(start[end]))
        end = starts[-1] - 1
    return np.array(starts[::-1], np.int64)


def cluster(base: DataFrame, k: int, max_values: int = MAX_VALUES) -> DataFrame:
    """(cid, n, centroid, low, high, loss): the optimal k clusters of base(x), from the lowest.

    Null and NaN values do not count; fewer than k distinct values make as many clusters;
    without any the result is empty.
    """
    spark = base.sparkSession
    rows = base.select(F.col("x").cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    counts = rows.groupBy("x").agg(F.count(F.lit(1)).alias("n")).limit(max_values + 1).toArrow()
    if len(counts) > max_values:
        raise ValueError(f"more than {max_values} distinct values; round them or raise max_values")
    out = "cid int, n long, centroid double, low double, high double, loss double"
    if not len(counts):
        return spark.createDataFrame([], out)
    counts = counts.sort_by("x")
    x, n = counts["x"].to_numpy(), counts["n"].to_numpy()
    starts = optimal_starts(x, n.astype(float), k)
    ends = np.append(starts[1:], len(x))
    made = []
    for c, (i, j) in enumerate(zip(starts, ends)):
        mean = float(np.average(x[i:j], weights=n[i:j]))
        made.append((c, int(n[i:j].sum()), mean, float(x[i]), float(x[j - 1]), float((n[i:j] * (x[i:j] - mean) ** 2).sum())))
    return spark.createDataFrame(made, out)
