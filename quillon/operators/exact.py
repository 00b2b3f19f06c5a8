"""Exact search: nearest-neighbour, range and threshold joins of a stated query set against all rows.

The base table is scanned once a block of queries, in its own partitioning and without a
shuffle: each task multiplies its Arrow batches with the queries' matrix, keeps a running
top-k per query, and only those k rows a query and task are shuffled for the final top-k.
Queries are the small side; they are taken to the driver in blocks of at most QUERY_BYTES,
so the bytes sent to the executors are bounded whatever the number of queries.  A task has
at most CELLS distances at a time; with several blocks, each one's result is cut before the
next is collected, so that driver and tasks hold one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.metrics import Metric, l2_error, metric
from quillon.operators.topk import top_k, union
from quillon.storage import cut

QUERY_BYTES = 32 << 20
#: A task compares this many rows at a time, with so many queries that there are at most CELLS distances (32 MB).
ROWS, CELLS = 4096, 1 << 22


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def query_blocks(queries: DataFrame, qid: str = "qid", vec: str = "qvec", block_bytes: int = QUERY_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The query set in blocks of (ids, matrix), ordered by id; each block is collected by itself."""
    n, d = queries.agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
    blocks = max(1, -(-(n * (d or 1) * 8) // block_bytes))
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(qid), F.lit(blocks)) == b)
        got = part.select(qid, F.col(vec).cast("array<double>").alias(vec)).toArrow().sort_by(qid)
        if len(got):
            yield got[qid].to_numpy(), matrix(got[vec])


class _Best:
    """The k best rows of each query so far, ties by id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.cost = [np.zeros(0)] * n
        self.ids = [np.zeros(0, np.int64)] * n

    def add(self, q: int, cost: np.ndarray, ids: np.ndarray) -> None:
        cost, ids = np.concatenate([self.cost[q], cost]), np.concatenate([self.ids[q], ids])
        ok = ~np.isnan(cost)
        cost, ids = cost[ok], ids[ok]
        if len(cost) > self.k:
            edge = np.partition(cost, self.k - 1)[self.k - 1]
            near = cost <= edge
            cost, ids = cost[near], ids[near]
        order = np.lexsort((ids, cost))[: self.k]
        self.cost[q], self.ids[q] = cost[order], ids[order]


class _BlockBest:
    """The k best rows of each of a block of queries so far, ties by id; all queries of a block at once."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.who, self.ids, self.cost = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.edge = np.full(n, np.inf)  # the k-th best cost, where there are k

    def add(self, cost: np.ndarray, ids: np.ndarray) -> None:
        """cost: queries x rows."""
        edge = self.edge
        if len(ids) > self.k and np.isinf(edge).any():
            edge = np.fmin(edge, np.partition(cost, self.k - 1, axis=1)[:, self.k - 1])
        i, j = np.nonzero(cost <= edge[:, None])
        if not len(i):
            return
        who, near, far = np.concatenate([self.who, i]), np.concatenate([self.ids, ids[j]]), np.concatenate([self.cost, cost[i, j]])
        order = np.lexsort((near, far, who))
        who = who[order]
        n = np.bincount(who, minlength=self.n)
        first = np.cumsum(n) - n
        stay = np.arange(len(who)) - first[who] < self.k
        self.who, self.ids, self.cost = who[stay], near[order][stay], far[order][stay]
        n = np.minimum(n, self.k)
        self.edge = np.full(self.n, np.inf)
        full = np.flatnonzero(n == self.k)
        self.edge[full] = self.cost[np.cumsum(n)[full] - 1]


def _scan(qids: np.ndarray, q: np.ndarray, m: Metric, k: int):
    sign, wide = -1.0 if m.descending else 1.0, CELLS // ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_BlockBest(len(qids[at : at + wide]), k) for at in range(0, len(qids), wide)]
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                ids, x = part.column(0).to_numpy(), matrix(part.column(1))
                for i, own in enumerate(best):
                    own.add(sign * m.kernel(q[i * wide : (i + 1) * wide], x), ids)
        for i, own in enumerate(best):
            if len(own.who):
                yield pa.RecordBatch.from_arrays([pa.array(qids[i * wide : (i + 1) * wide][own.who]), pa.array(own.ids), pa.array(sign * own.cost)], names=["qid", "id", "dist"])

    return run


def knn_join(base: DataFrame, queries: DataFrame, k: int, metric_name: str | Metric = "l2", where: Column | None = None, block_bytes: int = QUERY_BYTES) -> DataFrame:
    """(qid, rank, id, dist): the k nearest of base(id, vec) for each of queries(qid, qvec); `where` filters base first."""
    m = metric(metric_name)
    rows = (base if where is None else base.where(where)).select(F.col("id").cast("long"), F.col("vec"))
    parts, last = [], None
    found = lambda part: top_k(part, k, descending=m.descending).select("qid", "rank", "id", "dist")
    for qids, q in query_blocks(queries, block_bytes=block_bytes):
        if last is not None:
            parts.append(cut(found(last)))
        last = rows.mapInArrow(_scan(qids, q, m, k), "qid long, id long, dist double")
    if last is None:
        last = rows.sparkSession.createDataFrame([], "qid long, id long, dist double")
    return union([*parts, found(last)], rows.sparkSession)


def _scan_range(qids: np.ndarray, q: np.ndarray, m: Metric, radius: float, inclusive: bool):
    within = lambda d: (d >= radius if inclusive else d > radius) if m.descending else (d <= radius if inclusive else d < radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                x = matrix(part.column(1))
                for at in range(0, len(q), CELLS // ROWS):
                    own = q[at : at + CELLS // ROWS]
                    d = m.kernel(own, x)
                    if m.pairs is None:
                        i, j = np.nonzero(within(d))
                        far = d[i, j]
                    else:
                        # The kernel only finds who may be within; the distance itself does not depend on the tile.
                        i, j = np.nonzero(d <= radius + l2_error(own, x))
                        far = np.concatenate([m.pairs(own[i[k : k + ROWS]], x[j[k : k + ROWS]]) for k in range(0, len(i), ROWS)] or [np.zeros(0)])
                        ok = within(far)
                        i, j, far = i[ok], j[ok], far[ok]
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(qids[at + i]), part.column(0).take(pa.array(j)), pa.array(far)], names=["qid", "id", "dist"])

    return run


def range_join(base: DataFrame, queries: DataFrame, radius: float, metric_name: str | Metric = "l2", inclusive: bool = False, block_bytes: int = QUERY_BYTES) -> DataFrame:
    """(qid, id, dist) for all rows strictly nearer than `radius` (similarities: above it); no shuffle."""
    m = metric(metric_name)
    rows = base.select(F.col("id").cast("long"), F.col("vec"))
    out = None
    for qids, q in query_blocks(queries, block_bytes=block_bytes):
        part = rows.mapInArrow(_scan_range(qids, q, m, radius, inclusive), "qid long, id long, dist double")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.sparkSession.createDataFrame([], "qid long, id long, dist double")


def epsilon_search(base: DataFrame, queries: DataFrame, eps: float, at_most: int, metric_name: str = "l2") -> DataFrame:
    """The nearest `at_most` rows within eps."""
    m = metric(metric_name)
    return top_k(range_join(base, queries, eps, m, inclusive=True), at_most, descending=m.descending).select("qid", "rank", "id", "dist")


def capped_range(base: DataFrame, queries: DataFrame, radius: float, max_results: int, metric_name: str = "l2") -> DataFrame:
    """Range search whose radius shrinks until all queries together have at most max_results results."""
    m = metric(metric_name)
    order = F.col("dist").desc() if m.descending else F.col("dist").asc()
    return range_join(base, queries, radius, m).orderBy(order, "qid", "id").limit(max_results)


def multi_vector_search(base: DataFrame, queries: DataFrame, num_docs: int, metric_name: str = "l2", doc: str = "doc") -> DataFrame:
    """(qid, rank, doc, dist): the nearest documents, a document being as near as its nearest vector.

    The per-document minimum is taken inside each task before anything is shuffled.
    """
    m = metric(metric_name)
    sign = -1.0 if m.descending else 1.0
    rows = base.select(F.col(doc).cast("long").alias("doc"), "vec")
    parts = []
    for qids, q in query_blocks(queries):

        def run(batches: Iterator[pa.RecordBatch], qids=qids, q=q) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                docs, code = np.unique(batch.column(0).to_numpy(), return_inverse=True)
                cost = sign * m.kernel(q, matrix(batch.column(1)))
                near = np.full((len(qids), len(docs)), np.inf)
                for i in range(len(qids)):
                    np.minimum.at(near[i], code, cost[i])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, len(docs))), pa.array(np.tile(docs, len(qids))), pa.array(near.ravel())], names=["qid", "doc", "cost"])

        parts.append(rows.mapInArrow(run, "qid long, doc long, cost double"))
    out = union(parts, rows.sparkSession, "qid long, doc long, cost double")
    best = out.groupBy("qid", "doc").agg((F.min("cost") * sign).alias("dist"))
    return top_k(best, num_docs, ident="doc", descending=m.descending).select("qid", "rank", "doc", "dist")


def _matches(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in wanted and in the sorted keys that are equal, all pairs."""
    lo = np.searchsorted(keys, wanted)
    n = np.searchsorted(keys, wanted, "right") - lo
    return np.repeat(np.arange(len(wanted)), n), np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _among(qids: np.ndarray, q: np.ndarray, pairs, k: int):
    """cogroup of candidates(qid, id) and rows(id, vec) of a block: the block's k best of each query."""

    def run(c: pa.Table, t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids, x = t["id"].to_numpy(), matrix(t["vec"])
        names, asked = np.unique(c["id"].to_numpy(), return_inverse=True)
        who, at = np.searchsorted(qids, c["qid"].to_numpy()), asked
        known = (who < len(qids)) & (qids[np.minimum(who, len(qids) - 1)] == c["qid"].to_numpy())
        which = np.unique(who[known] * np.int64(max(1, len(names))) + at[known])
        who, at = np.divmod(which, max(1, len(names)))
        # Every row of the id, and every query of the name, as in a join.
        i, row = _matches(ids, names[at])
        who = who[i]
        i, who = _matches(qids, qids[who])
        row = row[i]
        far = np.concatenate([pairs(q[who[i : i + ROWS]], x[row[i : i + ROWS]]) for i in range(0, len(who), ROWS)] or [np.zeros(0)])
        name = qids[who]
        order = np.lexsort((ids[row], far, name))
        first = np.searchsorted(name[order], name[order])
        order = order[np.arange(len(order)) - first < k]
        return pa.table({"qid": pa.array(name[order], pa.int64()), "id": pa.array(ids[row[order]], pa.int64()), "dist": pa.array(far[order], pa.float64())})

    return run


def knn_among(candidates: DataFrame, base: DataFrame, queries: DataFrame, k: int, metric_name: str = "l2") -> DataFrame:
    """The k nearest among given (qid, id) pairs.

    Where the metric has distances of pairs, rows are dealt into blocks by a hash of the id; a
    block gets its vectors once and the ids of the pairs, and gives k rows a query.  It holds
    at most CELLS different pairs: more queries make smaller blocks.  For other metrics, a
    shuffle join on id, then one on qid.
    """
    m = metric(metric_name)
    if m.pairs is None:
        both = candidates.select("qid", "id").distinct().join(base.select("id", "vec"), "id").join(queries.select("qid", "qvec"), "qid")
        scored = both.select("qid", "id", m.column(F.col("qvec").cast("array<double>"), F.col("vec").cast("array<double>")).alias("dist"))
        return top_k(scored, k, descending=m.descending).select("qid", "rank", "id", "dist")
    n, parts = base.count(), []
    for qids, q in query_blocks(queries):
        block = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // max(1, min(ROWS, CELLS // len(qids))))))).alias("block")
        asked = candidates.select(F.col("qid").cast("long").alias("qid"), F.col("id").cast("long").alias("id")).where(F.col("qid").between(int(qids[0]), int(qids[-1])))
        rows = base.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
        asked, rows = asked.select("*", block), rows.select("*", block)
        parts.append(asked.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(_among(qids, q, m.pairs, k), "qid long, id long, dist double"))
    return top_k(union(parts, base.sparkSession), k).select("qid", "rank", "id", "dist")


def refine(candidates: DataFrame, base: DataFrame, queries: DataFrame, k: int, k_factor: float = 1.0, metric_name: str = "l2") -> DataFrame:
    """Two-stage search: the first k * k_factor candidates by rank, re-ranked by the exact distance."""
    if k_factor < 1:
        raise ValueError("k_factor must be at least 1")
    return knn_among(candidates.where(F.col("rank") <= int(k * k_factor)), base, queries, k, metric_name)
