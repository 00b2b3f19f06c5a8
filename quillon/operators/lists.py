"""Scans of inverted lists in place: running top-k per query, k rows a query and task are shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.metrics import _l2
from quillon.operators.exact import _Best
from quillon.operators.topk import top_k

_HITS = "qid long, id long, dist double"


def nearest_lists(q: np.ndarray, centroids: np.ndarray, nprobe: int) -> np.ndarray:
    """Lists of each query, nearest first; distances rounded to 9 digits, ties to the lower number."""
    return np.argsort(np.round(_l2(q, centroids), 9), axis=1, kind="stable")[:, : min(nprobe, len(centroids))]


def asking_lists(qids: np.ndarray, q: np.ndarray, centroids: np.ndarray, nprobe: int, assigned: DataFrame | None = None) -> dict[int, np.ndarray]:
    """For each list the rows of q that ask it: the nearest lists, or those that assigned(qid, cid) says."""
    if assigned is None:
        near = nearest_lists(q, centroids, nprobe)
        return {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}
    got = assigned.where(F.col("qid").isin([int(x) for x in qids])).select("qid", "cid").distinct().toPandas()  # a block's queries only
    at = {int(x): i for i, x in enumerate(qids)}
    return {int(c): np.array(sorted(at[int(x)] for x in rows["qid"])) for c, rows in got.groupby("cid")}


def scan_lists(lists: DataFrame, blocks: list, k: int, score: Callable[[np.ndarray, int, pa.Array], np.ndarray], descending: bool = False, where: Column | None = None, radius: float | None = None) -> DataFrame:
    """(qid, rank, id, dist) over lists(id, cid, value); score(queries, list, values) gives distances.

    With `radius`, all rows below it (above it, descending) come, and there is no rank.
    """
    rows = lists if where is None else lists.where(where)
    sign = -1.0 if descending else 1.0
    out = None
    for qids, q, asking in blocks:

        def run(batches: Iterator[pa.RecordBatch], qids=qids, q=q, asking=asking) -> Iterator[pa.RecordBatch]:
            best = _Best(len(qids), k)
            for batch in batches:
                for lo in range(0, batch.num_rows, 4096):
                    part = batch.slice(lo, 4096)
                    ids, cids = part.column(0).to_numpy(), part.column(1).to_numpy()
                    for c in np.unique(cids):
                        who = asking.get(int(c), ())
                        if not len(who):
                            continue
                        own = np.flatnonzero(cids == c)
                        cost = score(q[who], int(c), part.column(2).take(pa.array(own)))
                        if radius is not None:
                            i, j = np.nonzero(sign * cost < sign * radius)
                            if len(i):
                                yield pa.RecordBatch.from_arrays([pa.array(qids[np.asarray(who)[i]]), pa.array(ids[own[j]]), pa.array(cost[i, j])], names=["qid", "id", "dist"])
                            continue
                        for i, x in enumerate(who):
                            best.add(x, sign * cost[i], ids[own])
            n = [len(x) for x in best.ids]
            if sum(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, n)), pa.array(np.concatenate(best.ids)), pa.array(sign * np.concatenate(best.cost))], names=["qid", "id", "dist"])

        part = rows.where(F.col("cid").isin(sorted(asking))).mapInArrow(run, _HITS)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.sparkSession.createDataFrame([], _HITS)
    return out if radius is not None else top_k(out, k, descending=descending).select("qid", "rank", "id", "dist")
