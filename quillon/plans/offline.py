"""The offline job: statistics, deduplication, training, sharded building, merging, search, evaluation, consistency."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import cluster, evaluate, exact, mutate
from quillon.operators.ivf import IvfIndex
from quillon.operators.topk import top_k
from quillon.storage import cut


@dataclass
class OfflineRun:
    """What each step found; results(qid, rank, id, dist) name every id of a repeated vector."""

    rows: int
    distinct: int
    nlist: int
    objective: list[float]
    results: DataFrame
    recall: float
    consistent: bool


def run(base: DataFrame, queries: DataFrame, nlist: int, nprobe: int, k: int, shards: int = 2, iterations: int = 5, train_per_list: int = 256) -> OfflineRun:
    """base(id, vec) and queries(qid, qvec).

    Training draws rows by a hash of the id, about train_per_list a list (a documented
    bound); every row is indexed.
    """
    rows = base.count()
    distinct = cut(mutate.dedup_vectors(base.select("id", "vec")))
    n = distinct.count()
    share = min(1.0, train_per_list * nlist / max(n, 1))
    sample = distinct.select("id", "vec").where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = sample if sample.count() >= nlist else distinct.select("id", "vec")
    centroids, objective = cluster.lloyd(sample, cluster.seeds(sample, nlist), iterations)
    parts = [IvfIndex(centroids, cluster.assign(distinct.where(F.pmod(F.xxhash64("id"), F.lit(shards)) == s).select("id", "vec"), centroids)) for s in range(shards)]
    index = parts[0]
    for p in parts[1:]:
        index = index.merged(p)
    found = index.search(queries, k, nprobe)
    results = top_k(mutate.expand_instances(found, distinct), k).select("qid", "rank", "id", "dist")
    truth = exact.knn_join(base.select("id", "vec"), queries, k)
    recall = evaluate.recall_at_k(results, truth, k).agg(F.avg("recall")).first()[0]
    every = top_k(mutate.expand_instances(index.search(queries, k, nlist), distinct), k)
    consistent = every.select("qid", "rank", "id").exceptAll(truth.select("qid", "rank", "id")).isEmpty() and index.lists.count() == n
    return OfflineRun(rows, n, len(centroids), objective, results, recall, consistent)
