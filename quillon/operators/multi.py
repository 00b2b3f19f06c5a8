"""Indexes made of others: multi-index lists, sums over slices, two-level codes, refined codes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.metrics import Metric, _l2, l2_table
from quillon.functions.vectors import plus, sq_l2
from quillon.operators import cluster
from quillon.operators.exact import knn_among, knn_join, matrix, query_blocks
from quillon.operators.ivf import IvfIndex
from quillon.operators.lists import asking_lists, scan_lists
from quillon.operators.pq import ProductQuantizer
from quillon.operators.rerank import LISTED, kernel_scores, knn_reranked, with_vectors
from quillon.operators.topk import top_k
from quillon.storage import cut


@dataclass
class MultiIndex:
    """Lists are pairs of sub-lists, one of each half of the dimensions; a search probes pairs by summed distance."""

    halves: tuple[np.ndarray, np.ndarray]
    lists: DataFrame  # id, vec, cid = c0 * n + c1

    @classmethod
    def build(cls, base: DataFrame, n: int, iterations: int = 5) -> MultiIndex:
        rows = base.select("id", F.col("vec").cast("array<double>").alias("vec"))
        d = len(rows.first()["vec"])
        out, halves = rows, []
        for h, (a, w) in enumerate(((1, d // 2), (d // 2 + 1, d - d // 2))):
            half = rows.select("id", F.slice("vec", a, w).alias("vec"))
            c, _ = cluster.lloyd(half, cluster.seeds(half, n), iterations)
            halves.append(c)
            out = out.join(cluster.assign(half, c, keep=("id", "vec")).select("id", F.col("cid").alias(f"c{h}")), "id")
        return cls((halves[0], halves[1]), out.select("id", "vec", (F.col("c0") * n + F.col("c1")).cast("int").alias("cid")))

    def probes(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """(qid, cid, probe): the best pairs need only the nprobe best of either half."""
        spark, n, d0 = queries.sparkSession, len(self.halves[0]), self.halves[0].shape[1]
        near = []
        for h, c in enumerate(self.halves):
            q = queries.select("qid", (F.slice("qvec", 1, d0) if h == 0 else F.slice("qvec", d0 + 1, c.shape[1])).alias("qvec"))
            t = cluster.centroid_table(spark, c).select(F.col("cid").cast("long").alias("id"), F.col("cvec").alias("vec"))
            near.append(knn_join(t, q, min(nprobe, n)).select("qid", F.col("id").alias(f"c{h}"), F.col("dist").alias(f"d{h}")))
        both = near[0].join(near[1], "qid").select("qid", (F.col("c0") * n + F.col("c1")).cast("int").alias("cid"), F.round(F.col("d0") + F.col("d1"), 9).alias("d"))
        return both.withColumn("probe", F.row_number().over(Window.partitionBy("qid").orderBy("d", "cid"))).where(F.col("probe") <= nprobe).select("qid", "cid", "probe")

    def search(self, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
        """Lists are read in place, so that neither pairs nor vectors are shuffled once a query."""
        probes = cut(self.probes(queries, nprobe))
        blocks = [(qids, q, asking_lists(qids, q, self.halves[0], nprobe, probes)) for qids, q in query_blocks(queries)]
        return scan_lists(self.lists.select("id", "cid", "vec"), blocks, k, lambda q, c, vecs: l2_table(q, matrix(vecs)))


def split_metric(widths: list[int]) -> Metric:
    """The sum of the squared distances of consecutive slices."""
    ends = np.cumsum(widths)
    cuts = list(zip(ends - widths, ends))

    def column(a: Column, b: Column) -> Column:
        parts = [sq_l2(F.slice(a, int(lo) + 1, int(hi - lo)), F.slice(b, int(lo) + 1, int(hi - lo))) for lo, hi in cuts]
        return sum(parts[1:], parts[0])

    return Metric("split", column, lambda q, x: sum(_l2(q[:, lo:hi], x[:, lo:hi]) for lo, hi in cuts))


def split_search(base: DataFrame, queries: DataFrame, k: int, widths: list[int]) -> DataFrame:
    """Search on slices, whose distances are added up."""
    return knn_join(base, queries, k, split_metric(widths))


def random_search(base: DataFrame, queries: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """A baseline: each query gets k rows drawn by a hash."""
    n = base.count()
    numbered = base.select("id", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(n, 1))).alias("at"))
    draws = queries.select("qid", F.explode(F.sequence(F.lit(1), F.lit(8 * k))).alias("i")).select("qid", "i", F.pmod(F.xxhash64("qid", "i"), F.lit(max(n, 1))).alias("at"))
    got = draws.join(numbered, "at").groupBy("qid", "id").agg(F.min("i").cast("double").alias("dist"))
    return top_k(got, k).select("qid", "rank", "id", "dist")


@dataclass
class TwoLevelCodes:
    """List number and residual code of every vector; with `fine`, the residual of that is coded too."""

    centroids: np.ndarray
    pq: ProductQuantizer
    fine: ProductQuantizer | None
    codes: DataFrame  # id, cid, code[, fine]

    @classmethod
    def build(cls, base: DataFrame, nlist: int, m: int, k: int, fine_m: int = 0, iterations: int = 5) -> TwoLevelCodes:
        index = IvfIndex.build(base, nlist, iterations)
        rest = index.residuals().select("id", "cid", "vec")
        pq = ProductQuantizer.train(rest, m, k, iterations)
        codes = rest.select("id", "cid").join(pq.encode(rest), "id")
        fine = None
        if fine_m:
            left = rest.select("id", "vec").join(pq.decode(codes).select("id", F.col("vec").alias("near")), "id").select("id", plus(F.col("vec"), F.col("near"), -1.0).alias("vec"))
            fine = ProductQuantizer.train(left, fine_m, k, iterations)
            codes = codes.join(fine.encode(left).select("id", F.col("code").alias("fine")), "id")
        return cls(index.centroids, pq, fine, codes)

    def decode(self, refined: bool = True) -> DataFrame:
        """(id, vec): the vectors that the codes stand for."""
        table = F.broadcast(cluster.centroid_table(self.codes.sparkSession, self.centroids))
        out = self.codes.join(table, "cid").select("id", F.col("cvec").alias("vec")).join(self.pq.decode(self.codes).withColumnRenamed("vec", "a"), "id")
        out = out.select("id", plus(F.col("vec"), F.col("a")).alias("vec"))
        if self.fine is not None and refined:
            own = self.codes.select("id", F.col("fine").alias("code"))
            out = out.join(self.fine.decode(own).withColumnRenamed("vec", "a"), "id").select("id", plus(F.col("vec"), F.col("a")).alias("vec"))
        return out

    def search(self, queries: DataFrame, k: int, k_factor: int = 4) -> DataFrame:
        """Candidates by the first codes, re-ranked by the refined ones where there are any."""
        rough = knn_join(self.decode(False), queries, k * (k_factor if self.fine is not None else 1))
        return knn_among(rough, self.decode(), queries, k) if self.fine is not None else rough

    def search_reranked(self, base: DataFrame, queries: DataFrame, k: int, rerank: int, k_factor: int = 4) -> DataFrame:
        """The best `rerank` (at least k) of search(), re-ranked by exact distance."""
        keep = max(rerank, k)
        if keep <= LISTED or (self.fine is not None and keep * k_factor < self.codes.count()):
            return knn_among(self.search(queries, keep, k_factor), base, queries, k)
        # The first codes leave no row out.
        return knn_reranked(with_vectors(self.decode().withColumnRenamed("vec", "coded"), base), kernel_scores(), keep, queries, k)
