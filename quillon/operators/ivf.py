"""Inverted-file indexes: a coarse quantizer deals vectors into lists; a search joins its nearest lists.

Centroids are the bounded side.  A search scans the lists that some query probes in place,
with a running top-k per query, so that neither vectors nor a hot list are shuffled.  Stored
as Parquet partitioned by list, lists that no query probes are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.metrics import metric
from quillon.operators import cluster
from quillon.operators.exact import knn_join, matrix, query_blocks
from quillon.operators.lists import asking_lists, scan_lists
from quillon.operators.topk import top_k
from quillon.sources.manifest import read_manifest, write_manifest
from quillon.storage import cut


@dataclass
class IvfIndex:
    """centroids (nlist x d) and lists(id, vec, cid)."""

    centroids: np.ndarray
    lists: DataFrame

    @classmethod
    def build(cls, base: DataFrame, nlist: int, iterations: int = 10, tol: float = 0.0, empty: str = "keep", keep: tuple[str, ...] = ("id", "vec")) -> IvfIndex:
        centroids, _ = cluster.lloyd(base, cluster.seeds(base, nlist), iterations, tol, empty)
        return cls(centroids, cut(cluster.assign(base, centroids, keep=keep)))

    @property
    def nlist(self) -> int:
        return len(self.centroids)

    def probes(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """(qid, cid, probe, cdist): probe is the rank of the list, from 1."""
        table = cluster.centroid_table(queries.sparkSession, self.centroids).select(F.col("cid").cast("long").alias("id"), F.col("cvec").alias("vec"))
        got = knn_join(table, queries, min(nprobe, self.nlist), "l2")
        return got.select("qid", F.col("id").cast("int").alias("cid"), F.col("rank").alias("probe"), F.col("dist").alias("cdist"))

    def candidates(self, queries: DataFrame, nprobe: int, where: Column | None = None, max_codes: int | None = None) -> DataFrame:
        """(qid, qvec, probe, cid, id, vec): the vectors of the probed lists.

        max_codes: lists are read in probe order until that many vectors were seen.
        """
        probes = self.probes(queries, nprobe)
        if max_codes is not None:
            sizes = cluster.list_sizes(self.lists, self.nlist)
            before = F.sum("n").over(Window.partitionBy("qid").orderBy("probe").rowsBetween(Window.unboundedPreceding, -1))
            probes = probes.join(sizes, "cid").withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < max_codes).drop("before", "n")
        lists = self.lists if where is None else self.lists.where(where)
        return probes.join(queries.select("qid", "qvec"), "qid").join(lists, "cid")

    def _blocks(self, queries: DataFrame, nprobe: int, assigned: DataFrame | None) -> list:
        return [(qids, q, asking_lists(qids, q, self.centroids, nprobe, assigned)) for qids, q in query_blocks(queries)]

    def search(self, queries: DataFrame, k: int, nprobe: int, metric_name: str = "l2", where: Column | None = None, max_codes: int | None = None, assigned: DataFrame | None = None) -> DataFrame:
        """(qid, rank, id, dist): lists are scanned in place.  assigned(qid, cid): the lists of each query, instead of its nearest ones."""
        m = metric(metric_name)
        if max_codes is None:
            return scan_lists(self._scanned(where), self._blocks(queries, nprobe, assigned), k, lambda q, c, v: m.kernel(q, matrix(v)), m.descending)
        scored = self.candidates(queries, nprobe, where, max_codes).select("qid", "id", m.column(F.col("qvec").cast("array<double>"), F.col("vec").cast("array<double>")).alias("dist"))
        return top_k(scored, k, descending=m.descending).select("qid", "rank", "id", "dist")

    def _scanned(self, where: Column | None = None) -> DataFrame:
        rows = self.lists if where is None else self.lists.where(where)
        return rows.select(F.col("id").cast("long").alias("id"), "cid", "vec")

    def range_search(self, queries: DataFrame, radius: float, nprobe: int, metric_name: str = "l2", assigned: DataFrame | None = None) -> DataFrame:
        """(qid, id, dist) of all rows nearer than radius in the lists of each query."""
        m = metric(metric_name)
        return scan_lists(self._scanned(), self._blocks(queries, nprobe, assigned), 1, lambda q, c, v: m.kernel(q, matrix(v)), m.descending, radius=radius)

    def search_statistics(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """(qid, lists, distances): lists visited and vectors compared."""
        return self.candidates(queries, nprobe).groupBy("qid").agg(F.countDistinct("cid").alias("lists"), F.count(F.lit(1)).alias("distances"))

    def residuals(self) -> DataFrame:
        """lists with vec replaced by its difference from the list's centroid."""
        table = cluster.centroid_table(self.lists.sparkSession, self.centroids)
        rest = F.zip_with(F.col("vec").cast("array<double>"), F.col("cvec"), lambda x, c: x - c)
        return self.lists.join(F.broadcast(table), "cid").withColumn("vec", rest).drop("cvec")

    def shards(self, n: int) -> list[IvfIndex]:
        """Shard i holds the lists with cid % n = i."""
        return [IvfIndex(self.centroids, self.lists.where(F.col("cid") % n == i)) for i in range(n)]

    def merged(self, other: IvfIndex, shift_ids: int = 0) -> IvfIndex:
        if self.centroids.shape != other.centroids.shape or not np.array_equal(self.centroids, other.centroids):
            raise ValueError("indexes have different coarse quantizers")
        return IvfIndex(self.centroids, self.lists.unionByName(other.lists.withColumn("id", F.col("id") + shift_ids)))

    def save(self, path: str) -> None:
        spark = self.lists.sparkSession
        cluster.centroid_table(spark, self.centroids).coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        self.lists.repartition("cid").sortWithinPartitions("cid", "id").write.mode("overwrite").partitionBy("cid").parquet(f"{path}/lists")
        write_manifest(spark, path, {"kind": "ivf", "nlist": self.nlist, "dim": int(self.centroids.shape[1])})

    @classmethod
    def load(cls, spark: SparkSession, path: str, **expect: object) -> IvfIndex:
        """Reads a saved index; parameters given must be those it was saved with."""
        read_manifest(spark, path, {"kind": "ivf", **expect})
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cid").collect()
        return cls(np.array([r["cvec"] for r in rows]), spark.read.parquet(f"{path}/lists"))


def load_or_build(spark: SparkSession, path: str, base: DataFrame, nlist: int, iterations: int = 10) -> IvfIndex:
    """Loads when the stored index has the lists, dimension and number of rows asked for; builds and stores anew when there is none or another.

    Any other failure is raised and leaves the store as it is.
    """
    rows, dim = base.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    try:
        index = IvfIndex.load(spark, path, nlist=nlist, dim=dim)
        if index.lists.count() == rows:
            return index
    except ValueError:  # other parameters
        pass
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    IvfIndex.build(base, nlist, iterations).save(path)
    return IvfIndex.load(spark, path, nlist=nlist)
