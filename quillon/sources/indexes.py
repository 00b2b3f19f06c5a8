"""Saving and loading of coded and graph indexes: Parquet tables beside a manifest with their parameters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from quillon.operators.cluster import centroid_table
from quillon.operators.graph import GraphIndex
from quillon.operators.ivfpq import IvfPqIndex, PqIvfIndex
from quillon.operators.pq import ProductQuantizer
from quillon.sources.manifest import read_manifest, write_manifest


def _put(spark: SparkSession, path: str, x: np.ndarray) -> None:
    """An array as rows of its last dimension, in order."""
    centroid_table(spark, x.reshape(-1, x.shape[-1])).coalesce(1).write.mode("overwrite").parquet(path)


def _get(spark: SparkSession, path: str, shape: list[int]) -> np.ndarray:
    return np.array([r["cvec"] for r in spark.read.parquet(path).orderBy("cid").collect()]).reshape(shape)


def save_pq(path: str, pq: ProductQuantizer, codes: DataFrame) -> None:
    spark = codes.sparkSession
    _put(spark, f"{path}/codebooks", pq.codebooks)
    codes.write.mode("overwrite").parquet(f"{path}/codes")
    write_manifest(spark, path, {"kind": "pq", "shape": list(pq.codebooks.shape)})


def load_pq(spark: SparkSession, path: str, **expect: object) -> tuple[ProductQuantizer, DataFrame]:
    shape = read_manifest(spark, path, {"kind": "pq", **expect})["shape"]
    return ProductQuantizer(_get(spark, f"{path}/codebooks", shape)), spark.read.parquet(f"{path}/codes")


def save_ivfpq(path: str, index: IvfPqIndex) -> None:
    spark = index.codes.sparkSession
    _put(spark, f"{path}/centroids", index.centroids)
    _put(spark, f"{path}/codebooks", index.books)
    index.codes.repartition("cid").write.mode("overwrite").partitionBy("cid").parquet(f"{path}/lists")
    write_manifest(spark, path, {"kind": "ivfpq", "nlist": len(index.centroids), "dim": int(index.centroids.shape[1]), "shape": list(index.books.shape), "residual": index.residual})


def load_ivfpq(spark: SparkSession, path: str, **expect: object) -> IvfPqIndex:
    v = read_manifest(spark, path, {"kind": "ivfpq", **expect})
    return IvfPqIndex(_get(spark, f"{path}/centroids", [v["nlist"], v["dim"]]), _get(spark, f"{path}/codebooks", v["shape"]), spark.read.parquet(f"{path}/lists").select("id", "cid", "code"), v["residual"])


def save_pqivf(path: str, index: PqIvfIndex) -> None:
    spark = index.codes.sparkSession
    _put(spark, f"{path}/codebooks", index.pq.codebooks)
    _put(spark, f"{path}/centroids", index.centroids.astype(float))
    index.codes.repartition("cid").write.mode("overwrite").partitionBy("cid").parquet(f"{path}/lists")
    write_manifest(spark, path, {"kind": "pqivf", "shape": list(index.pq.codebooks.shape), "nlist": len(index.centroids)})


def load_pqivf(spark: SparkSession, path: str, **expect: object) -> PqIvfIndex:
    v = read_manifest(spark, path, {"kind": "pqivf", **expect})
    pq = ProductQuantizer(_get(spark, f"{path}/codebooks", v["shape"]))
    return PqIvfIndex(pq, _get(spark, f"{path}/centroids", [v["nlist"], v["shape"][0]]).astype(np.uint8), spark.read.parquet(f"{path}/lists").select("id", "cid", "code"))


def save_graph(path: str, index: GraphIndex) -> None:
    spark = index.rows.sparkSession
    index.rows.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/nodes")
    index.edges.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/edges")
    nodes, edges = spark.read.parquet(f"{path}/nodes").count(), spark.read.parquet(f"{path}/edges").count()
    write_manifest(spark, path, {"kind": "graph", "m": index.m, "metric": index.metric_name, "nodes": nodes, "edges": edges})


def load_graph(spark: SparkSession, path: str, **expect: object) -> GraphIndex:
    """Checks the numbers of nodes and edges, so a damaged index is not used."""
    v = read_manifest(spark, path, {"kind": "graph", **expect})
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    if (nodes.count(), edges.count()) != (v["nodes"], v["edges"]):
        raise ValueError(f"{path}: nodes or edges are missing")
    return GraphIndex(nodes.select("id", "vec", "shard"), edges.select("shard", "level", "node", "nbr"), v["m"], v["metric"])
