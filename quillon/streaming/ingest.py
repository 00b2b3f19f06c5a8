"""Streams of vectors: appending micro-batches to an inverted-file table, and queries as a stream."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators import cluster
from quillon.operators.exact import knn_join


def ingest(stream: DataFrame, centroids: np.ndarray, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Assigns each micro-batch of (id, vec) to lists and appends it to Parquet partitioned by list and batch.

    A batch that is run again overwrites its own partitions, so each row is stored once.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = cluster.assign(batch, centroids).drop("cdist").withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "cid").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def answer(queries: DataFrame, base: DataFrame, k: int, path: str, checkpoint: str, metric_name: str = "l2") -> StreamingQuery:
    """Exact neighbours of each micro-batch of (qid, qvec) against a static table, appended as Parquet."""

    def write(batch: DataFrame, number: int) -> None:
        got = knn_join(base, batch, k, metric_name).withColumn("batch", F.lit(number))
        got.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
