"""Evaluation of search results against ground truth: (qid, rank, id) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.storage import cut


def hits(found: DataFrame, truth: DataFrame, k: int, truth_k: int | None = None) -> DataFrame:
    """(qid, hits): how many of the first k found are among the first truth_k true ones; 0 for queries without a hit."""
    t = truth.where(F.col("rank") <= (truth_k or k)).select("qid", "id")
    n = found.where(F.col("rank") <= k).select("qid", "id").distinct().join(t, ["qid", "id"]).groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))
    return truth.select("qid").distinct().join(n, "qid", "left").select("qid", F.coalesce("hits", F.lit(0)).alias("hits"))


def recall_at_k(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, recall): found and true among the first k, over k."""
    return hits(found, truth, k).select("qid", (F.col("hits") / float(k)).alias("recall"))


def first_in_r(found: DataFrame, truth: DataFrame, rs: tuple[int, ...] = (1, 10, 100)) -> DataFrame:
    """(r, rate): how often the true nearest is among the first r found."""
    top = truth.where("rank = 1").select("qid", F.col("id").alias("best"))
    at = top.join(found.select("qid", F.col("id").alias("best"), F.col("rank").alias("at")), ["qid", "best"], "left")
    each = at.select("qid", "at", F.explode(F.array(*map(F.lit, rs))).alias("r"))
    return each.groupBy("r").agg(F.avg((F.coalesce("at", F.lit(1 << 30)) <= F.col("r")).cast("double")).alias("rate"))


def intersection(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: share of the first k in common, over all queries."""
    return hits(found, truth, k).agg((F.sum("hits") / (F.count(F.lit(1)) * float(k))).alias("intersection"))


def range_precision_recall(found: DataFrame, truth: DataFrame, qids: DataFrame) -> DataFrame:
    """(qid, precision, recall) of range results; nothing found is precise, nothing true is recalled only if nothing was found."""
    count = lambda df, name: df.groupBy("qid").agg(F.count(F.lit(1)).alias(name))
    f, t = found.select("qid", "id"), truth.select("qid", "id")
    rows = qids.select("qid").join(count(f, "nres"), "qid", "left").join(count(t, "ngt"), "qid", "left").join(count(f.join(t, ["qid", "id"]), "both"), "qid", "left").na.fill(0)
    precision = F.when(F.col("nres") == 0, 1.0).otherwise(F.col("both") / F.greatest("nres", F.lit(1)))
    recall = F.when(F.col("ngt") > 0, F.col("both") / F.greatest("ngt", F.lit(1))).otherwise((F.col("nres") == 0).cast("double"))
    return rows.select("qid", precision.alias("precision"), recall.alias("recall"))


def pareto(points: DataFrame, perf: str = "perf", cost: str = "cost") -> DataFrame:
    """Points that no cheaper or equal point matches in performance; of equal points one stays.

    The best of each cost comes first, map-side.  Then ranges of the cost are partitions: each
    looks at its own costs in order, and at the best of all ranges before it, one row a range.
    """
    best = points.groupBy(F.col(cost)).agg(F.max(perf).alias(perf))
    ranged = cut(best.repartitionByRange(cost).withColumn("_range", F.spark_partition_id()))
    tops = ranged.groupBy("_range").agg(F.max(perf).alias("_top"))
    before = F.max("_top").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    ranged = ranged.join(F.broadcast(tops.select("_range", before.alias("_before"))), "_range")
    within = F.max(perf).over(Window.partitionBy("_range").orderBy(cost).rowsBetween(Window.unboundedPreceding, -1))
    seen = F.greatest(F.col("_before"), F.col("_within"))
    return ranged.withColumn("_within", within).where(seen.isNull() | (F.col(perf) > seen)).select(perf, cost)


def sweep(search, settings: list[dict], truth: DataFrame, k: int) -> list[dict]:
    """Recall and seconds of search(**setting) for each setting."""
    import time

    out = []
    for s in settings:
        t = time.time()
        got = recall_at_k(search(**s), truth, k).agg(F.avg("recall")).first()[0]
        out.append({**s, "recall": got, "seconds": time.time() - t})
    return out
