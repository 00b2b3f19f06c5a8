"""Top-k per query.  Ties are broken by id, fewer than k rows stay fewer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, by: str = "qid", value: str = "dist", ident: str = "id", descending: bool = False) -> DataFrame:
    """Adds rank (from 1) and keeps rank <= k; Spark limits each partition before the shuffle."""
    first = F.col(value).desc() if descending else F.col(value).asc()
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(first, F.col(ident).asc()))).where(F.col("rank") <= k)


def merge_top_k(parts: list[DataFrame], k: int, descending: bool = False) -> DataFrame:
    """Merges results of shards: top-k is distributive."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top_k(out.drop("rank"), k, descending=descending)


def union(parts: list[DataFrame], spark: SparkSession, schema: str = "qid long, id long, dist double") -> DataFrame:
    """The parts together; without any, an empty table."""
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
