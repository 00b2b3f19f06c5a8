"""Changes of an index table: upsert, tombstones, removal, merge, shards, sliding windows, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of `new` replace those of the same key."""
    return base.join(new.select(key), key, "left_anti").unionByName(new)


def remove(base: DataFrame, gone: DataFrame | Column, key: str = "id") -> DataFrame:
    """Removes rows by a table of keys or by a condition (null counts as false)."""
    if isinstance(gone, DataFrame):
        return base.join(gone.select(key).distinct(), key, "left_anti")
    return base.where(~F.coalesce(gone, F.lit(False)))


def update_vectors(base: DataFrame, new: DataFrame, key: str = "id", vec: str = "vec") -> DataFrame:
    """Overwrites the vectors of known keys; unknown keys are ignored."""
    n = new.select(key, F.col(vec).alias("_new"))
    return base.join(n, key, "left").withColumn(vec, F.coalesce("_new", vec)).drop("_new")


def mark_deleted(tombstones: DataFrame, ids: DataFrame, base: DataFrame) -> DataFrame:
    """Tombstones with more ids; ids must exist and not be marked yet."""
    twice = ids.join(tombstones, "id", "left_semi").count()
    unknown = ids.join(base.select("id"), "id", "left_anti").count()
    if twice or unknown:
        raise ValueError(f"{twice} ids are deleted already, {unknown} are unknown")
    return tombstones.unionByName(ids)


def unmark_deleted(tombstones: DataFrame, ids: DataFrame) -> DataFrame:
    if ids.join(tombstones, "id", "left_anti").count():
        raise ValueError("some ids are not deleted")
    return tombstones.join(ids, "id", "left_anti")


def reconstruct(base: DataFrame, ids: DataFrame) -> DataFrame:
    """Vectors of given ids; unknown ids are an error."""
    missing = ids.join(base.select("id"), "id", "left_anti").count()
    if missing:
        raise ValueError(f"{missing} ids are unknown")
    return base.join(ids.select("id").distinct(), "id", "left_semi")


def merge(a: DataFrame, b: DataFrame, shift_ids: int = 0) -> DataFrame:
    return a.unionByName(b.withColumn("id", F.col("id") + shift_ids))


def shard_of(n: int, shards: int, position: Column) -> Column:
    """Contiguous shards of n rows by position from 0: shard s has positions [s n / S, (s + 1) n / S)."""
    return F.floor(((position + 1) * shards - 1) / F.lit(n)).cast("int")


def sliding_window(base: DataFrame, slice_col: str, newest: int, size: int) -> DataFrame:
    """The rows of the last `size` slices."""
    return base.where((F.col(slice_col) > newest - size) & (F.col(slice_col) <= newest))


def dedup_vectors(base: DataFrame) -> DataFrame:
    """(id, vec, instances): one row for each distinct vector, its lowest id and all ids that have it."""
    return base.groupBy("vec").agg(F.min("id").alias("id"), F.array_sort(F.collect_list("id")).alias("instances"))


def expand_instances(found: DataFrame, distinct: DataFrame) -> DataFrame:
    """Search results on distinct vectors, with every id that has the vector."""
    return found.join(distinct.select("id", "instances"), "id").withColumn("id", F.explode("instances")).drop("instances", "rank")
