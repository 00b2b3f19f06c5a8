"""Index manifests: one small JSON text beside the tables of an index, through Spark's file systems."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def write_manifest(spark: SparkSession, path: str, values: dict) -> None:
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str, expect: dict | None = None) -> dict:
    """The stored values; raises ValueError where they differ from what is expected."""
    values = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    for k, v in (expect or {}).items():
        if values.get(k) != v:
            raise ValueError(f"{path}: {k} is {values.get(k)!r}, not {v!r}")
    return values
