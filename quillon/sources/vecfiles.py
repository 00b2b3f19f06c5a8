"""Vector files: readers and writers for the fbin/ibin/u8bin and fvecs/ivecs/bvecs layouts.

xvecs files are fixed-length records (a little-endian int32 dimension before each
vector), so they are read through Hadoop's fixed-length input, which splits a file of any
size between tasks.  xbin files start with int32 counts n and d; each file of a set is one
binary record, so large sets come as many files.  Both read whatever path Spark can open.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"f": ("<f4", "float", pa.float32()), "i": ("<i4", "int", pa.int32()), "b": ("u1", "smallint", pa.int16())}


def read_bin(spark: SparkSession, path: str, kind: str = "f", chunk: int = 65536) -> DataFrame:
    """(file, id, vec): id is the row number within its file."""
    dtype, name, arrow = KINDS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path_, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                buf = raw.as_buffer()
                n, d = struct.unpack("<ii", buf.slice(0, 8).to_pybytes())
                want = 8 + n * d * np.dtype(dtype).itemsize
                if len(buf) != want:
                    raise ValueError(f"{path_}: {len(buf)} bytes, its header says {want}")
                x = np.frombuffer(buf, dtype, n * d, 8).reshape(n, d)
                for lo in range(0, n, chunk):
                    part = x[lo : lo + chunk]
                    flat = pa.array(part.ravel().astype(np.int16) if kind == "b" else part.ravel(), arrow)
                    vec = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, d, dtype=np.int32)), flat)
                    yield pa.RecordBatch.from_arrays([pa.array([path_] * len(part)), pa.array(np.arange(lo, lo + len(part))), vec], names=["file", "id", "vec"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"file string, id long, vec array<{name}>")


def _first_dimension(spark: SparkSession, path: str) -> int:
    """The int32 at the start of a file, or of the first file of a folder, through Hadoop's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(at).isDirectory():
        at = sorted((f.getPath() for f in fs.listStatus(at) if f.isFile() and f.getLen()), key=str)[0]
    f = fs.open(at)
    try:
        return struct.unpack("<i", bytes(f.read() for _ in range(4)))[0]
    finally:
        f.close()


def read_vecs(spark: SparkSession, path: str, kind: str = "f", dim: int | None = None) -> DataFrame:
    """(id, vec): id is the record number over the file."""
    dtype, name, arrow = KINDS[kind]
    sc = spark.sparkContext
    dim = dim or _first_dimension(spark, path)
    size = 4 + dim * np.dtype(dtype).itemsize
    raw = sc.binaryRecords(path, size).zipWithIndex().map(lambda r: (r[1], bytearray(r[0])))
    rows = spark.createDataFrame(raw, "id long, raw binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, size)
            if (x[:, :4].copy().view("<i4") != dim).any():
                raise ValueError(f"{path}: records of different dimensions")
            v = x[:, 4:].copy().view(dtype).ravel()
            vec = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, dim, dtype=np.int32)), pa.array(v.astype(np.int16) if kind == "b" else v, arrow))
            yield pa.RecordBatch.from_arrays([batch.column(0), vec], names=["id", "vec"])

    return rows.mapInArrow(run, f"id long, vec array<{name}>")


def write_vecs(df: DataFrame, path: str, kind: str = "f", vec: str = "vec", order: str = "id") -> int:
    """Exports one local file in id order, a row at a time from the driver; the number of rows."""
    dtype = KINDS[kind][0]
    n = 0
    with open(path, "wb") as f:
        for r in df.select(order, vec).orderBy(order).toLocalIterator(prefetchPartitions=True):
            v = np.array(r[vec], dtype)
            f.write(struct.pack("<i", len(v)) + v.tobytes())
            n += 1
    return n


def write_bin(df: DataFrame, path: str, kind: str = "f", vec: str = "vec", order: str = "id") -> int:
    dtype = KINDS[kind][0]
    n, d = df.agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
    with open(path, "wb") as f:
        f.write(struct.pack("<ii", n, d or 0))
        for r in df.select(order, vec).orderBy(order).toLocalIterator(prefetchPartitions=True):
            f.write(np.array(r[vec], dtype).tobytes())
    return n


def to_binary16(vec: str, kind: str = "fp16"):
    """Column of bytes: each value as half precision, or as the upper half of single precision."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        if kind == "fp16":
            return s.map(lambda v: np.asarray(v, "<f2").tobytes())
        return s.map(lambda v: (np.asarray(v, "<f4").view("<u4") >> 16).astype("<u2").tobytes())

    return run(vec)
