"""Inverted files whose lists hold codes instead of vectors, packed to BINARY.

A codec turns rows into a fixed number of bytes and scores codes against queries; it is
fitted on a few numbers a dimension, so it is the bounded side like the centroids.  Lists
are scanned in place: a task decodes the rows of the lists that queries ask for, keeps a
running top-k per query, and k rows a query and task are shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.metrics import _l2
from quillon.operators import cluster, transforms
from quillon.operators.codecs import ScalarQuantizer
from quillon.operators.exact import matrix, query_blocks
from quillon.operators.lists import asking_lists, scan_lists
from quillon.sources.manifest import read_manifest, write_manifest


def codes_of(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """A BINARY column of equal lengths as a matrix of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), size)


class Codec:
    """encode(x) gives bytes a row, decode(codes) the vectors that they stand for."""

    kind = ""

    def encode(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def decode(self, codes: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def scores(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to coded rows."""
        return _l2(q, self.decode(codes))

    def size(self, dim: int) -> int:
        return self.encode(np.zeros((1, dim))).shape[1]


@dataclass
class ScalarCodec(Codec):
    """Each dimension in `bits` bits between its bounds; codes lie bit by bit."""

    low: list[float]
    width: list[float]
    bits: int = 8
    kind = "scalar"

    @classmethod
    def train(cls, base: DataFrame, bits: int = 8, mode: str = "minmax", arg: float = 0.0, uniform: bool = False) -> ScalarCodec:
        q = ScalarQuantizer.train(base, bits, mode, arg, uniform)
        return cls([float(x) for x in q.low], [float(x) for x in q.width], bits)

    def encode(self, x: np.ndarray) -> np.ndarray:
        low, width, top = np.array(self.low), np.array(self.width), float((1 << self.bits) - 1)
        unit = np.where(width == 0, 0.0, np.clip((x - low) / np.where(width == 0, 1.0, width), 0.0, 1.0))
        level = np.floor(unit * top).astype(np.uint8)
        if self.bits == 8:
            return level
        one = np.unpackbits(level[:, :, None], axis=2)[:, :, 8 - self.bits :]
        return np.packbits(one.reshape(len(x), -1), axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        d, top = len(self.low), float((1 << self.bits) - 1)
        level = codes
        if self.bits != 8:
            one = np.unpackbits(codes, axis=1, count=d * self.bits).reshape(len(codes), d, self.bits)
            level = (one * (1 << np.arange(self.bits)[::-1])).sum(2)
        return np.array(self.low) + np.array(self.width) * ((level + 0.5) / top)


@dataclass
class HalfCodec(Codec):
    """16-bit floats: IEEE halves, or the upper half of a 32-bit float rounded to even."""

    brain: bool = False
    kind = "half"

    def encode(self, x: np.ndarray) -> np.ndarray:
        if not self.brain:
            return x.astype("<f2").view(np.uint8)
        w = x.astype("<f4").view("<u4")
        return ((w + 0x7FFF + ((w >> 16) & 1)) >> 16).astype("<u2").view(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        c = np.ascontiguousarray(codes)
        if not self.brain:
            return c.view("<f2").astype(float)
        return (c.view("<u2").astype("<u4") << 16).view("<f4").astype(float)


@dataclass
class DirectCodec(Codec):
    """Whole numbers from 0 to 255, or with `signed` from -128 to 127, as they are."""

    signed: bool = False
    kind = "direct"

    def encode(self, x: np.ndarray) -> np.ndarray:
        shift = 128 if self.signed else 0
        return np.clip(np.rint(x) + shift, 0, 255).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return codes.astype(float) - (128 if self.signed else 0)


@dataclass
class OneBitCodec(Codec):
    """One bit a dimension around a centre, with the squared norm and the scale of the difference as 32-bit floats."""

    center: list[float]
    kind = "onebit"

    @classmethod
    def train(cls, base: DataFrame) -> OneBitCodec:
        return cls([float(x) for x in transforms.moments(base)[1]])

    def encode(self, x: np.ndarray) -> np.ndarray:
        r = x - np.array(self.center)
        n2, l1 = (r * r).sum(1), np.abs(r).sum(1)
        dp = np.where(l1 > 0, n2 * np.sqrt(r.shape[1]) / np.where(l1 > 0, l1, 1.0), 0.0)
        return np.concatenate([np.stack([n2, dp], 1).astype("<f4").view(np.uint8), np.packbits(r > 0, axis=1)], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        d = len(self.center)
        dp = np.ascontiguousarray(codes[:, 4:8]).view("<f4").astype(float)
        return np.array(self.center) + dp / np.sqrt(d) * (np.unpackbits(codes[:, 8:], axis=1, count=d) * 2.0 - 1.0)

    def scores(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        y = q - np.array(self.center)
        n2 = np.ascontiguousarray(codes[:, :4]).view("<f4").astype(float)[:, 0]
        return n2[None, :] + (y * y).sum(1)[:, None] - 2 * y @ (self.decode(codes) - np.array(self.center)).T


@dataclass
class SignCodec(Codec):
    """One bit a dimension: whether it is at least its threshold.  Scores are Hamming distances."""

    thresholds: list[float]
    kind = "sign"

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x >= np.array(self.thresholds), axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.unpackbits(codes, axis=1, count=len(self.thresholds)).astype(float)

    def scores(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.encode(q)[:, None, :] ^ codes[None, :, :]).sum(2).astype(float)


@dataclass
class SpectralCodec(Codec):
    """One bit a dimension: the parity of the half period that (x - shift) falls in.  Scores are Hamming distances."""

    shift: list[float]
    period: float = 1.0
    kind = "spectral"

    @classmethod
    def train(cls, base: DataFrame, period: float, thresholds: str = "global") -> SpectralCodec:
        """Thresholds: `global` 0, `median` the medians; with lists by residual, 0 is the centroid."""
        if thresholds == "median":
            each = base.select(F.posexplode(F.col("vec").cast("array<double>")).alias("j", "x"))
            return cls([float(r["m"]) for r in each.groupBy("j").agg(F.median("x").alias("m")).orderBy("j").collect()], period)
        dim = base.agg(F.max(F.size("vec"))).first()[0] or 0
        return cls([0.0] * dim, period)

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(np.floor((x - np.array(self.shift)) * 2.0 / self.period).astype(np.int64) & 1, axis=1)

    def scores(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.encode(q)[:, None, :] ^ codes[None, :, :]).sum(2).astype(float)


CODECS = {c.kind: c for c in (ScalarCodec, HalfCodec, DirectCodec, OneBitCodec, SignCodec, SpectralCodec)}
TRAIN = {
    "SQ8": lambda b: ScalarCodec.train(b, 8),
    "SQ6": lambda b: ScalarCodec.train(b, 6),
    "SQ4": lambda b: ScalarCodec.train(b, 4),
    "SQfp16": lambda b: HalfCodec(),
    "SQbf16": lambda b: HalfCodec(True),
    "SQ8direct": lambda b: DirectCodec(),
    "SQ8directsigned": lambda b: DirectCodec(True),
    "RaBitQ": OneBitCodec.train,
}


@dataclass
class CodedIvf:
    """centroids (nlist x d), lists(id, cid, code), and whether codes are of differences from the centroid."""

    centroids: np.ndarray
    lists: DataFrame
    codec: Codec
    by_residual: bool

    @classmethod
    def build(cls, base: DataFrame, nlist: int, codec: str | Codec = "SQ8", iterations: int = 10, by_residual: bool = True, centroids: np.ndarray | None = None) -> CodedIvf:
        """codec: a name of TRAIN, or a codec that is already fitted (on residuals, with by_residual)."""
        if centroids is None:
            centroids, _ = cluster.lloyd(base, cluster.seeds(base, nlist), iterations)
        dealt = cluster.assign(base, centroids, keep=("id", "vec"))
        rest = _residuals(dealt, centroids) if by_residual else dealt
        fitted = TRAIN[codec](rest) if isinstance(codec, str) else codec

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    codes = fitted.encode(matrix(batch.column(2)))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "cid", "code"])

        lists = rest.select(F.col("id").cast("long").alias("id"), F.col("cid").cast("int").alias("cid"), "vec").mapInArrow(run, "id long, cid int, code binary")
        return cls(centroids, lists, fitted, by_residual)

    def search(self, queries: DataFrame, k: int, nprobe: int, assigned: DataFrame | None = None) -> DataFrame:
        """(qid, rank, id, dist).  assigned(qid, cid): the lists of each query instead of its nearest ones."""
        codec, centroids, by_residual = self.codec, self.centroids, self.by_residual
        size = codec.size(centroids.shape[1])

        def score(q: np.ndarray, cid: int, codes: pa.Array) -> np.ndarray:
            return codec.scores(q - centroids[cid] if by_residual else q, codes_of(codes, size))

        blocks = [(qids, q, asking_lists(qids, q, centroids, nprobe, assigned)) for qids, q in query_blocks(queries)]
        return scan_lists(self.lists.select("id", "cid", "code"), blocks, k, score)

    def reconstruct(self) -> DataFrame:
        """(id, cid, vec): the vectors that the codes stand for."""
        codec, centroids, by_residual = self.codec, self.centroids, self.by_residual
        size = codec.size(centroids.shape[1])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = codec.decode(codes_of(batch.column(2), size))
                    x = x + centroids[batch.column(1).to_numpy()] if by_residual else x
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "cid", "vec"])

        return self.lists.select("id", "cid", "code").mapInArrow(run, "id long, cid int, vec array<double>")

    def save(self, path: str) -> None:
        spark = self.lists.sparkSession
        cluster.centroid_table(spark, self.centroids).coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        self.lists.repartition("cid").sortWithinPartitions("cid", "id").write.mode("overwrite").partitionBy("cid").parquet(f"{path}/lists")
        write_manifest(spark, path, {"kind": "coded_ivf", "nlist": len(self.centroids), "dim": int(self.centroids.shape[1]), "by_residual": self.by_residual, "codec": self.codec.kind, "fitted": json.dumps(asdict(self.codec))})

    @classmethod
    def load(cls, spark: SparkSession, path: str, **expect: object) -> CodedIvf:
        held = read_manifest(spark, path, {"kind": "coded_ivf", **expect})
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cid").collect()
        codec = CODECS[held["codec"]](**json.loads(held["fitted"]))
        return cls(np.array([r["cvec"] for r in rows]), spark.read.parquet(f"{path}/lists").select("id", "cid", "code"), codec, held["by_residual"])


def _residuals(dealt: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(2)) - centroids[batch.column(1).to_numpy()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "cid", "vec"])

    return dealt.select(F.col("id").cast("long").alias("id"), F.col("cid").cast("int").alias("cid"), "vec").mapInArrow(run, "id long, cid int, vec array<double>")


def binary_ivf(base: DataFrame, nlist: int, iterations: int = 10) -> CodedIvf:
    """An inverted file over the sign bits of base: binary centroids, Hamming distances everywhere.

    Centroids are means of bits, set where more than half of the list's rows are.
    """
    dim = base.agg(F.max(F.size("vec"))).first()[0] or 0
    as_bits = base.select("id", F.transform("vec", lambda x: (x >= 0).cast("double")).alias("vec"))
    means, _ = cluster.lloyd(as_bits, cluster.seeds(as_bits, nlist), iterations)
    return CodedIvf.build(as_bits, nlist, SignCodec([0.5] * dim), by_residual=False, centroids=(means > 0.5).astype(float))
