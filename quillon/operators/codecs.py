"""Codecs and hashes: scalar quantizers, row-wise min-max, sign hashes, binary search, 1-bit residual codes.

All are Column expressions over a bounded model (a few numbers a dimension); searches on
the results are exact joins (see exact.py) with the fitting metric.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.metrics import Metric
from quillon.functions.vectors import dbl, inner_product, sign_bits, total, zipped
from quillon.operators.exact import knn_join


def _array(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


@dataclass
class ScalarQuantizer:
    """Per-dimension ranges; codes have `bits` bits: floor of the scaled value, decoded to the middle of its step."""

    low: list[float]
    width: list[float]
    bits: int = 8

    @classmethod
    def train(cls, base: DataFrame, bits: int = 8, mode: str = "minmax", arg: float = 0.0, uniform: bool = False) -> ScalarQuantizer:
        """minmax: widened by arg times the range on both sides; meanstd: mean +- arg * std."""
        each = base.select(F.posexplode(dbl("vec")).alias("j", "x"))
        stats = each.groupBy("j").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"), F.var_pop("x").alias("var")).orderBy("j").collect()
        if mode == "minmax":
            low = [r["lo"] - arg * (r["hi"] - r["lo"]) for r in stats]
            high = [r["hi"] + arg * (r["hi"] - r["lo"]) for r in stats]
        elif mode == "meanstd":
            std = [r["var"] ** 0.5 if r["var"] > 0 else 1.0 for r in stats]
            low = [r["mean"] - arg * s for r, s in zip(stats, std)]
            high = [r["mean"] + arg * s for r, s in zip(stats, std)]
        else:
            raise ValueError(mode)
        if uniform:
            low, high = [min(low)] * len(low), [max(high)] * len(high)
        return cls(low, [h - a for a, h in zip(low, high)], bits)

    def encode(self, vec: Column | str) -> Column:
        top = float((1 << self.bits) - 1)
        spec = F.arrays_zip(dbl(vec).alias("x"), _array(self.low).alias("lo"), _array(self.width).alias("w"))
        unit = lambda r: F.when(r["w"] == 0, 0.0).otherwise(F.least(F.greatest((r["x"] - r["lo"]) / F.when(r["w"] == 0, 1.0).otherwise(r["w"]), F.lit(0.0)), F.lit(1.0)))
        return F.transform(spec, lambda r: F.floor(unit(r) * top).cast("smallint"))

    def decode(self, code: Column | str) -> Column:
        top = float((1 << self.bits) - 1)
        spec = F.arrays_zip((F.col(code) if isinstance(code, str) else code).alias("c"), _array(self.low).alias("lo"), _array(self.width).alias("w"))
        return F.transform(spec, lambda r: r["lo"] + r["w"] * ((r["c"] + F.lit(0.5)) / top))


def rowwise_encode(vec: Column | str, bits: int = 8) -> Column:
    """struct(scale, low, code): each row scaled to its own minimum and maximum."""
    v = dbl(vec)
    low, scale = F.array_min(v), F.array_max(v) - F.array_min(v)
    top = float((1 << bits) - 1)
    code = F.transform(v, lambda x: F.when(scale == 0, 0).otherwise(F.floor((x - low) / F.when(scale == 0, 1.0).otherwise(scale) * top)).cast("smallint"))
    return F.struct(scale.alias("scale"), low.alias("low"), code.alias("code"))


def rowwise_decode(coded: Column, bits: int = 8) -> Column:
    top = float((1 << bits) - 1)
    return F.transform(coded["code"], lambda c: (c + F.lit(0.5)) / top * coded["scale"] + coded["low"])


def as_numbers(bits: Column) -> Column:
    """Bits as doubles, so that Hamming distance is the l1 metric."""
    return F.transform(bits, lambda b: b.cast("double"))


@dataclass
class SignHash:
    """Bits of the first nbits dimensions (after any rotation) against a threshold: 0 or the trained median."""

    nbits: int
    thresholds: list[float] | None = None

    @classmethod
    def train(cls, base: DataFrame, nbits: int) -> SignHash:
        """Medians: the mean of the two middle values where the number of rows is even."""
        each = base.select(F.posexplode(F.slice(dbl("vec"), 1, nbits)).alias("j", "x"))
        got = each.groupBy("j").agg(F.median("x").alias("m")).orderBy("j").collect()
        return cls(nbits, [r["m"] for r in got])

    def bits(self, vec: Column | str) -> Column:
        v = F.slice(dbl(vec), 1, self.nbits)
        if self.thresholds is not None:
            v = F.zip_with(v, _array(self.thresholds), lambda x, t: x - t)
        return sign_bits(v)

    def search(self, base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        b = base.select("id", as_numbers(self.bits("vec")).alias("vec"))
        q = queries.select("qid", as_numbers(self.bits("qvec")).alias("qvec"))
        return knn_join(b, q, k, "l1")


def spectral_bits(vec: Column | str, period: float, shift: Column | None = None) -> Column:
    """floor((x - c) * 2 / period) mod 2, with c = 0 or a vector of thresholds."""
    v = dbl(vec) if shift is None else zipped(dbl(vec), shift, lambda x, c: x - c)
    return F.transform(v, lambda x: F.pmod(F.floor(x * 2.0 / period).cast("long"), F.lit(2)).cast("int"))


def bucket_keys(key: Column, bits: int, flips: int) -> Column:
    """All keys within `flips` bit flips of a key of `bits` bits."""
    masks = [sum(1 << b for b in c) for r in range(flips + 1) for c in itertools.combinations(range(bits), r)]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: m.bitwiseXOR(key))


def hash_search(base: DataFrame, queries: DataFrame, bits: int, flips: int) -> DataFrame:
    """(qid, id, words): rows whose first `bits` bits are within `flips` flips of the query's; tables (id, words), (qid, qwords) of packed bits."""
    low = (1 << bits) - 1
    b = base.select("id", "words", F.col("words")[0].bitwiseAND(F.lit(low).cast("long")).alias("key"))
    q = queries.select("qid", "qwords", F.explode(bucket_keys(F.col("qwords")[0].bitwiseAND(F.lit(low).cast("long")), bits, flips)).alias("key"))
    return b.join(q, "key").select("qid", "qwords", "id", "words")


def rabitq_encode(vec: Column | str, center: Column) -> Column:
    """[squared norm of the residual, its scale, one bit a dimension as 0 or 1]."""
    r = zipped(dbl(vec), center, lambda x, c: x - c)
    n2 = inner_product(r, r)
    l1 = total(F.transform(r, F.abs))
    dp = F.when(l1 > 0, n2 * F.sqrt(F.size(r).cast("double")) / F.when(l1 > 0, l1).otherwise(1.0)).otherwise(0.0)
    return F.concat(F.array(n2, dp), F.transform(r, lambda x: (x > 0).cast("double")))


def _rabitq_kernel(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    root = np.sqrt(q.shape[1])
    dot = (2 * (q @ b[:, 2:].T) - q.sum(1)[:, None]) / root
    return b[:, 0][None, :] + (q * q).sum(1)[:, None] - 2 * b[:, 1][None, :] * dot


def _rabitq_column(q: Column, b: Column) -> Column:
    bits = F.slice(b, 3, F.size(q))
    dot = (2 * total(F.zip_with(q, bits, lambda x, y: x * y)) - total(q)) / F.sqrt(F.size(q).cast("double"))
    return b[0] + inner_product(q, q) - 2 * b[1] * dot


#: Estimated squared distance between a centred query and a 1-bit code.
RABITQ = Metric("rabitq", _rabitq_column, _rabitq_kernel)
