"""Vector transforms that are learned by aggregation: centring, PCA, rotations, ITQ, OPQ.

Moments are added up inside each task (a d x d matrix a task); decompositions run on the
driver over d x d matrices.  ITQ and OPQ fit on the `sample` smallest ids, a documented
bound; everything is applied to all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import cluster
from quillon.operators.exact import matrix
from quillon.operators.pq import ProductQuantizer

SAMPLE = 20_000


@dataclass
class Linear:
    """x -> a x + b."""

    a: np.ndarray
    b: np.ndarray

    def apply(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        at = df.columns.index(vec)
        ddl = ", ".join(f"`{f.name}` {'array<double>' if f.name == vec else f.dataType.simpleString()}" for f in df.schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cols = list(batch.columns)
                x = matrix(cols[at])
                cols[at] = pa.array(list(x @ self.a.T + self.b) if len(x) else [], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

        return df.mapInArrow(run, ddl)

    def reverse(self) -> Linear:
        """For orthonormal rows."""
        return Linear(self.a.T, -self.b @ self.a)

    def then(self, other: Linear) -> Linear:
        return Linear(other.a @ self.a, other.a @ self.b + other.b)


def moments(base: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance (population)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, c = 0, 0.0, 0.0
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):
                n, s, c = n + len(x), s + x.sum(0), c + x.T @ x
        if n:
            d = len(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1).astype(np.int32)), pa.array(np.full(d + 1, n)), pa.array(np.zeros(d + 1)), pa.array(np.zeros(d + 1)), pa.array([s, *c], pa.list_(pa.float64()))], names=["cid", "n", "w", "loss", "s"])

    got = base.select("vec").mapInArrow(run, cluster._SUMS).groupBy("cid").applyInArrow(cluster._add, cluster._SUMS).toArrow().sort_by("cid")
    n, m = int(got["n"][0].as_py()), matrix(got["s"])
    mean = m[0] / n
    return n, mean, m[1:] / n - np.outer(mean, mean)


def centring(base: DataFrame) -> Linear:
    _, mean, _ = moments(base)
    return Linear(np.eye(len(mean)), -mean)


def random_rotation(d_in: int, d_out: int | None = None, seed: int = 12345) -> Linear:
    d_out = d_out or d_in
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(max(d_in, d_out), max(d_in, d_out))))
    return Linear(q[:d_out, :d_in], np.zeros(d_out))


def pca(base: DataFrame, d_out: int, eigen_power: float = 0.0, epsilon: float = 0.0) -> Linear:
    """Principal axes by falling variance; rows are scaled by (eigenvalue + epsilon) ** eigen_power, -0.5 whitens."""
    _, mean, cov = moments(base)
    value, vector = np.linalg.eigh(cov)
    order = np.argsort(value)[::-1][:d_out]
    a = vector[:, order].T
    a = a * np.sign(a[np.arange(len(a)), np.abs(a).argmax(1)])[:, None]
    if eigen_power:
        a = a * (np.maximum(value[order], 0) + epsilon)[:, None] ** eigen_power
    return Linear(a, -a @ mean)


def itq(base: DataFrame, d_out: int, iterations: int = 50, sample: int = SAMPLE, seed: int = 123) -> Linear:
    """Rotation after PCA that brings values near their signs."""
    start = pca(base, d_out)
    x = cluster.drawn(base, sample, seed) @ start.a.T + start.b
    r = random_rotation(d_out, seed=seed).a
    for _ in range(iterations):
        u, _, vt = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
        r = (u @ vt).T
    return start.then(Linear(r.T, np.zeros(d_out)))


def opq(base: DataFrame, m: int, k: int = 16, iterations: int = 10, sample: int = SAMPLE, seed: int = 123) -> Linear:
    """Rotation that lowers the product-quantization error, by turns of quantizing and of Procrustes."""
    x = cluster.drawn(base, sample, seed)
    r = np.eye(x.shape[1])
    books = None
    for _ in range(iterations):
        y = x @ r.T
        if books is None:
            books = y[:k].reshape(-1, m, x.shape[1] // m).transpose(1, 0, 2).copy()
        pq = ProductQuantizer(books)
        codes = pq.codes_of(y)
        for j in range(m):
            for c in np.unique(codes[:, j]):
                books[j][c] = y[codes[:, j] == c, j * pq.width : (j + 1) * pq.width].mean(0)
        u, _, vt = np.linalg.svd(pq.decode_of(pq.codes_of(y)).T @ x)
        r = u @ vt
    return Linear(r, np.zeros(len(r)))


def residual_codebooks(base: DataFrame, levels: int, k: int, iterations: int = 5) -> list[np.ndarray]:
    """Residual quantizer: a chain of Lloyd runs, each on what the last left over."""
    books, rest = [], base.select("id", F.col("vec").cast("array<double>").alias("vec"))
    for _ in range(levels):
        book, _ = cluster.lloyd(rest, cluster.seeds(rest, k), iterations)
        books.append(book)
        rest = residual(rest, book)
    return books


def residual(rows: DataFrame, book: np.ndarray) -> DataFrame:
    """rows(id, vec) less the nearest codeword of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            y = x - book[cluster.nearest(x, book)[0]] if len(x) else x
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(y), pa.list_(pa.float64()))], names=["id", "vec"])

    return rows.select("id", "vec").mapInArrow(run, "id long, vec array<double>")
