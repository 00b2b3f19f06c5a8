"""Additive quantizers: a vector is a sum of codewords, one of each codebook.

Codebooks are bounded (levels x K x d doubles) and go to the tasks.  Residual quantizers
train as a chain of clusterings over all rows; encoding keeps a beam of the best sums.
Local search improves codes one codebook at a time with the others fixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.metrics import _l2
from quillon.operators import cluster
from quillon.operators.exact import knn_among, knn_join, matrix
from quillon.operators.pq import codes_matrix
from quillon.operators.rerank import LISTED, knn_reranked, with_vectors
from quillon.operators.transforms import residual_codebooks


@dataclass
class AdditiveQuantizer:
    """books: levels x K x d.  `slices` > 1: levels are dealt over equal slices of the dimensions."""

    books: np.ndarray
    beam: int = 1
    rounds: int = 0
    slices: int = 1

    @classmethod
    def train(cls, base: DataFrame, levels: int, k: int, iterations: int = 5, beam: int = 1, rounds: int = 0, slices: int = 1) -> AdditiveQuantizer:
        """A residual quantizer, of each slice by itself; rounds > 0 adds local search to the encoding."""
        rows = base.select("id", F.col("vec").cast("array<double>").alias("vec"))
        if slices == 1:
            return cls(np.stack(residual_codebooks(rows, levels, k, iterations)), beam, rounds)
        d = len(rows.first()["vec"])
        if d % slices:
            raise ValueError(f"dimension {d} is not a multiple of {slices}")
        w, books = d // slices, []
        for s in range(slices):
            for b in residual_codebooks(rows.select("id", F.slice("vec", s * w + 1, w).alias("vec")), levels, k, iterations):
                full = np.zeros((len(b), d))
                full[:, s * w : (s + 1) * w] = b
                books.append(full)
        return cls(np.stack(books), beam, rounds, slices)

    def codes_of(self, x: np.ndarray) -> np.ndarray:
        n, levels = len(x), len(self.books)
        codes = np.zeros((n, 1, levels), np.uint8)
        rest = x[:, None, :]
        for j, book in enumerate(self.books):
            d = np.round(((rest * rest).sum(2)[:, :, None] + (book * book).sum(1) - 2 * rest @ book.T), 9)
            flat = d.reshape(n, -1)
            keep = min(self.beam, flat.shape[1])
            pick = np.argsort(flat, axis=1, kind="stable")[:, :keep]
            parent, code = pick // len(book), pick % len(book)
            codes = np.take_along_axis(codes, parent[:, :, None], 1).copy()
            codes[:, :, j] = code
            rest = np.take_along_axis(rest, parent[:, :, None], 1) - book[code]
        best = codes[:, 0]
        for _ in range(self.rounds):
            for j, book in enumerate(self.books):
                others = x - (self.decode_of(best) - book[best[:, j]])
                best[:, j] = np.round(_l2(others, book), 9).argmin(1)
        return best

    def decode_of(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[j][codes[:, j]] for j in range(len(self.books)))

    def encode(self, base: DataFrame) -> DataFrame:
        """(id, code)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 2048):
                    part = batch.slice(lo, 2048)
                    codes = self.codes_of(matrix(part.column(1)))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "code"])

        return base.select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(run, "id long, code binary")

    def decode(self, codes: DataFrame) -> DataFrame:
        levels = len(self.books)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = self.decode_of(codes_matrix(batch.column(1), levels)) if batch.num_rows else np.zeros((0, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "vec"])

        return codes.select("id", "code").mapInArrow(run, "id long, vec array<double>")

    def search(self, codes: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
        return knn_join(self.decode(codes), queries, k, metric)

    def search_reranked(self, codes: DataFrame, base: DataFrame, queries: DataFrame, k: int, rerank: int) -> DataFrame:
        """The best `rerank` (at least k) by codes, re-ranked by exact distance."""
        if max(rerank, k) <= LISTED:
            return knn_among(self.search(codes, queries, max(rerank, k)), base, queries, k)
        scores = lambda q: lambda batch: _l2(q, self.decode_of(codes_matrix(batch["code"], len(self.books))))
        return knn_reranked(with_vectors(codes.select("id", "code"), base), scores, rerank, queries, k)
