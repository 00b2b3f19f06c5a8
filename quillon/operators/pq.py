"""Product quantization: codebooks, codes, asymmetric and symmetric search, quantized tables, re-ranking.

Codebooks are the bounded side (M x K x d/M doubles).  Training adds up sub-vectors inside
each task; encoding and table look-ups are matrix work on Arrow batches; a search shuffles
only the best candidates of each task.  Codes are BINARY, one byte (K <= 256) a sub-space.
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
from quillon.operators.exact import _Best, knn_among, matrix, query_blocks
from quillon.operators.rerank import LISTED, Scores, knn_reranked, with_vectors
from quillon.operators.topk import top_k, union


def codes_matrix(column: pa.Array, m: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, m)


def looked_up(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Sum of each code's entries in a table (M x K), from the first sub-space to the last: equal codes have equal sums."""
    out = np.zeros(len(codes))
    for j in range(codes.shape[1]):
        out += table[j][codes[:, j]]
    return out


def annealed(distances: np.ndarray, steps: int = 20_000, seed: int = 0) -> np.ndarray:
    """A number for each of K = 2^b codewords, so that bits in which numbers differ follow the codewords' distances.

    Distances are brought to the mean and spread of Hamming distances; near pairs weigh
    most (2 to the minus their target).  Simulated annealing swaps two numbers at a time;
    the best numbering seen is returned, at worst the given one.
    """
    k = len(distances)
    bits = k.bit_length() - 1
    if k != 1 << bits:
        raise ValueError(f"{k} codewords are no power of two")
    number, pairs = np.arange(k), ~np.eye(k, dtype=bool)
    if k < 4 or distances[pairs].std() == 0:
        return number
    hamming = np.bitwise_count(number[:, None] ^ number[None, :]).astype(float)
    scaled = (distances - distances[pairs].mean()) / distances[pairs].std()
    target = scaled * hamming[pairs].std() + hamming[pairs].mean()
    weight = np.where(pairs, 0.5**target, 0.0)
    r = np.random.default_rng(seed)
    swaps, luck = r.integers(0, k, (steps, 2)), np.log(r.random(steps))
    gain, least, best, heat = 0.0, 0.0, number.copy(), None
    for step, (a, b) in enumerate(swaps):
        if a == b:
            continue
        now_a, now_b = hamming[number[a]][number], hamming[number[b]][number]
        change = weight[a] * ((target[a] - now_b) ** 2 - (target[a] - now_a) ** 2) + weight[b] * ((target[b] - now_a) ** 2 - (target[b] - now_b) ** 2)
        change[[a, b]] = 0.0  # the two keep their distance
        delta = 2 * float(change.sum())
        heat = abs(delta) if heat is None else heat
        if delta <= 0 or luck[step] * heat * 0.001 ** (step / steps) < -delta:
            number[a], number[b] = number[b], number[a]
            gain += delta
            if gain < least:
                least, best = gain, number.copy()
    return best


@dataclass
class ProductQuantizer:
    """codebooks: M x K x sub-dimension."""

    codebooks: np.ndarray

    @property
    def m(self) -> int:
        return self.codebooks.shape[0]

    @property
    def k(self) -> int:
        return self.codebooks.shape[1]

    @property
    def width(self) -> int:
        return self.codebooks.shape[2]

    @classmethod
    def train(cls, base: DataFrame, m: int, k: int, iterations: int = 10) -> ProductQuantizer:
        """Lloyd's algorithm in every sub-space at once; seeds are the vectors of the k smallest ids."""
        start = cluster.seeds(base, k)
        d = start.shape[1]
        if d % m:
            raise ValueError(f"dimension {d} is not a multiple of {m}")
        if k > 256:
            raise ValueError("codes have one byte")
        books = start.reshape(len(start), m, d // m).transpose(1, 0, 2).copy()
        for _ in range(iterations):
            books = cls(books)._step(base)
        return cls(books)

    def polysemous(self, steps: int = 20_000, seed: int = 0) -> ProductQuantizer:
        """The same codewords numbered anew, so that Hamming distances of codes tell near from far (max_hamming)."""
        books = np.empty_like(self.codebooks)
        for j, book in enumerate(self.codebooks):
            books[j][annealed(np.sqrt(_l2(book, book)), steps, seed + j)] = book
        return ProductQuantizer(books)

    def _step(self, base: DataFrame) -> np.ndarray:
        books, m, k, w = self.codebooks, self.m, self.k, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, s = np.zeros((m, k), np.int64), np.zeros((m, k, w))
            for batch in batches:
                x = matrix(batch.column(0))
                for j in range(m if len(x) else 0):
                    sub = x[:, j * w : (j + 1) * w]
                    best, _ = cluster.nearest(sub, books[j])
                    n[j] += np.bincount(best, minlength=k)
                    np.add.at(s[j], best, sub)
            key = np.arange(m * k)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(n.ravel()), pa.array(n.ravel() * 1.0), pa.array(np.zeros(m * k)), pa.array(list(s.reshape(m * k, w)), pa.list_(pa.float64()))], names=["cid", "n", "w", "loss", "s"])

        got = base.select("vec").mapInArrow(run, cluster._SUMS).groupBy("cid").applyInArrow(cluster._add, cluster._SUMS).toArrow()
        out = books.reshape(m * k, w).copy()
        cid, n = got["cid"].to_numpy(), got["n"].to_numpy()
        out[cid[n > 0]] = matrix(got["s"])[n > 0] / n[n > 0][:, None]
        return out.reshape(m, k, w)

    def codes_of(self, x: np.ndarray) -> np.ndarray:
        w = self.width
        return np.stack([cluster.nearest(x[:, j * w : (j + 1) * w], self.codebooks[j])[0] for j in range(self.m)], 1).astype(np.uint8) if len(x) else np.zeros((0, self.m), np.uint8)

    def decode_of(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.codebooks[j][codes[:, j]] for j in range(self.m)], 1)

    def encode(self, base: DataFrame) -> DataFrame:
        """(id, code)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = self.codes_of(matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "code"])

        return base.select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(run, "id long, code binary")

    def decode(self, codes: DataFrame) -> DataFrame:
        """(id, vec): the vectors that codes stand for."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = self.decode_of(codes_matrix(batch.column(1), self.m))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "vec"])

        return codes.select("id", "code").mapInArrow(run, "id long, vec array<double>")

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of each query's sub-vectors to the codewords: queries x M x K."""
        w = self.width
        return np.stack([_l2(q[:, j * w : (j + 1) * w], self.codebooks[j]) for j in range(self.m)], 1)

    def _symmetric_tables(self, q: np.ndarray) -> np.ndarray:
        return self.tables(self.decode_of(self.codes_of(q)))

    def scores(self) -> Scores:
        """Summed table entries of rows(code), as search() has them."""

        def of(q: np.ndarray):
            lut = self.tables(q)

            def cost(batch: pa.RecordBatch) -> np.ndarray:
                c = codes_matrix(batch["code"], self.m)
                return np.stack([looked_up(t, c) for t in lut])

            return cost

        return of

    def search(self, codes: DataFrame, queries: DataFrame, k: int, mode: str = "adc", max_hamming: int | None = None) -> DataFrame:
        """(qid, rank, id, dist) by summed table entries.

        mode: `adc` exact queries, `sdc` encoded queries, `fast` tables rounded to bytes with
        one scale a query (dist is the integer sum).  max_hamming: only codes that differ from
        the query's code in fewer bits are scored.
        """
        parts = []
        for qids, q in query_blocks(queries):
            lut = self._symmetric_tables(q) if mode == "sdc" else self.tables(q)
            if mode == "fast":
                scale = lut.reshape(len(q), -1).max(1) / 255.0
                lut = np.minimum(255, np.floor(lut / np.where(scale > 0, scale, 1.0)[:, None, None] + 0.5))
            own = self.codes_of(q)

            def run(batches: Iterator[pa.RecordBatch], qids=qids, lut=lut, own=own) -> Iterator[pa.RecordBatch]:
                best = _Best(len(qids), k)
                for batch in batches:
                    ids, c = batch.column(0).to_numpy(), codes_matrix(batch.column(1), self.m)
                    for i in range(len(qids)):
                        pick = slice(None)
                        if max_hamming is not None:
                            pick = np.flatnonzero(np.bitwise_count(c ^ own[i]).sum(1) < max_hamming)
                        best.add(i, looked_up(lut[i], c[pick]) if mode == "adc" else np.round(looked_up(lut[i], c[pick]), 9), ids[pick])
                n = [len(x) for x in best.ids]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, n)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.cost))], names=["qid", "id", "dist"])

            parts.append(codes.select("id", "code").mapInArrow(run, "qid long, id long, dist double"))
        return top_k(union(parts, codes.sparkSession), k).select("qid", "rank", "id", "dist")

    def search_reranked(self, codes: DataFrame, base: DataFrame, queries: DataFrame, k: int, rerank: int, mode: str = "adc", rerank_metric: str = "l2") -> DataFrame:
        """The best `rerank` (at least k) by codes, re-ranked by exact distance; up to LISTED of them are listed, more are found in place."""
        if max(rerank, k) > LISTED and mode == "adc":
            return knn_reranked(with_vectors(codes.select("id", "code"), base), self.scores(), rerank, queries, k, metric_name=rerank_metric)
        return knn_among(self.search(codes, queries, max(rerank, k), mode), base, queries, k, rerank_metric)
