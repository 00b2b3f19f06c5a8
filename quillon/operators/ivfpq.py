"""Inverted lists with product-quantized residuals: codebooks per list or shared, and lists over coded centroids.

The model is bounded (nlist x K x d doubles for codebooks per list).  A search reads codes
in place: each task keeps a running top-k per query over the codes of probed lists, with
look-up tables made once a (query, list).  Stored by list, unprobed lists are not read.
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
from quillon.operators.pq import ProductQuantizer, codes_matrix
from quillon.operators.rerank import LISTED, Scores, knn_reranked, with_vectors
from quillon.operators.topk import top_k, union


@dataclass
class IvfPqIndex:
    """centroids nlist x d; books (nlist or 1) x M x K x w; codes(id, cid, code)."""

    centroids: np.ndarray
    books: np.ndarray
    codes: DataFrame | None = None
    residual: bool = True

    def _model(self) -> IvfPqIndex:
        """The index without its table, as tasks get it."""
        return IvfPqIndex(self.centroids, self.books, None, self.residual)

    @classmethod
    def build(cls, base: DataFrame, nlist: int, m: int, k: int, iterations: int = 5, pq_iterations: int = 5, per_list: bool = True, residual: bool = True) -> IvfPqIndex:
        centroids, _ = cluster.lloyd(base, cluster.seeds(base, nlist), iterations)
        d = centroids.shape[1]
        if d % m:
            raise ValueError(f"dimension {d} is not a multiple of {m}")
        start = cluster.seeds(base, k)
        near, _ = cluster.nearest(start, centroids)
        rest = start - centroids[near] if residual else start
        book = rest.reshape(len(rest), m, d // m).transpose(1, 0, 2)
        books = np.repeat(book[None], nlist if per_list else 1, axis=0).copy()
        index = cls(centroids, books, None, residual)
        for _ in range(pq_iterations):
            index.books = index._step(base)
        index.codes = index.encode(base)
        return index

    def _rest(self, x: np.ndarray, cid: np.ndarray) -> np.ndarray:
        return x - self.centroids[cid] if self.residual else x

    def _book(self, c: int) -> np.ndarray:
        return self.books[c if len(self.books) > 1 else 0]

    def _codes(self, rest: np.ndarray, cid: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rest), self.books.shape[1]), np.uint8)
        groups = np.unique(cid) if len(self.books) > 1 else [0]
        for c in groups:
            own = np.flatnonzero(cid == c) if len(self.books) > 1 else np.arange(len(rest))
            out[own] = ProductQuantizer(self._book(c)).codes_of(rest[own])
        return out

    def _step(self, base: DataFrame) -> np.ndarray:
        lists, m, k, w = self.books.shape
        model = self._model()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, s = np.zeros((lists, m, k), np.int64), np.zeros((lists, m, k, w))
            for batch in batches:
                x = matrix(batch.column(0))
                if not len(x):
                    continue
                cid, _ = cluster.nearest(x, model.centroids)
                rest = model._rest(x, cid)
                codes = model._codes(rest, cid)
                at = cid if lists > 1 else np.zeros(len(x), int)
                for j in range(m):
                    np.add.at(n, (at, j, codes[:, j]), 1)
                    np.add.at(s, (at, j, codes[:, j]), rest[:, j * w : (j + 1) * w])
            hit = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(n.ravel()[hit]), pa.array(n.ravel()[hit] * 1.0), pa.array(np.zeros(len(hit))), pa.array(list(s.reshape(-1, w)[hit]), pa.list_(pa.float64()))], names=["cid", "n", "w", "loss", "s"])

        got = base.select("vec").mapInArrow(run, cluster._SUMS).groupBy("cid").applyInArrow(cluster._add, cluster._SUMS).toArrow()
        out = self.books.reshape(-1, w).copy()
        out[got["cid"].to_numpy()] = matrix(got["s"]) / got["n"].to_numpy()[:, None]
        return out.reshape(self.books.shape)

    def encode(self, base: DataFrame) -> DataFrame:
        model = self._model()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(1))
                cid = cluster.nearest(x, model.centroids)[0] if len(x) else np.zeros(0, int)
                codes = model._codes(model._rest(x, cid), cid) if len(x) else np.zeros((0, 1), np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cid.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "cid", "code"])

        return base.select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(run, "id long, cid int, code binary")

    def coarse(self, q: np.ndarray, nprobe: int) -> np.ndarray:
        """Lists of each query, nearest first."""
        d = np.round(_l2(q, self.centroids), 9)
        return np.argsort(d, axis=1, kind="stable")[:, : min(nprobe, len(self.centroids))]

    def scores(self, nprobe: int) -> Scores:
        """Summed table entries of rows(cid, code) of the lists that a query asks."""
        model, m = self._model(), self.books.shape[1]

        def of(q: np.ndarray):
            probes, made = model.coarse(q, nprobe), {}

            def cost(batch: pa.RecordBatch) -> np.ndarray:
                out, cids, codes = np.full((len(q), batch.num_rows), np.nan), batch["cid"].to_numpy(), codes_matrix(batch["code"], m)
                for c in np.unique(cids):
                    own, who = np.flatnonzero(cids == c), np.flatnonzero((probes == c).any(1))
                    if not len(who):
                        continue
                    if c not in made:
                        made[c] = ProductQuantizer(model._book(c)).tables(model._rest(q[who], np.full(len(who), c)))
                    total = np.zeros((len(who), len(own)))
                    for j in range(m):
                        total += made[c][:, j].take(codes[own, j], axis=1)
                    out[np.ix_(who, own)] = total
                return out

            return cost

        return of

    def search(self, queries: DataFrame, k: int, nprobe: int, rerank: int = 0, base: DataFrame | None = None) -> DataFrame:
        """(qid, rank, id, dist): by codes, or with rerank by exact distances of the best max(rerank, k)."""
        keep = max(rerank, k)
        if rerank and keep > LISTED:
            return knn_reranked(with_vectors(self.codes.select("id", "cid", "code"), base), self.scores(nprobe), keep, queries, k)
        m, model = self.books.shape[1], self._model()
        parts = []
        for qids, q in query_blocks(queries):
            probes = self.coarse(q, nprobe)
            probed = sorted({int(c) for c in probes.ravel()})
            asking = {c: np.flatnonzero((probes == c).any(1)) for c in probed}

            def run(batches: Iterator[pa.RecordBatch], qids=qids, q=q, asking=asking) -> Iterator[pa.RecordBatch]:
                best, at, made = _Best(len(qids), keep), np.arange(m), {}
                for batch in batches:
                    ids, cids, codes = batch.column(0).to_numpy(), batch.column(1).to_numpy(), codes_matrix(batch.column(2), m)
                    for c in np.unique(cids):
                        own = np.flatnonzero(cids == c)
                        who = asking.get(int(c), ())
                        if len(who) and c not in made:
                            made[c] = ProductQuantizer(model._book(c)).tables(model._rest(q[who], np.full(len(who), c)))
                        for i, x in enumerate(who):
                            best.add(x, made[c][i][at, codes[own]].sum(1), ids[own])
                n = [len(x) for x in best.ids]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, n)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.cost))], names=["qid", "id", "dist"])

            parts.append(self.codes.where(F.col("cid").isin(probed)).select("id", "cid", "code").mapInArrow(run, "qid long, id long, dist double"))
        found = top_k(union(parts, self.codes.sparkSession), keep).select("qid", "rank", "id", "dist")
        return knn_among(found, base, queries, k) if rerank else found


@dataclass
class PqIvfIndex:
    """Lists over coded centroids: vectors are coded first, centroids are codes, moved by the mode of each position."""

    pq: ProductQuantizer
    centroids: np.ndarray  # nlist x M codes
    codes: DataFrame | None = None  # id, cid, code

    @classmethod
    def build(cls, base: DataFrame, nlist: int, m: int, k: int, pq_iterations: int = 5, iterations: int = 5) -> PqIvfIndex:
        pq = ProductQuantizer.train(base, m, k, pq_iterations)
        encoded = pq.encode(base)
        first = encoded.orderBy("id").limit(nlist).collect()
        centroids = np.array([list(r["code"]) for r in first], np.uint8)
        for _ in range(iterations):
            index = cls(pq, centroids)
            mode = cluster.modes(index.assigned(encoded).select("cid", F.transform(F.sequence(F.lit(1), F.lit(m)), lambda i: F.conv(F.hex(F.substring("code", i, F.lit(1))), 16, 10).cast("int")).alias("code"))).collect()
            new = centroids.copy()
            for r in mode:
                new[r["cid"], r["m"]] = r["code"]
            changed = int((new != centroids).sum())
            centroids = new
            if changed <= 0.01 * centroids.size:
                break
        index = cls(pq, centroids)
        index.codes = index.assigned(encoded)
        return index

    def _between(self) -> np.ndarray:
        """Squared distances between codewords: M x K x K."""
        return np.stack([_l2(b, b) for b in self.pq.codebooks])

    def list_of(self, codes: np.ndarray) -> np.ndarray:
        d = self._symmetric(codes)
        return np.round(d, 9).argmin(1)

    def _symmetric(self, codes: np.ndarray) -> np.ndarray:
        table = self._between()
        return sum(table[j][codes[:, j]][:, self.centroids[:, j]] for j in range(self.pq.m))

    def assigned(self, encoded: DataFrame) -> DataFrame:
        model = PqIvfIndex(self.pq, self.centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cid = model.list_of(codes_matrix(batch.column(1), model.pq.m)) if batch.num_rows else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cid.astype(np.int32)), batch.column(1)], names=["id", "cid", "code"])

        return encoded.select("id", "code").mapInArrow(run, "id long, cid int, code binary")

    def scores(self, nprobe: int) -> Scores:
        """Summed table entries of rows(cid, code) of the lists that a query asks."""
        model = PqIvfIndex(self.pq, self.centroids)

        def of(q: np.ndarray):
            near = np.argsort(np.round(model._symmetric(model.pq.codes_of(q)), 9), axis=1, kind="stable")[:, :nprobe]
            asked = np.zeros((len(q), len(model.centroids)), bool)
            asked[np.arange(len(q))[:, None], near] = True
            coded = model.pq.scores()(q)
            return lambda batch: np.where(asked[:, batch["cid"].to_numpy()], coded(batch), np.nan)

        return of

    def search(self, base: DataFrame, queries: DataFrame, k: int, nprobe: int, rerank: int) -> DataFrame:
        if max(rerank, k) > LISTED:
            return knn_reranked(with_vectors(self.codes.select("id", "cid", "code"), base), self.scores(nprobe), rerank, queries, k)
        parts = []
        for qids, q in query_blocks(queries):
            near = np.argsort(np.round(self._symmetric(self.pq.codes_of(q)), 9), axis=1, kind="stable")[:, :nprobe]
            spark = queries.sparkSession
            probes = spark.createDataFrame([(int(a), int(c)) for a, row in zip(qids, near) for c in row], "qid long, cid int")
            some = self.codes.where(F.col("cid").isin(sorted({int(c) for c in near.ravel()})))
            pairs = some.join(F.broadcast(probes), "cid").select("qid", "id", "code")
            lut = {int(a): t for a, t in zip(qids, self.pq.tables(q))}
            m = self.pq.m

            def run(batches: Iterator[pa.RecordBatch], lut=lut) -> Iterator[pa.RecordBatch]:
                at = np.arange(m)
                for batch in batches:
                    who, codes = batch.column(0).to_numpy(), codes_matrix(batch.column(2), m)
                    d = np.zeros(len(who))
                    for x in np.unique(who):
                        own = np.flatnonzero(who == x)
                        d[own] = lut[int(x)][at, codes[own]].sum(1)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], names=["qid", "id", "dist"])

            parts.append(pairs.mapInArrow(run, "qid long, id long, dist double"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return knn_among(top_k(out, max(rerank, k)), base, queries, k)
