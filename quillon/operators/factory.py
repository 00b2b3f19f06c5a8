"""Index factory: a short description becomes a pipeline of transforms, an index and an optional re-ranking.

Grammar, comma-separated: transforms `L2norm`, `Centern`, `PCAn`, `PCAWn`, `RRn`, `ITQn`,
`OPQm`, `Padn`; then one of `Flat`, `IVFn,Flat`, `IVFn,PQm[xb]`, `IVFn,c`, `PQm[xb]`,
`SQ8`, `SQ6`, `SQ4`, `LSHn[t]`, `HNSWm`, `RaBitQ`, `BIVFn` (binary); then `RFlat` to re-rank by
the vectors themselves.  Coded lists c: `SQ8`, `SQ6`, `SQ4`, `SQfp16`, `SQbf16`, `SQ8direct`,
`SQ8directsigned`, `RaBitQ`.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.vectors import normalised, padded, zipped
from quillon.operators import codecs, graph, ivf, ivfcodes, ivfpq, pq, transforms
from quillon.operators.exact import knn_among, knn_join
from quillon.operators.rerank import LISTED, kernel_scores, knn_reranked, with_vectors


@dataclass
class Index:
    """build(base) fits on base(id, vec) and indexes it; search(queries, k) asks it."""

    description: str
    metric: str = "l2"
    steps: list[Callable[[DataFrame], Callable[[DataFrame, str], DataFrame]]] = field(default_factory=list)
    core: str = "Flat"
    refine: bool = False
    fitted: list = field(default_factory=list)
    base: DataFrame | None = None
    state: object = None

    def _through(self, df: DataFrame, vec: str) -> DataFrame:
        for f in self.fitted:
            df = f(df, vec)
        return df

    def build(self, base: DataFrame, **options: int) -> Index:
        df = base.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"), *[c for c in base.columns if c not in ("id", "vec")])
        self.base, self.fitted = df, []
        for s in self.steps:
            f = s(df)
            self.fitted.append(f)
            df = f(df, "vec")
        it = options.get("iterations", 5)
        c = self.core
        if c == "Flat":
            self.state = df
        elif m := re.fullmatch(r"IVF(\d+),Flat", c):
            self.state = ivf.IvfIndex.build(df, int(m[1]), it)
        elif m := re.fullmatch(r"IVF(\d+),PQ(\d+)(?:x(\d+))?", c):
            self.state = ivfpq.IvfPqIndex.build(df, int(m[1]), int(m[2]), 1 << int(m[3] or 8), it, it, per_list=False)
        elif m := re.fullmatch(r"IVF(\d+),(\w+)", c):
            self.state = ivfcodes.CodedIvf.build(df, int(m[1]), m[2], it)
        elif m := re.fullmatch(r"BIVF(\d+)", c):
            self.state = ivfcodes.binary_ivf(df, int(m[1]), it)
        elif m := re.fullmatch(r"PQ(\d+)(?:x(\d+))?", c):
            q = pq.ProductQuantizer.train(df, int(m[1]), 1 << int(m[2] or 8), it)
            self.state = (q, q.encode(df))
        elif m := re.fullmatch(r"SQ([468])", c):
            q = codecs.ScalarQuantizer.train(df, int(m[1]))
            self.state = (q, df.select("id", q.encode("vec").alias("code")))
        elif m := re.fullmatch(r"LSH(\d+)(t?)", c):
            h = codecs.SignHash.train(df, int(m[1])) if m[2] else codecs.SignHash(int(m[1]))
            self.state = (h, df.select("id", "vec"))
        elif m := re.fullmatch(r"HNSW(\d+)", c):
            self.state = graph.GraphIndex.build(df, int(m[1]), metric_name=self.metric)
        elif c == "RaBitQ":
            mean = transforms.moments(df)[1]
            center = F.array(*[F.lit(float(x)) for x in mean])
            self.state = (center, df.select("id", codecs.rabitq_encode("vec", center).alias("vec")))
        else:
            raise ValueError(f"unknown index {c!r}")
        return self

    def _coded(self, q: DataFrame, nprobe: int):
        """Coded rows, their scores and the queries as these take them; None for indexes whose candidates are always listed."""
        c, s = self.core, self.state
        if isinstance(s, ivfpq.IvfPqIndex):
            return s.codes.select("id", "cid", "code"), s.scores(nprobe), q
        if c.startswith("PQ"):
            return s[1].select("id", "code"), s[0].scores(), q
        if c.startswith("SQ"):
            return s[1].select("id", s[0].decode("code").alias("coded")), kernel_scores(self.metric), q
        if c.startswith("LSH"):
            bits = lambda v: codecs.as_numbers(s[0].bits(v))
            # Of bits, l2 is l1.
            return s[1].select("id", bits("vec").alias("coded")), kernel_scores("l2"), q.select("qid", bits("qvec").alias("qvec"))
        return None

    def search(self, queries: DataFrame, k: int, nprobe: int = 8, ef: int = 64, k_factor: int = 4, where: Column | None = None) -> DataFrame:
        q = self._through(queries.select("qid", F.col("qvec").cast("array<double>").alias("qvec")), "qvec")
        n = k * k_factor if self.refine else k
        c, s = self.core, self.state
        coded = self._coded(q, nprobe) if self.refine and n > LISTED else None
        if coded is not None:
            rows, scores, own = coded
            return knn_reranked(with_vectors(rows, self.base), scores, n, queries, k, own, self.metric)
        if c == "Flat":
            found = knn_join(s, q, n, self.metric, where)
        elif isinstance(s, ivf.IvfIndex):
            found = s.search(q, n, nprobe, self.metric, where)
        elif isinstance(s, ivfcodes.CodedIvf):
            asked = q.withColumn("qvec", F.transform("qvec", lambda x: (x >= 0).cast("double"))) if c.startswith("BIVF") else q
            found = s.search(asked, n, nprobe)
        elif isinstance(s, ivfpq.IvfPqIndex):
            found = s.search(q, n, nprobe)
        elif isinstance(s, graph.GraphIndex):
            found = s.search(q, n, ef, where)
        elif c.startswith("PQ"):
            found = s[0].search(s[1], q, n)
        elif c.startswith("SQ"):
            found = knn_join(s[1].select("id", s[0].decode("code").alias("vec")), q, n, self.metric)
        elif c.startswith("LSH"):
            found = s[0].search(s[1], q, n)
        else:
            found = knn_join(s[1], q.withColumn("qvec", zipped(F.col("qvec"), s[0], lambda x, y: x - y)), n, codecs.RABITQ)
        return knn_among(found, self.base, queries, k, self.metric) if self.refine else found


def _step(name: str):
    linear = lambda fit: lambda base: (lambda t: lambda df, vec: t.apply(df, vec))(fit(base))
    if name == "L2norm":
        return lambda base: lambda df, vec: df.withColumn(vec, normalised(F.col(vec)))
    if name == "Center":
        return linear(transforms.centring)
    if m := re.fullmatch(r"PCA(W?)(\d+)", name):
        return linear(lambda base: transforms.pca(base, int(m[2]), -0.5 if m[1] else 0.0))
    if m := re.fullmatch(r"RR(\d+)", name):
        return linear(lambda base: transforms.random_rotation(len(base.first()["vec"]), int(m[1])))
    if m := re.fullmatch(r"ITQ(\d+)", name):
        return linear(lambda base: transforms.itq(base, int(m[1])))
    if m := re.fullmatch(r"OPQ(\d+)", name):
        return linear(lambda base: transforms.opq(base, int(m[1])))
    if m := re.fullmatch(r"Pad(\d+)", name):
        return lambda base: lambda df, vec: df.withColumn(vec, padded(F.col(vec), int(m[1])))
    return None


def index_factory(description: str, metric: str = "l2") -> Index:
    """Parses a description; nothing is read before build()."""
    words = [w.strip() for w in description.split(",")]
    out = Index(description, metric)
    if words and words[-1] == "RFlat":
        out.refine = True
        words.pop()
    while words and (s := _step(words[0])):
        out.steps.append(s)
        words.pop(0)
    out.core = ",".join(words)
    if not re.fullmatch(r"Flat|IVF\d+,(Flat|PQ\d+(x\d+)?|SQ[468]|SQfp16|SQbf16|SQ8direct|SQ8directsigned|RaBitQ)|BIVF\d+|PQ\d+(x\d+)?|SQ[468]|LSH\d+t?|HNSW\d+|RaBitQ", out.core):
        raise ValueError(f"cannot read index description {description!r}")
    return out


def describe(index: Index) -> str:
    """The description that gives the same index."""
    return index.description


def code_size(description: str, dim: int) -> int:
    """Bytes of a stored vector."""
    core = index_factory(description).core
    if m := re.fullmatch(r"IVF\d+,(SQfp16|SQbf16|SQ8direct|SQ8directsigned|SQ[468]|RaBitQ)", core):
        core = m[1]
    if core in ("SQfp16", "SQbf16"):
        return 2 * dim
    if core.startswith("SQ8direct"):
        return dim
    if core.startswith("BIVF"):
        return -(-dim // 8)
    if m := re.search(r"PQ(\d+)(?:x(\d+))?", core):
        return -(-int(m[1]) * int(m[2] or 8) // 8)
    if m := re.fullmatch(r"SQ(\d)", core):
        return -(-dim * int(m[1]) // 8)
    if m := re.fullmatch(r"LSH(\d+)t?", core):
        return -(-int(m[1]) // 8)
    return 8 + -(-dim // 8) if core == "RaBitQ" else 4 * dim
