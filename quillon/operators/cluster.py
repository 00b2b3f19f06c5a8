"""Iterative clustering: Lloyd's algorithm and its variants, k-modes, statistics.

The model (centroids: nlist x d doubles) is the bounded side and goes to the tasks; rows
never move.  Each task adds up its own rows by cluster, so a pass shuffles one row a
cluster and task, whatever the sizes of the clusters.  Assignments compare distances
rounded to 9 digits and break ties by the lower number, so they do not depend on the
order of summation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.metrics import _l2, _unit
from quillon.operators.exact import matrix

EMPTY_POLICIES = ("keep", "zero", "reseed", "split")


def seeds(base: DataFrame, n: int) -> np.ndarray:
    """The vectors of the n smallest ids."""
    rows = base.select("id", F.col("vec").cast("array<double>").alias("vec")).orderBy("id").limit(n).collect()
    return np.array([r["vec"] for r in rows], float).reshape(len(rows), -1)


def nearest(x: np.ndarray, centroids: np.ndarray, spherical: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Number of and distance to the nearest centroid of each row."""
    d = np.round(1.0 - x @ centroids.T if spherical else _l2(x, centroids), 9)
    best = d.argmin(1)
    return best, d[np.arange(len(x)), best]


def _sums(centroids: np.ndarray, spherical: bool, weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = centroids.shape
        n, w, s, loss = np.zeros(k, np.int64), np.zeros(k), np.zeros((k, d)), np.zeros(k)
        for batch in batches:
            x = matrix(batch.column(0))
            if not len(x):
                continue
            weight = batch.column(1).to_numpy(zero_copy_only=False) if weighted else np.ones(len(x))
            best, cost = nearest(x, centroids, spherical)
            n += np.bincount(best, minlength=k)
            w += np.bincount(best, weight, k)
            loss += np.bincount(best, cost * weight, k)
            np.add.at(s, best, x * weight[:, None])
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(n[hit]), pa.array(w[hit]), pa.array(loss[hit]), pa.array(list(s[hit]), pa.list_(pa.float64()))], names=["cid", "n", "w", "loss", "s"])

    return run


def _add(t: pa.Table) -> pa.Table:
    return pa.table({"cid": t["cid"].slice(0, 1), "n": [int(np.sum(t["n"].to_numpy()))], "w": [float(np.sum(t["w"].to_numpy()))], "loss": [float(np.sum(t["loss"].to_numpy()))], "s": pa.array([matrix(t["s"]).sum(0)], pa.list_(pa.float64()))})


_SUMS = "cid int, n long, w double, loss double, s array<double>"


def lloyd(base: DataFrame, centroids: np.ndarray, iterations: int = 10, tol: float = 0.0, empty: str = "keep", weight: str | None = None, spherical: bool = False) -> tuple[np.ndarray, list[float]]:
    """Centroids after at most `iterations` passes over base(id, vec), and the objective before each.

    Stops when no squared move exceeds tol.  Empty clusters: `keep` the old centroid, `zero`
    it, `reseed` from the seed of the largest cluster's centroid moved by a fixed step, or
    `split` the largest cluster in two by +-1/1024.
    """
    if empty not in EMPTY_POLICIES:
        raise ValueError(f"empty must be one of {EMPTY_POLICIES}")
    rows = base.select("vec", *([F.col(weight).cast("double")] if weight else []))
    objective = []
    for _ in range(iterations):
        got = rows.mapInArrow(_sums(centroids, spherical, weight is not None), _SUMS).groupBy("cid").applyInArrow(_add, _SUMS).toArrow()
        cid, n, w = got["cid"].to_numpy(), got["n"].to_numpy(), got["w"].to_numpy()
        objective.append(float(got["loss"].to_numpy().sum()))
        new = centroids.copy() if empty != "zero" else np.zeros_like(centroids)
        if len(cid):
            ok = w > 0
            new[cid[ok]] = matrix(got["s"])[ok] / w[ok][:, None]
            if empty in ("split", "reseed"):
                size = np.zeros(len(centroids), np.int64)
                size[cid] = n
                for c in np.flatnonzero(size == 0):
                    big = int(size.argmax())
                    step = np.where(np.arange(new.shape[1]) % 2 == 0, 1.0, -1.0) / 1024
                    new[c] = new[big] * (1 + step)
                    if empty == "split":
                        new[big] = new[big] * (1 - step)
                        size[c], size[big] = size[big] // 2, size[big] - size[big] // 2
        if spherical:
            new = _unit(new)
        moved = float(((new - centroids) ** 2).sum(1).max(initial=0.0))
        centroids = new
        if moved <= tol:
            break
    return centroids, objective


def drawn(base: DataFrame, n: int, seed: int) -> np.ndarray:
    """n vectors drawn by a hash of the id and the seed."""
    rows = base.select("id", F.col("vec").cast("array<double>").alias("vec")).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n).collect()
    return np.array([r["vec"] for r in rows], float).reshape(len(rows), -1)


def kmeans(base: DataFrame, k: int, iterations: int = 25, redo: int = 1, seed: int = 1234, per_centroid: int = 256, spherical: bool = False, whole_numbers: bool = False) -> tuple[np.ndarray, list[float]]:
    """The best of `redo` runs from drawn seeds, on about per_centroid rows a centroid (a documented bound), splitting empty clusters."""
    n = base.count()
    if n < k:
        raise ValueError(f"{n} rows cannot make {k} clusters")
    share = min(1.0, per_centroid * k / n)
    rows = base if share == 1.0 else base.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    best: tuple[np.ndarray, list[float]] | None = None
    for r in range(redo):
        c, loss = lloyd(rows, drawn(rows, k, seed + r), iterations, empty="split", spherical=spherical)
        if best is None or loss[-1] < best[1][-1]:
            best = (np.round(c) if whole_numbers else c, loss)
    return best


def assign(base: DataFrame, centroids: np.ndarray, spherical: bool = False, keep: tuple[str, ...] = ("id", "vec")) -> DataFrame:
    """base with cid int and cdist double."""
    rows = base.select(*keep)
    at = list(keep).index("vec")
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["cid int", "cdist double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(at))
            best, cost = nearest(x, centroids, spherical) if len(x) else (np.zeros(0, int), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int32)), pa.array(cost)], names=[*batch.schema.names, "cid", "cdist"])

    return rows.mapInArrow(run, ddl)


def centroid_table(spark, centroids: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cid int, cvec array<double>")


def list_sizes(assigned: DataFrame, nlist: int) -> DataFrame:
    """(cid, n) with a row for each list, empty ones too."""
    every = assigned.sparkSession.range(nlist).select(F.col("id").cast("int").alias("cid"))
    return every.join(assigned.groupBy("cid").agg(F.count(F.lit(1)).alias("n")), "cid", "left").select("cid", F.coalesce("n", F.lit(0)).alias("n"))


def list_statistics(assigned: DataFrame, nlist: int) -> DataFrame:
    """One row: smallest, largest and mean list, empty lists, imbalance factor k * sum(n^2) / sum(n)^2."""
    n = F.col("n").cast("double")
    return list_sizes(assigned, nlist).agg(
        F.min("n").alias("min_size"),
        F.max("n").alias("max_size"),
        F.avg("n").alias("avg_size"),
        F.count_if(F.col("n") == 0).alias("empty_lists"),
        (F.lit(float(nlist)) * F.sum(n * n) / (F.sum(n) * F.sum(n))).alias("imbalance"),
    )


def modes(codes: DataFrame, by: str = "cid", code: str = "code") -> DataFrame:
    """(by, m, code, n): the most frequent code of each position of a code array; ties go to the lowest code."""
    each = codes.select(by, F.posexplode(code).alias("m", "c")).groupBy(by, "m", "c").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(by, "m").agg(F.max_by("c", F.struct("n", -F.col("c"))).alias("code"), F.max("n").alias("n"))


def two_level(base: DataFrame, outer: int, inner: int, iterations: int = 5) -> np.ndarray:
    """Coarse clusters first, then clusters within each: outer * inner centroids, one pass a cluster for each iteration."""
    coarse, _ = lloyd(base, seeds(base, outer), iterations)
    assigned = assign(base, coarse).cache()
    out = []
    for c in range(outer):
        own = assigned.where(F.col("cid") == c).select("id", "vec")
        start = seeds(own, inner)
        out.append(lloyd(own, start, iterations)[0] if len(start) else np.zeros((0, coarse.shape[1])))
    assigned.unpersist()
    return np.concatenate(out)


def progressive(base: DataFrame, k: int, dims: list[int], iterations: int = 3) -> np.ndarray:
    """Clusters on growing numbers of leading dimensions, each started from the last."""
    full = seeds(base, k)
    centroids = full[:, : dims[0]]
    for d in dims:
        start = full[:, :d].copy()
        start[:, : centroids.shape[1]] = centroids
        centroids, _ = lloyd(base.select("id", F.slice("vec", 1, d).alias("vec")), start, iterations)
    return centroids
