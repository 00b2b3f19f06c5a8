"""Vector queries over the test tables, each with its SQL where SQL can say it.

The base is all of `embeddings`, queries are its vectors whose vec_id is divisible by 100;
seeds are the smallest ids.  Where recall is measured, a query is no neighbour of itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.functions.metrics import distance
from quillon.operators import cluster, codecs, evaluate, exact, graph, mutate, onedim, transforms
from quillon.operators.factory import index_factory
from quillon.operators.ivf import IvfIndex
from quillon.operators.ivfcodes import CodedIvf, binary_ivf
from quillon.operators.ivfpq import IvfPqIndex, PqIvfIndex
from quillon.operators.pq import ProductQuantizer
from quillon.operators.topk import merge_top_k, top_k
from quillon.plans import oracles as O
from quillon.plans.oracles import QB, ip, knn, l2, ranked
from quillon.storage import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: NPROBE and the depths of re-ranking give recalls of 0.9 and more (index_recalls) on vectors without clusters.
NLIST, ITER, NPROBE, K, M, KS = 16, 3, 12, 10, 8, 16


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), V.dbl("embedding").alias("vec"), "label")


def asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), V.dbl("embedding").alias("qvec"))


def others(found: DataFrame) -> DataFrame:
    """Results without the query itself, ranked anew."""
    return top_k(found.where("qid <> id").drop("rank"), K).select("qid", "rank", "id", "dist")


def depth(b: DataFrame) -> int:
    """How many coded candidates are re-ranked: half of the rows, as the codes are coarse."""
    return max(50, b.count() // 2)


DEPTH_SQL = "(SELECT greatest(50, count(*) // 2) FROM b)"


def shown(df: DataFrame) -> DataFrame:
    return df.withColumn("dist", F.round("dist", 6))


# --- exact search -----------------------------------------------------------------------


def _flat(metric: str, prepare: str = "{}", column=None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b, q = base(spark, sf_dir), asks(spark, sf_dir)
        if column is not None:
            b, q = b.withColumn("vec", column("vec")), q.withColumn("qvec", column("qvec"))
        return shown(exact.knn_join(b, q, K, metric))

    run.__name__ = f"knn_{metric}"
    query(knn(metric, K, prepare))(run)


_abs = lambda c: F.transform(c, F.abs)
_holes = lambda c: F.transform(c, lambda x: F.when(F.abs(x) < 0.01, F.lit(float("nan"))).otherwise(x))
for _m in ("l2", "ip", "ip1", "cosine", "l1", "linf", "lp3", "canberra", "braycurtis", "abs_ip"):
    _flat(_m)
for _m in ("jensenshannon", "jaccard", "gower"):
    _flat(_m, "list_transform({}, lambda x: abs(x))", _abs)
_flat("nan_euclidean", "list_transform({}, lambda x: CASE WHEN abs(x) < 0.01 THEN 'nan'::DOUBLE ELSE x END)", _holes)


@query(f"WITH {QB} SELECT qid, id, round({l2('qv', 'v')}, 6) AS dist FROM q, b WHERE {l2('qv', 'v')} < 1.6")
def range_l2(spark, sf_dir):
    return shown(exact.range_join(base(spark, sf_dir), asks(spark, sf_dir), 1.6, "l2"))


@query(f"WITH {QB} SELECT qid, id, round({ip('qv', 'v')}, 6) AS dist FROM q, b WHERE {ip('qv', 'v')} > 0.25")
def range_ip(spark, sf_dir):
    return shown(exact.range_join(base(spark, sf_dir), asks(spark, sf_dir), 0.25, "ip"))


@query(f"WITH {QB} " + ranked(f"SELECT qid, id, {l2('qv', 'v')} AS dist FROM q, b WHERE {l2('qv', 'v')} <= 1.7", 20))
def epsilon_search(spark, sf_dir):
    return shown(exact.epsilon_search(base(spark, sf_dir), asks(spark, sf_dir), 1.7, 20))


@query(f"WITH {QB} SELECT qid, id, round({l2('qv', 'v')}, 6) AS dist FROM q, b WHERE {l2('qv', 'v')} < 1.7 ORDER BY {l2('qv', 'v')}, qid, id LIMIT 100")
def range_capped(spark, sf_dir):
    return shown(exact.capped_range(base(spark, sf_dir), asks(spark, sf_dir), 1.7, 100))


@query(knn("l2", K, where="label % 2 = 0 AND id >= 100"))
def knn_filtered(spark, sf_dir):
    return shown(exact.knn_join(base(spark, sf_dir), asks(spark, sf_dir), K, "l2", (F.col("label") % 2 == 0) & (F.col("id") >= 100)))


@query(knn("l2", K, where="((label = 1 OR label = 2) AND NOT (id BETWEEN 100 AND 199)) OR ((label = 3) <> (id % 3 = 0))"))
def selector_algebra(spark, sf_dir):
    either = F.col("label").isin(1, 2) & ~F.col("id").between(100, 199)
    return shown(exact.knn_join(base(spark, sf_dir), asks(spark, sf_dir), K, "l2", either | ((F.col("label") == 3) != (F.col("id") % 3 == 0))))


@query(f"WITH {QB}, o AS (SELECT o_orderkey % 500 AS id FROM orders WHERE o_totalprice > 400000) " + ranked(f"SELECT qid, id, {l2('qv', 'v')} AS dist FROM q, b WHERE id IN (SELECT id FROM o)", K))
def selector_table(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_totalprice > 400000").select((F.col("o_orderkey") % 500).alias("id")).distinct()
    return shown(exact.knn_join(base(spark, sf_dir).join(ids, "id", "left_semi"), asks(spark, sf_dir), K))


@query(f"WITH {QB} " + ranked(f"SELECT qid, label::BIGINT AS id, min({l2('qv', 'v')}) AS dist FROM q, b GROUP BY qid, label", 3, columns="qid, rank, id AS doc, round(dist, 6) AS dist"))
def multi_vector(spark, sf_dir):
    return shown(exact.multi_vector_search(base(spark, sf_dir), asks(spark, sf_dir), 3, doc="label"))


@query(f"WITH {QB} " + ranked(f"SELECT qid, id, {l2('qv', 'v')} AS dist FROM q JOIN b ON (id * 7 + qid) % 11 = 0", 5))
def knn_among_candidates(spark, sf_dir):
    b, q = base(spark, sf_dir), asks(spark, sf_dir)
    pairs = q.select("qid").join(b.select("id"), (F.col("id") * 7 + F.col("qid")) % 11 == 0)
    return shown(exact.knn_among(pairs, b, q, 5))


@query(f"WITH {QB} " + ranked(f"SELECT qid, id, {l2('qv', 'v')} AS dist FROM q, b", 1, columns="qid, id, round(dist, 6) AS dist"))
def assign_nearest(spark, sf_dir):
    return shown(exact.knn_join(base(spark, sf_dir), asks(spark, sf_dir), 1)).drop("rank")


@query(f"WITH {QB} SELECT qid, id, round({l2('qv', 'v')}, 6) AS l2, round({O.METRIC_SQL['cosine']('qv', 'v')}, 6) AS cosine FROM q JOIN b ON id = 100 + qid * 2")
def pairwise_indexed(spark, sf_dir):
    both = asks(spark, sf_dir).withColumn("id", 100 + F.col("qid") * 2).join(base(spark, sf_dir), "id")
    return both.select("qid", "id", F.round(distance("l2", "qvec", "vec"), 6).alias("l2"), F.round(distance("cosine", "qvec", "vec"), 6).alias("cosine"))


@query(
    "WITH q AS (SELECT event_id AS qid, value AS x FROM events WHERE event_id % 100 = 0), b AS (SELECT event_id AS id, value AS y FROM events WHERE value IS NOT NULL) "
    + ranked("SELECT qid, id, abs(x - y) AS dist FROM q, b WHERE x IS NOT NULL", 5)
)
def knn_1d(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("value IS NOT NULL")
    return shown(onedim.nearest(e.select(F.col("event_id").alias("id"), F.col("value").alias("x")), e.where("event_id % 100 = 0").select(F.col("event_id").alias("qid"), F.col("value").alias("x")), 5))


# --- vector functions -------------------------------------------------------------------


@query(f"WITH {QB} SELECT id, round(sqrt({ip('v', 'v')}), 6) AS norm, round({ip('v', 'v')}, 6) AS norm2 FROM b")
def vector_norms(spark, sf_dir):
    return base(spark, sf_dir).select("id", F.round(V.norm(F.col("vec")), 6).alias("norm"), F.round(V.inner_product(F.col("vec"), F.col("vec")), 6).alias("norm2"))


@query(f"WITH {QB}, s AS (SELECT id, list_transform(v, lambda x: x * 3.0) AS v FROM b) SELECT id, j - 1 AS j, round(v[j] / sqrt({ip('v', 'v')}), 6) AS x FROM s, range(1, 65) r(j)")
def renormalise(spark, sf_dir):
    return base(spark, sf_dir).select("id", F.posexplode(V.normalised(V.scaled(F.col("vec"), F.lit(3.0)))).alias("j", "x")).select("id", F.col("j").cast("long").alias("j"), F.round("x", 6).alias("x"))


@query(f"WITH {QB} SELECT id, round(v[64], 6) AS a, 0.0 AS b, round(v[1], 6) AS c, 67::BIGINT AS n FROM b")
def remap_and_pad(spark, sf_dir):
    v = V.padded(F.col("vec"), 67)
    r = V.remapped(F.col("vec"), [63, -1, 0])
    return base(spark, sf_dir).select("id", F.round(r[0], 6).alias("a"), r[1].alias("b"), F.round(r[2], 6).alias("c"), F.size(v).cast("long").alias("n"))


@query(f"WITH {QB} SELECT id, round({ip('v[1:2]', '[2.0, -1.0]')} + 0.5, 6) AS y0, round({ip('v[1:2]', '[0.0, 3.0]')}, 6) AS y1 FROM b")
def linear_transform(spark, sf_dir):
    y = V.linear(V.subspace(F.col("vec"), 0, 2), [[2.0, -1.0], [0.0, 3.0]], [0.5, 0.0])
    return base(spark, sf_dir).select("id", F.round(y[0], 6).alias("y0"), F.round(y[1], 6).alias("y1"))


@query(f"WITH {QB}, m AS (SELECT j, avg(v[j]) AS mean FROM b, range(1, 65) r(j) GROUP BY j) SELECT id, j - 1 AS j, round(v[j] - mean, 6) AS x FROM b, m")
def centring(spark, sf_dir):
    b = base(spark, sf_dir).select("id", "vec")
    return transforms.centring(b).apply(b).select("id", F.posexplode("vec").alias("j", "x")).select("id", F.col("j").cast("long").alias("j"), F.round("x", 6).alias("x"))


@query(f"WITH {QB} SELECT j - 1 AS j, round(min(v[j]), 6) AS lo, round(max(v[j]), 6) AS hi, round(avg(v[j]), 6) AS mean, round(stddev_pop(v[j]), 6) AS std, count(*) FILTER (WHERE isnan(v[j])) AS nans FROM b, range(1, 65) r(j) GROUP BY j")
def matrix_stats(spark, sf_dir):
    x = F.col("x")
    return (
        base(spark, sf_dir)
        .select(F.posexplode("vec").alias("j", "x"))
        .groupBy(F.col("j").cast("long").alias("j"))
        .agg(F.round(F.min(x), 6).alias("lo"), F.round(F.max(x), 6).alias("hi"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("std"), F.count_if(F.isnan(x)).alias("nans"))
    )


@query("SELECT l_returnflag, round(sum(l_quantity * l_discount), 4) AS dot, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY l_returnflag")
def column_dot(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_quantity") * F.col("l_discount")), 4).alias("dot"), F.round(F.sum("l_quantity"), 2).alias("total"))


@query(f"WITH {QB}, n AS (SELECT j, sum(v[j] * (id % 5)) AS y FROM b, range(1, 65) r(j) GROUP BY j) SELECT j - 1 AS j, round(y, 6) AS y FROM n")
def matrix_vector(spark, sf_dir):
    each = base(spark, sf_dir).select("id", F.posexplode("vec").alias("j", "x"))
    return each.groupBy(F.col("j").cast("long").alias("j")).agg(F.round(F.sum(F.col("x") * (F.col("id") % 5)), 6).alias("y"))


# --- clustering -------------------------------------------------------------------------

_C = f"{QB}, {O.lloyd(NLIST, ITER)}"


@query(f"WITH {_C} SELECT cid::INTEGER AS cid, count(a.id) AS n FROM c{ITER} LEFT JOIN ca{ITER} a USING (cid) GROUP BY cid")
def kmeans_sizes(spark, sf_dir):
    b = base(spark, sf_dir)
    c, _ = cluster.lloyd(b, cluster.seeds(b, NLIST), ITER)
    return cluster.list_sizes(cluster.assign(b, c), NLIST)


@query(f"WITH {_C} SELECT cid::INTEGER AS cid, j - 1 AS j, round(c[j], 6) AS x FROM c{ITER}, range(1, 65) r(j)")
def kmeans_centroids(spark, sf_dir):
    b = base(spark, sf_dir)
    c, _ = cluster.lloyd(b, cluster.seeds(b, NLIST), ITER)
    return cluster.centroid_table(spark, c).select("cid", F.posexplode("cvec").alias("j", "x")).select("cid", F.col("j").cast("long").alias("j"), F.round("x", 6).alias("x"))


@query(f"WITH {_C}, n AS (SELECT cid, count(a.id) AS n FROM c{ITER} LEFT JOIN ca{ITER} a USING (cid) GROUP BY cid) SELECT min(n) AS min_size, max(n) AS max_size, avg(n) AS avg_size, count(*) FILTER (WHERE n = 0) AS empty_lists, round({NLIST} * sum(n * n) / (sum(n) * sum(n)), 6) AS imbalance FROM n")
def kmeans_statistics(spark, sf_dir):
    b = base(spark, sf_dir)
    c, _ = cluster.lloyd(b, cluster.seeds(b, NLIST), ITER)
    return cluster.list_statistics(cluster.assign(b, c), NLIST).withColumn("imbalance", F.round("imbalance", 6))


@query(f"WITH {QB}, w AS (SELECT id, v, 1.0 + label AS wt FROM b), {O.lloyd(NLIST, ITER, 'w', weight='s.wt')} SELECT cid::INTEGER AS cid, count(a.id) AS n, round(any_value(c[1]), 6) AS x0 FROM c{ITER} LEFT JOIN ca{ITER} a USING (cid) GROUP BY cid")
def kmeans_weighted(spark, sf_dir):
    b = base(spark, sf_dir).withColumn("wt", 1.0 + F.col("label"))
    c, _ = cluster.lloyd(b, cluster.seeds(b, NLIST), ITER, weight="wt")
    first = cluster.centroid_table(spark, c).select("cid", F.round(F.col("cvec")[0], 6).alias("x0"))
    return cluster.list_sizes(cluster.assign(b, c), NLIST).join(first, "cid")


@query(f"WITH {QB}, {O.lloyd(NLIST, ITER, spherical=True)} SELECT cid::INTEGER AS cid, count(a.id) AS n, round(any_value(c[1]), 6) AS x0 FROM c{ITER} LEFT JOIN ca{ITER} a USING (cid) GROUP BY cid")
def kmeans_spherical(spark, sf_dir):
    b = base(spark, sf_dir)
    c, _ = cluster.lloyd(b, cluster.seeds(b, NLIST), ITER, spherical=True)
    first = cluster.centroid_table(spark, c).select("cid", F.round(F.col("cvec")[0], 6).alias("x0"))
    return cluster.list_sizes(cluster.assign(b, c, spherical=True), NLIST).join(first, "cid")


def _values(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("value").alias("x"))


def _clusters_1d(found: DataFrame) -> DataFrame:
    return found.select("cid", "n", *[F.round(c, 6).alias(c) for c in ("centroid", "low", "high")], F.round("loss", 3).alias("loss"))


@query()
def clustering_1d(spark, sf_dir):
    return _clusters_1d(onedim.cluster(_values(spark, sf_dir), 8))


@query(
    "WITH v AS (SELECT value AS x, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY value), "
    "m AS (SELECT avg(value) AS m FROM events), t AS (SELECT x, n, n * (x - m) AS s, n * (x - m) * (x - m) AS q FROM v, m), "
    "p AS (SELECT x, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(q) OVER w AS q, sum(n) OVER () AS n1, sum(s) OVER () AS s1, sum(q) OVER () AS q1 FROM t WINDOW w AS (ORDER BY x)), "
    "c AS (SELECT x AS edge FROM p WHERE n < n1 ORDER BY q - s * s / n + (q1 - q) - (s1 - s) * (s1 - s) / (n1 - n), x LIMIT 1), "
    "g AS (SELECT (value > edge)::INTEGER AS cid, value AS x FROM events, c WHERE value IS NOT NULL) "
    "SELECT cid, count(*) AS n, round(avg(x), 6) AS centroid, round(min(x), 6) AS low, round(max(x), 6) AS high, round(var_pop(x) * count(*), 3) AS loss FROM g GROUP BY cid"
)
def clustering_1d_two(spark, sf_dir):
    return _clusters_1d(onedim.cluster(_values(spark, sf_dir), 2))


_LI = "b AS (SELECT l_orderkey * 10 + l_linenumber AS id, [min(l_quantity) / 50.0, min(l_discount) * 10.0, min(l_tax) * 10.0]::DOUBLE[] AS v FROM lineitem GROUP BY 1)"


@query(f"WITH {_LI}, {O.lloyd(8, 3, d=3)} SELECT cid::INTEGER AS cid, count(a.id) AS n FROM c3 LEFT JOIN ca3 a USING (cid) GROUP BY cid")
def kmeans_lineitem(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines = t.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(*[F.min(c).alias(c) for c in ("l_quantity", "l_discount", "l_tax")])
    b = cut(lines.select("id", F.array(F.col("l_quantity") / 50.0, F.col("l_discount") * 10.0, F.col("l_tax") * 10.0).alias("vec")))  # every pass reads it again
    c, _ = cluster.lloyd(b, cluster.seeds(b, 8), 3)
    return cluster.list_sizes(cluster.assign(b, c), 8)


@query(f"WITH {_C} SELECT a.id, a.cid::INTEGER AS cid, j - 1 AS j, round(v[j] - c[j], 6) AS x FROM ca{ITER} a JOIN b USING (id) JOIN c{ITER} c ON c.cid = a.cid, range(1, 65) r(j)")
def residuals(spark, sf_dir):
    r = IvfIndex.build(base(spark, sf_dir), NLIST, ITER).residuals()
    return r.select("id", "cid", F.posexplode("vec").alias("j", "x")).select("id", "cid", F.col("j").cast("long").alias("j"), F.round("x", 6).alias("x"))


# --- inverted files ---------------------------------------------------------------------

_IVF = O.ivf(NLIST, ITER, NPROBE)


@query(f"WITH {_IVF} " + ranked("SELECT qid, id, dist FROM x", K))
def ivf_search(spark, sf_dir):
    return shown(IvfIndex.build(base(spark, sf_dir), NLIST, ITER).search(asks(spark, sf_dir), K, NPROBE))


@query(knn("l2", K))
def ivf_all_lists(spark, sf_dir):
    return shown(IvfIndex.build(base(spark, sf_dir), NLIST, ITER).search(asks(spark, sf_dir), K, NLIST))


@query(f"WITH {_IVF} " + ranked("SELECT qid, x.id, dist FROM x JOIN b USING (id) WHERE label < 5", K))
def ivf_filtered(spark, sf_dir):
    index = IvfIndex.build(base(spark, sf_dir), NLIST, ITER, keep=("id", "vec", "label"))
    return shown(index.search(asks(spark, sf_dir), K, NPROBE, where=F.col("label") < 5))


@query(f"WITH {O.ivf(NLIST, ITER, 8)}, n AS (SELECT cid, count(*) AS n FROM ca{ITER} GROUP BY cid), pm AS (SELECT qid, cid, coalesce(sum(n) OVER (PARTITION BY qid ORDER BY probe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p JOIN n USING (cid)) " + ranked("SELECT x.qid, id, dist FROM x JOIN pm ON x.qid = pm.qid AND x.cid = pm.cid WHERE before < 80", K))
def ivf_max_codes(spark, sf_dir):
    return shown(IvfIndex.build(base(spark, sf_dir), NLIST, ITER).search(asks(spark, sf_dir), K, 8, max_codes=80))


@query(f"WITH {_IVF} SELECT qid, id, round(dist, 6) AS dist FROM x WHERE dist < 1.7")
def ivf_range(spark, sf_dir):
    return shown(IvfIndex.build(base(spark, sf_dir), NLIST, ITER).range_search(asks(spark, sf_dir), 1.7, NPROBE))


@query(f"WITH {_IVF} SELECT qid, count(DISTINCT cid) AS lists, count(*) AS distances FROM x GROUP BY qid")
def ivf_visited(spark, sf_dir):
    return IvfIndex.build(base(spark, sf_dir), NLIST, ITER).search_statistics(asks(spark, sf_dir), NPROBE)


_NEAR = "SELECT qid, id, " + l2("qv", "v") + " AS dist FROM q, b WHERE qid <> id"


@query(f"WITH {_IVF}, f AS ({ranked('SELECT qid, id, dist FROM x WHERE qid <> id', K)}), t AS (SELECT * FROM ({ranked(_NEAR, K)})) SELECT q.qid, (SELECT count(*) FROM f JOIN t USING (qid, id) WHERE f.qid = q.qid) / 10.0::DOUBLE AS recall FROM q")
def ivf_recall(spark, sf_dir):
    b, q = base(spark, sf_dir), asks(spark, sf_dir)
    return evaluate.recall_at_k(others(IvfIndex.build(b, NLIST, ITER).search(q, K + 1, NPROBE)), others(exact.knn_join(b, q, K + 1)), K)


_GIVEN = f"WITH {QB}, {O.lloyd(NLIST, ITER)}, g AS (SELECT qid, ((qid // 100 + 5 * s) % {NLIST}) AS cid FROM q, range(3) r(s)), x AS (SELECT g.qid, b.id, {l2('qv', 'v')} AS dist FROM g JOIN q USING (qid) JOIN ca{ITER} a ON a.cid = g.cid JOIN b ON b.id = a.id) "


def _given(spark, sf_dir):
    """Lists that someone else assigned to the queries."""
    q = asks(spark, sf_dir)
    return q, q.select("qid", F.explode(F.array(*[((F.col("qid") / 100).cast("long") + 5 * s) % NLIST for s in range(3)]).cast("array<int>")).alias("cid"))


@query(_GIVEN + ranked("SELECT qid, id, dist FROM x", K))
def ivf_preassigned(spark, sf_dir):
    q, given = _given(spark, sf_dir)
    return shown(IvfIndex.build(base(spark, sf_dir), NLIST, ITER).search(q, K, 0, assigned=given))


@query(_GIVEN + "SELECT qid, id, round(dist, 6) AS dist FROM x WHERE dist < 1.7")
def ivf_range_preassigned(spark, sf_dir):
    q, given = _given(spark, sf_dir)
    return shown(IvfIndex.build(base(spark, sf_dir), NLIST, ITER).range_search(q, 1.7, 0, assigned=given))


def _ivf_sq_sql(bits: int) -> str:
    top = (1 << bits) - 1
    code = f"floor(CASE WHEN w = 0 THEN 0 ELSE least(greatest((v[j] - lo) / w, 0), 1) END * {top}.0)"
    return (
        f"WITH {QB}, {O.lloyd(NLIST, ITER)}, p AS MATERIALIZED (SELECT * FROM (SELECT qid, cid, row_number() OVER (PARTITION BY qid ORDER BY round({l2('qv', 'c')}, 9), cid) AS probe FROM q, c{ITER}) WHERE probe <= {NPROBE}), "
        "r AS (SELECT j, min(v[j]) AS lo, max(v[j]) - min(v[j]) AS w FROM b, range(1, 65) t(j) GROUP BY j), "
        f"d AS MATERIALIZED (SELECT id, list(lo + w * (({code} + 0.5) / {top}.0) ORDER BY j) AS dv FROM b, r GROUP BY id) "
        + ranked(f"SELECT p.qid, d.id, {l2('qv', 'dv')} AS dist FROM p JOIN q USING (qid) JOIN ca{ITER} a ON a.cid = p.cid JOIN d ON d.id = a.id", K)
    )


def _ivf_sq(bits: int):
    def run(spark, sf_dir):
        return shown(CodedIvf.build(base(spark, sf_dir), NLIST, f"SQ{bits}", ITER, by_residual=False).search(asks(spark, sf_dir), K, NPROBE))

    query(_ivf_sq_sql(bits), f"ivf_sq{bits}")(run)


for _bits in (8, 6, 4):
    _ivf_sq(_bits)


_SIGNS = "list_transform({}, lambda x: CASE WHEN x >= 0 THEN 1.0 ELSE 0.0 END)"


@query(
    f"WITH {QB}, q2 AS (SELECT qid, {_SIGNS.format('qv')} AS qv FROM q), b2 AS MATERIALIZED (SELECT id, {_SIGNS.format('v')} AS v FROM b), {O.lloyd(NLIST, ITER, 'b2')}, "
    f"h AS MATERIALIZED (SELECT cid, list_transform(c, lambda x: CASE WHEN x > 0.5 THEN 1.0 ELSE 0.0 END) AS c FROM c{ITER}), "
    f"a AS MATERIALIZED (SELECT id, cid FROM (SELECT id, cid, {O.METRIC_SQL['l1']('v', 'c')} AS d FROM b2, h) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, cid) = 1), "
    f"p AS MATERIALIZED (SELECT * FROM (SELECT qid, cid, row_number() OVER (PARTITION BY qid ORDER BY {O.METRIC_SQL['l1']('qv', 'c')}, cid) AS probe FROM q2, h) WHERE probe <= {NPROBE}) "
    + ranked(f"SELECT p.qid, b2.id, {O.METRIC_SQL['l1']('qv', 'v')} AS dist FROM p JOIN q2 USING (qid) JOIN a USING (cid) JOIN b2 ON b2.id = a.id", K)
)
def ivf_binary(spark, sf_dir):
    q = asks(spark, sf_dir).withColumn("qvec", codecs.as_numbers(V.sign_bits(F.col("qvec"))))
    return shown(binary_ivf(base(spark, sf_dir), NLIST, ITER).search(q, K, NPROBE))


@query(knn("l2", K))
def ivf_shards_merged(spark, sf_dir):
    index = IvfIndex.build(base(spark, sf_dir), NLIST, ITER)
    q = asks(spark, sf_dir)
    return shown(merge_top_k([s.search(q, K, NLIST) for s in index.shards(2)], K).select("qid", "rank", "id", "dist"))


# --- product quantization ---------------------------------------------------------------

_PQ = f"{QB}, {O.pq(M, KS, ITER)}"
_ADC = "SELECT qid, e.id, sum(d) AS dist FROM e JOIN lut ON e.m = lut.m AND e.cid = lut.cid GROUP BY qid, e.id"


def _pq(spark, sf_dir):
    b = base(spark, sf_dir)
    q = ProductQuantizer.train(b, M, KS, ITER)
    return b, q, q.encode(b)


@query(f"WITH {_PQ} SELECT id, string_agg(cid::VARCHAR, ',' ORDER BY m) AS code FROM e GROUP BY id")
def pq_encode(spark, sf_dir):
    _, _, codes = _pq(spark, sf_dir)
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(M)), lambda i: F.conv(F.hex(F.substring("code", i, F.lit(1))), 16, 10)), ",")
    return codes.select("id", text.alias("code"))


@query(f"WITH {_PQ} " + ranked(_ADC, K))
def pq_adc(spark, sf_dir):
    _, q, codes = _pq(spark, sf_dir)
    return shown(q.search(codes, asks(spark, sf_dir), K))


@query(f"WITH {_PQ}, a AS ({ranked(_ADC, DEPTH_SQL)}) " + ranked(f"SELECT a.qid, a.id, {l2('qv', 'v')} AS dist FROM a JOIN q ON a.qid = q.qid JOIN b ON a.id = b.id", K))
def pq_reranked(spark, sf_dir):
    b, q, codes = _pq(spark, sf_dir)
    return shown(q.search_reranked(codes, b, asks(spark, sf_dir), K, depth(b)))


@query(f"WITH {_PQ}, qe AS MATERIALIZED (SELECT qid, m, cid FROM (SELECT qid, m, cid, round(d, 9) AS d FROM lut) QUALIFY row_number() OVER (PARTITION BY qid, m ORDER BY d, cid) = 1), kk AS MATERIALIZED (SELECT x.m, x.cid AS a, y.cid AS b, {l2('x.c', 'y.c')} AS d FROM k{ITER} x JOIN k{ITER} y ON x.m = y.m) " + ranked("SELECT qid, e.id, sum(d) AS dist FROM qe JOIN e ON e.m = qe.m JOIN kk ON kk.m = e.m AND kk.a = qe.cid AND kk.b = e.cid GROUP BY qid, e.id", K, order="round(dist, 9), id"))
def pq_sdc(spark, sf_dir):
    _, q, codes = _pq(spark, sf_dir)
    return shown(q.search(codes, asks(spark, sf_dir), K, "sdc"))


@query(f"WITH {_PQ}, sc AS (SELECT qid, max(d) / 255.0 AS s FROM lut GROUP BY qid), lu AS MATERIALIZED (SELECT qid, m, cid, least(255, floor(d / s + 0.5)) AS d FROM lut JOIN sc USING (qid)) " + ranked("SELECT qid, e.id, sum(d) AS dist FROM e JOIN lu ON e.m = lu.m AND e.cid = lu.cid GROUP BY qid, e.id", K))
def pq_fastscan(spark, sf_dir):
    _, q, codes = _pq(spark, sf_dir)
    return shown(q.search(codes, asks(spark, sf_dir), K, "fast"))


@query(f"WITH {_PQ}, qe AS MATERIALIZED (SELECT qid, m, cid FROM (SELECT qid, m, cid, round(d, 9) AS d FROM lut) QUALIFY row_number() OVER (PARTITION BY qid, m ORDER BY d, cid) = 1), h AS (SELECT qid, e.id, sum(bit_count(xor(qe.cid, e.cid))) AS h FROM qe JOIN e USING (m) GROUP BY qid, e.id) " + ranked("SELECT lut.qid, e.id, sum(d) AS dist FROM e JOIN lut ON e.m = lut.m AND e.cid = lut.cid JOIN h ON h.qid = lut.qid AND h.id = e.id WHERE h < 12 GROUP BY lut.qid, e.id", K))
def pq_polysemous(spark, sf_dir):
    _, q, codes = _pq(spark, sf_dir)
    return shown(q.search(codes, asks(spark, sf_dir), K, max_hamming=12))


@query()
def pq_polysemous_trained(spark, sf_dir):
    """Numbers of codewords are annealed, so that the Hamming filter passes near codes."""
    b = base(spark, sf_dir)
    q = ProductQuantizer.train(b, M, KS, ITER).polysemous()
    return shown(q.search(q.encode(b), asks(spark, sf_dir), K, max_hamming=12))


def _exact_of(adc: str) -> str:
    return f"SELECT {adc}.qid, {adc}.id, {l2('q.qv', 'b.v')} AS dist FROM {adc} JOIN q ON {adc}.qid = q.qid JOIN b ON {adc}.id = b.id"


@query(f"WITH {QB}, {O.residual_pq(8, M, 8, ITER, 2, True)}, {O.residual_search(8, M, 8, ITER, 2, True, 7, DEPTH_SQL)} " + ranked(_exact_of("adc"), K))
def ivfpq_per_list(spark, sf_dir):
    b = base(spark, sf_dir)
    return shown(IvfPqIndex.build(b, 8, M, 8, ITER, 2, per_list=True).search(asks(spark, sf_dir), K, 7, depth(b), b))


@query(f"WITH {QB}, {O.residual_pq(NLIST, M, KS, ITER, 2, False)}, {O.residual_search(NLIST, M, KS, ITER, 2, False, NPROBE, K)} SELECT qid, rk AS rank, id, round(dist, 6) AS dist FROM adc")
def ivfpq_shared(spark, sf_dir):
    return shown(IvfPqIndex.build(base(spark, sf_dir), NLIST, M, KS, ITER, 2, per_list=False).search(asks(spark, sf_dir), K, NPROBE))


@query()
def pqivf(spark, sf_dir):
    b = base(spark, sf_dir)
    return shown(PqIvfIndex.build(b, NLIST, M, KS, ITER, 3).search(b, asks(spark, sf_dir), K, 14, depth(b)))


# --- codecs and hashes ------------------------------------------------------------------


def _sq_sql(top: int) -> str:
    return f"WITH {QB}, r AS (SELECT j, min(v[j]) AS lo, max(v[j]) - min(v[j]) AS w FROM b, range(1, 65) t(j) GROUP BY j), c AS (SELECT id, j, lo, w, floor(CASE WHEN w = 0 THEN 0 ELSE least(greatest((v[j] - lo) / w, 0), 1) END * {top}.0) AS code FROM b, r) SELECT id, sum(code)::BIGINT AS codes, round(sum(lo + w * ((code + 0.5) / {top}.0)), 6) AS decoded FROM c GROUP BY id"


def _sq(bits: int):
    def run(spark, sf_dir):
        b = base(spark, sf_dir)
        q = codecs.ScalarQuantizer.train(b, bits)
        out = b.select("id", q.encode("vec").alias("code")).withColumn("vec", q.decode("code"))
        return out.select("id", F.aggregate("code", F.lit(0).cast("long"), lambda s, x: s + x).alias("codes"), F.round(V.total(F.col("vec")), 6).alias("decoded"))

    query(_sq_sql((1 << bits) - 1), f"scalar_quantizer_{bits}bit")(run)


for _bits in (8, 6, 4):
    _sq(_bits)


@query(f"WITH {QB}, r AS (SELECT id, v, list_min(v) AS lo, list_max(v) - list_min(v) AS s FROM b) SELECT id, round(lo, 6) AS low, round(s, 6) AS scale, list_sum(list_transform(v, lambda x: floor((x - lo) / s * 255.0)))::BIGINT AS codes FROM r")
def rowwise_minmax(spark, sf_dir):
    c = base(spark, sf_dir).select("id", codecs.rowwise_encode("vec").alias("c"))
    return c.select("id", F.round("c.low", 6).alias("low"), F.round("c.scale", 6).alias("scale"), F.aggregate("c.code", F.lit(0).cast("long"), lambda s, x: s + x).alias("codes"))


_SIGN = "list_transform({}, lambda x: CASE WHEN x >= 0 THEN 1.0 ELSE 0.0 END)"


@query(knn("l1", K, "list_transform({}[1:32], lambda x: CASE WHEN x >= 0 THEN 1.0 ELSE 0.0 END)"))
def lsh_search(spark, sf_dir):
    return shown(codecs.SignHash(32).search(base(spark, sf_dir), asks(spark, sf_dir), K))


@query(f"WITH {QB}, t AS (SELECT list(m ORDER BY j) AS t FROM (SELECT j, median(v[j]) AS m FROM b, range(1, 33) r(j) GROUP BY j)), q2 AS (SELECT qid, list_transform(list_zip(qv[1:32], t), lambda z: CASE WHEN z[1] - z[2] >= 0 THEN 1 ELSE 0 END) AS qv FROM q, t), b2 AS (SELECT id, list_transform(list_zip(v[1:32], t), lambda z: CASE WHEN z[1] - z[2] >= 0 THEN 1 ELSE 0 END) AS v FROM b, t) " + ranked(f"SELECT qid, id, {O.METRIC_SQL['l1']('qv', 'v')}::DOUBLE AS dist FROM q2, b2", K))
def lsh_trained(spark, sf_dir):
    b = base(spark, sf_dir)
    return shown(codecs.SignHash.train(b, 32).search(b, asks(spark, sf_dir), K))


def _bits_of(spark, sf_dir):
    b = base(spark, sf_dir).withColumn("vec", codecs.as_numbers(V.sign_bits(F.col("vec"))))
    return b, asks(spark, sf_dir).withColumn("qvec", codecs.as_numbers(V.sign_bits(F.col("qvec"))))


@query(knn("l1", K, _SIGN))
def binary_knn(spark, sf_dir):
    return shown(exact.knn_join(*_bits_of(spark, sf_dir), K, "l1"))


def _packed(spark, sf_dir):
    b = base(spark, sf_dir).select("id", V.packed(V.sign_bits(F.col("vec")), 64).alias("words"))
    q = asks(spark, sf_dir).select("qid", V.packed(V.sign_bits(F.col("qvec")), 64).alias("qwords"))
    return b, q


_BITS = f"WITH {QB}, q2 AS (SELECT qid, {_SIGN.format('qv')} AS qv FROM q), b2 AS (SELECT id, {_SIGN.format('v')} AS v FROM b), h AS (SELECT qid, id, {O.METRIC_SQL['l1']('qv', 'v')}::BIGINT AS h, {O.METRIC_SQL['l1']('qv[1:6]', 'v[1:6]')} AS near FROM q2, b2)"


@query(f"{_BITS} SELECT qid, id, h AS hamming FROM h WHERE h < 24")
def binary_range(spark, sf_dir):
    return exact.range_join(*_bits_of(spark, sf_dir), 24, "l1").select("qid", "id", F.col("dist").cast("long").alias("hamming"))


@query(f"{_BITS} SELECT qid, count(*) FILTER (WHERE h <= 26) AS n FROM h GROUP BY qid")
def hamming_count(spark, sf_dir):
    b, q = _bits_of(spark, sf_dir)
    counts = exact.range_join(b, q, 26, "l1", inclusive=True).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    return q.select("qid").join(counts, "qid", "left").na.fill(0)


@query(f"{_BITS} SELECT qid, rank, id, dist FROM (SELECT qid, id, h AS dist, row_number() OVER (PARTITION BY qid ORDER BY h, id) AS rank FROM h WHERE near <= 1) WHERE rank <= 10")
def binary_hash(spark, sf_dir):
    b, q = _packed(spark, sf_dir)
    found = codecs.hash_search(b, q, 6, 1).select("qid", "id", V.hamming(F.col("words"), F.col("qwords")).cast("long").alias("dist"))
    return top_k(found, K).select("qid", "rank", "id", "dist")


@query(f"WITH {QB} SELECT id, list_sum(list_transform(v, lambda x: ((floor(x * 2.0 / 0.1)::BIGINT % 2) + 2) % 2))::BIGINT AS bits FROM b")
def spectral_hash(spark, sf_dir):
    return base(spark, sf_dir).select("id", F.aggregate(codecs.spectral_bits("vec", 0.1), F.lit(0), lambda s, x: s + x).cast("long").alias("bits"))


@query(
    f"WITH {QB}, m AS (SELECT list(x ORDER BY j) AS c FROM (SELECT j, avg(v[j]) AS x FROM b, range(1, 65) r(j) GROUP BY j)), r AS (SELECT id, list_transform(list_zip(v, c), lambda z: z[1]-z[2]) AS r FROM b, m), "
    f"e AS (SELECT id, r, {ip('r', 'r')} AS n2, {ip('r', 'r')} * 8.0 / list_sum(list_transform(r, lambda x: abs(x))) AS dp FROM r), qq AS (SELECT qid, list_transform(list_zip(qv, c), lambda z: z[1]-z[2]) AS y FROM q, m) "
    + ranked(f"SELECT qid, id, n2 + {ip('y', 'y')} - 2 * dp * ((2 * {O._sum('y', 'r', 'CASE WHEN z[2] > 0 THEN z[1] ELSE 0.0 END')} - list_sum(y)) / 8.0) AS dist FROM qq, e", K)
)
def rabitq_search(spark, sf_dir):
    b = base(spark, sf_dir)
    center = F.array(*[F.lit(float(x)) for x in transforms.moments(b)[1]])
    coded = b.select("id", codecs.rabitq_encode("vec", center).alias("vec"))
    q = asks(spark, sf_dir).withColumn("qvec", V.zipped(F.col("qvec"), center, lambda x, c: x - c))
    return shown(exact.knn_join(coded, q, K, codecs.RABITQ))


# --- composition, mutation, evaluation ---------------------------------------------------


@query(f"WITH {QB}, f AS ({ranked('SELECT qid, id, ' + O.METRIC_SQL['l1']('qv', 'v') + ' AS dist FROM q, b', 40)}) " + ranked(_exact_of("f"), K))
def refine_two_stage(spark, sf_dir):
    b, q = base(spark, sf_dir), asks(spark, sf_dir)
    return shown(exact.refine(exact.knn_join(b, q, 40, "l1"), b, q, K, 4.0))


@query(knn("l2", K))
def shards_merged(spark, sf_dir):
    b, q = base(spark, sf_dir), asks(spark, sf_dir)
    return shown(merge_top_k([exact.knn_join(b.where(F.col("id") % 3 == i), q, K) for i in range(3)], K)).select("qid", "rank", "id", "dist")


@query(f"WITH {QB} " + ranked(f"SELECT qid, id, {l2('qv', 'v')} AS dist FROM q, (SELECT id, v FROM b WHERE id % 10 <> 3 AND id % 7 <> 1 UNION ALL SELECT id + 100000000, v FROM b WHERE id % 10 = 3)", K))
def upsert_remove_merge(spark, sf_dir):
    b = base(spark, sf_dir)
    rest = mutate.remove(mutate.remove(b, F.col("id") % 10 == 3), b.where("id % 7 = 1").select("id"))
    return shown(exact.knn_join(mutate.merge(rest, b.where("id % 10 = 3"), 100_000_000), asks(spark, sf_dir), K))


@query(f"WITH {QB} " + ranked(f"SELECT qid, id, {l2('qv', 'v')} AS dist FROM q, b WHERE id // 50 BETWEEN 3 AND 5", K))
def sliding_window(spark, sf_dir):
    b = base(spark, sf_dir).withColumn("slice", F.floor(F.col("id") / 50))
    return shown(exact.knn_join(mutate.sliding_window(b, "slice", 5, 3), asks(spark, sf_dir), K))


@query(f"WITH {QB}, d AS (SELECT id, v FROM b UNION ALL SELECT id + 100000000, v FROM b WHERE id % 4 = 0) SELECT min(id) AS id, count(*) AS n FROM d GROUP BY v")
def dedup_vectors(spark, sf_dir):
    b = base(spark, sf_dir).select("id", "vec")
    out = mutate.dedup_vectors(mutate.merge(b, b.where("id % 4 = 0"), 100_000_000))
    return out.select("id", F.size("instances").cast("long").alias("n"))


@query(f"WITH {QB} SELECT id, round(list_sum(v), 6) AS total FROM b WHERE id IN (60, 70, 80)")
def reconstruct(spark, sf_dir):
    return mutate.reconstruct(base(spark, sf_dir), spark.createDataFrame([(60,), (70,), (80,)], "id long")).select("id", F.round(V.total(F.col("vec")), 6).alias("total"))


_TWO = f"WITH {QB}, t AS ({ranked('SELECT qid, id, ' + l2('qv', 'v') + ' AS dist FROM q, b', K)}), f AS ({ranked('SELECT qid, id, ' + O.METRIC_SQL['linf']('qv', 'v') + ' AS dist FROM q, b', 100)})"


def _found(spark, sf_dir):
    b, q = base(spark, sf_dir), asks(spark, sf_dir)
    return exact.knn_join(b, q, 100, "linf"), exact.knn_join(b, q, K)


@query(f"{_TWO} SELECT r, avg((coalesce(f.rank, 1000) <= r)::INT)::DOUBLE AS rate FROM (SELECT unnest([1, 10, 100]) AS r) CROSS JOIN (SELECT * FROM t WHERE rank = 1) t LEFT JOIN f ON f.qid = t.qid AND f.id = t.id GROUP BY r")
def first_in_r(spark, sf_dir):
    return evaluate.first_in_r(*_found(spark, sf_dir))


@query(f"{_TWO} SELECT count(*) / (SELECT 10.0::DOUBLE * count(*) FROM q) AS intersection FROM t JOIN f USING (qid, id) WHERE f.rank <= 10")
def intersection_measure(spark, sf_dir):
    return evaluate.intersection(*_found(spark, sf_dir), K)


@query(f"WITH {QB}, f AS (SELECT qid, id FROM q, b WHERE {O.METRIC_SQL['l1']('qv', 'v')} < 7.6), t AS (SELECT qid, id FROM q, b WHERE {l2('qv', 'v')} < 1.4), n AS (SELECT qid, (SELECT count(*) FROM f WHERE f.qid = q.qid) AS nres, (SELECT count(*) FROM t WHERE t.qid = q.qid) AS ngt, (SELECT count(*) FROM f JOIN t USING (qid, id) WHERE f.qid = q.qid) AS n FROM q) SELECT qid, CASE WHEN nres = 0 THEN 1.0 ELSE n / nres END::DOUBLE AS precision, CASE WHEN ngt > 0 THEN n / ngt WHEN nres = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall FROM n")
def range_precision_recall(spark, sf_dir):
    b, q = base(spark, sf_dir), asks(spark, sf_dir)
    return evaluate.range_precision_recall(exact.range_join(b, q, 7.6, "l1"), exact.range_join(b, q, 1.4), q)


@query("WITH p AS (SELECT p_partkey AS id, p_size AS perf, p_retailprice AS cost FROM part), w AS (SELECT *, max(perf) OVER (ORDER BY cost, perf DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM p) SELECT perf, cost FROM w WHERE best IS NULL OR perf > best")
def pareto_front(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return evaluate.pareto(p.select(F.col("p_size").alias("perf"), F.col("p_retailprice").alias("cost")))


@query(f"WITH {_PQ}, g AS (SELECT b.label, e.m, e.cid, count(*) AS n FROM e JOIN b USING (id) GROUP BY ALL) SELECT label, m::INTEGER AS m, cid::INTEGER AS code, n FROM g QUALIFY row_number() OVER (PARTITION BY label, m ORDER BY n DESC, cid) = 1")
def code_modes(spark, sf_dir):
    b, _, codes = _pq(spark, sf_dir)
    arrays = codes.select("id", F.transform(F.sequence(F.lit(1), F.lit(M)), lambda i: F.conv(F.hex(F.substring("code", i, F.lit(1))), 16, 10).cast("int")).alias("code"))
    return cluster.modes(arrays.join(b.select("id", "label"), "id"), "label").select("label", "m", "code", "n")


# --- graphs -----------------------------------------------------------------------------


@query(f"WITH {QB} SELECT id, rank, nbr, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nbr) AS rank FROM (SELECT x.id, y.id AS nbr, {l2('x.v', 'y.v')} AS dist FROM b x JOIN b y ON x.id <> y.id)) WHERE rank <= 5")
def knn_graph(spark, sf_dir):
    return shown(graph.knn_graph(base(spark, sf_dir), 5))


@query()
def nn_descent(spark, sf_dir):
    return shown(graph.nn_descent(base(spark, sf_dir), 5))


@query()
def hnsw_search(spark, sf_dir):
    return shown(graph.GraphIndex.build(base(spark, sf_dir), 16, 100, shards=2).search(asks(spark, sf_dir), K, 64))


@query()
def navigating_graph(spark, sf_dir):
    return shown(graph.navigating_search(base(spark, sf_dir), asks(spark, sf_dir), K, 16, 40, 64, shards=2))


@query()
def ivf_hnsw(spark, sf_dir):
    b, q = base(spark, sf_dir), asks(spark, sf_dir)
    index = IvfIndex.build(b, 8, ITER)
    probes: dict[int, list[int]] = {}
    for r in index.probes(q, 7).collect():
        probes.setdefault(r["qid"], []).append(r["cid"])
    g = graph.GraphIndex.build(index.lists, 16, 100, shard_by=F.col("cid"))
    return shown(g.search(q, K, 64, shards=probes))


def _factory(name: str, description: str, **options):
    def run(spark, sf_dir):
        b = base(spark, sf_dir)
        return shown(index_factory(description).build(b, iterations=2).search(asks(spark, sf_dir), K, k_factor=depth(b) // K, **options))

    query(None, name)(run)


_factory("factory_opq_ivfpq", "OPQ8,IVF16,PQ8x4,RFlat", nprobe=14)
_factory("factory_pca_sq8", "PCA32,SQ8,RFlat")
_factory("factory_itq_lsh", "ITQ32,LSH32,RFlat")


# --- combinations -----------------------------------------------------------------------


def _half(h: int) -> str:
    cut = "v[1:32]" if h == 0 else "v[33:64]"
    return f"b{h} AS MATERIALIZED (SELECT id, {cut} AS v FROM b), {O.lloyd(4, ITER, f'b{h}', f'h{h}', 32)}"


@query(
    f"WITH {QB}, {_half(0)}, {_half(1)}, p AS MATERIALIZED (SELECT * FROM (SELECT qid, x.cid AS x, y.cid AS y, row_number() OVER (PARTITION BY qid ORDER BY round({l2('qv[1:32]', 'x.c')} + {l2('qv[33:64]', 'y.c')}, 9), x.cid * 4 + y.cid) AS probe FROM q, h0{ITER} x, h1{ITER} y) WHERE probe <= 13) "
    + ranked(f"SELECT p.qid, b.id, {l2('qv', 'v')} AS dist FROM p JOIN q USING (qid) JOIN h0a{ITER} a ON a.cid = p.x JOIN h1a{ITER} c ON c.cid = p.y AND c.id = a.id JOIN b ON b.id = a.id", K)
)
def multi_index(spark, sf_dir):
    from quillon.operators.multi import MultiIndex

    return shown(MultiIndex.build(base(spark, sf_dir), 4, ITER).search(asks(spark, sf_dir), K, 13))


@query(knn("l2", K))
def split_vectors(spark, sf_dir):
    from quillon.operators.multi import split_search

    return shown(split_search(base(spark, sf_dir), asks(spark, sf_dir), K, [16, 16, 32]))


@query(f"WITH {QB}, d AS (SELECT id, v FROM b UNION ALL SELECT id + 100000000, v FROM b WHERE id % 4 = 0) " + ranked(f"SELECT qid, id, {l2('qv', 'v')} AS dist FROM q, d", K))
def ivf_flat_dedup(spark, sf_dir):
    b = base(spark, sf_dir).select("id", "vec")
    distinct = mutate.dedup_vectors(mutate.merge(b, b.where("id % 4 = 0"), 100_000_000))
    found = IvfIndex.build(distinct.select("id", "vec"), NLIST, 1).search(asks(spark, sf_dir), K, NLIST)
    return shown(top_k(mutate.expand_instances(found, distinct), K)).select("qid", "rank", "id", "dist")


@query(f"{_BITS} SELECT h AS hamming, count(*) AS n FROM h GROUP BY h")
def hamming_histogram(spark, sf_dir):
    every = exact.range_join(*_bits_of(spark, sf_dir), 64, "l1", inclusive=True)
    return every.groupBy(F.col("dist").cast("long").alias("hamming")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {QB} SELECT id, round(list_sort(v)[1], 6) AS lo, round(list_sort(v)[3], 6) AS third, round(list_reverse_sort(v)[2], 6) AS second FROM b")
def row_extremes(spark, sf_dir):
    lo, hi = V.smallest(F.col("vec"), 3), V.largest(F.col("vec"), 2)
    return base(spark, sf_dir).select("id", F.round(lo[0], 6).alias("lo"), F.round(lo[2], 6).alias("third"), F.round(hi[1], 6).alias("second"))


@query(
    f"WITH {QB}, {O.lloyd(8, 2, 'b', 'f')}, r AS MATERIALIZED (SELECT id, list_transform(list_zip(v, c), lambda z: z[1]-z[2]) AS v FROM b JOIN fa2 a USING (id) JOIN f2 c ON c.cid = a.cid), {O.lloyd(8, 2, 'r', 'g')} "
    "SELECT a.id, a.cid::INTEGER AS first, g.cid::INTEGER AS second FROM fa2 a JOIN ga2 g USING (id)"
)
def residual_quantizer(spark, sf_dir):
    from quillon.operators.additive import AdditiveQuantizer

    b = base(spark, sf_dir)
    codes = AdditiveQuantizer.train(b, 2, 8, 2).encode(b)
    byte = lambda i: F.conv(F.hex(F.substring("code", i, 1)), 16, 10).cast("int")
    return codes.select("id", byte(1).alias("first"), byte(2).alias("second"))


@query(f"WITH {QB} SELECT qid, id, round({l2('qv', 'v')}, 6) AS l2, round({O.METRIC_SQL['cosine']('qv', 'v')}, 6) AS cosine, round({O.METRIC_SQL['linf']('qv', 'v')}, 6) AS linf FROM q, b WHERE (qid + id) % 40 = 0")
def sql_functions(spark, sf_dir):
    from quillon.functions.sql import register

    register(spark)
    base(spark, sf_dir).createOrReplaceTempView("_base")
    asks(spark, sf_dir).createOrReplaceTempView("_asks")
    return spark.sql("SELECT qid, id, round(vec_l2(qvec, vec), 6) AS l2, round(vec_cosine(qvec, vec), 6) AS cosine, round(vec_linf(qvec, vec), 6) AS linf FROM _asks JOIN _base ON (qid + id) % 40 = 0")


@query()
def local_search_quantizer(spark, sf_dir):
    from quillon.operators.additive import AdditiveQuantizer

    b = base(spark, sf_dir)
    q = AdditiveQuantizer.train(b, 4, 16, 2, beam=4, rounds=2)
    return shown(q.search_reranked(q.encode(b), b, asks(spark, sf_dir), K, depth(b)))


@query()
def two_level_codes(spark, sf_dir):
    from quillon.operators.multi import TwoLevelCodes

    b = base(spark, sf_dir)
    return shown(TwoLevelCodes.build(b, 8, 8, 16, fine_m=8, iterations=2).search_reranked(b, asks(spark, sf_dir), K, depth(b)))


#: Approximate searches that end in exact distances, and so are measured by recall.
RECALLED = ("ivf_search", "pq_reranked", "ivfpq_per_list", "pqivf", "hnsw_search", "navigating_graph", "ivf_hnsw", "ivf_sq8", "ivf_sq6", "multi_index", "local_search_quantizer", "two_level_codes", "factory_opq_ivfpq", "factory_pca_sq8", "factory_itq_lsh", "offline_job")


@query()
def index_recalls(spark, sf_dir):
    """(name, recall): mean share of the exact ten, the query itself among them, that each registered approximate search finds."""
    truth = cut(exact.knn_join(base(spark, sf_dir), asks(spark, sf_dir), K))
    rows = [evaluate.recall_at_k(QUERIES[name](spark, sf_dir), truth, K).agg(F.avg("recall").alias("recall")).select(F.lit(name).alias("name"), "recall") for name in RECALLED]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query()
def offline_job(spark, sf_dir):
    from quillon.plans.offline import run

    r = run(base(spark, sf_dir), asks(spark, sf_dir), NLIST, 13, K)
    return shown(r.results)
