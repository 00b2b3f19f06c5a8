"""SQL for the vector queries, as DuckDB runs it; iterations are unrolled into named tables."""

from __future__ import annotations

DIM = 64
QB = """q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0),
b AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"""


def _sum(a: str, b: str, f: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: {f}))"


def l2(a: str, b: str) -> str:
    return _sum(a, b, "(z[1]-z[2])*(z[1]-z[2])")


def ip(a: str, b: str) -> str:
    return _sum(a, b, "z[1]*z[2]")


def _ratio(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) ELSE 0.0 END)"


METRIC_SQL = {
    "l2": lambda a, b: l2(a, b),
    "ip": lambda a, b: ip(a, b),
    "ip1": lambda a, b: f"(1.0 - {ip(a, b)})",
    "cosine": lambda a, b: f"(1.0 - {_ratio(ip(a, b), f'sqrt({ip(a, a)}) * sqrt({ip(b, b)})')})",
    "l1": lambda a, b: _sum(a, b, "abs(z[1]-z[2])"),
    "linf": lambda a, b: f"list_max(list_transform(list_zip({a}, {b}), lambda z: abs(z[1]-z[2])))",
    "lp3": lambda a, b: _sum(a, b, "pow(abs(z[1]-z[2]), 3)"),
    "canberra": lambda a, b: _sum(a, b, "CASE WHEN abs(z[1])+abs(z[2]) <> 0 THEN abs(z[1]-z[2])/(abs(z[1])+abs(z[2])) ELSE 0.0 END"),
    "braycurtis": lambda a, b: _ratio(_sum(a, b, "abs(z[1]-z[2])"), _sum(a, b, "abs(z[1]+z[2])")),
    "jensenshannon": lambda a, b: "0.5*" + _sum(a, b, "(CASE WHEN z[1]>0 THEN -z[1]*ln((z[1]+z[2])/2/z[1]) ELSE 0.0 END) + (CASE WHEN z[2]>0 THEN -z[2]*ln((z[1]+z[2])/2/z[2]) ELSE 0.0 END)"),
    "jaccard": lambda a, b: _ratio(_sum(a, b, "least(z[1],z[2])"), _sum(a, b, "greatest(z[1],z[2])")),
    "abs_ip": lambda a, b: _sum(a, b, "abs(z[1]*z[2])"),
    "gower": lambda a, b: _sum(a, b, "abs(z[1]-z[2])") + f"/{DIM}.0",
    "nan_euclidean": lambda a, b: f"({_sum(a, b, 'CASE WHEN isnan(z[1]) OR isnan(z[2]) THEN 0.0 ELSE (z[1]-z[2])*(z[1]-z[2]) END')} * {DIM}.0 / {_sum(a, b, 'CASE WHEN isnan(z[1]) OR isnan(z[2]) THEN 0 ELSE 1 END')})",
}
DESCENDING = ("ip", "jaccard", "abs_ip")


def ranked(rows: str, k: int, order: str = "dist, id", columns: str = "qid, rank, id, round(dist, 6) AS dist") -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}) AS rank FROM ({rows}) t) u WHERE rank <= {k}"


def knn(metric: str, k: int = 10, prepare: str = "{}", where: str = "true") -> str:
    expr = METRIC_SQL[metric]("qv", "v")
    order = "dist DESC, id" if metric in DESCENDING else "dist, id"
    fix = lambda c: prepare.format(c)
    return f"WITH {QB}, q2 AS (SELECT qid, {fix('qv')} AS qv FROM q), b2 AS (SELECT id, {fix('v')} AS v FROM b WHERE {where}) " + ranked(f"SELECT qid, id, {expr} AS dist FROM q2, b2", k, order)


def lloyd(nlist: int, iterations: int, source: str = "b", name: str = "c", d: int = DIM, spherical: bool = False, weight: str = "1.0") -> str:
    """Named tables c0..cN (cid, c) and a0..a{N-1}, aN: the assignment to the last centroids."""
    dist = f"(1.0 - {ip('v', 'c')})" if spherical else l2("v", "c")
    out = [f"{name}0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) - 1 AS cid, v AS c FROM (SELECT id, v FROM {source} ORDER BY id LIMIT {nlist}))"]
    for i in range(iterations + 1):
        out.append(f"{name}a{i} AS MATERIALIZED (SELECT id, cid, d FROM (SELECT id, cid, round({dist}, 9) AS d FROM {source}, {name}{i}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, cid) = 1)")
        if i < iterations:
            out.append(
                f"{name}m{i} AS MATERIALIZED (SELECT cid, list(x ORDER BY j) AS m FROM (SELECT a.cid, j, sum(s.v[j] * {weight}) / sum({weight}) AS x FROM {name}a{i} a JOIN {source} s USING (id), range(1, {d + 1}) r(j) GROUP BY a.cid, j) GROUP BY cid)"
            )
            m = f"list_transform(m, lambda x: x / sqrt({ip('m', 'm')}))" if spherical else "m"
            out.append(f"{name}{i + 1} AS MATERIALIZED (SELECT c.cid, coalesce({m}, c) AS c FROM {name}{i} c LEFT JOIN {name}m{i} m ON c.cid = m.cid)")
    return ", ".join(out)


def ivf(nlist: int, iterations: int, nprobe: int) -> str:
    """Named tables to probes p(qid, cid, probe, cdist) and candidates x(qid, probe, cid, id, dist)."""
    n = iterations
    return (
        f"{QB}, {lloyd(nlist, n)}, p AS MATERIALIZED (SELECT * FROM (SELECT qid, cid, cd, row_number() OVER (PARTITION BY qid ORDER BY cd, cid) AS probe FROM (SELECT qid, cid, {l2('qv', 'c')} AS cd FROM q, c{n})) WHERE probe <= {nprobe}), "
        f"x AS MATERIALIZED (SELECT p.qid, probe, p.cid, b.id, {l2('qv', 'v')} AS dist FROM p JOIN q USING (qid) JOIN ca{n} a ON a.cid = p.cid JOIN b ON b.id = a.id)"
    )


def pq(m: int, k: int, iterations: int, source: str = "b", d: int = DIM) -> str:
    """Named tables: s(id, m, v) sub-vectors, k0..kN(m, cid, c) codebooks, e(id, m, cid) codes."""
    w = d // m
    out = [f"s AS MATERIALIZED (SELECT id, m, v[m * {w} + 1 : m * {w} + {w}] AS v FROM {source}, range({m}) r(m))"]
    out.append(f"k0 AS MATERIALIZED (SELECT m, row_number() OVER (PARTITION BY m ORDER BY id) - 1 AS cid, v AS c FROM s WHERE id IN (SELECT id FROM {source} ORDER BY id LIMIT {k}))")
    for i in range(iterations + 1):
        name = "e" if i == iterations else f"e{i}"
        out.append(f"{name} AS MATERIALIZED (SELECT id, m, cid FROM (SELECT id, s.m, cid, round({l2('v', 'c')}, 9) AS d FROM s JOIN k{i} k ON s.m = k.m) QUALIFY row_number() OVER (PARTITION BY id, m ORDER BY d, cid) = 1)")
        if i < iterations:
            out.append(f"u{i} AS MATERIALIZED (SELECT m, cid, list(x ORDER BY j) AS c2 FROM (SELECT e.m, e.cid, j, avg(s.v[j]) AS x FROM e{i} e JOIN s ON e.id = s.id AND e.m = s.m, range(1, {w + 1}) r(j) GROUP BY e.m, e.cid, j) GROUP BY m, cid)")
            out.append(f"k{i + 1} AS MATERIALIZED (SELECT k.m, k.cid, coalesce(c2, c) AS c FROM k{i} k LEFT JOIN u{i} u ON k.m = u.m AND k.cid = u.cid)")
    out.append(f"qs AS MATERIALIZED (SELECT qid, m, qv[m * {w} + 1 : m * {w} + {w}] AS qv FROM q, range({m}) r(m))")
    out.append(f"lut AS MATERIALIZED (SELECT qid, k.m, cid, {l2('qv', 'c')} AS d FROM qs JOIN k{iterations} k ON qs.m = k.m)")
    return ", ".join(out)


def residual_pq(nlist: int, m: int, k: int, coarse: int, fine: int, per_list: bool, d: int = DIM) -> str:
    """Named tables of an inverted file with coded residuals: rs(id, g, m, v), books, codes e(id, g, cid, m, code)."""
    w = d // m
    g = "a.cid" if per_list else "0"
    out = [lloyd(nlist, coarse), f"r AS MATERIALIZED (SELECT b.id, a.cid AS lst, {g} AS g, list_transform(list_zip(v, c), lambda z: z[1]-z[2]) AS v FROM b JOIN ca{coarse} a USING (id) JOIN c{coarse} c ON c.cid = a.cid)"]
    out.append(f"rs AS MATERIALIZED (SELECT id, lst, g, m, v[m * {w} + 1 : m * {w} + {w}] AS v FROM r, range({m}) t(m))")
    groups = f"(SELECT cid AS g FROM c{coarse})" if per_list else "(SELECT 0 AS g)"
    out.append(f"k0 AS MATERIALIZED (SELECT gg.g, m, row_number() OVER (PARTITION BY gg.g, m ORDER BY id) - 1 AS cid, v AS c FROM rs, {groups} gg WHERE id IN (SELECT id FROM b ORDER BY id LIMIT {k}))")
    for i in range(fine + 1):
        name = "e" if i == fine else f"e{i}"
        out.append(f"{name} AS MATERIALIZED (SELECT id, lst, g, m, cid FROM (SELECT id, lst, rs.g, rs.m, cid, round({l2('v', 'c')}, 9) AS d FROM rs JOIN k{i} k ON rs.m = k.m AND rs.g = k.g) QUALIFY row_number() OVER (PARTITION BY id, m ORDER BY d, cid) = 1)")
        if i < fine:
            out.append(f"u{i} AS MATERIALIZED (SELECT g, m, cid, list(x ORDER BY j) AS c2 FROM (SELECT e.g, e.m, e.cid, j, avg(rs.v[j]) AS x FROM e{i} e JOIN rs ON e.id = rs.id AND e.m = rs.m, range(1, {w + 1}) t(j) GROUP BY ALL) GROUP BY g, m, cid)")
            out.append(f"k{i + 1} AS MATERIALIZED (SELECT k.g, k.m, k.cid, coalesce(c2, c) AS c FROM k{i} k LEFT JOIN u{i} u ON k.g = u.g AND k.m = u.m AND k.cid = u.cid)")
    return ", ".join(out)


def residual_search(nlist: int, m: int, k: int, coarse: int, fine: int, per_list: bool, nprobe: int, keep: int, d: int = DIM) -> str:
    """adc(qid, id, dist) with rank <= keep after residual_pq()."""
    w = d // m
    g = "p.cid" if per_list else "0"
    return (
        f"p AS MATERIALIZED (SELECT * FROM (SELECT qid, qv, cid, c, row_number() OVER (PARTITION BY qid ORDER BY round(cd, 9), cid) AS probe FROM (SELECT qid, qv, cid, c, {l2('qv', 'c')} AS cd FROM q, c{coarse})) WHERE probe <= {nprobe}), "
        f"pr AS MATERIALIZED (SELECT qid, cid, list_transform(list_zip(qv, c), lambda z: z[1]-z[2]) AS rv FROM p), "
        f"lut AS MATERIALIZED (SELECT qid, p.cid AS lst, k.m, k.cid, {l2(f'rv[k.m * {w} + 1 : k.m * {w} + {w}]', 'k.c')} AS d FROM pr p JOIN k{fine} k ON k.g = {g}), "
        f"adc AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rk FROM (SELECT qid, e.id, sum(d) AS dist FROM lut JOIN e ON e.lst = lut.lst AND e.m = lut.m AND e.cid = lut.cid GROUP BY qid, e.id)) WHERE rk <= {keep})"
    )
