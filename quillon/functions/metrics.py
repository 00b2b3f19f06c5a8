"""Metrics: a Column expression and a numpy kernel for each, and which way they sort.

Kernels take Q (queries x d) and B (rows x d) in doubles and give queries x rows.  The
product metrics are one matrix multiplication; the others go query by query, so their
memory is that of B.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.vectors import dbl, inner_product, norm, sq_l2, total, zipped


@dataclass(frozen=True)
class Metric:
    name: str
    column: Callable[[Column, Column], Column]
    kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]
    descending: bool = False
    #: Of rows x and y, one by one, summed from the first dimension to the last; where the kernel's own rounding depends on how it multiplies.
    pairs: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None


def _each(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    return lambda q, b: np.stack([f(x, b) for x in q]) if len(q) else np.zeros((0, len(b)))


def _l2(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((q * q).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (q @ b.T), 0.0)


def l2_pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distance of each row of x to the same row of y, as a sum of squares from left to right: 0 for equal rows."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        gap = x[:, j] - y[:, j]
        out += gap * gap
    return out


def l2_table(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """l2_pairs of each row of q with each of b: queries x rows."""
    out = np.zeros((len(q), len(b)))
    for x, y in zip(np.ascontiguousarray(q.T), np.ascontiguousarray(b.T)):
        gap = x[:, None] - y[None, :]
        out += gap * gap
    return out


def l2_error(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far _l2 may be from l2_pairs: queries x rows."""
    return 4 * (q.shape[1] + 4) * np.finfo(float).eps * ((q * q).sum(1)[:, None] + (b * b).sum(1)[None, :])


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b != 0)


def _js(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    m = (x + b) / 2
    part = lambda p: np.where(p > 0, -p * np.log(np.divide(m, p, out=np.ones_like(m), where=p > 0)), 0.0)
    return 0.5 * (part(np.broadcast_to(x, b.shape)) + part(b)).sum(1)


def _nan_l2(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    ok = ~(np.isnan(x) | np.isnan(b))
    n = ok.sum(1)
    s = (np.where(ok, x - b, 0.0) ** 2).sum(1)
    return np.where(n > 0, s * b.shape[1] / np.maximum(n, 1), np.nan)


def _gower(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    ok = ~(np.isnan(x) | np.isnan(b))
    num, cat = (x >= 0) & (b >= 0), (x < 0) & (b < 0)
    gap = np.abs(x - b)
    d = np.where(num, np.where(gap > 1, np.nan, gap), np.where(cat, (x != b).astype(float), np.nan))
    n = ok.sum(1)
    return np.where(n > 0, np.where(ok, d, 0.0).sum(1) / np.maximum(n, 1), np.nan)


_safe = lambda a, b: F.when(b != 0, a / b).otherwise(0.0)


def _c_cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.lit(1.0) - _safe(inner_product(a, b), n)


def _c_js(a: Column, b: Column) -> Column:
    part = lambda p, m: F.when(p > 0, -p * F.ln(m / p)).otherwise(0.0)
    return total(zipped(a, b, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))) * 0.5


def _c_nan(a: Column, b: Column) -> Column:
    ok = lambda x, y: ~F.isnan(x) & ~F.isnan(y)
    n = total(zipped(a, b, lambda x, y: ok(x, y).cast("double")))
    s = total(zipped(a, b, lambda x, y: F.when(ok(x, y), (x - y) * (x - y)).otherwise(0.0)))
    return F.when(n > 0, s * F.size(a) / n).otherwise(F.lit(float("nan")))


def _c_gower(a: Column, b: Column) -> Column:
    nan = F.lit(float("nan"))
    ok = lambda x, y: ~F.isnan(x) & ~F.isnan(y)
    one = lambda x, y: F.when((x >= 0) & (y >= 0), F.when(F.abs(x - y) > 1, nan).otherwise(F.abs(x - y))).when((x < 0) & (y < 0), (x != y).cast("double")).otherwise(nan)
    n = total(zipped(a, b, lambda x, y: ok(x, y).cast("double")))
    return F.when(n > 0, total(zipped(a, b, lambda x, y: F.when(ok(x, y), one(x, y)).otherwise(0.0))) / n).otherwise(nan)


def lp(p: float) -> Metric:
    """Sum of |x - y| ** p, without the root."""
    return Metric(f"lp{p:g}", lambda a, b: total(zipped(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p)))), _each(lambda x, b: (np.abs(x - b) ** p).sum(1)))


METRICS: dict[str, Metric] = {
    m.name: m
    for m in (
        Metric("l2", sq_l2, _l2, pairs=l2_pairs),
        Metric("ip", inner_product, lambda q, b: q @ b.T, True),
        Metric("ip1", lambda a, b: F.lit(1.0) - inner_product(a, b), lambda q, b: 1.0 - q @ b.T),
        Metric("cosine", _c_cosine, lambda q, b: 1.0 - _unit(q) @ _unit(b).T),
        Metric("l1", lambda a, b: total(zipped(a, b, lambda x, y: F.abs(x - y))), _each(lambda x, b: np.abs(x - b).sum(1))),
        Metric("linf", lambda a, b: F.array_max(zipped(a, b, lambda x, y: F.abs(x - y))), _each(lambda x, b: np.abs(x - b).max(1))),
        lp(3),
        Metric("canberra", lambda a, b: total(zipped(a, b, lambda x, y: _safe(F.abs(x - y), F.abs(x) + F.abs(y)))), _each(lambda x, b: _ratio(np.abs(x - b), np.abs(x) + np.abs(b)).sum(1))),
        Metric(
            "braycurtis",
            lambda a, b: _safe(total(zipped(a, b, lambda x, y: F.abs(x - y))), total(zipped(a, b, lambda x, y: F.abs(x + y)))),
            _each(lambda x, b: _ratio(np.abs(x - b).sum(1), np.abs(x + b).sum(1))),
        ),
        Metric("jensenshannon", _c_js, _each(_js)),
        Metric(
            "jaccard",
            lambda a, b: _safe(total(zipped(a, b, lambda x, y: F.least(x, y))), total(zipped(a, b, lambda x, y: F.greatest(x, y)))),
            _each(lambda x, b: _ratio(np.minimum(x, b).sum(1), np.maximum(x, b).sum(1))),
            True,
        ),
        Metric("abs_ip", lambda a, b: total(zipped(a, b, lambda x, y: F.abs(x * y))), _each(lambda x, b: np.abs(x * b).sum(1)), True),
        Metric("nan_euclidean", _c_nan, _each(_nan_l2)),
        Metric("gower", _c_gower, _each(_gower)),
    )
}


def metric(name: str | Metric) -> Metric:
    return name if isinstance(name, Metric) else METRICS[name]


def distance(name: str, a: Column | str, b: Column | str) -> Column:
    """The metric between two vector columns."""
    return metric(name).column(dbl(a), dbl(b))
