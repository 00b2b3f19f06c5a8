"""Metrics as SQL functions of a session, written in SQL, so that Catalyst sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

_SUM = "aggregate(zip_with(a, b, (x, y) -> {0}), 0D, (s, v) -> s + v)"
BODIES = {
    "vec_ip": _SUM.format("x * y"),
    "vec_l2": _SUM.format("(x - y) * (x - y)"),
    "vec_l1": _SUM.format("abs(x - y)"),
    "vec_linf": "array_max(zip_with(a, b, (x, y) -> abs(x - y)))",
    "vec_abs_ip": _SUM.format("abs(x * y)"),
    "vec_canberra": _SUM.format("CASE WHEN abs(x) + abs(y) <> 0 THEN abs(x - y) / (abs(x) + abs(y)) ELSE 0D END"),
}
BODIES["vec_cosine"] = f"1D - {BODIES['vec_ip']} / nullif(sqrt({_SUM.format('x * x')}) * sqrt({_SUM.format('y * y')}), 0D)"


def register(spark: SparkSession) -> list[str]:
    """Creates the temporary functions name(a, b) on arrays of doubles; their names."""
    for name, body in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")
    return list(BODIES)
