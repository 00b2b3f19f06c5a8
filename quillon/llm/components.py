"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut

#: So many edges (4 MB) are labelled on the driver; more, by rounds of joins.
AT_ONCE = 1 << 18


def labelled(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (x, y), and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    i, j = at[: len(x)], at[len(x) :]
    comp = np.arange(len(nodes))
    while True:
        lo, hi = np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])
        if (lo == hi).all():
            return nodes, nodes[comp]
        np.minimum.at(comp, hi, lo)
        while (comp[comp] != comp).any():
            comp = comp[comp]


def components(edges: DataFrame, a: str = "a", b: str = "b", at_once: int = AT_ONCE) -> DataFrame:
    """(node, comp): comp is the smallest node that is reachable.  Nodes are longs.

    edges are read more than once, so they should be cut.  At most `at_once` of them are
    labelled on the driver, which saves the rounds' shuffles and files.  Of more, each
    round every node takes the smallest label among itself and its neighbours, then
    the label of that label, so labels travel in doubling steps.  Both steps are joins on
    a unique side with map-side minima, so a hub costs no more than its edges.  Labels are
    cut every round and only counts reach the driver.
    """
    both = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x <> y")
    if both.count() <= at_once:
        got = both.toArrow()
        node, comp = labelled(got["x"].to_numpy(), got["y"].to_numpy())
        return edges.sparkSession.createDataFrame(pa.table({"node": pa.array(node, pa.int64()), "comp": pa.array(comp, pa.int64())}), "node long, comp long")
    both = cut(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = cut(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("y")).select("node", F.least("node", "y").alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), F.col("comp").alias("c")), "y").groupBy(F.col("x").alias("node")).agg(F.min("c").alias("c"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "c").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("c"))
        new = cut(step.join(jump, "comp").select("node", "old", F.least("comp", "c").alias("comp")))
        changed = new.where("old <> comp").count()
        labels = new.select("node", "comp")
        if not changed:
            return labels
