"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

On each level a row draws for every child a uniform u from a hash of its id and the
child's name, and goes to the child with the smallest -ln(u) / weight.  A child's
chance is its share of the weight; when a child's weight grows, rows only move into
that child, and within children whose weights stay the same nothing moves.

One more shard takes rows only into itself, at any number of shards.  The base tree always
has all its places; a place whose shard does not exist yet is vacant, and a row that
arrives there descends again with other draws, ATTEMPTS times at most, and then draws among
all existing shards of the tree.  A shard that fills a place so gets the rows that had met
it first, and no other row notices.  Shards beyond the base tree are regions of their own.

Law: `key` (the id and the number of shards decide).  All work is DataFrame
expressions: the draws are one projection; slots need one shuffle of narrow rows.

Slots number a shard's rows without gaps from 0.  A shard is never gathered: rows are
dealt into (shard, cell) by hash, cells are counted map-side, running offsets over the
cells come from that small table, and rows are numbered within their cell only.  The
number of cells grows with the rows.

Defined results: null text has size 8 and text_crc32 0.  A null id is drawn like the
word `null`.  Equal ids get equal shards; rows that are equal in everything are numbered
in any order.  Empty tables give empty results.  Extra columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import column, parts


@dataclass(frozen=True)
class Node:
    """A node of the tree; a leaf has a shard number, a vacant place has neither that nor children."""

    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int | None = None


def leaf(shard: int, weight: float = 1.0) -> Node:
    return Node(f"shard{shard}", weight, (), shard)


def inner(name: str, children: list[Node]) -> Node:
    """A node that weighs what its children weigh."""
    return Node(name, sum(c.weight for c in children), tuple(children))


def topology(shards: int, regions: int = 3, racks: int = 2, per_rack: int = 4) -> Node:
    """A tree of `shards` equal shards.

    The first regions * racks * per_rack shards have their places in the base tree; every
    other shard is a region of its own.  topology(n + 1) is topology(n) with one vacant place
    filled or one region more.
    """
    base = regions * racks * per_rack
    place = lambda s: leaf(s) if s < shards else Node(f"shard{s}", 1.0)
    tops = []
    for g in range(regions):
        rack_nodes = []
        for r in range(racks):
            first = (g * racks + r) * per_rack
            rack_nodes.append(inner(f"region{g}/rack{r}", [place(first + i) for i in range(per_rack)]))
        tops.append(inner(f"region{g}", rack_nodes))
    for s in range(base, shards):
        tops.append(inner(f"region+{s}", [inner(f"region+{s}/rack0", [leaf(s)])]))
    return inner("root", tops)


def leaves(node: Node) -> list[Node]:
    """The existing shards of a tree that have a weight."""
    if node.weight <= 0:
        return []
    return [node] if node.shard is not None else [x for c in node.children for x in leaves(c)]


def vacant(node: Node) -> bool:
    return node.shard is None and (not node.children or any(vacant(c) for c in node.children))


def reweighted(node: Node, weights: dict[int, float]) -> Node:
    """The tree with other weights for some shards; ancestors weigh what their children weigh."""
    if node.shard is not None:
        return leaf(node.shard, weights.get(node.shard, node.weight))
    return inner(node.name, [reweighted(c, weights) for c in node.children]) if node.children else node


#: Draws have 52 bits, so that they are exact doubles above 0 and below 1.
_DRAW = float(1 << 52)


#: Descents past vacant places before a row draws among all existing shards.
ATTEMPTS = 3


def _cost(key: Column, name: str, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 12).cast("double")
    return -F.log((bits + 0.5) / _DRAW) / F.lit(float(weight))


def _race(key: Column, suffix: str, nodes: list[Node], then) -> Column:
    """What `then` makes of the node with the least cost."""
    if len(nodes) == 1:
        return then(nodes[0])
    costs = [_cost(key, n.name + suffix, n.weight) for n in nodes]
    least, out = F.least(*costs), then(nodes[-1])
    for n, cost in reversed(list(zip(nodes[:-1], costs[:-1]))):
        out = F.when(cost == least, then(n)).otherwise(out)
    return out


def _down(key: Column, node: Node, suffix: str) -> Column:
    """The shard at the end of one descent, null at a vacant place."""
    if node.shard is not None or not node.children:
        return F.lit(node.shard).cast("int")
    live = [c for c in node.children if c.weight > 0]
    if not live:
        raise ValueError(f"{node.name} has no weight")
    return _race(key, suffix, live, lambda c: _down(key, c, suffix))


def descend(key: Column, node: Node) -> Column:
    """The shard that the tree gives a key, as one expression."""
    if not vacant(node):
        return _down(key, node, "")
    some = leaves(node)
    if not some:
        raise ValueError(f"{node.name} has no shard")
    tries = [_down(key, node, f"#{a}" if a else "") for a in range(ATTEMPTS)]
    return F.coalesce(*tries, _race(key, "#all", some, lambda n: F.lit(n.shard).cast("int")))


#: Rows of a cell, on average; a task numbers some cells at a time.
CELL_ROWS = 200_000


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", tree: Node | None = None, grown: Node | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot, grown_shard."""
    tree, grown = tree or topology(shards), grown or topology(shards + 1)
    key = F.coalesce(column(id_col).cast("string"), F.lit("null"))
    rows = docs.select(
        column(id_col).alias(id_col),
        (F.coalesce(F.octet_length(column(text_col)), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(column(text_col), F.lit(""))).alias("text_crc32"),
        descend(key, tree).cast("int").alias("shard"),
        descend(key, grown).cast("int").alias("grown_shard"),
    )
    cells = parts(docs.count(), shards * cell_rows, 16)
    rows = rows.withColumn("cell", F.pmod(F.xxhash64(key, F.col("text_crc32"), F.lit("cell")), F.lit(cells)).cast("int"))
    counts = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "cell", F.coalesce(before, F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("shard", "cell").orderBy(column(id_col).asc_nulls_first(), "text_crc32", "size"))
    numbered = rows.withColumn("own", own)
    return numbered.join(offsets, ["shard", "cell"]).select(
        id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("own") - 1 + F.col("offset")).cast("long").alias("slot"), "grown_shard"
    )
