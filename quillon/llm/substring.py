"""Substring deduplication by Rabin-Karp hashes of every fixed-length token window.

A window is `width` consecutive words of one document.  Every window of every document is
hashed and counted; a window that occurs more than once is repeated, and a word is removed
when a repeated window that covers it is not the first of its kind (a window with the same
words starts in a smaller id, or earlier in the same document).  Windows are judged on the
input.  Windows that go and touch merge into maximal intervals.

Documents are cut into blocks by ranges of (id, text hash), so the order of blocks is the
order of documents.  A block counts its distinct windows and sends them to the parts of the
hash space (see blocks.py), where all counts meet: a part adds them up, finds for each
repeated window the earliest block, and answers each block with two bits a window.  A window
that a third of all documents hold is one entry a block; no list of its places is ever made.

A window is told apart by 92 bits of two independent hashes: two different windows of n are
confused with chance n * n / 2**93 in all.

Defined results
* null or short text: no window, nothing removed; null counts as no words.
* rows with equal id: ordered by a hash of their text; rows equal in id and text are one
  document and get the same result.  Null ids come before all others.
* empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import blocks
from quillon.llm.common import column
from quillon.llm.textkit import plain, row_windows, words

WIDTH = 20
_NULL_ID = -(1 << 63)


#: Bits of the first hash that a window keeps.
_KEPT = np.uint64(4)


class _Block:
    """The distinct rows of a block in document order, and the windows of their words."""

    def __init__(self, t: pa.Table, width: int):
        ids = t["id"].fill_null(_NULL_ID).to_numpy()
        known = ~np.asarray(t["id"].is_null())
        th = t["th"].to_numpy()
        order = np.lexsort((th, ids, known))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(ids[order]) != 0) | (np.diff(th[order]) != 0) | (np.diff(known[order]) != 0)
        self.row = np.empty(len(order), np.int64)  # of each table row, its distinct row
        self.row[order] = np.cumsum(new) - 1
        self.text = plain(t["text"].take(pa.array(order[new])))
        first, start, one, two, n = [np.zeros(1, np.int64)], [], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], 0
        for w in words(self.text, lower=False, twice=True):
            at, h = row_windows(w, width)
            start.append(at + n)
            one.append(h >> _KEPT)
            two.append((row_windows(w, width, w.others)[1] >> np.uint64(32)).astype(np.uint32))
            first.append(w.first[1:] + n)
            n += len(w.hashes)
        self.first = np.concatenate(first)  # first word of each distinct row
        self.start = np.concatenate(start) if start else np.zeros(0, np.int64)
        a, b = np.concatenate(one), np.concatenate(two)
        by = np.argsort(a, kind="stable")
        x, y = a[by], b[by]
        if ((x[1:] == x[:-1]) & (y[1:] < y[:-1])).any():  # equal first hashes, second ones out of order
            by = np.lexsort((b, a))
            x, y = a[by], b[by]
        change = np.ones(len(by), bool)
        change[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        at = np.flatnonzero(change)
        self.one, self.two = x[at], y[at]  # the distinct windows, sorted
        self.count = np.diff(np.append(at, len(by)))
        self.earliest = by[at]  # both sorts are stable
        self.inverse = np.empty(len(by), np.int64)
        self.inverse[by] = np.cumsum(change) - 1

    def spans(self, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
        return blocks.part_spans(self.one << _KEPT, n_parts)


_ASKED = "block long, part long, windows binary, others binary, counts binary"


def _ask(t: pa.Table, width: int, n_parts: int) -> pa.Table:
    b = _Block(t, width)
    full, cuts = b.spans(n_parts)
    spans = list(zip(cuts[:-1], cuts[1:]))
    return pa.table(
        {
            "block": pa.array(np.full(len(full), t["block"][0].as_py(), np.int64)),
            "part": pa.array(full),
            "windows": pa.array([blocks.sorted_packed(b.one[x:y]) for x, y in spans], pa.binary()),
            "others": pa.array([b.two[x:y].tobytes() for x, y in spans], pa.binary()),
            "counts": pa.array([blocks.counts_packed(b.count[x:y]) for x, y in spans], pa.binary()),
        }
    )


def _answer(t: pa.Table) -> pa.Table:
    """Two bits a window: whether it is repeated, and whether an earlier block has it."""
    t = t.take(pa.array(np.argsort(t["block"].to_numpy(), kind="stable")))
    others = [np.frombuffer(x, "<u4") for x in t["others"].to_pylist()]
    sizes = [len(x) for x in others]
    one = np.concatenate([blocks.sorted_unpacked(x) for x in t["windows"].to_pylist()])
    two = np.concatenate(others)
    count = np.concatenate([blocks.counts_unpacked(x, n) for x, n in zip(t["counts"].to_pylist(), sizes)])
    by = np.lexsort((two, one))  # stable: equal windows stay in block order
    new = np.ones(len(by), bool)
    new[1:] = (one[by][1:] != one[by][:-1]) | (two[by][1:] != two[by][:-1])
    total = np.add.reduceat(count[by], np.flatnonzero(new))
    repeated, late = np.zeros(len(by), bool), np.zeros(len(by), bool)
    repeated[by] = (total > 1)[np.cumsum(new) - 1]
    late[by] = ~new
    cuts = np.cumsum(sizes)[:-1]
    bits = lambda x: pa.array([np.packbits(p).tobytes() for p in np.split(x, cuts)], pa.binary())
    return pa.table({"block": t["block"], "part": t["part"], "repeated": bits(repeated), "late": bits(late)})


def _apply(t: pa.Table, answers: pa.Table, width: int, n_parts: int) -> pa.Table:
    if not len(t):
        return _SCHEMA.empty_table()
    b = _Block(t, width)
    full, cuts = b.spans(n_parts)
    place = {p: (int(x), int(y)) for p, x, y in zip(full.tolist(), cuts[:-1], cuts[1:])}
    repeated, late = np.zeros(len(b.one), bool), np.zeros(len(b.one), bool)
    for part, more, later in zip(answers["part"].to_pylist(), answers["repeated"].to_pylist(), answers["late"].to_pylist()):
        lo, hi = place[part]
        repeated[lo:hi] = np.unpackbits(np.frombuffer(more, np.uint8), count=hi - lo)
        late[lo:hi] = np.unpackbits(np.frombuffer(later, np.uint8), count=hi - lo)
    repeated, late = repeated[b.inverse], late[b.inverse]
    goes = repeated & (late | (b.earliest[b.inverse] != np.arange(len(b.inverse))))
    n_windows = np.diff(np.searchsorted(b.start, b.first))
    n_repeated = np.diff(np.concatenate([[0], np.cumsum(repeated)])[np.searchsorted(b.start, b.first)])
    edge = np.zeros(int(b.first[-1]) + 1, np.int64)
    at = b.start[goes]
    edge[at] += 1
    edge[at + width] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    n_words, n_removed, spans, kept = [], [], [], []
    for r, text in enumerate(b.text):
        g = gone[b.first[r] : b.first[r + 1]]
        own = (text.as_py() or "").encode().split()
        step = np.diff(np.concatenate([[0], g.view(np.int8), [0]]))
        n_words.append(len(g))
        n_removed.append(int(g.sum()))
        spans.append([{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))])
        kept.append(b" ".join(compress(own, ~g)).decode() if n_removed[-1] else b" ".join(own).decode())
    take = pa.array(b.row)
    cols = [pa.array(x, f.type).take(take) for x, f in zip((n_words, n_removed, spans, kept, n_windows, n_repeated), list(_SCHEMA)[1:])]
    return pa.Table.from_arrays([t["id"], *cols], schema=_SCHEMA)


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_SCHEMA = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(_SPAN)), ("kept_text", pa.string()), ("n_windows", pa.int64()), ("n_repeated", pa.int64())])
_OUT = "id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string, n_windows long, n_repeated long"


def substring_dedup(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = blocks.BLOCK_BYTES, part_entries: int = blocks.PART_ENTRIES) -> DataFrame:
    """Per row: id, n_words, n_removed, removed (maximal word intervals, end exclusive), kept_text, n_windows, n_repeated (windows that occur more than once)."""
    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"), F.xxhash64(F.coalesce(column(text_col), F.lit(""))).alias("th"))
    dealt, n_parts = blocks.by_range(rows, block_bytes, part_entries)
    asked = dealt.groupBy("block").applyInArrow(lambda t: _ask(t, width, n_parts), _ASKED)
    answers = asked.groupBy("part").applyInArrow(_answer, "block long, part long, repeated binary, late binary")
    out = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda t, a: _apply(t, a, width, n_parts), _OUT)
    return out.withColumnRenamed("id", id_col)
