"""Line deduplication by a deletion-neighbourhood join.

A line is a repeat when an earlier line has the same text or a text within the edit bound
(insertions, deletions, substitutions of characters).  The bound of a line grows with its
length: one edit for each `per_edit` characters, at most `max_edits`; a pair may differ by
the smaller bound of its two lines.  Order is (id, text hash, line number).  Every repeat
goes, the earliest line of a text stays unless an earlier line is within the bound.  Blank
lines are layout: they stay.

Steps
1. Distinct line texts, pre-aggregated in each batch and each task to their earliest place.
   A place is one decimal number, so that all aggregations are hash aggregations.
2. With a bound of one edit, the first or the last half of a line stays as it was, so a text
   can only have a neighbour if another text agrees with it in one of four (length, half)
   keys.  Texts that share no key have no neighbour; this is exact and drops nothing.
   Larger bounds do without this step.
3. The others are numbered in the order of their places and emit all variants within their
   bound as hashed keys: up to k characters replaced by a wildcard or deleted.  A variant
   with s wildcards and d deletions that equals one of another text with s wildcards and e
   deletions is an edit script of s + d + e steps between the two, and every script within
   the bound gives such a pair.  Hashes come from prefix sums.
4. Variants are joined by aggregation: each key keeps the earliest text for every number of
   deletions, and every text takes the earliest that it meets within the bound over its
   keys.  No pairs within a key are ever made.
5. The edit distance of a text and the partner it met is verified on the texts.
6. Texts with more than one place or an earlier neighbour are joined with the lines.  Lines
   whose text a bitmap of these lacks stay, and are left out before the join.

Skew: texts with very many occurrences are looked up in a broadcast table of bounded size
and their lines are spread (see common.skew_join).

Texts are told apart by two 64-bit hashes.  Rows of one id are told apart by 31 bits of a
hash of their text.

Defined results
* null text: no lines; the row keeps its null.  Rows equal in id and text: one document,
  equal results.  Null ids come first.
* ties: places are distinct otherwise.
* empty tables give empty results; extra columns pass through, except those named like
  an output (n_lines, n_removed, removed_lines), which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bitmap, column, cut, drop_clashes, in_bitmap, private, skew_join
from quillon.llm.textkit import BASE_INV, BYTE, OTHER, U, Lines, lines, mix64, plain, powers, row_of, sealed, segment_sums
from quillon.storage import collected

OUTPUTS = ("n_lines", "n_removed", "removed_lines")
#: Characters of a line for each edit of its bound, and the largest bound.
PER_EDIT, MAX_EDITS = 20, 1
_LENGTH = U(0xA0761D6478BD642F)
_WILD = U(0x2545F4914F6CDD1D)

#: A place is id * 2**62 + tag * 2**31 + line number; a null id counts as -2**64.  Its quotient by 2**31 names the document.
_PLACE = pa.decimal128(38, 0)
_STEP = 1 << 31


def _places(ids: pa.Array, tags: np.ndarray, numbers: np.ndarray) -> pa.Array:
    """The places of lines as decimals, written as 128-bit integers."""
    null = np.asarray(ids.is_null())
    i = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    low = (tags.astype(np.int64) << 31) | numbers.astype(np.int64)
    out = np.empty((len(i), 2), np.int64)
    out[:, 0] = np.where(null, low, (i << 62) | low)
    out[:, 1] = np.where(null, -(1 << 62), i >> 2)
    return pa.Array.from_buffers(_PLACE, len(i), [None, pa.py_buffer(out.tobytes())])


def _document(id_col: str, text_col: str) -> Column:
    """What the places of a document's lines have in common."""
    number = F.lit(_STEP).cast("decimal(12,0)")
    own = F.coalesce(column(id_col).cast("long").cast("decimal(20,0)"), F.lit(str(-(1 << 64))).cast("decimal(20,0)"))
    return (own * number + F.coalesce(F.xxhash64(column(text_col)).bitwiseAND(_STEP - 1), F.lit(0))).cast("decimal(38,0)")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(column(id_col).cast("long").alias("id"), F.xxhash64(column(text_col)).bitwiseAND(_STEP - 1).alias("tag"), column(text_col).alias("text"))


class _Split:
    """The lines that are not blank of some rows: hashes, places, and character counts."""

    def __init__(self, batch: pa.RecordBatch, ln: Lines):
        at = np.flatnonzero(~ln.blank)
        self.row = row_of(ln.first)[at]
        self.number = at - ln.first[self.row]
        self.start, self.end, self.data = ln.start[at], ln.end[at], ln.data
        self.part = batch.slice(ln.rows.start, len(ln.rows))
        _, self.ip = powers(len(ln.data) + 1)

    def hashes(self, table: np.ndarray) -> np.ndarray:
        sums = segment_sums(table, self.data, np.column_stack([self.start, self.end]).ravel())[::2]
        return sealed(sums, self.start, self.end, self.ip).view(np.int64)

    def places(self, pick: np.ndarray | slice = slice(None)) -> pa.Array:
        row = self.row[pick]
        return _places(self.part.column("id").take(pa.array(row)), self.part.column("tag").to_numpy(zero_copy_only=False)[row], self.number[pick])

    def measured(self, least: int) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
        """First hashes and characters of each line, and four half keys of lines of at least `least`.

        First and last half at the line's own length, then as the longer text of a pair.  A
        substitution leaves two texts of equal length with a common first or last half.  A
        deletion leaves the shorter text's own half keys with those of the longer text that
        are made for one character less.  All are sums of three segments of a line: what is
        before the middle character, that character, and what is after it.
        """
        start, end = self.start, self.end
        inner = np.flatnonzero((self.data & 0xC0) == 0x80)  # bytes that begin no character
        before = inner - np.arange(len(inner))  # characters that begin before each
        c0 = start - np.searchsorted(inner, start)
        n = end - np.searchsorted(inner, end) - c0
        cut_at = lambda k: np.clip(c0 + k + np.searchsorted(before, c0 + k, "right"), start, end)
        middle = np.maximum(n - 1, 0) // 2
        m1, m2 = cut_at(middle), cut_at(middle + 1)
        sums = segment_sums(BYTE, self.data, np.column_stack([start, m1, m2, end]).ravel())
        a, b, c = sums[0::4], sums[1::4], sums[2::4]
        even, long_enough, out = n % 2 == 0, n >= least, []
        half = np.where(even, m2, m1)
        for side, size, (x, y), total in (
            (0, n, (start, half), a + np.where(even, b, U(0))),
            (1, n, (half, end), c + np.where(even, U(0), b)),
            (0, n - 1, (start, m1), a),
            (1, n - 1, (m2, end), c),
        ):
            h = mix64(sealed(total, x, y, self.ip) + size.astype(U) * U(0x9E3779B97F4A7C15) + U(side))
            out.append(pa.array(h.view(np.int64), mask=~long_enough))
        return sealed(a + b + c, start, end, self.ip).view(np.int64), n, out


_TEXTS = "t1 long, t2 long, place decimal(38,0), c long, n int, half0 long, half1 long, half2 long, half3 long"


def _distinct_lines(least: int):
    """mapInArrow: rows to the distinct line texts of some rows, each with its earliest place there and its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ln in lines(plain(batch.column("text"))):
                s = _Split(batch, ln)
                if not len(s.start):
                    continue
                (t1, n, half), t2, place = s.measured(least), s.hashes(OTHER), s.places()
                words = np.frombuffer(place.buffers()[1], np.int64).reshape(-1, 2)
                order = np.lexsort((words[:, 0].view(U), words[:, 1], t2, t1))
                a, b = t1[order], t2[order]
                new = np.ones(len(order), bool)
                new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                at = np.flatnonzero(new)
                take = pa.array(order[at])
                c = np.diff(np.append(at, len(order)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[at]), pa.array(b[at]), place.take(take), pa.array(c.astype(np.int64)), pa.array(n[order[at]].astype(np.int32)), *(h.take(take) for h in half)],
                    names=["t1", "t2", "place", "c", "n", "half0", "half1", "half2", "half3"],
                )

    return run


def _repeated_lines(bits: np.ndarray | None):
    """mapInArrow: rows to (t1, t2, place) of lines whose text the bitmap has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ln in lines(plain(batch.column("text"))):
                s = _Split(batch, ln)
                t1 = s.hashes(BYTE)
                at = np.flatnonzero(in_bitmap(bits, t1.view(U)))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(t1[at]), pa.array(s.hashes(OTHER)[at]), s.places(at)], names=["t1", "t2", "place"])

    return run


def _picked_lines(bits: np.ndarray | None):
    """mapInArrow: rows to (place, line) of lines whose text the bitmap has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ln in lines(plain(batch.column("text"))):
                s = _Split(batch, ln)
                at = np.flatnonzero(in_bitmap(bits, s.hashes(BYTE).view(U)))
                if len(at):
                    raw = ln.data.tobytes()
                    yield pa.RecordBatch.from_arrays([s.places(at), pa.array([raw[a:b].decode() for a, b in zip(s.start[at].tolist(), s.end[at].tolist())], pa.string())], names=["place", "line"])

    return run


#: What a text has to emit when the bound is one edit: positions of the last or first half
#: for substitutions, the same for deletions, and itself.
SWAP_LAST, SWAP_FIRST, LESS_LAST, LESS_FIRST, OWN = 1, 2, 4, 8, 16


def variants(line: str, edits: int, need: int = 31) -> Iterator[tuple[np.ndarray, int, int]]:
    """(keys, wildcards, deletions) of a line with up to `edits` characters replaced by a wildcard or deleted.

    `need` leaves out positions that cannot be edited; it only applies to a bound of one.
    """
    c = np.frombuffer(line.encode("utf-32-le"), "<u4").astype(U)
    n = len(c)
    p, _ = powers(n + 1)
    value = mix64(c + U(1)) * p[:n]
    s = np.zeros(n + 1, U)
    np.cumsum(value, out=s[1:], dtype=U)
    shift = [U(pow(BASE_INV, d, 1 << 64)) for d in range(edits + 1)]
    half, short = n // 2, (n - 1) // 2
    with np.errstate(over="ignore"):
        for k in range(min(edits, n) + 1):
            at = np.arange(n).reshape(n, 1) if k == 1 else np.array(list(combinations(range(n), k)), np.int64).reshape(comb(n, k), k)
            for wild in product((True, False), repeat=k):
                rows, deleted = at, 0
                if edits == 1 and k == 1:
                    first, last, (a, b) = (SWAP_FIRST, SWAP_LAST, (half, half)) if wild[0] else (LESS_FIRST, LESS_LAST, (short, short + 1))
                    rows = rows[a if not need & first else 0 : b if not need & last else n] if need & (first | last) else rows[:0]
                elif edits == 1 and not need & OWN:
                    continue
                h, begin = np.zeros(len(rows), U), np.zeros(len(rows), np.int64)
                for j in range(k):
                    x = rows[:, j]
                    h += (s[x] - s[begin]) * shift[deleted]
                    if wild[j]:
                        h += _WILD * p[x] * shift[deleted]
                    else:
                        deleted += 1
                    begin = x + 1
                h += (s[n] - s[begin]) * shift[deleted]
                keys = mix64(h + U(n - deleted) * _LENGTH + U(sum(wild)) + U(edits) * _WILD)
                yield np.unique(keys) if deleted else keys, sum(wild), deleted


_KEYS = "key long, s int, d int, bound int, ord long"


def _neighbourhoods(per_edit: int, max_edits: int):
    """mapInArrow: (ord, need, line) to the variants of each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "s", "d", "bound", "ord"]
        for batch in batches:
            ords, need = batch.column("ord").to_numpy(), batch.column("need").to_pylist()
            held: list[tuple] = []
            size = 0
            for i, line in enumerate(batch.column("line")):
                text = line.as_py()
                for bound in range(1, min(max_edits, len(text) // per_edit) + 1):  # two lines meet under the smaller bound
                    for keys, s, d in variants(text, bound, need[i] if max_edits == 1 else 31):
                        held.append((keys, s, d, bound, ords[i]))
                        size += len(keys)
                if size > 200_000 or i == batch.num_rows - 1:
                    sizes = [len(h[0]) for h in held]
                    flat = lambda j, kind: pa.array(np.repeat(np.array([h[j] for h in held], kind), sizes))  # noqa: E731, B023
                    keys = np.concatenate([h[0] for h in held]) if held else np.zeros(0, U)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), flat(1, np.int32), flat(2, np.int32), flat(3, np.int32), flat(4, np.int64)], names=names)
                    held, size = [], 0

    return run


def _alive(texts: DataFrame, per_edit: int, max_edits: int) -> DataFrame:
    """(t1, place, need): texts that may have a neighbour, and what they have to emit."""
    able = texts.where(F.col("n") >= per_edit)
    if max_edits > 1:
        return able.select("t1", "place", F.lit(31).alias("need"))
    sides = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"half{k}").alias("half")) for k in range(4)])
    half = able.select("t1", "place", F.explode(sides).alias("s")).select("t1", "place", "s.k", "s.half")
    met = half.groupBy("half").agg(F.count_if(F.col("k") < 2).alias("same"), F.count_if(F.col("k") >= 2).alias("longer")).where("same > 1 or (same > 0 and longer > 0)")
    swap = (F.col("k") < 2) & (F.col("same") > 1)
    pair = (F.col("same") > 0) & (F.col("longer") > 0)
    need = (
        F.when(swap & (F.col("k") == 0), SWAP_LAST).when(swap & (F.col("k") == 1), SWAP_FIRST).otherwise(0)
        + F.when(pair & (F.col("k") == 2), LESS_LAST).when(pair & (F.col("k") == 3), LESS_FIRST).when(pair, OWN).otherwise(0)
    )
    return half.join(met, "half").withColumn("need", need).where("need > 0").groupBy("t1", "place").agg(F.bit_or("need").alias("need"))


def _fuzzy_firsts(rows: DataFrame, texts: DataFrame, per_edit: int, max_edits: int) -> DataFrame:
    """(place, near): for texts with an earlier text within the bound, the earliest place among those."""
    alive = cut(_alive(texts, per_edit, max_edits))
    picked = rows.mapInArrow(_picked_lines(bitmap(alive, "t1")), "place decimal(38,0), line string")
    some = picked.join(alive.select("place", "need"), "place").dropDuplicates(["place"])
    # Numbers in the order of the places: ranges are partitions, and a partition's numbers grow.
    some = cut(some.repartitionByRange("place").sortWithinPartitions("place").withColumn("ord", F.monotonically_increasing_id()))
    del alive, picked
    collected(rows.sparkSession)  # the half keys' shuffle files go before variants are shuffled
    keys = some.select("ord", "need", "line").mapInArrow(_neighbourhoods(per_edit, max_edits), _KEYS)
    least = [F.min(F.when(F.col("d") == e, F.col("ord"))).alias(f"least{e}") for e in range(max_edits + 1)]
    met = keys.groupBy("key").agg(*least, F.count(F.lit(1)).alias("c")).where("c > 1")
    near = F.least(F.lit((1 << 63) - 1), *[F.when(F.col("s") + F.col("d") + e <= F.col("bound"), F.col(f"least{e}")) for e in range(max_edits + 1)])
    pairs = keys.join(met, "key").withColumn("with", near).where("with < ord").groupBy("ord").agg(F.min("with").alias("with"))
    a = some.select("ord", "place", "line")
    b = some.select(F.col("ord").alias("with"), F.col("place").alias("near"), F.col("line").alias("other"))
    return pairs.join(a, "ord").join(b, "with").where(F.levenshtein("line", "other", max_edits) >= 0).select("place", "near")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fuzzy: bool = True, per_edit: int = PER_EDIT, max_edits: int = MAX_EDITS) -> DataFrame:
    """(document, removed_lines): the line numbers that go, of documents that lose some."""
    rows = _rows(docs, id_col, text_col)
    keep = ["n", *(f"half{k}" for k in range(4))] if fuzzy else []
    texts = rows.mapInArrow(_distinct_lines(per_edit), _TEXTS).groupBy("t1", "t2").agg(F.min("place").alias("place"), F.sum("c").alias("c"), *[F.first(k).alias(k) for k in keep])
    texts = cut(texts)
    if fuzzy:
        texts = texts.select("t1", "t2", "place", "c").join(_fuzzy_firsts(rows, texts, per_edit, max_edits), "place", "left")
    else:
        texts = texts.withColumn("near", F.lit(None).cast("decimal(38,0)"))
    first = texts.where("c > 1 or near is not null").select("t1", "t2", "c", F.least("place", F.coalesce("near", "place")).alias("first"))
    first = cut(first)
    del texts
    collected(docs.sparkSession)  # the variants' shuffle files go before the texts are shuffled
    repeated = rows.mapInArrow(_repeated_lines(bitmap(first, "t1")), "t1 long, t2 long, place decimal(38,0)")
    gone = skew_join(repeated, first, ["t1", "t2"], "c", F.xxhash64("place")).where("first < place")
    gone = gone.select("place", F.expr(f"pmod(place, {_STEP})").cast("int").alias("no"))
    gone = gone.select("no", ((F.col("place") - F.col("no")) / F.lit(_STEP).cast("decimal(12,0)")).cast("decimal(38,0)").alias("document"))
    return gone.groupBy("document").agg(F.array_sort(F.collect_set("no")).alias("removed_lines"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fuzzy: bool = True, per_edit: int = PER_EDIT, max_edits: int = MAX_EDITS) -> DataFrame:
    """docs with the lines that stay as text, and n_lines, n_removed, removed_lines (numbers from 0)."""
    docs = drop_clashes(docs, *OUTPUTS)
    key, lost = private(docs, "document", "lost")
    gone = removals(docs, id_col, text_col, fuzzy, per_edit, max_edits).select(F.col("document").alias(key), F.col("removed_lines").alias(lost))
    # The texts are streamed past a hash table of the removals, not sorted.
    out = docs.withColumn(key, _document(id_col, text_col)).join(gone.hint("shuffle_hash"), key, "left")
    text, numbers = column(text_col), column(lost)
    # The split is the argument of the outer function, so that it is made once a text.
    stay = lambda s: F.array_except(F.sequence(F.lit(0), F.size(s) - 1), numbers)
    kept = F.transform(F.array(F.split(text, "\n")), lambda s: F.array_join(F.transform(stay(s), lambda i: F.get(s, i)), "\n"))[0]
    return out.select(
        *[(F.when(numbers.isNull(), text).otherwise(kept).alias(text_col) if c == text_col else column(c)) for c in docs.columns],
        F.when(text.isNull(), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.when(numbers.isNull(), 0).otherwise(F.size(numbers)).cast("long").alias("n_removed"),
        F.coalesce(numbers, F.array().cast("array<int>")).alias("removed_lines"),
    )
