"""MinHash near-deduplication with bottom-k sketches from one hash function.

A document's set holds the hashes of its distinct word shingles (one hash function).  Its
sketch retains the k smallest.  Two documents are linked when their Jaccard similarity is
at least num/den; results name the components of the links.

1. Documents with equal sets form a class; everything after works on classes.
2. Inverted lists of retained values generate overlaps.  A class need not be in the lists
   of all its values: if two sets have similarity t, at most (1 - t) of the values in either
   sketch are not common to both, so the first (1 - t) k + 1 values of each sketch, in any
   order that all share, have one in common.  This is exact where the sketch is the whole
   set (n <= k); for larger sets Z standard deviations are added (chance of a miss below 1e-6
   at the threshold itself, and far below above it).  The common order puts values that
   many classes retain last, so passages that many documents share generate no lists
   unless a document is made of them.
3. Lists of at most CAP classes give their pairs of compatible size.  The union-sketch
   estimate filters them (Z standard deviations below the threshold).
4. Lists above CAP come from large groups of near copies.  Each list picks the class that
   retains the most common values as its hub, and only hub pairs are made.  After their
   links are verified, lists whose classes are all in one component are settled.  The rest
   are compared exactly in blocks of BLOCK classes, without pairs inside one component, and
   a block only gives the links of a spanning forest.  Nothing is capped or sampled.
5. Every link is verified by exact Jaccard on the full sets.

Sets are sets of 63-bit hashes; class numbers are 64-bit hashes of whole sets.

Defined results
* null, empty or blank text: n_shingles 0, component_id is the own id, linked with nothing.
* fewer words than a shingle: the whole word sequence is the one shingle.
* ties: the smallest id stays.  Rows equal in id and text are one document: all stay or go.
* null ids lose to any id; a component of null ids only has a null component_id and stays.
* empty tables give empty results; extra columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bitmap, column, cut, in_bitmap, private
from quillon.llm.components import components
from quillon.llm.textkit import U, list_column, mix64, plain, row_of, row_windows, span_hashes, words

NGRAM, SKETCH, CAP, BLOCK, Z = 5, 128, 64, 512, 5.0


def shingle_sets(text: pa.Array, ngram: int) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """For some rows at a time: the rows, their sets one after another (sorted), and the size of each."""
    for w in words(text, lower=True):
        at, h = row_windows(w, ngram)
        row = row_of(w.first)[at]
        n = np.diff(w.first)
        few = np.flatnonzero((n > 0) & (n < ngram))
        if len(few):
            h = np.concatenate([h, span_hashes(w.hashes, w.first[few], w.first[few + 1])])
            row = np.concatenate([row, few])
        h = mix64(h) >> U(1)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        yield w.rows, h[new], np.bincount(row[new], minlength=len(n))


def _sum_by(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    s = np.zeros(len(h) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(h, out=s[1:], dtype=U)
        ends = np.cumsum(sizes)
        return s[ends] - s[ends - sizes]


def class_ids(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each whole set."""
    with np.errstate(over="ignore"):
        return mix64(_sum_by(mix64(h), sizes) + mix64(_sum_by(mix64(h ^ U(0x5851F42D4C957F2D)), sizes)) * U(3) + sizes.astype(U)).view(np.int64)


def _class_rows(ngram: int, k: int, wanted: np.ndarray | None = None):
    """mapInArrow: (id, th, text) to (id, th, n, cid) and, with k, the sketch; with `wanted`, (cid, vals) of those classes only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, h, sizes in shingle_sets(plain(batch.column("text")), ngram):
                cid = class_ids(h, sizes)
                if wanted is not None:
                    pick = np.flatnonzero((sizes > 0) & in_bitmap(wanted, cid))
                    pick = pick[np.unique(cid[pick], return_index=True)[1]]
                    chosen = np.zeros(len(sizes), bool)
                    chosen[pick] = True
                    pick = np.flatnonzero(chosen)
                    yield pa.RecordBatch.from_arrays([pa.array(cid[pick]), list_column(h[np.repeat(chosen, sizes)].view(np.int64), sizes[pick], pa.int64())], names=["cid", "vals"])
                    continue
                part = batch.slice(rows.start, len(rows))
                out = [part.column("id"), part.column("th"), pa.array(sizes.astype(np.int64)), pa.array(cid)]
                names = ["id", "th", "n", "cid"]
                if k:
                    place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    out.append(list_column(h[place < k].view(np.int64), np.minimum(sizes, k), pa.int64()))
                    names.append("vals")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def prefix_length(n: int, k: int, num: int, den: int) -> int:
    """Values of a sketch that must be in lists."""
    if n <= k:
        return n - -(-num * n // den) + 1
    t = num / den
    sd = math.sqrt(k * t * (1 - t) * max(0.0, 1 - k * t / n))
    return min(k, math.ceil(k * (1 - t) + Z * sd) + 1)


def _list_rows(k: int, num: int, den: int, common: np.ndarray):
    """mapInArrow: (cid, n, vals) to (v, cid, n, share): the lists of a class; share of its values that many classes retain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vals = plain(batch.column("vals"))
            flat, sizes = np.asarray(vals.flatten()), np.asarray(vals.value_lengths())
            row = np.repeat(np.arange(len(sizes)), sizes)
            hot = in_bitmap(common, flat.view(U)) if common is not None else np.zeros(len(flat), bool)
            order = np.lexsort((flat, hot, row))
            n = batch.column("n").to_numpy()
            p = np.array([prefix_length(int(x), k, num, den) for x in n], np.int64)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = place < p[row]
            share = (np.bincount(row, hot, len(sizes)) / np.maximum(sizes, 1)).astype(np.float64)
            take = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([pa.array(flat[order][keep]), batch.column("cid").take(take), batch.column("n").take(take), pa.array(share[row[keep]])], names=["v", "cid", "n", "share"])

    return run


def _fits(a: Column, b: Column, num: int, den: int) -> Column:
    """Sizes that allow the similarity."""
    return F.least(a, b) * den >= F.greatest(a, b) * num


def _estimated(pairs: DataFrame, sketches: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that the union sketch leaves, with `sure` where both sketches are whole sets and the link is exact."""
    sk = sketches.select("cid", "n", "vals")
    a = sk.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("vals").alias("va"))
    b = sk.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("vals").alias("vb"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "va", "vb")
    t = num / den
    least = k * t - Z * math.sqrt(k * t * (1 - t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            va, vb = batch.column("va"), batch.column("vb")
            xs, ys = np.asarray(va.flatten()), np.asarray(vb.flatten())
            ax, ay = np.concatenate([[0], np.cumsum(va.value_lengths())]), np.concatenate([[0], np.cumsum(vb.value_lengths())])
            whole = (na <= k) & (nb <= k)
            keep = np.zeros(len(na), bool)
            for i in range(len(na)):
                both = np.sort(np.concatenate([xs[ax[i] : ax[i + 1]], ys[ay[i] : ay[i + 1]]]))
                twice = both[1:] == both[:-1]
                c = int(twice.sum())
                if whole[i]:
                    keep[i] = c * den >= (na[i] + nb[i] - c) * num
                else:
                    first = np.ones(len(both), bool)
                    first[1:] = ~twice
                    u = both[first][:k]  # the union's sketch
                    keep[i] = int((both[1:][twice] <= u[-1]).sum()) >= min(1.0, len(u) / k) * least
            at = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(at)), batch.column("b").take(pa.array(at)), pa.array(whole[at])], names=["a", "b", "sure"])

    return both.mapInArrow(run, "a long, b long, sure boolean")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose full sets have the similarity."""
    a = sets.select(F.col("cid").alias("a"), F.col("vals").alias("va"))
    b = sets.select(F.col("cid").alias("b"), F.col("vals").alias("vb"))
    both = pairs.join(a, "a").join(b, "b").withColumn("c", F.size(F.array_intersect("va", "vb")))
    return both.where(F.col("c") * den >= (F.size("va") + F.size("vb") - F.col("c")) * num).select("a", "b")


def _block_links(num: int, den: int):
    """applyInArrow on the classes of two blocks of a list: links between different components, as a spanning forest."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        side = t["side"].to_numpy()
        vals = plain(t["vals"])
        flat, n = np.asarray(vals.flatten()), np.asarray(vals.value_lengths()).astype(np.int64)
        start = np.cumsum(n) - n
        _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(n)), n)
        comp = np.unique(t["comp"].to_numpy(), return_inverse=True)[1].astype(np.int64)
        cid = t["cid"].to_numpy()
        left = np.flatnonzero(side == 0)
        right = left if not (side == 1).any() else np.flatnonzero(side == 1)
        # Values that one class alone has meet nothing; the others get columns of a 0/1 matrix.
        shared = count[code] > 1
        columns = np.full(len(count), -1)
        columns[count > 1] = np.arange(int((count > 1).sum()))
        code, row = columns[code[shared]], row[shared]
        meet = np.zeros((len(left), len(right)), np.float32)
        where_l, where_r = np.full(len(n), -1), np.full(len(n), -1)
        where_l[left], where_r[right] = np.arange(len(left)), np.arange(len(right))
        width = 4096
        for lo in range(0, int(columns.max(initial=-1)) + 1, width):
            own = np.flatnonzero((code >= lo) & (code < lo + width))
            ml, mr = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
            l, r = own[where_l[row[own]] >= 0], own[where_r[row[own]] >= 0]  # noqa: E741
            ml[where_l[row[l]], code[l] - lo] = 1
            mr[where_r[row[r]], code[r] - lo] = 1
            meet += ml @ mr.T
        both = meet.astype(np.int64)
        link = both * den >= (n[left][:, None] + n[right][None, :] - both) * num
        link &= comp[left][:, None] != comp[right][None, :]
        root = np.arange(int(comp.max(initial=-1)) + 1)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(link)):
            x, y = find(comp[left[i]]), find(comp[right[j]])
            if x != y:
                root[x] = y
                out.append((cid[left[i]], cid[right[j]]))
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _hot_links(hot: DataFrame, sets: DataFrame, links: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """Links among classes of large lists: hubs first, then blocks of the lists that hubs do not settle."""
    hub = hot.groupBy("v").agg(F.max(F.struct("share", "cid", "n")).alias("hub"))
    star = hot.join(hub, "v").where(F.col("cid") != F.col("hub.cid")).where(_fits(F.col("n"), F.col("hub.n"), num, den))
    star = star.select(F.least("cid", "hub.cid").alias("a"), F.greatest("cid", "hub.cid").alias("b")).distinct()
    links = cut(links.unionByName(_verified(star, sets, num, den)).distinct())
    comp = components(links)
    rows = hot.join(comp, F.col("cid") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "cid")).select("v", "cid", "n", "comp")
    open_lists = rows.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("v")
    # A component that fills blocks has blocks of its own, which need no comparison among
    # themselves; the other classes share blocks.  So the work is theirs times the list.
    sizes = cut(rows.join(open_lists, "v").groupBy("v", "comp").agg(F.count(F.lit(1)).alias("own")))
    small = sizes.where(F.col("own") < block).groupBy("v").agg(F.sum("own").alias("others"))
    rows = rows.join(sizes, ["v", "comp"]).join(small, "v", "left")
    apart = F.xxhash64("comp", F.pmod(F.xxhash64("cid"), F.ceil(F.col("own") / block)))
    shared = F.pmod(F.xxhash64("cid"), F.ceil(F.col("others") / block))
    rows = cut(rows.select("v", "cid", "n", "comp", F.when(F.col("own") >= block, apart).otherwise(shared).alias("block")))
    blocks = rows.groupBy("v", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("small"), F.max("n").alias("large"))
    x, y = blocks.alias("x"), blocks.alias("y")
    pairs = x.join(y, (F.col("x.v") == F.col("y.v")) & (F.col("x.block") <= F.col("y.block")))
    pairs = pairs.where("x.lo < x.hi or y.lo < y.hi or x.lo <> y.lo")
    pairs = pairs.where((F.col("x.large") * den >= F.col("y.small") * num) & (F.col("y.large") * den >= F.col("x.small") * num))
    pairs = pairs.select(F.col("x.v").alias("v"), F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    sides = pairs.select("v", "i", "j", F.col("i").alias("block"), F.lit(0).alias("side")).unionByName(pairs.where("i < j").select("v", "i", "j", F.col("j").alias("block"), F.lit(1).alias("side")))
    work = sides.join(rows.select("v", "block", "cid", "comp"), ["v", "block"]).join(sets, "cid").select("v", "i", "j", "side", "cid", "comp", "vals")
    more = work.groupBy("v", "i", "j").applyInArrow(_block_links(num, den), "a long, b long")
    return links.unionByName(more.distinct())


def _classes(docs: DataFrame, id_col: str, text_col: str, num: int, den: int, ngram: int, k: int, cap: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, th, n, cid), and (cid, component_id) of the classes with a shingle."""
    rows = docs.select(column(id_col).cast("long").alias("id"), F.xxhash64(column(text_col)).alias("th"), column(text_col).alias("text"))
    marked = rows.mapInArrow(_class_rows(ngram, 0), "id long, th long, n long, cid long")
    sketched = rows.mapInArrow(_class_rows(ngram, k), "id long, th long, n long, cid long, vals array<long>")
    classes = cut(sketched.where("n > 0").groupBy("cid").agg(F.min("id").alias("label"), F.first("n").alias("n"), F.first("vals").alias("vals")))

    frequent = classes.select(F.explode("vals").alias("v")).groupBy("v").count().where(F.col("count") > cap)
    lists = classes.select("cid", "n", "vals").mapInArrow(_list_rows(k, num, den, bitmap(frequent, "v")), "v long, cid long, n long, share double")
    size = lists.groupBy("v").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    listed = cut(lists.join(size, "v"))

    member = F.struct("n", "cid")
    small = listed.where(F.col("size") <= cap).groupBy("v").agg(F.array_sort(F.collect_list(member)).alias("m"))
    pairs = small.select(F.posexplode("m").alias("i", "x"), "m").select("x", F.explode(F.slice(F.col("m"), F.col("i") + 2, F.size("m"))).alias("y"))
    pairs = pairs.where(F.col("x.n") * den >= F.col("y.n") * num).select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b"))
    likely = cut(_estimated(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("overlap")), classes, k, num, den))
    hot = listed.where(F.col("size") > cap).select("v", "cid", "n", "share")

    need = cut(likely.where("not sure").select(F.explode(F.array("a", "b")).alias("cid")).unionByName(hot.select("cid")).distinct().join(classes.select("cid", "n"), "cid"))
    long_ones = rows.mapInArrow(_class_rows(ngram, 0, bitmap(need.where(F.col("n") > k), "cid")), "cid long, vals array<long>")
    long_ones = long_ones.join(need.where(F.col("n") > k).select("cid"), "cid").groupBy("cid").agg(F.first("vals").alias("vals"))
    sets = cut(classes.where(F.col("n") <= k).join(need.select("cid"), "cid").select("cid", "vals").unionByName(long_ones))
    links = likely.where("sure").select("a", "b").unionByName(_verified(likely.where("not sure").select("a", "b"), sets, num, den))
    if not hot.isEmpty():
        links = _hot_links(hot, sets, links, num, den, block)
    comp = components(cut(links))
    named = classes.select("cid", "label").join(comp, F.col("cid") == F.col("node"), "left").select("cid", "label", "comp")
    least = named.where("comp is not null").groupBy("comp").agg(F.min("label").alias("least"))
    return marked, named.join(least, "comp", "left").select("cid", F.when(F.col("comp").isNull(), F.col("label")).otherwise(F.col("least")).alias("component_id"))


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, k: int = SKETCH, cap: int = CAP, block: int = BLOCK) -> DataFrame:
    """Per row: id, th (hash of its text), n_shingles, component_id, kept."""
    marked, named = _classes(docs, id_col, text_col, num, den, ngram, k, cap, block)
    out = marked.join(named, "cid", "left")
    comp = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "th", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"))


def drop_near_duplicates(docs: DataFrame, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, one document of each component, unchanged."""
    own, th, mark = private(docs, "own", "th", "mark")
    marks = near_duplicates(docs, num, den, id_col, text_col, **options).where("not kept").select(column(id_col).alias(own), F.coalesce("th", F.lit(0)).alias(mark)).distinct()
    rows = docs.withColumn(th, F.coalesce(F.xxhash64(column(text_col)), F.lit(0)))
    return rows.join(marks, column(id_col).cast("long").eqNullSafe(F.col(own)) & (F.col(th) == F.col(mark)), "left_anti").drop(th)
