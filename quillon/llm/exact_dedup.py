"""Exact deduplication through a minimal perfect hash over historical digests.

History is reduced to its distinct SHA-256 digests, each with the largest id that has
it (the winner) and its number of rows.  Digests are dealt into buckets of some
thousands by their leading bits; every bucket gets its own minimal perfect hash, whose
slots hold the full digest and the winner.  An incoming row goes to the slot of its
digest and is a repeat only if all 32 bytes agree.  Rows that are in no slot
(nonmembers) are grouped separately, among themselves.

`dedup_onto` reconciles both sides: incoming rows are counted by digest (map-side first),
and history's winners and counts are brought up to date, so that all rows of a text, old
and new, name the same row.

Skew: history is pre-aggregated map-side, so a hot text is one digest.  A bucket that
gets many incoming rows is copied to several salts, each of at most `group_rows` rows
in expectation; no row set of a digest is ever gathered in one task.  Digests of very many
incoming rows are brought to their rows by broadcast (see common.skew_join).

Defined results
* null text is the empty text; texts are compared byte for byte.
* ties: rows with equal text and equal id all carry that id as keep_id and all stay.
* null ids lose to any id; a group with null ids only has a null keep_id and all stay.
* empty tables give empty results; other columns are passed through, except those named
  like an output (keep_id, group_size, kept, text_sha256), which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import column, cut, drop_clashes, parts, private, skew_join
from quillon.llm.textkit import U, mix64

OUTPUTS = ("keep_id", "group_size", "kept", "text_sha256")
#: Bits per key on each level of a perfect hash.
GAMMA = 2
MAX_LEVELS = 128


class PerfectHash:
    """Minimal perfect hash of 32-byte digests: cascaded bit arrays, ranked by set bits.

    On each level a key sets its bit; keys that share a bit go on to the next level.
    A key's slot is the rank of its bit among all bits that are set.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = []
        below = 0
        for bits in levels:
            self.ranks.append(below + np.cumsum(bits) - 1)
            below += int(bits.sum())
        self.size = below

    @staticmethod
    def _place(words: np.ndarray, level: int, m: int) -> np.ndarray:
        seed = mix64(np.array([level + 1], U))[0]
        with np.errstate(over="ignore"):
            h = words[:, level % 4] + seed * (words[:, (level + 1) % 4] | U(1))
        return (mix64(h) % U(m)).astype(np.int64)

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        left, levels = words, []
        while len(left):
            if len(levels) == MAX_LEVELS:
                raise ValueError("digests are not distinct")
            m = max(64, GAMMA * len(left))
            at = cls._place(left, len(levels), m)
            bits = np.bincount(at, minlength=m) == 1
            levels.append(bits)
            left = left[~bits[at]]
        return cls(levels)

    def slots(self, words: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where the key sets no bit, so is surely no member."""
        out = np.full(len(words), -1, np.int64)
        left = np.arange(len(words))
        for k, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            at = self._place(words[left], k, len(bits))
            hit = bits[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out

    def dump(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<u4")
        return sizes.tobytes() + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        k = int(np.frombuffer(raw, "<u4", 1)[0])
        at, levels = 4 * (k + 1), []
        for m in np.frombuffer(raw, "<u4", k, 4).tolist():
            n = (m + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, n, at), count=m).astype(bool))
            at += n
        return cls(levels)


def _digest_words(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 4)


def _build(group: pa.Table, rows_each: int) -> pa.Table:
    words = _digest_words(group["digest"])
    mph = PerfectHash.build(words)
    order = np.empty(len(words), np.int64)
    order[mph.slots(words)] = np.arange(len(words))
    n = group["n"].to_numpy()
    return pa.table(
        {
            "bucket": group["bucket"].slice(0, 1).cast(pa.int64()),
            "fan": pa.array([max(1, -(-int(n.sum()) // rows_each))], pa.int32()),
            "mph": pa.array([mph.dump()], pa.binary()),
            "digests": pa.array([words[order].tobytes()], pa.binary()),
            "winners": pa.array([group["winner"].combine_chunks().take(pa.array(order))], pa.list_(pa.int64())),
            "sizes": pa.array([n[order]], pa.list_(pa.int64())),
        }
    )


def _lookup(rows: pa.Table, index: pa.Table) -> pa.Table:
    n = len(rows)
    winner, size, member = pa.nulls(n, pa.int64()), np.zeros(n, np.int64), np.zeros(n, bool)
    if n and len(index):
        words = _digest_words(rows["digest"])
        held = np.frombuffer(index["digests"][0].as_py(), "<u8").reshape(-1, 4)
        slot = PerfectHash.load(index["mph"][0].as_py()).slots(words)
        member = slot >= 0
        member[member] = (held[slot[member]] == words[member]).all(axis=1)  # all 32 bytes
        at = pa.array(np.where(member, slot, 0), mask=~member)
        winner = index["winners"][0].values.take(at)
        size = np.where(member, np.asarray(index["sizes"][0].values)[np.where(member, slot, 0)], 0)
    return pa.table({"id": rows["id"], "past": rows["past"], "digest": rows["digest"], "winner": winner, "size": pa.array(size), "member": pa.array(member)})


def _digests(docs: DataFrame, id_col: str, text_col: str, buckets: int, past: Column) -> DataFrame:
    out = docs.select(column(id_col).cast("long").alias("id"), F.sha2(F.coalesce(column(text_col), F.lit("")), 256).alias("hex"), past.alias("past"))
    bucket = F.conv(F.substring("hex", 1, 15), 16, 10).cast("long") % buckets
    return out.select("id", F.unhex("hex").alias("digest"), bucket.alias("bucket"), "past")


def build_index(history: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text", group_rows: int = 16384) -> DataFrame:
    """One row a bucket: perfect hash, slot digests, slot winners, slot sizes, and into how many salts its rows go."""
    distinct = _digests(history, id_col, text_col, buckets, F.lit(True)).groupBy("bucket", "digest").agg(F.max("id").alias("winner"), F.count(F.lit(1)).alias("n"))
    return distinct.groupBy("bucket").applyInArrow(lambda g: _build(g, group_rows), "bucket long, fan int, mph binary, digests binary, winners array<long>, sizes array<long>")


#: A broadcast of (bucket, fan) takes 12 bytes a row: at most 12 MB.
BROADCAST_ROWS = 1_000_000


def _found(docs: DataFrame, history: DataFrame, past: Column, id_col: str, text_col: str, bucket_keys: int, group_rows: int) -> DataFrame:
    """Per row of docs: id, past, digest, and winner, size, member of history's slot."""
    buckets = parts(history.count(), bucket_keys)
    index = cut(build_index(history, buckets, id_col, text_col, group_rows))
    hot = index.where("fan > 1").select("bucket", "fan")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    rows = _digests(docs, id_col, text_col, buckets, past).join(hot, "bucket", "left")
    # Rows of one id, or of none, come from several partitions: those part them.
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", F.spark_partition_id()), F.coalesce("fan", F.lit(1))).cast("int")).drop("fan")
    salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("fan") - 1))).drop("fan")
    return (
        rows.groupBy("bucket", "salt")
        .cogroup(salted.groupBy("bucket", "salt"))
        .applyInArrow(_lookup, "id long, past boolean, digest binary, winner long, size long, member boolean")
    )


def _alone() -> Column:
    """In place of a digest: something longer than one, another for every id."""
    return F.concat(F.col("digest"), F.encode(F.xxhash64("id", F.spark_partition_id()).cast("string"), "UTF-8"))


def _marks(rows: DataFrame, id_col: str, keep: Column, size: Column, kept: Column) -> DataFrame:
    return rows.select(F.col("id").alias(id_col), keep.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = 4096, group_rows: int = 16384) -> DataFrame:
    """Per row of docs: id, keep_id, group_size, kept, text_sha256.

    Without `history`, docs is its own history.  With it, a text that history holds is a
    repeat: keep_id is history's winner, group_size its number of rows there, kept is
    false; the other rows are grouped among themselves.
    """
    if history is None:
        found = _found(docs, docs, F.lit(True), id_col, text_col, bucket_keys, group_rows)
        return _marks(found, id_col, F.col("winner"), F.col("size"), F.col("id").eqNullSafe(F.col("winner")))
    found = cut(_found(docs, history, F.lit(False), id_col, text_col, bucket_keys, group_rows))
    fresh = found.where("not member")
    groups = fresh.groupBy("digest").agg(F.max("id").alias("best"), F.count(F.lit(1)).alias("n"))
    fresh = skew_join(fresh.select("id", "digest"), cut(groups.withColumn("size", F.col("n"))), ["digest"], "n", _alone())
    old = _marks(found.where("member"), id_col, F.col("winner"), F.col("size"), F.lit(False))
    return old.unionByName(_marks(fresh, id_col, F.col("best"), F.col("size"), F.col("id").eqNullSafe(F.col("best"))))


def dedup_onto(docs: DataFrame, past: Column, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = 4096, group_rows: int = 16384) -> DataFrame:
    """Like exact_dedup(docs), where the rows for which `past` is true are history and the others come in.

    Incoming rows are looked up in the perfect hash over history's digests; nonmembers are
    grouped separately; members bring the winner and the count of their slot up to date.
    """
    past = F.coalesce(past, F.lit(False))
    found = cut(_found(docs, docs.where(past), past, id_col, text_col, bucket_keys, group_rows))
    news = found.where("not past").groupBy("digest").agg(F.max("id").alias("best"), F.count(F.lit(1)).alias("more"), F.max("size").alias("old"))
    news = news.select("digest", "best", "more", (F.col("more") + F.col("old")).alias("weight"))
    rows = skew_join(found.select("id", "digest", "winner", "size"), cut(news), ["digest"], "weight", _alone())
    keep = F.greatest("winner", "best")
    return _marks(rows, id_col, keep, F.col("size") + F.coalesce("more", F.lit(0)), F.col("id").eqNullSafe(keep))


def drop_repeats(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns and text_sha256."""
    docs = drop_clashes(docs, *OUTPUTS)
    own, sha = private(docs, "own", "sha")
    marks = exact_dedup(docs, history, id_col, text_col).where("kept").select(column(id_col).alias(own), "text_sha256").distinct()
    rows = docs.withColumn(sha, F.sha2(F.coalesce(column(text_col), F.lit("")), 256))
    return rows.join(marks, column(id_col).cast("long").eqNullSafe(F.col(own)) & (F.col(sha) == F.col("text_sha256"))).drop(own, sha)
