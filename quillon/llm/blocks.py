"""Exchange between blocks of documents and parts of a hash space.

Some operators need, for each of a very large number of hashes, a fact about all
documents (a count, an earlier place).  A row for each hash would cost tens of bytes in
every shuffle.  Instead documents are grouped in blocks; a block sends each part of the
hash space one packet of its distinct hashes there, sorted and written as differences; a
part answers each block with one packet in the same order; and the block, which makes the
same hashes again from its text, reads the answers by position.  A hash that is very
frequent is one entry a block, so it cannot make a part large.

Blocks and parts start at BLOCK_BYTES and PART_ENTRIES.  A packet holds, on average, block
entries times part entries over all entries; from the size on at which that would fall
below LEAST_PACKET (some 90 GB of text), both grow with the square root of the input.  So the
number of packets, which are the rows that are shuffled, stays in proportion to the input
(a row for LEAST_PACKET hashes at worst), and a task's memory grows with the root: at 100 TB
of text a block has some 200 MB, a part some 33 million entries.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import parts, text_bytes

#: Text bytes of a block and entries of a part, on average, at least.
BLOCK_BYTES = 6_000_000
PART_ENTRIES = 1_000_000
#: Entries of a packet, on average, at least.
LEAST_PACKET = 64
#: Bytes of text for a word, about; only sizes the parts.
WORD_BYTES = 6.5
#: Rows that a block edge is drawn from, about.
EDGE_ROWS = 32


def scale(size: int, block_bytes: int, part_entries: int, entries_a_word: float = 1.0) -> tuple[int, int]:
    """Number of blocks and of parts for so many bytes of text."""
    grown = max(1.0, math.sqrt(LEAST_PACKET * size / (block_bytes * part_entries))) if block_bytes >= BLOCK_BYTES else 1.0
    return parts(size, block_bytes * grown), parts(entries_a_word * size / WORD_BYTES, part_entries * grown)


def sizes(docs: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES, part_entries: int = PART_ENTRIES, entries_a_word: float = 1.0) -> tuple[int, int]:
    """Number of blocks, number of parts."""
    return scale(text_bytes(docs, text_col)[1], block_bytes, part_entries, entries_a_word)


def by_hash(docs: DataFrame, n_blocks: int, *key: str) -> DataFrame:
    """docs with a block number drawn from a hash of the key columns."""
    return docs.withColumn("block", F.pmod(F.xxhash64(*key), F.lit(n_blocks)).cast("long"))


def by_range(rows: DataFrame, block_bytes: int, part_entries: int) -> tuple[DataFrame, int]:
    """Rows (id, th, text) with a block number that never falls as (id, th) grows, null ids first; and the number of parts.

    Block edges come from rows that a hash draws, some EDGE_ROWS a block, weighted by their
    bytes.  Rows without an id are in blocks below 0 by ranges of th.
    """
    from pyspark.ml.feature import Bucketizer  # here, so that tasks do not load it

    length = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    n, size, unknown = rows.agg(F.count("id"), F.sum(length), F.sum(F.when(F.col("id").isNull(), length))).first()
    n_blocks, n_parts = scale(int(size or 0), block_bytes, part_entries)
    edges = np.zeros(0)
    if n_blocks > 1 and n:
        rate = min(1.0, EDGE_ROWS * n_blocks / n)
        drawn = rows.where(F.col("id").isNotNull() & (F.pmod(F.xxhash64("id", F.lit("edge")), F.lit(1 << 30)) < int(rate * (1 << 30))))
        got = drawn.groupBy(F.col("id").cast("double").alias("id")).agg(F.sum(length).alias("size")).toPandas().sort_values("id")
        upto = np.cumsum(got["size"].to_numpy(float))
        if len(upto):
            at = np.searchsorted(upto, upto[-1] * np.arange(1, n_blocks) / n_blocks)
            edges = np.unique(got["id"].to_numpy(float)[at])
    fan = parts(int(unknown or 0), size / n_blocks if size else 1)
    low = F.floor((F.col("th").cast("double") / float(1 << 64) + 0.5) * fan)
    none = F.least(F.greatest(low, F.lit(0)), F.lit(fan - 1)) - fan
    if not len(edges):
        return rows.withColumn("block", F.when(F.col("id").isNull(), none).otherwise(0).cast("long")), n_parts
    cutter = Bucketizer(splits=[-float("inf"), *edges.tolist(), float("inf")], inputCol="_at", outputCol="_block", handleInvalid="keep")
    out = cutter.transform(rows.withColumn("_at", F.col("id").cast("double")))
    return out.withColumn("block", F.when(F.col("id").isNull(), none).otherwise(F.col("_block")).cast("long")).drop("_at", "_block"), n_parts


def part_of(hashes: np.ndarray, n_parts: int) -> np.ndarray:
    """The part of each hash; parts are equal ranges of the hash space."""
    return ((hashes >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)


def part_spans(sorted_hashes: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts that sorted hashes reach, and where each begins, with the end."""
    full, begin = np.unique(part_of(sorted_hashes, n_parts), return_index=True)
    return full, np.append(begin, len(sorted_hashes))


def sorted_packed(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as a first one and differences of as few bytes as the largest needs."""
    step = np.diff(values)
    width = max(1, (int(step.max()).bit_length() + 7) // 8) if len(step) else 1
    return values[:1].tobytes() + bytes([width]) + step.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def sorted_unpacked(raw: bytes) -> np.ndarray:
    width = raw[8]
    step = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    wide = np.zeros((len(step) + 1, 8), np.uint8)
    wide[1:, :width] = step
    out = wide.view(np.uint64).ravel()
    out[0] = np.frombuffer(raw, np.uint64, 1)[0]
    return np.cumsum(out, dtype=np.uint64)


def counts_packed(counts: np.ndarray) -> bytes:
    """Counts as one byte each, those of 255 and more after them as eight bytes."""
    big = counts >= 255
    return np.where(big, 255, counts).astype(np.uint8).tobytes() + counts[big].astype("<i8").tobytes()


def counts_unpacked(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<i8", -1, n)
    return out
