"""Plumbing that the text operators share: tables, lineage cuts, bounded bitmaps, blocks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.storage import cut, shared_dir

__all__ = ["aside", "bitmap", "column", "cut", "drop_clashes", "in_bitmap", "parts", "private", "restored", "shared_dir", "skew_join", "spread", "table", "text_bytes", "words_text"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than cores is dealt out, so that all cores share costly work on its rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def words_text(text: str = "text") -> Column:
    """The text column with null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def drop_clashes(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names (in any case); an operator's own outputs replace them."""
    low = {n.lower() for n in names}
    return df.select(*[column(c) for c in df.columns if c.lower() not in low])


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def private(df: DataFrame, *stems: str) -> list[str]:
    """For each stem a column name that df does not have, in any case."""
    low, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        while stem.lower() in low:
            stem += "_"
        low.add(stem.lower())
        out.append(stem)
    return out


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns of these names (in any case) under private names, and those by their own names.

    For an operator that replaces columns named like its outputs, where the caller's are to stay.
    """
    low = {n.lower() for n in names}
    own = [c for c in df.columns if c.lower() in low]
    kept = dict(zip(own, private(df, *(f"{c}_" for c in own))))
    return df.select(*[column(c).alias(kept.get(c, c)) for c in df.columns]), kept


def restored(df: DataFrame, columns: list[str], kept: dict[str, str]) -> DataFrame:
    """These columns of df, those put aside under their own names again."""
    return df.select(*[column(kept[c]).alias(c) if c in kept else column(c) for c in columns])


#: Bits of a membership bitmap: at most 8 MB, and about sixteen for each value below that.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 26
#: With more values than this a bitmap of MOST_BITS would pass most of what it is asked.
MOST_VALUES = MOST_BITS // 2


def bitmap(values: DataFrame, column: str) -> np.ndarray | None:
    """A one-hash membership filter over a long column of hashes, sized by their number.

    At most MOST_BITS / 64 words reach the driver, as Arrow columns: rows of Python objects
    would take some hundred bytes a word.  Members always test true; others may.
    None (every value passes) when there are too many values for a filter of bounded size;
    whoever filters must therefore be right without it.
    """
    n = values.count()
    if n > MOST_VALUES:
        return None
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * max(1, n) - 1).bit_length()))
    slot = f"(`{column}` & {bits - 1}L)"
    words = values.selectExpr(f"shiftright({slot}, 6) AS w", f"shiftleft(1L, cast({slot} & 63 AS int)) AS b")
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return out.view(np.uint64)


def in_bitmap(bits: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.ones(len(hashes), bool)
    slot = hashes.astype(np.uint64) & np.uint64(64 * len(bits) - 1)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


#: A key is hot with more rows than this and more than a HOT_KEYS-th of all rows; so at most HOT_KEYS keys are.
HOT_ROWS, HOT_KEYS = 1000, 50_000


def skew_join(rows: DataFrame, keys: DataFrame, by: list[str], weight: str, apart: Column) -> DataFrame:
    """rows left-joined with keys (one row a key; `weight` is about how many rows have it) without a task that gets a hot key's rows.

    Hot keys are few by definition and go by broadcast.  Their rows then enter the shuffle
    under `apart`, a value in place of the first key that no key has.
    """
    often = max(HOT_ROWS, int(keys.agg(F.sum(weight)).first()[0] or 0) // HOT_KEYS)
    more = [c for c in keys.columns if c not in (*by, weight)]
    hot, here, first = private(rows, "hot", "here", "first")
    found = F.struct(*[column(c) for c in more]).alias(hot)
    out = rows.join(F.broadcast(keys.where(column(weight) > often).select(*by, found)), by, "left")
    out = out.withColumn(first, F.col(by[0])).withColumn(by[0], F.when(F.col(hot).isNull(), F.col(by[0])).otherwise(apart))
    cold = keys.where(column(weight) <= often).select(*by, found).withColumnRenamed(hot, here)
    out = out.join(cold, by, "left").withColumn(by[0], F.col(first))
    got = F.coalesce(F.col(hot), F.col(here))
    return out.select(*[column(c) for c in rows.columns], *[got[c].alias(c) for c in more])


def text_bytes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of a table."""
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(text)))).first()
    return n, int(size or 0)


def parts(amount: float, each: float, least: int = 1) -> int:
    """How many parts of about `each` hold `amount`."""
    return max(least, math.ceil(amount / each))
