"""A document pipeline of five text operators, each stage's result read by the next.

run() writes every stage but the last as Parquet into the cluster's shared checkpoint
folder and reads it again, so that no stage recomputes another and a lost executor costs
its own stage's work only.  A stage's folder goes when the next one has been written; the
last folder stays, for the result is read from it.

Every stage keeps all columns of its documents, whatever their names: a column that is named
like an output of the operator is put aside and comes back with its own values.  Repeated
rows (equal in everything) get equal decisions.  Empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, decontam, langid, line_dedup, near_dedup
from quillon.llm.common import aside, restored, shared_dir, table
from quillon.llm.queries import RANK_FILE
from quillon.ship import shipped
from quillon.storage import remove


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the classifier rejects; lang becomes the predicted one.

    Null and empty texts and those without a letter go.  A tie between languages is
    rejected.  Whole texts count, however long.  Null ids are like others.  Without any
    labelled row nothing can be told, and all documents go.
    """
    rows, kept = aside(docs, *langid.OUTPUTS)
    out = langid.classify(rows, langid.fit(docs)).where("not rejected")
    return restored(out.withColumn("lang", F.col("lang_pred")), docs.columns, kept)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that repeat an earlier one; a document that loses lines and keeps no word goes.

    n_chars of a document that loses lines is counted again.  Null texts and texts without
    a repeat stay as they are.  Ties: the line in the smallest (doc_id, text hash, number)
    is the earliest; null ids come first.  Lines and texts may have any length.
    """
    rows, kept = aside(docs, *line_dedup.OUTPUTS)
    out = line_dedup.line_dedup(rows)
    out = out.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")))
    return restored(out, docs.columns, kept)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five words, similarity 0.8).

    The smallest doc_id stays; rows that repeat it in id and text stay with it; null ids lose
    to any id.  Null, empty and blank texts have no words and stay.
    """
    return near_dedup.drop_near_duplicates(docs, 80, 100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Null and empty texts hold none and stay; null and empty items are in no document.  Rows
    of one id are judged by their own text; null ids are like others.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_tokens and token_ids; only documents whose ids decode to their text pass.

    A null text has no ids and passes.  The new columns replace those of their names.
    """
    import public_tokenizers

    rows, kept = aside(docs, "decoded")
    out = bpe.bpe(rows, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)
    out = out.where(F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    new = ["n_tokens", "token_ids"]
    return restored(out, [c for c in docs.columns if c.lower() not in new] + new, kept)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", shipped(language_id)),
    ("line_dedup", shipped(line_dedup_stage)),
    ("near_dedup", shipped(near_dedup_stage)),
    ("decontamination", shipped(decontamination)),
    ("byte_bpe", shipped(byte_bpe)),
]

#: Compression, edit neighbourhoods and merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, with all its columns and those of the last stage."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    return docs
