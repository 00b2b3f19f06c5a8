"""The opN queries: thin digests of the operators over their whole tables, and their SQL where it can be said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, chat, decontam, exact_dedup, langid, line_dedup, lm, near_dedup, sharding, substring
from quillon.llm.common import spread, table, words_text

RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def _remainder(n: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows up to the mean id are history; the others are looked up in its perfect hash, and both are reconciled."""
    docs = table(spark, sf_dir, "documents")
    middle = docs.agg(F.avg("doc_id")).first()[0]
    out = exact_dedup.dedup_onto(docs, F.col("doc_id") <= F.lit(middle))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and item that contaminates it; documents without a row are clean."""
    out = decontam.matches(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("rid").alias("doc_id"), F.col("item").alias("item_id"), "cover", "n_slots", "reparameterised", F.lit(False).alias("kept"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "n_shingles", "component_id", "kept")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(words_text(), 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (_remainder(5) == 0).alias("held_out"))
    dictionaries = langid.fit(docs.where("not held_out and lang is not null"))
    out = langid.classify(spread(docs.select("doc_id", "text", "held_out")), dictionaries)
    return out.select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = bpe.bpe(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN, packed=True)
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (_remainder(7) == 2).alias("held_out"))
    return lm.lm_scores(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_failures")


def op9_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), "|")
    return out.select("conv_id", "speaker", "block", "n_turns", "rendered", spans.alias("mask_spans"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), "n_windows", "n_repeated")


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_template_decontamination,
        op3_minhash_near_dedup,
        op4_line_dedup,
        op5_language_id,
        op6_byte_bpe,
        op7_hash_tree_sharding,
        op8_backoff_lm,
        op9_perspective_rotation,
        op10_substring_dedup,
    )
}

ORACLE_SQL = {
    "op1_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
     g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)""",
    "op9_perspective_rotation": """
WITH r AS (
  SELECT conv_id, coalesce(turn::BIGINT, -4611686018427387904) AS o, greatest(floor(coalesce(turn, 0) / 1024.0), 0)::BIGINT AS block,
         coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS speaker FROM r WHERE role <> 'system'),
s AS (
  SELECT r.conv_id, speaker, block, o, role, text, role = speaker AND role <> 'system' AS masked,
         CASE WHEN role = 'system' THEN '<|' || replace(role, '<|', '< |') || '|>' || chr(10)
              WHEN role = speaker THEN '<|assistant|>' || chr(10)
              ELSE '<|user name=' || replace(role, '<|', '< |') || '|>' || chr(10) END AS head,
         replace(text, '<|', '< |') || '<|end|>' || chr(10) AS body
  FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, speaker, block ORDER BY o, role, text) AS k FROM s),
e AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, block ORDER BY k) AS upto FROM n)
SELECT conv_id, speaker, block, count(*) AS n_turns, string_agg(head || body, '' ORDER BY k) AS rendered,
       coalesce(string_agg(((upto - length(body))::BIGINT)::VARCHAR || ':' || (upto::BIGINT)::VARCHAR, '|' ORDER BY k) FILTER (WHERE masked), '') AS mask_spans
FROM e GROUP BY conv_id, speaker, block""",
    "op3_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.m = e.x),
c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op4_line_dedup": r"""
WITH l AS MATERIALIZED (
  SELECT doc_id, i - 1 AS no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
t AS MATERIALIZED (
  SELECT line, min((doc_id, no)) AS place, length(line) AS n FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' GROUP BY line),
k AS MATERIALIZED (
  SELECT line, place, n, unnest([(0, n, line[1:n // 2]), (1, n, line[n // 2 + 1:]), (0, n - 1, line[1:(n - 1) // 2]), (1, n - 1, line[(n - 1) // 2 + 2:])]) AS key FROM t WHERE n >= 20),
p AS (SELECT DISTINCT a.line, a.n, b.line AS other, b.place FROM k a JOIN k b ON a.key = b.key AND b.place < a.place),
v AS (
  SELECT line, min(place) AS near FROM p WHERE
    CASE WHEN n = length(other) THEN len(list_filter(range(1, n + 1), lambda i: line[i] <> other[i])) = 1
         WHEN n = length(other) + 1 THEN len(list_filter(range(1, n + 1), lambda i: line[1:i - 1] || line[i + 1:] = other)) > 0
         WHEN n = length(other) - 1 THEN len(list_filter(range(1, n + 2), lambda i: other[1:i - 1] || other[i + 1:] = line)) > 0
         ELSE false END
  GROUP BY line),
g AS (
  SELECT l.doc_id, l.no, l.line, t.line IS NOT NULL AND least(t.place, coalesce(v.near, t.place)) < (l.doc_id, l.no) AS gone
  FROM l LEFT JOIN t ON t.line = l.line LEFT JOIN v ON v.line = l.line),
o AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '') AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN o USING (doc_id)""",
    "op10_substring_dedup": r"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS MATERIALIZED (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
f AS MATERIALIZED (SELECT k, min((doc_id, i)) AS first FROM x GROUP BY k HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM x JOIN f USING (k) WHERE (doc_id, i) > first),
a AS (SELECT doc_id, j, ws[j] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM w)),
o AS (
  SELECT a.doc_id, count(*) AS n_words, count(g.j) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY a.j) FILTER (WHERE g.j IS NULL), '') AS kept
  FROM a LEFT JOIN g ON g.doc_id = a.doc_id AND g.j = a.j GROUP BY a.doc_id),
c AS (SELECT doc_id, count(*) AS n_windows, count(f.k) AS n_repeated FROM x LEFT JOIN f USING (k) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256,
       coalesce(n_windows, 0) AS n_windows, coalesce(n_repeated, 0) AS n_repeated
FROM documents d LEFT JOIN o USING (doc_id) LEFT JOIN c USING (doc_id)""",
}
