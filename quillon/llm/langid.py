"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from a bounded sample of
labelled rows.  A text is encoded once with every dictionary; the language whose
dictionary gives the fewest bytes wins.  The text is encoded in pieces of PIECE bytes,
each by itself, so that a long text cannot become its own dictionary; every piece
counts.  Before that, dictionaries and texts alike are lower-cased and each run of
other characters than letters becomes one space: case, digits, mark-up and punctuation
say little about a language.  The verdict is rejected when the winner's margin over the runner-up is narrow.

The only fitted state is the sample: at most `docs_per_lang` rows of each language, of
each at most `doc_bytes` bytes, cut to `dict_bytes` a dictionary, for the `max_langs`
languages with the most rows (of equal ones the alphabetically first).  Rows enter by the
smallest hash of (id, text), so the sample depends on the data only, not on partitions.

Defined results
* null text, or text without a letter: `und`, score 0, rejected.
* equal sizes: the alphabetically first language wins, margin 0, rejected.
* a language whose sample is below the 8 bytes that the library asks of a dictionary: the
  sample is written several times over.  One without any letter cannot be learned.
* no labelled row at all: everything is `und`.  Rows with null lang are not learned from.
* rows are independent; repeated rows get equal answers; empty tables stay empty.
* columns named like an output are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import drop_clashes
from quillon.llm.textkit import plain

OUTPUTS = ("lang_pred", "score", "margin", "rejected")
PIECE = 4096
SHORT = 1024
LEVEL = 5
#: Documented bounds of the sample.
DOCS_PER_LANG, DOC_BYTES, DICT_BYTES, MAX_LANGS = 160, 2048, 112 * 1024, 200
#: A verdict is rejected below this share of the runner-up's size.
MIN_MARGIN = 0.004
HASH_RANGE = 1 << 30


def normal(text: pa.Array) -> pa.Array:
    """Lower case, with one space for each run of non-letters; null stays null."""
    return pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(text), r"[^\p{L}]+", " "))


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", docs_per_lang: int = DOCS_PER_LANG, doc_bytes: int = DOC_BYTES, dict_bytes: int = DICT_BYTES, max_langs: int = MAX_LANGS) -> dict[str, bytes]:
    """Dictionaries by language, from a bounded sample of rows with a language and some text.

    Counts come first, so that a hash threshold admits about twice the rows wanted of each
    language; only those reach the driver.
    """
    have = labelled.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    counts = {r[0]: r[1] for r in have.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), lang_col).limit(max_langs).collect()}
    if not counts:
        return {}
    drawn = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(HASH_RANGE))
    limit: Column = F.lit(0)
    for lang, n in counts.items():
        share = min(HASH_RANGE, int(HASH_RANGE * min(1.0, (2 * docs_per_lang + 64) / n)))
        limit = F.when(F.col(lang_col) == lang, F.lit(share)).otherwise(limit)
    rows = have.where(drawn < limit).select(F.col(lang_col).alias("lang"), drawn.alias("h"), F.substring(F.col(text_col), 1, doc_bytes).alias("t")).distinct().collect()
    out = {}
    for lang in sorted(counts):
        texts = [r["t"] for r in sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["h"], r["t"]))[:docs_per_lang]]
        raw = b" ".join(t.encode()[:doc_bytes] for t in normal(pa.array(texts, pa.string())).to_pylist())[:dict_bytes]
        if raw:
            out[lang] = raw if len(raw) >= 8 else b" ".join([raw] * 8)
    return out


def coders(dictionaries: dict[str, bytes], level: int = LEVEL) -> list:
    import zstandard as zstd

    out = []
    for raw in dictionaries.values():
        d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append(zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def encoded_sizes(raw: bytes, codecs: list, piece: int = PIECE) -> np.ndarray:
    """Bytes of the whole text under each dictionary.

    A short text is written several times over: the coder stores what it cannot shorten by
    some bytes as it is, under any dictionary, and the copies carry it over that mark at
    nearly the same few bytes for every dictionary.
    """
    if len(raw) < SHORT:
        raw = b" ".join([raw] * (SHORT // (len(raw) + 1) + 1))
    cuts = [raw[i : i + piece] for i in range(0, len(raw), piece)]
    return np.array([sum(len(c.compress(x)) for x in cuts) for c in codecs], np.int64)


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_margin: float = MIN_MARGIN, piece: int = PIECE) -> DataFrame:
    """docs with lang_pred string, score double (0 to 1), margin double, rejected boolean."""
    docs = drop_clashes(docs, *OUTPUTS)
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["lang_pred string", "score double", "margin double", "rejected boolean"])
    langs = list(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs = coders(dictionaries)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                text = plain(part.column(text_col))
                lettered = np.asarray(pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False))
                pred, score, margin = [], np.zeros(len(text)), np.zeros(len(text))
                for i, t in enumerate(normal(text)):
                    if not langs or not lettered[i]:
                        pred.append("und")
                        continue
                    size = encoded_sizes(t.as_py().encode(), codecs, piece)
                    best = int(size.argmin())
                    pred.append(langs[best])
                    rest = np.delete(size, best)
                    margin[i] = (rest.min() - size[best]) / rest.min() if len(rest) else 1.0
                    score[i] = 1 / np.exp(-(size - size[best]) / (4 + 0.01 * size[best])).sum()
                reject = np.array([p == "und" for p in pred], bool) | (margin < min_margin)
                new = [pa.array(pred, pa.string()), pa.array(score), pa.array(margin), pa.array(reject)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *OUTPUTS])

    return docs.mapInArrow(run, ddl)
