"""The pipeline on a small fixture, stage by stage against brute force."""

import random
import re

import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from quillon.llm import langid
from quillon.llm.bpe import encoding
from tests.llm.test_line_dedup import within_one
from tests.llm.test_near_dedup import brute as near_brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(rng):
    en, de = "the of and to in that was for with not are this from have one had by word but what".split(), "der die und das ist nicht von mit auf ein eine dem den für als auch es an werden aus".split()
    item = "When Anna sells 12 red apples for 3 dollars each to Boris she then counts all of the money twice before going home"
    out = []
    for i in range(70):
        words = en if i % 3 else de
        lines = [" ".join(rng.choice(words) + rng.choice(["", "", str(rng.randint(0, 9))]) for _ in range(rng.randint(12, 40))) for _ in range(rng.randint(1, 4))]
        if i % 5 == 0:
            lines.insert(0, "all rights reserved by the owner of the page" + ("." if i % 2 else ""))
        if i % 11 == 0:
            lines.append(item)
        out.append(("\n".join(lines), "en" if i % 3 else "de"))
    out += [(out[4][0] + " more", "en"), (out[7][0], "en"), (None, "en"), ("", "en"), ("12 34", None), ("!!!", "de")]
    return out, item


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    rng = random.Random(2)
    rows, item = texts(rng)
    docs = [(100 + i, t, lang, f"s{i % 3}", len(t) if t is not None else None) for i, (t, lang) in enumerate(rows)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, item


def brute(spark, docs, item):
    dictionaries = langid.fit(spark.createDataFrame(docs, DOCS))
    codecs, langs = langid.coders(dictionaries), list(dictionaries)
    rows = {}
    for i, t, *_ in docs:
        if t and re.search(r"[^\W\d_]", t):
            size = sorted((int(s), lang) for s, lang in zip(langid.encoded_sizes(langid.normal(pa.array([t]))[0].as_py().encode(), codecs), langs))
            if (size[1][0] - size[0][0]) / size[1][0] >= langid.MIN_MARGIN:
                rows[i] = (t, size[0][1])
    seen, kept = [], {}
    for i in sorted(rows):
        lines = []
        for ln in rows[i][0].split("\n"):
            if ln.strip(" \t\r") == "":
                lines.append(ln)
                continue
            if not any(ln == x or (min(len(ln), len(x)) >= 20 and within_one(ln, x)) for x in seen):
                lines.append(ln)
            seen.append(ln)
        text = "\n".join(lines)
        if text == rows[i][0] or text.strip():
            kept[i] = (text, rows[i][1])
    comp = near_brute([(i, t) for i, (t, _) in kept.items()], 80)
    kept = {i: v for i, v in kept.items() if comp[i][1] == i}
    kept = {i: v for i, v in kept.items() if item not in v[0]}
    enc = encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return {i: (t, lang, tuple(enc.encode_ordinary(t))) for i, (t, lang) in kept.items()}


def test_against_brute_force(spark, fixture):
    path, docs, item = fixture
    got = {r["doc_id"]: (r["text"], r["lang"], tuple(r["token_ids"])) for r in corpus_pipeline.run(spark, path).collect()}
    assert got == brute(spark, docs, item)
    assert 40 < len(got) < len(docs)


def test_stages(spark, fixture):
    path = fixture[0]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        assert out.columns[: len(docs.columns)] == docs.columns and (k == 4 or out.columns == docs.columns)
        assert stage(spark, docs.limit(0), path).count() == 0
        assert out.count() <= docs.count()


def test_stages_keep_columns_of_any_name(spark, fixture):
    path, docs, _ = fixture
    names = ("n_lines", "Removed_Lines", "score", "margin", "rejected", "th", "rid", "own", "decoded", "document")
    rows = [(*d, *[f"{n}{d[0]}" for n in names]) for d in docs]
    rows += [rows[3], rows[3], (None, *rows[5][1:]), (rows[6][0], "another text of the same number and of some length here", *rows[6][2:])]
    wide = spark.createDataFrame(rows, DOCS + "".join(f", {n} string" for n in names))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, path)
        assert out.columns[: len(wide.columns)] == wide.columns
        got = out.collect()
        assert got
        for r in got:
            assert r["doc_id"] is None or all(r[n] == f"{n}{r['doc_id']}" for n in names)
        assert sum(r["doc_id"] == rows[3][0] for r in got) in (0, 3)  # equal rows are judged alike
