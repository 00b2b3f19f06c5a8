"""The registered queries on whole small tables: beside their SQL, else beside brute force."""

import hashlib
import os
import re
import sys
import zlib

import duckdb
import public_tokenizers
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
from compare import canon  # noqa: E402

from quillon.llm.bpe import encoding  # noqa: E402
from quillon.llm.lm import K, ORDER  # noqa: E402
from quillon.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402
from quillon.llm.sharding import topology  # noqa: E402
from tests.llm.test_lm import brute as lm_brute  # noqa: E402
from tests.llm.test_sharding import brute as shard_of  # noqa: E402

DATA = "/root/testdata/sf0.001"
DOCS = {r["doc_id"]: r for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{DATA}/{f}')")
    assert canon(QUERIES[name](spark, DATA).toPandas()) == canon(con.execute(ORACLE_SQL[name]).df())


def test_decontamination(spark):
    """Items that a document holds word for word, whatever the case and punctuation."""
    plain = lambda t: " " + " ".join(re.sub(r"[^\w\s]", "", t.lower()).split()) + " "
    items = pq.read_table(f"{DATA}/benchmark.parquet").to_pylist()
    want = {(d, i["item_id"]) for d, r in DOCS.items() for i in items if plain(i["text"]) in plain(r["text"])}
    assert {(r["doc_id"], r["item_id"]) for r in QUERIES["op2_template_decontamination"](spark, DATA).collect()} == want and want


def test_language(spark):
    got = QUERIES["op5_language_id"](spark, DATA).collect()
    assert {r["doc_id"]: r["held_out"] for r in got} == {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in DOCS}
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == DOCS[r["doc_id"]]["lang"] for r in held) >= 0.9 * len(held)


def test_bpe(spark):
    enc = encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    got = QUERIES["op6_byte_bpe"](spark, DATA).collect()
    assert len(got) == len(DOCS)
    for r in got:
        t = DOCS[r["doc_id"]]["text"]
        ids = enc.encode_ordinary(t)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_sharding(spark):
    got = QUERIES["op7_hash_tree_sharding"](spark, DATA).collect()
    assert {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in got} == {d: (shard_of(str(d), topology(24)), shard_of(str(d), topology(25))) for d in DOCS}


def test_language_model(spark):
    rows = [(d, r["text"], zlib.crc32(str(d).encode()) % 7 == 2) for d, r in DOCS.items()]
    got = {r["doc_id"]: r for r in QUERIES["op8_backoff_lm"](spark, DATA).collect()}
    for i, n, known, total, base, full, failures in lm_brute(rows, ORDER, K):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(full) and r["n_failures"] == failures
