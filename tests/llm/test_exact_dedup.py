import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import common
from quillon.llm.exact_dedup import PerfectHash, dedup_onto, drop_repeats, exact_dedup

SCHEMA = "doc_id long, text string, KEPT string"


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 77, 5000):
        keys = rng.integers(0, 2**63, (n, 4)).astype(np.uint64)
        h = PerfectHash.load(PerfectHash.build(keys).dump())
        assert sorted(h.slots(keys)) == list(range(n)) and h.size == n
        other = rng.integers(0, 2**63, (50, 4)).astype(np.uint64)
        assert (h.slots(other) < max(n, 1)).all()


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["", None, "hot", "hot", "hot", f"t{rng.randint(0, 40)}", "é" * 3, "x" * 200_000])) for i in range(400)]
    rows += [rows[0], rows[0], (None, "hot"), (None, "only null ids"), (None, "only null ids"), (-7, "t1")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(5)
    for keys, each in ((4096, 16384), (4, 8)):  # the second makes many buckets and salts
        got = exact_dedup(df, bucket_keys=keys, group_rows=each).collect()
        assert sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in got), key=repr) == brute(rows)


def test_incoming_rows_onto_history(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)  # so that the frequent texts count as hot
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "", "hot", "hot", f"t{rng.randint(0, 30)}", "old only" if i <= 100 else "new only"])) for i in range(300)]
    rows += [rows[0], rows[299], (None, "hot"), (None, "no id"), (None, "no id")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(4)
    for past in (F.col("doc_id") <= 100, F.lit(False), F.lit(True), F.col("doc_id") % 3 == 0):
        got = dedup_onto(df, past, bucket_keys=16, group_rows=32).collect()
        assert sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in got), key=repr) == brute(rows)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", "x", "y", "z"), (2, "a", "x", "y", "w")], "doc_id long, text string, _id string, own string, Sha string")
    out = drop_repeats(docs)
    assert out.columns == [*docs.columns, "text_sha256"] and [r["Sha"] for r in out.collect()] == ["w"]


def test_history(spark):
    past = spark.createDataFrame([(1, "a", ""), (9, "a", ""), (2, "b", "")], SCHEMA)
    new = spark.createDataFrame([(3, "a", ""), (4, "c", ""), (5, "c", ""), (6, None, "")], SCHEMA)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(new, past).collect()}
    assert got == {3: (9, 2, False), 4: (5, 2, False), 5: (5, 2, True), 6: (6, 1, True)}
    assert {r["doc_id"] for r in drop_repeats(new, past).collect()} == {5, 6}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(none).collect() == [] and exact_dedup(none, none).collect() == []
    assert drop_repeats(spark.createDataFrame([(1, "x", "k")], SCHEMA)).columns == ["doc_id", "text", "text_sha256"]
