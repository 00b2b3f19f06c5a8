import random
import re

import pytest

from quillon.llm.near_dedup import drop_near_duplicates, near_duplicates

SCHEMA = "doc_id long, text string, KEPT string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, num=85, den=100):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if sets[i] and sets[j] and c * den >= len(sets[i] | sets[j]) * num:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def corpus(rng, groups, sizes, length, edits):
    out = []
    shared = [f"s{j}" for j in range(25)]
    for g in range(groups):
        base = [f"g{g}w{rng.randint(0, 10**6)}" for _ in range(rng.choice(length))]
        if rng.random() < 0.5:
            base[3:3] = shared
        for _ in range(rng.choice(sizes)):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**9)}"
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("cap,k,block", [(64, 128, 512), (4, 16, 512), (3, 128, 512), (3, 128, 5)])
def test_against_brute_force(spark, cap, k, block):
    rng = random.Random(cap * k)
    texts = corpus(rng, 14, [1, 2, 3, 12], [4, 30, 60, 200], 3) + corpus(rng, 1, [70], [80], 4)
    texts += ["", None, "  \t", "one two", "ONE two", "One two three", "A b c d e f", "a B c d e f", "word " * 3000]
    ids = rng.sample(range(10**6), len(texts))
    rows = list(zip(ids, texts))
    df = spark.createDataFrame([(*r, "x") for r in rows + [rows[3]]], SCHEMA).repartition(4)
    got = near_duplicates(df, k=k, cap=cap, block=block).collect()
    assert len(got) == len(rows) + 1
    want = brute(rows)
    if k == 128:
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    else:  # small sketches may miss a link at the threshold; they never make one up
        wrong = sum(want[r["doc_id"]] != (r["n_shingles"], r["component_id"]) for r in got)
        assert wrong <= 3
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_filter_null_ids_and_empty(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(3, t, "a"), (1, t + " x", "b"), (None, t, "c"), (2, None, "d"), (2, "", "e"), (None, "lone", "f")]
    out = drop_near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "KEPT"]
    assert sorted(r["KEPT"] for r in out.collect()) == ["b", "d", "e", "f"]
    assert drop_near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_filter_keeps_columns_of_any_name(spark):
    t = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, t, "a", "b", "c"), (2, t, "a", "b", "d"), (3, None, "x", "y", "z")], "doc_id long, text string, _th string, own string, Mark string")
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns and sorted(r["Mark"] for r in out.collect()) == ["c", "z"]
