import math
import random
import re
from collections import Counter

import pytest

from quillon.llm.lm import lm_scores

SCHEMA = "doc_id long, text string, held_out boolean, SCORE string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def seq(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return ["<s>", *WORD.findall(low), "</s>"]


def brute(rows, order, k):
    grams = Counter()
    for _, t, held in rows:
        if not held:
            s = seq(t)
            for n in range(1, order + 1):
                for i in range(len(s) - n + 1):
                    grams[tuple(s[i : i + n])] += 1
    words = {g[0]: c for g, c in grams.items() if len(g) == 1 and g[0] != "<s>"}
    n_all, v = sum(words.values()), len(words)

    def p(h, w):
        if not h:
            return (words.get(w, 0) + 1) / (n_all + v + 1)
        low = p(h[1:], w)
        return (grams[(*h, w)] + k * low) / (grams[h] + k) if grams[h] else low

    out = []
    for i, t, _ in rows:
        s = seq(t)
        base = sum(math.log10(p((), w)) for w in s[1:])
        full = sum(math.log10(p(tuple(s[max(0, j - order + 1) : j]), s[j])) for j in range(1, len(s)))
        failures = 0
        for j in range(1, len(s)):
            h = tuple(s[max(0, j - order + 1) : j])
            while h and not grams[h]:
                h = h[1:]  # the state is the longest context that was seen
            while h and not grams[(*h, s[j])]:
                h, failures = h[1:], failures + 1
        out.append((i, len(s) - 1, sum(w in words for w in s[1:]), n_all, base, full, failures))
    # every distribution sums to 1 over the known tokens and the unknown one
    for h in list(grams)[:50]:
        if len(h) == order - 1 and h[-1] != "</s>":
            assert sum(p(h, w) for w in [*words, "\0"]) == pytest.approx(1)
    return out


@pytest.mark.parametrize("order,block_bytes", [(2, 100), (3, 10**7), (4, 500), (1, 300)])
def test_against_brute_force(spark, order, block_bytes):
    rng = random.Random(order)
    vocab = ["The", "the", "of", "É", "é", "x.", "GO", "go"] + [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(vocab[: rng.randint(3, 38)]) for _ in range(rng.randint(0, 30))), rng.random() < 0.2) for i in range(60)]
    rows += [(100, None, False), (101, "", True), (102, "the " * 2000, False), (103, "the\tof the", True), (None, "go go", False)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    got = {r["doc_id"]: r for r in lm_scores(df, order=order, k=3.0, block_bytes=block_bytes, part_entries=50).collect()}
    assert len(got) == len(rows)
    for i, n, known, total, base, full, failures in brute(rows, order, 3.0):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(full)
        assert r["n_failures"] == failures
    assert (sum(r["n_failures"] for r in got.values()) > 0) == (order > 1)


def test_no_training_rows_and_empty(spark):
    got = lm_scores(spark.createDataFrame([(1, "a b", True, "")], SCHEMA)).collect()
    assert got[0]["train_tokens"] == 0 and got[0]["base_score"] == 0 and got[0]["score"] == 0
    assert lm_scores(spark.createDataFrame([], SCHEMA)).collect() == []
