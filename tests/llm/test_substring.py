import random
import re
from collections import Counter

import numpy as np

from quillon.llm import blocks
from quillon.llm.substring import substring_dedup

SCHEMA = "doc_id long, text string, kept_TEXT string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    """rows: distinct (id, text) in document order."""
    seen, out = set(), {}
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            if k in seen:
                gone[s : s + width] = [True] * width
            seen.add(k)
        out[i, t] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def repeated(rows, width):
    """By id, the windows of a document that occur more than once in all."""
    windows = {i: [tuple(w[s : s + width]) for s in range(len(w) - width + 1)] for i, t in rows for w in [WORD.findall(t or "")]}
    count = Counter(k for ks in windows.values() for k in ks)
    return {i: (len(ks), sum(count[k] > 1 for k in ks)) for i, ks in windows.items()}


def test_against_brute_force(spark):
    rng = random.Random(5)
    for block_bytes, width in ((200, 4), (10_000, 3), (10**9, 20)):
        passages = [" ".join(rng.choice("abcdefghij") + rng.choice("xyzé") for _ in range(rng.randint(3, 40))) for _ in range(8)]
        rows = [(i, "\n".join(rng.choice(passages) if rng.random() < 0.6 else " ".join(rng.choice("pqrstuvw") + str(rng.randint(0, 99)) for _ in range(15)) for _ in range(rng.randint(0, 5)))) for i in range(40)]
        rows += [(200, None), (201, ""), (202, " \t\n "), (203, "a " * 3000), (-5, passages[0]), (204, "x y" + " ".join(passages)), (205, " z  q")]
        given = rows + [rows[3], rows[3], rows[44]]
        rng.shuffle(given)
        df = spark.createDataFrame([(i, t, "clash") for i, t in given], SCHEMA).repartition(5)
        got = substring_dedup(df, width, block_bytes=block_bytes, part_entries=64).collect()
        want = brute(sorted(rows, key=lambda r: r[0]), width)
        assert len(got) == len(given)
        counted = repeated(rows, width)
        by_id = {i: v for (i, _), v in want.items()}
        for r in got:
            assert (r["n_words"], r["n_removed"], r["kept_text"]) == by_id[r["doc_id"]]
            assert (r["n_windows"], r["n_repeated"]) == counted[r["doc_id"]]
            assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"]
            assert all(a["end"] < b["start"] for a, b in zip(r["removed"], r["removed"][1:]))


def test_empty_and_null_ids(spark):
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    t = " ".join(map(str, range(30)))
    got = substring_dedup(spark.createDataFrame([(1, t, ""), (None, t, "")], SCHEMA)).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {None: 0, 1: 30}


def test_packets():
    rng = random.Random(1)
    for n in (1, 2, 1000):
        for top in (1 << 10, 1 << 60):
            v = np.sort(np.array([rng.randrange(top) for _ in range(n)], np.uint64))
            assert (blocks.sorted_unpacked(blocks.sorted_packed(v)) == v).all()
    h = np.sort(np.array([rng.randrange(1 << 64) for _ in range(500)], np.uint64))
    full, cuts = blocks.part_spans(h, 7)
    assert cuts[0] == 0 and cuts[-1] == 500 and all((blocks.part_of(h[a:b], 7) == p).all() for p, a, b in zip(full, cuts, cuts[1:]))
    # rows that are shuffled stay in proportion to the input
    for size in (10**9, 10**12, 10**14):
        n_blocks, n_parts = blocks.scale(size, blocks.BLOCK_BYTES, blocks.PART_ENTRIES)
        assert n_blocks * n_parts <= 1.1 * size / blocks.WORD_BYTES / blocks.LEAST_PACKET or size < 10**11


def test_null_ids_are_split(spark):
    rows = [(None, f"text {i} " * 200) for i in range(300)] + [(i, f"text {i} " * 200) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup(df, 20, block_bytes=20_000, part_entries=5000).collect()
    assert {r["n_removed"] for r in got if r["doc_id"] is not None} == {400}
    assert all(r["n_removed"] == 398 for r in got if r["doc_id"] is None)
