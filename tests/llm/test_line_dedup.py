import random
import time

import numpy as np
import pyarrow as pa

from quillon.llm import line_dedup as module
from quillon.llm.line_dedup import PER_EDIT, line_dedup
from quillon.llm.textkit import BYTE, OTHER, U, mix64, span_hashes

SCHEMA = "doc_id long, text string, N_Lines string"


def within_one(a: str, b: str) -> bool:
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    for i in range(len(b)):
        if a == b[:i] + b[i + 1 :] or (len(a) == len(b) and a[:i] + a[i + 1 :] == b[:i] + b[i + 1 :]):
            return True
    return False


def brute(rows):
    """Kept text by (id, text); rows of one id have distinct texts only when order does not matter."""
    places = [(i if i is not None else -(1 << 63), t, no, ln) for i, t in sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0)) for no, ln in enumerate(t.split("\n"))]
    out = {}
    seen = []
    for i, t, no, ln in places:
        if ln.strip(" \t\r") == "":
            gone = False
        else:
            gone = any(ln == x or (min(len(ln), len(x)) >= PER_EDIT and within_one(ln, x)) for x in seen)
            seen.append(ln)
        out.setdefault((i, t), []).append((ln, gone))
    return {k: ("\n".join(ln for ln, g in v if not g), sum(g for _, g in v)) for k, v in out.items()}


def test_against_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab cé") for _ in range(rng.randint(18, 30))) for _ in range(12)]

    def line():
        s = rng.choice(base)
        i = rng.randrange(len(s))
        return rng.choice([s, s, s[:i] + s[i + 1 :], s[:i] + rng.choice("abx") + s[i:], s[:i] + rng.choice("abx") + s[i + 1 :], "", "  ", "short", "shorx"])

    rows = [(i, "\n".join(line() for _ in range(rng.randint(1, 6)))) for i in range(60)]
    rows += [(None, "from nowhere at all, a line\n" + base[0]), (99, None), (100, ""), rows[5], rows[5], (101, "a a a a a " * 5000 + "\nx")]
    got = line_dedup(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    texts = {}
    for r in got:
        texts.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        mine = texts[i]
        assert len(mine) == sum(1 for j, _ in rows if j == i)
        if t is None:
            assert mine[0]["text"] is None and mine[0]["n_lines"] == 0 and mine[0]["n_removed"] == 0
            continue
        key = (i if i is not None else -(1 << 63), t)
        assert any((r["text"], r["n_removed"]) == want[key] for r in mine), (i, t, mine, want[key])


def test_empty(spark):
    assert line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_two_edits(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abc é") for _ in range(rng.choice([14, 15, 22, 23, 31]))) for _ in range(6)]

    def changed(s):
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(s))
            s = rng.choice([s[:i] + s[i + 1 :], s[:i] + "x" + s[i:], s[:i] + "y" + s[i + 1 :]])
        return s

    rows = [(i, changed(rng.choice(base))) for i in range(120)]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), per_edit=10, max_edits=2).collect()}
    bound = lambda a, b: min(2, len(a) // 10, len(b) // 10)
    want = {i: int(bool(t.strip()) and any(u.strip() and (t == u or distance(t, u) <= bound(t, u)) for _, u in rows[:k])) for k, (i, t) in enumerate(rows)}
    assert got == want and 20 < sum(want.values()) < 120


def test_clashing_columns_and_hot_line(spark):
    hot = "one line that a third of all documents hold"
    rows = [(i, f"{hot}\nown line {i} {i * i} of this document", i, "th", 1.5) for i in range(2500)] + [(7, "another text", 0, "t", 0.0), (-5, f"{hot}!", 0, "n", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id long, Th string, document double")
    got = line_dedup(docs, max_edits=1)
    assert got.columns == [*docs.columns, "n_lines", "n_removed", "removed_lines"]
    out = got.collect()
    assert len(out) == len(rows) and {r["id"] for r in out} == {r[2] for r in rows}
    assert {r["doc_id"]: r["removed_lines"] for r in out if r["n_removed"]}.keys() == set(range(2500)) and all(0 in r["removed_lines"] for r in out if r["n_removed"])


def test_null_ids_come_first_and_lines_of_one_id_are_apart(spark):
    rows = [(None, "a line that is repeated here"), (-(1 << 63), "a line that is repeated here\nmore"), (3, "x\n\ny"), (3, "y\n\nx")]
    out = {(r["doc_id"], r["text"]): r["n_removed"] for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[(None, rows[0][1])] == 0 and out[(-(1 << 63), "more")] == 1
    assert sorted(t for i, t in out if i == 3) in (["", "x\n\ny"], ["", "y\n\nx"])


def batch_of(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int64()), pa.array(texts, pa.string())], names=["id", "tag", "text"])


def spans(text: str, least: int):
    """Hashes and half keys of one line, each from its own bytes."""
    h = lambda s, table=BYTE: span_hashes(table[np.frombuffer(s.encode(), np.uint8)], np.array([0]), np.array([len(s.encode())]))
    n = len(text)
    keys = [(0, n, text[: n // 2]), (1, n, text[n // 2 :]), (0, n - 1, text[: (n - 1) // 2]), (1, n - 1, text[(n - 1) // 2 + 1 :])]
    halves = [int(mix64(h(s) + np.array([size]).astype(U) * U(0x9E3779B97F4A7C15) + U(side)).view(np.int64)[0]) if n >= least else None for side, size, s in keys]
    return int(h(text).view(np.int64)[0]), int(h(text, OTHER).view(np.int64)[0]), n, *halves


def test_hashes_and_half_keys_of_each_line():
    rng = random.Random(11)
    texts = ["\n".join("".join(rng.choice(" \taé日😀") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 5))) for _ in range(80)] + [None, "", " \t\r", "x"]
    for least in (1, 2, 5):
        got = {tuple(r[k] for k in ("t1", "t2", "n", "half0", "half1", "half2", "half3")) for out in module._distinct_lines(least)(iter([batch_of(texts)])) for r in out.to_pylist()}
        assert got == {spans(ln, least) for t in texts if t is not None for ln in t.split("\n") if ln.strip(" \t\r")}


def test_hashing_takes_less_than_four_prefix_sums():
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    batch = batch_of(["\n".join(" ".join(rng.choices(words, k=50)) for _ in range(10)) for _ in range(1000)])
    data = np.frombuffer("".join(batch.column("text").to_pylist()).encode(), np.uint8)[: 1 << 20]
    ends = np.arange(300, len(data), 300)

    def seconds(f):
        times = []
        for _ in range(5):
            t = time.process_time()
            f()
            times.append(time.process_time() - t)
        return min(times)

    size = sum(len(t) for t in batch.column("text").to_pylist()) / len(data)
    once = size * seconds(lambda: span_hashes(BYTE[data], ends - 300, ends))
    assert seconds(lambda: list(module._distinct_lines(PER_EDIT)(iter([batch])))) < 4 * once


def test_only_lines_of_repeated_texts_are_joined(spark, monkeypatch):
    joined = []
    skew_join = module.skew_join
    monkeypatch.setattr(module, "skew_join", lambda rows, *args: joined.append(rows.count()) or skew_join(rows, *args))
    rows = [(i, f"a line of document number {i} {i * i * 7919} alone\nanother {i * 104729} of its own {i}\n{'twice' if i in (3, 250) else i}") for i in range(300)]
    out = {r["doc_id"]: r["removed_lines"] for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), fuzzy=False).collect()}
    assert {i: v for i, v in out.items() if v} == {250: [2]} and 2 <= joined[0] < 20
