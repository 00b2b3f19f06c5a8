from quillon.llm.chat import rotate

SCHEMA = "conv_id long, turn int, role string, text string, Mask string"


def brute(rows, context=("system",), block_turns=1024):
    out = {}
    convs = {r[0] for r in rows}
    for c in convs:
        own = [(t, r if r is not None else "unknown", x or "") for i, t, r, x in rows if i == c]
        for speaker in {r for _, r, _ in own if r not in context}:
            blocks = {}
            for t, r, x in sorted(own, key=lambda y: (-(1 << 62) if y[0] is None else y[0], y[1], y[2])):
                blocks.setdefault(max((t or 0) // block_turns, 0), []).append((r, x))
            for b, turns in blocks.items():
                text, spans = "", []
                for r, x in turns:
                    clean = lambda s: s.replace("<|", "< |")
                    text += f"<|{clean(r)}|>\n" if r in context else "<|assistant|>\n" if r == speaker else f"<|user name={clean(r)}|>\n"
                    body = clean(x) + "<|end|>\n"
                    if r == speaker and r not in context:
                        spans.append((len(text), len(text) + len(body)))
                    text += body
                out[c, speaker, b] = (len(turns), text, spans)
    return out


def test_against_brute_force(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "anna", "Hi <|assistant|> é"), (1, 2, "boris", None), (1, 3, "anna", "Bye"), (1, 4, "clara", "x" * 50_000),
        (2, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "assistant", "b"), (2, None, "user", "first"), (2, 5, None, "who"),
        (3, 0, "system", "alone"), (None, 0, "u", "n"), (None, 1, "v", "m"), (4, 1500, "u", "late"), (4, 3, "u", "early"), (4, -2, "w<|x", "neg"),
    ]
    df = spark.createDataFrame([(*r, "c") for r in rows], SCHEMA).repartition(4)
    got = {(r["conv_id"], r["speaker"], r["block"]): (r["n_turns"], r["rendered"], [tuple(m) for m in r["mask"]]) for r in rotate(df).collect()}
    assert got == brute(rows)
    small = {(r["conv_id"], r["speaker"], r["block"]): (r["n_turns"], r["rendered"], [tuple(m) for m in r["mask"]]) for r in rotate(df, block_turns=2).collect()}
    assert small == brute(rows, block_turns=2)


def test_masks_cover_the_speaker_only(spark):
    df = spark.createDataFrame([(1, i, r, f"turn {i}", "") for i, r in enumerate(["a", "b", "a", "c"])], SCHEMA)
    for r in rotate(df).collect():
        said = "".join(r["rendered"][m["start"] : m["end"]] for m in r["mask"])
        assert said == "".join(f"turn {i}<|end|>\n" for i, who in enumerate(["a", "b", "a", "c"]) if who == r["speaker"])


def test_empty(spark):
    assert rotate(spark.createDataFrame([], SCHEMA)).collect() == []
