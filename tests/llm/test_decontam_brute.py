"""Templates and slots of decontamination beside a version in plain Python that tries every assignment of slot values."""

import itertools
import random

from quillon.llm.decontam import MIN_COVER, NUMBER_WORDS, UNITS, WIDTH, _compounds, matches

SPOKEN, UNIT_WORDS = {*NUMBER_WORDS, *_compounds()}, set(UNITS)


def upper(c):
    return "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" or "Α" <= c <= "Ω" or "А" <= c <= "Я"


def core(c):
    return ord(c) >= 128 or c.isalnum()


def canonical(text):
    """(value, views) of the canonical words: kinds in the three typed views."""
    words, newline = [], True
    for line in text.split("\n"):
        for raw in line.split():
            inside = [i for i, c in enumerate(raw) if core(c)]
            if not inside:
                continue
            value = raw[inside[0] : inside[-1] + 1].lower()
            digits = any(c.isdigit() for c in value) and (all(c in "0123456789.,:/+-" for c in value) or value[0].isdigit())
            first = raw[0 if core(raw[0]) else 1]
            rest = raw[(0 if core(raw[0]) else 1) + 1 :]
            words.append({"value": value, "number": digits or value in SPOKEN, "spoken": value in SPOKEN, "end": raw[-1], "line": newline, "opened": upper(first) and not (rest and upper(rest[0]))})
            newline = False
        newline = True
    merged = []
    for w in words:
        if merged and w["spoken"] and merged[-1]["number"] and merged[-1]["end"] not in ".!?:,":
            merged[-1] |= {"value": (merged[-1]["value"], w["value"]), "end": w["end"]}
        else:
            merged.append(dict(w))
    out = []
    for i, w in enumerate(merged):
        begin = i == 0 or merged[i - 1]["end"] in ".!?:" or w["line"]
        kind = "NUM" if w["number"] else "UNIT" if i and merged[i - 1]["number"] and w["value"] in UNIT_WORDS else None
        opened = w["opened"] and kind is None
        out.append((w["value"], (None, kind, "NAME" if opened and not begin else kind, "NAME" if opened else kind)))
    return out


def windows(words, width):
    for view in range(4):
        for at in range(len(words) - width + 1):
            some = words[at : at + width]
            kinds = [w[1][view] for w in some]
            if view and (sum(k is not None for k in kinds) > width / 2 or kinds == [w[1][view - 1] for w in some]):
                continue
            yield at, tuple(k and ("kind", k) or v for (v, _), k in zip(some, kinds))


def cover(doc, item):
    d, t = canonical(doc), canonical(item)
    width = min(WIDTH, len(t))
    ours = {}
    for at, template in windows(t, width):
        ours.setdefault(template, set()).add(at)
    found = set()
    for at, template in windows(d, width):
        for mine in ours.get(template, ()):
            slots = frozenset(((t[mine + j][0], t[mine + j][1][3]), d[at + j][0]) for j in range(width) if t[mine + j][1][3])
            if len({k for k, _ in slots}) == len(slots):
                found.add((mine, slots))
    choices = {}
    for _, slots in found:
        for key, value in slots:
            choices.setdefault(key, set()).add(value)
    best = 0
    for values in itertools.product(*[sorted(v, key=repr) for v in choices.values()]):
        chosen = dict(zip(choices, values))
        best = max(best, len({x for mine, slots in found if all(chosen[k] == v for k, v in slots) for x in range(mine, mine + width)}))
    return best / len(t)


def test_against_brute_force(spark):
    rng = random.Random(11)
    names, units, plain = ["Anna", "Boris", "Émile", "Tom"], ["kg", "hours", "euros"], "buys sells apples and then the of from market box green slowly again".split()
    numbers = ["3", "12", "4.5", "seven", "twenty five", "ninety-nine"]

    def item():
        words = []
        for _ in range(rng.randint(6, 20)):
            x = rng.random()
            words += [rng.choice(names)] if x < 0.15 else [rng.choice(numbers), rng.choice([*units, "pens"])] if x < 0.35 else [rng.choice(plain) + rng.choice(["", "", "", ",", "."])]
        return " ".join(words)

    def changed(text):
        words = text.split()
        swap = {n: rng.choice(names) for n in names} | {u: rng.choice(units) for u in units} | {"3": "8", "12": rng.choice(["3", "forty two"]), "seven": "11"}
        words = [swap.get(w, w) if rng.random() < 0.9 else w for w in words]
        if rng.random() < 0.5:
            words.insert(rng.randrange(len(words)), rng.choice([*plain, "3"]))
        return " ".join([*rng.choices(plain, k=3), *words, *rng.choices(plain, k=3)])

    items = [(i, item()) for i in range(12)]
    docs = [(i, rng.choice([changed, changed, str.upper, str])(rng.choice(items)[1]) + rng.choice(["", "\n" + rng.choice(items)[1]])) for i in range(80)]
    got = {(r["rid"], r["item"]): r["cover"] for r in matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(i, j): c for i, d in docs for j, t in items if (c := cover(d, t)) >= MIN_COVER}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert len(want) > 60 and any(c < 1 for c in want.values())
