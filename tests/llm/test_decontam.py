from quillon.llm.decontam import decontaminate, matches

DOC = "doc_id long, text string, COVER string"
ITEM = "item_id long, text string"
Q = "At the market Anna buys 12 apples for 3 dollars each, and then Anna gives 4 apples to Boris. How many does she keep in the end?"


def found(spark, docs, items):
    d = spark.createDataFrame([(*r, "x") for r in docs], DOC)
    return {(r["rid"], r["item"]): r for r in matches(d, spark.createDataFrame(items, ITEM)).collect()}


def test_copies_and_reparameterised(spark):
    docs = [
        (1, "Some words before. " + Q + " and after"),
        (2, "x " + Q.upper() + " y"),
        (3, Q.replace("Anna", "Clara").replace("Boris", "David").replace("12", "150").replace("4", "7").replace("3 dollars", "9 euros")),
        (4, Q.replace("then Anna", "then Paul")),  # one name for two: inconsistent from there on
        (5, "At the market there is a lot to see, and Anna keeps a stall in the end of it all."),
        (6, None),
        (7, ""),
        (8, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"),
        (9, "word " * 30000 + Q),
        (None, Q),
        (1, "Some words before. " + Q + " and after"),
        (10, Q.replace(" ", "\t").replace("apples", "apples!!")),
    ]
    got = found(spark, docs, [(70, Q), (71, Q), (72, None), (73, "too short"), (74, "")])
    assert {k[0] for k in got if k[1] == 70} >= {1, 2, 3, 9, None, 10}
    assert {k[0] for k in got} & {5, 6, 7, 8} == set()
    assert {k[0] for k in got if k[1] == 70} == {k[0] for k in got if k[1] == 71}
    assert {k[1] for k in got} == {70, 71}
    assert not got[1, 70]["reparameterised"] and got[3, 70]["reparameterised"]
    assert got[1, 70]["cover"] > got.get((4, 70), {"cover": 0})["cover"]


def test_filter_keeps_clean_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, Q, "a"), (2, "clean text", "b"), (2, Q, "c"), (None, None, "d"), (2, "clean text", "b")], DOC)
    out = decontaminate(docs, spark.createDataFrame([(1, Q)], ITEM))
    assert out.columns == ["doc_id", "text", "COVER"]
    assert sorted(r["COVER"] for r in out.collect()) == ["b", "b", "d"]


def test_short_items_and_empty(spark):
    item = "the quick brown fox jumps"
    assert set(found(spark, [(1, "see how the quick brown fox jumps over"), (2, "the quick brown dog jumps")], [(5, item)])) == {(1, 5)}
    none = spark.createDataFrame([], ITEM)
    assert decontaminate(spark.createDataFrame([(1, Q, "a")], DOC), none).count() == 1
    assert decontaminate(spark.createDataFrame([], DOC), spark.createDataFrame([(1, Q)], ITEM)).collect() == []


def test_conflict_drops_only_its_windows(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    for i in (20, 90, 160):
        words[i] = "3"
    changed = [*words[:90], "4", *words[91:]]
    noun = " ".join(["Haus" if w == "3" else w for w in words])
    other = " ".join(["Dorf" if i == 90 else w for i, w in enumerate(noun.split())])
    shop = "the shop sold 12 red pens to one man and then sold 3 blue pens to his son before it closed"
    same = shop.replace("12", "5").replace(" 3 ", " 5 ")
    got = found(spark, [(1, " ".join(changed)), (2, other), (3, same)], [(10, " ".join(words)), (20, noun), (30, shop)])
    assert got[1, 10]["cover"] >= 0.99 and got[2, 20]["cover"] >= 0.99  # all but the changed word
    assert got[3, 30]["cover"] == 1.0 and got[3, 30]["reparameterised"]  # two values may become one
    back = found(spark, [(1, shop)], [(1, same)])  # one value never becomes two: only part of the windows count
    assert back.get((1, 1), {"cover": 0})["cover"] < 1.0


def test_largest_consistent_set():
    from itertools import combinations
    from random import Random

    from pyspark.sql import Row

    from quillon.llm.decontam import _consistent

    r = Random(4)
    for _ in range(60):
        ws = [{"at": r.randrange(12), "width": 3, "pairs": [Row(i=i, d=d, same=i == d) for i, d in [(r.randrange(4), r.randrange(3)) for _ in range(r.randrange(3))]]} for _ in range(8)]
        fair = lambda c: len({(p["i"], p["d"]) for j in c for p in ws[j]["pairs"]}) == len({p["i"] for j in c for p in ws[j]["pairs"]})
        cover = lambda c: len({x for j in c for x in range(ws[j]["at"], ws[j]["at"] + 3)})
        kept = _consistent(ws)
        assert fair(kept) and cover(kept) == max(cover(c) for n in range(9) for c in combinations(range(8), n) if fair(c))
    assert _consistent(None) is None


def test_copies_of_items_full_of_numbers(spark):
    items = [(1, "What is 12 + 7 * 3 - 4 / 2 + 9?"), (2, "Continue: 2 4 8 16 32 64 128 256 512 1024 2048"), (3, "Row 1 2 3 sum 6, row 4 5 6 sum 15, row 7 8 9 sum 24")]
    docs = [(k, f"He asked us this: {text} And then he left.") for k, text in items]
    got = found(spark, [*docs, (9, "What is 1 + 2 * 5 - 6 / 3 + 8? And 5 7 9 11 13 15 17 19 21 23 25")], items)
    assert set(got) == {(1, 1), (2, 2), (3, 3)}
    assert all(r["cover"] == 1.0 and not r["reparameterised"] for r in got.values())


def test_names_that_begin_sentences(spark):
    tom = "Tom has 3 apples. Tom buys 5 more. Tom eats 1. Tom gives 2 to Ann. How many are left?"
    bob = tom.replace("Tom", "Bob")
    mixed = bob.replace("Bob gives", "Max gives")  # one name for two
    other = "Tom went home early. Ann stayed with 3 friends. How many of them left? Nobody knows to this day."
    got = found(spark, [(1, bob), (2, tom), (3, "Well, " + bob), (4, other), (5, mixed)], [(1, tom)])
    assert {1, 2, 3} <= {k[0] for k in got} and (4, 1) not in got
    assert got[1, 1]["cover"] == 1.0 and got[1, 1]["reparameterised"] and not got[2, 1]["reparameterised"]
    assert got.get((5, 1), {"cover": 0})["cover"] < 1.0


def test_short_items_are_matched_as_they_are(spark):
    items = [(1, "What is 2 + 2?"), (2, "+ - * / 7 ="), (3, "Paris")]
    docs = [(1, "He said: what is 2 + 2? Nobody knew."), (2, "What is 2 2?"), (3, "what is 3 + 3?"), (4, "We write + - * / 7 = here"), (5, "Paris is large"), (6, " PARIS\n")]
    got = found(spark, docs, items)
    assert set(got) == {(1, 1), (4, 2), (6, 3)} and all(r["cover"] == 1.0 for r in got.values())


def test_number_words_and_lengths(spark):
    shop = "the shop sold 12 red pens to one man and then sold 25 blue pens to his son before it closed"
    words = shop.replace("12", "twelve").replace("25", "twenty five")
    hyphen = shop.replace("12", "ninety-nine").replace("25", "2 million")
    french = "il a vendu 12 stylos rouges pendant 3 heures et puis 25 stylos bleus avant la fin du jour"
    german = "er lief 12 kilometer in 3 stunden und danach noch 25 meter weiter bis zum alten haus am see"
    docs = [(1, words), (2, hyphen), (3, french.replace("12", "quinze").replace("25", "vingt-cinq").replace("heures", "jours")), (4, german.replace("25", "fünfunddreißig").replace("meter", "kilometer").replace("stunden", "tagen"))]
    got = found(spark, docs, [(1, shop), (2, french), (3, german)])
    assert set(got) == {(1, 1), (2, 1), (3, 2), (4, 3)}
    assert all(r["reparameterised"] and r["cover"] == 1.0 for k, r in got.items() if k != (4, 3)) and got[4, 3]["cover"] >= 0.5


def test_slots_are_judged_over_the_whole_document(spark):
    """One item value that stands for two document values is a conflict, however far apart they are."""
    item = "the shop sold 12 red pens to a man in town and the other shop sold 12 blue pens to his son"
    plain = item.replace("sold 12 red", "sold 7 red").replace("sold 12 blue", "sold 9 blue")
    moved = plain.replace("in town and", "in town today and")
    got = found(spark, [(1, plain), (2, moved), (3, item.replace("12", "7"))], [(1, item)])
    assert got[3, 1]["cover"] == 1.0
    assert all(got.get((d, 1), {"cover": 0})["cover"] < 1.0 for d in (1, 2))
    assert got.get((2, 1), {"cover": 0})["cover"] <= got.get((1, 1), {"cover": 0})["cover"]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, Q, "a", 1, "k"), (2, "clean text", "b", 2, "k")], "doc_id long, text string, th string, rid long, own string")
    out = decontaminate(docs, spark.createDataFrame([(1, Q)], ITEM))
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(2, "clean text", "b", 2, "k")]
