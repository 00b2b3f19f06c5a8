import pyarrow as pa
from pyspark.sql import functions as F

from quillon.llm.langid import classify, coders, encoded_sizes, fit, normal

DATA = "/root/testdata/sf0.01/documents.parquet"
SCHEMA = "doc_id long, text string, lang string, SCORE string"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA).withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    dictionaries = fit(docs.where("not held"))
    assert set(dictionaries) == {"de", "en", "es", "fr"}
    assert dictionaries == fit(docs.where("not held").repartition(7))
    got = classify(docs.where("held"), dictionaries).collect()
    right = sum(r["lang"] == r["lang_pred"] for r in got) / len(got)
    assert right >= 0.93
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["rejected"] for r in got) / len(got) < 0.03
    codecs = coders(dictionaries)
    for r in got[:40]:  # the same by hand
        size = encoded_sizes(normal(pa.array([r["text"]]))[0].as_py().encode(), codecs)
        assert list(dictionaries)[int(size.argmin())] == r["lang_pred"]


def test_edges(spark):
    rows = [(1, "the cat and the dog sat on the mat " * 20, "en", ""), (2, "der Hund und die Katze sind auf dem Dach " * 20, "de", ""), (3, "nobody knows", None, ""), (4, None, "en", ""), (5, "12 !? 34", "en", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    d = fit(df)
    assert set(d) == {"de", "en"}
    ask = spark.createDataFrame([(1, None, None, ""), (2, "", None, ""), (3, "12 !?", None, ""), (4, "the cat sat on the mat", None, ""), (5, "DER HUND!! UND!! DIE KATZE " * 3000, None, ""), (4, "the cat sat on the mat", None, "")], SCHEMA)
    got = [(r["doc_id"], r["lang_pred"], r["rejected"]) for r in classify(ask, d).collect()]
    assert sorted(got) == [(1, "und", True), (2, "und", True), (3, "und", True), (4, "en", False), (4, "en", False), (5, "de", False)]
    none = spark.createDataFrame([], SCHEMA)
    assert fit(none) == {} and classify(none, d).collect() == []
    assert {r["lang_pred"] for r in classify(ask, {}).collect()} == {"und"}
