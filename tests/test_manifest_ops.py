"""Language fill rules (B7) and keep-first with null keys (E1)."""

from pyspark.sql import functions as F

from dhvani.operators import manifest as M


def test_lang_rules(spark):
    assert M.lang_from_path("/data/archive/m.csv") == "hi"
    assert M.lang_from_path("/data/english/m.csv") == "en"
    assert M.lang_from_path("/data/x/m.csv") is None
    df = spark.createDataFrame([("/data/hindi/a.csv",), ("/tmp/english/b.csv",), ("/x/y.csv",)], "p string")
    assert [r.l for r in df.select(M.lang_from_path_col(F.col("p")).alias("l")).collect()] == ["hi", "en", None]
    m = spark.createDataFrame([("a",)], "id string")
    assert M.add_lang(m, "hi").first().lang == "hi"
    assert M.add_lang(m.withColumn("lang", F.lit("en")), "hi").first().lang == "en"
    assert "lang" not in M.add_lang(m, None).columns


def test_keep_first_null_keys_and_order(spark):
    a = spark.createDataFrame([(None, "a1", 1), ("k", "a2", 2)], "wav_path string, t string, o long")
    b = spark.createDataFrame([(None, "b1", 0), ("k", "b2", 0), ("z", "b3", 5)], "wav_path string, t string, o long")
    c = M.combine([(a, "/english/a.csv", F.col("o")), (b, "/hindi/b.csv", F.col("o"))])
    got = sorted((r.wav_path or "", r.t, r.lang) for r in c.collect())
    assert got == [("", "a1", "en"), ("k", "a2", "en"), ("z", "b3", "hi")]
