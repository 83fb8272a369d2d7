"""Edge rows from FIXTURES.md section 3 for the text and path functions."""

import pytest
from pyspark.sql import functions as F

from dhvani.functions import paths as P
from dhvani.functions import text as T


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("src,expected", [
    ("It's 5' 6\" [noise]", "it's five' six noise"),
    ("abc123 _5 007 1234", "abc seven one thousand two hundred and thirty four"),
    ("१२ apples", "twelve apples"),
    ("café", "caf"),
    ("", ""),
    ("?!,.", ""),
    ("21 105 1005 1000000", "twenty one one hundred and five one thousand and five one million"),
    ("0 1100 2005000 1000099", "zero one thousand one hundred two million five thousand one million and ninety nine"),
])
def test_normalize_en(spark, src, expected):
    assert one(spark, T.normalize_en, src) == expected


def test_normalize_en_idempotent(spark, duck01):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        T.normalize_en(F.col("text")).alias("a")).select("a", T.normalize_en(F.col("a")).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


@pytest.mark.parametrize("src,expected", [
    ("नमस्ते (laugh) दुनिया।। 12", "नमस्ते दुनिया।"),
    ("[x]१२ abc", "१२"),
    ("क(a\nb)ख", "क ख"),
])
def test_normalize_hi(spark, src, expected):
    assert one(spark, T.normalize_hi, src) == expected


def test_normalize_by_lang(spark):
    df = spark.createDataFrame([("hi-IN", "नमस्ते 12"), ("hindi", "नमस्ते 12"), ("fr", "nous 12"), ("en", "We 12")],
                               "lang string, t string")
    out = [r.y for r in df.select(T.normalize_by_lang(F.col("t"), F.col("lang")).alias("y")).collect()]
    assert out == ["नमस्ते", "नमस्ते", "nous twelve", "we twelve"]


@pytest.mark.parametrize("src,expected", [
    ("a/b.tar.gz", "b.tar"), (".bashrc", ".bashrc"), ("x/a.", "a."), ("a/b/", "b"), ("/c/d.wav", "d"),
])
def test_path_stem(spark, src, expected):
    assert one(spark, P.path_stem, src) == expected


def test_resolve_and_proc_path(spark):
    df = spark.createDataFrame([("/abs/x.wav",), ("rel/dir/y.flac",)], "p string")
    r = [x.r for x in df.select(P.resolve_path(F.col("p"), "/data/splits/test.csv").alias("r")).collect()]
    assert r == ["/abs/x.wav", "/data/splits/y.flac"]
    q = [x.q for x in spark.createDataFrame([("/in/a/b/c.mp3",), ("/in/top.wav",), ("/other/z.wav",)], "p string")
         .select(P.proc_path(F.col("p"), "/in", "/out").alias("q")).collect()]
    assert q == ["/out/a/b/c_proc.wav", "/out/top_proc.wav", None]


def test_number_words_large(spark):
    df = spark.createDataFrame([("1" + "0" * 35,), ("1" + "0" * 36,), ("000",), ("1" + "0" * 303,), ("9" * 306,), ("1" + "0" * 306,)], "x string")
    out = [r.y for r in df.select(T.number_words(F.col("x")).alias("y")).collect()]
    assert out[:4] == ["one hundred decillion", "one undecillion", "zero", "one centillion"]
    assert out[4].startswith("nine hundred and ninety-nine centillion".replace("-", " ")) and out[4].endswith("nine hundred and ninety nine")
    assert out[5] == "1" + "0" * 306  # no words from here on
