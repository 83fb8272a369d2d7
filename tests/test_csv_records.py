"""CSV read in splits against Spark's reader of whole files (``multiLine``)."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from dhvani.sources import csv_records as C
from dhvani.sources import transcripts as S

WHOLE = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"',
         "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "97")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def quoted(x: str, r) -> str:
    if any(c in x for c in ',"\n\r') or r.random() < 0.2:
        return '"' + x.replace('"', '""') + '"'
    return x


def random_csv(seed: int, end: str = "\n") -> str:
    r = random.Random(seed)
    words = ["a", "bb", "", "c,d", 'say ""no""', "line\nbreak", "\n\n", '"', "é ü", "x" * 40, ' "q" ', "tail,\n", "long " * 30]
    rows = [["file", "text", "n"]]
    for k in range(r.randint(0, 60)):
        rows.append([f"f{k}", "".join(r.choice(words) for _ in range(r.randint(0, 4))), r.choice(["1", "22", ""])])
    return end.join(",".join(quoted(x, r) for x in row) for row in rows) + r.choice(["", end, end + end])


def both(spark, path, schema=None):
    got = C.read_quoted_csv(spark, path, schema)
    reader = spark.read.options(**WHOLE)
    want = (reader.schema(schema) if schema else reader).csv(path)
    assert got.drop("line_ord").schema == want.schema
    rows = [tuple(r) for r in got.orderBy("line_ord").drop("line_ord").collect()]
    return rows, [tuple(r) for r in want.collect()]


def write(text: str, name: str = "t.csv") -> str:
    p = os.path.join(tempfile.mkdtemp(prefix="dhvani-csvr-"), name)
    with open(p, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return p


@pytest.mark.parametrize("seed", range(4))
def test_same_rows_as_whole_files(small_splits, seed):
    p = write(random_csv(seed))
    assert small_splits.read.text(p).rdd.getNumPartitions() >= min(os.path.getsize(p) // 200, 2)
    got, want = both(small_splits, p)
    assert got == want


@pytest.mark.parametrize("text", [
    "", "a,b\n", "a,b\n1,2", 'a,b\n"x",y\n', 'a,b\r\n"l1\r\nl2",y\r\n1,2\r\n', "a,b\n\n\n1,2\n\n3,4\n", 'a,b\n5" disc,6" disc\n7,8\n',
    'a,b\n"x""y\n""z",1\n', 'a,b\n1\n2,3,4\n', 'a,b\n"",\n"",""\n', 'a,a,\n1,2,3\n', 'a,b\n' + '"' + "inside\n" * 100 + '",1\n2,3\n'])
def test_shapes(small_splits, text):
    got, want = both(small_splits, write(text)) if text else ([], [])
    assert got == want


def test_a_quote_that_is_never_closed_takes_the_rest(small_splits):
    """The rest of the file, as the reader of whole files has it but for the last line end."""
    got, want = both(small_splits, write('a,b\nx,y\n"never closed,1\n2,3\n' + "4,5\n" * 60))
    assert got == [("x", "y"), (want[1][0].removesuffix("\n"), None)] and len(want) == 2


def test_header_over_lines_and_several_files(small_splits):
    d = tempfile.mkdtemp(prefix="dhvani-csvd-")
    for k in range(3):
        with open(os.path.join(d, f"p{k}.csv"), "w") as f:
            f.write('file,"te\nxt"\n' + "".join(f'f{k}-{j},"some ""text""\nin lines {j}"\n' for j in range(30)))
    got, want = both(small_splits, d)
    assert sorted(got) == sorted(want) and len(got) == 90


def test_merge_join_beyond_the_broadcast_bound(small_splits, monkeypatch):
    monkeypatch.setattr(C, "BROADCAST_ROWS", 0)
    got, want = both(small_splits, write(random_csv(5)))
    assert got == want


def test_types_and_inference(small_splits):
    p = write('i,d,t,s\n1,2.5,2024-01-02,x\n-3,,2024-05-06,"1\n2"\n')
    got, want = both(small_splits, p, "i int, d double, t date, s string")
    assert got == want
    df = C.read_quoted_csv(small_splits, p, infer=True).drop("line_ord")
    assert [f.dataType.simpleString() for f in df.schema] == ["int", "double", "date", "string"]


def test_order_and_tasks(small_splits):
    p = write("n,t\n" + "".join(f'{k},"row {k}\nof it"\n' for k in range(500)))
    df = C.read_quoted_csv(small_splits, p, "n int, t string")
    assert [r.n for r in df.orderBy("line_ord").select("n").collect()] == list(range(500))
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 20


def test_unreadable_csv_falls_back_to_lines(spark):
    p = write('path,caption\na.wav,one,two\nk|text of k\n')
    assert {r.key: r.text for r in S.load_transcripts(spark, p).collect()}["k"] == "text of k"
    p = write('path,caption\na.wav,"open\nk|text of k\n')
    assert {r.key: r.text for r in S.load_transcripts(spark, p).collect()}["k"] == "text of k"
    p = write('path,caption\na.wav,"closed, ""quoted""\nand more"\n')
    assert {r.key: r.text for r in S.load_transcripts(spark, p).collect()} == {"a": 'closed, "quoted"\nand more'}
