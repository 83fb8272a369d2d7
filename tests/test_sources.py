"""Transcript parsing edge rows and file sources (files written to a fresh temp dir)."""

import os
import tempfile

from pyspark.sql import functions as F

from dhvani.operators.lookup import attach_transcript, route, semi_existing
from dhvani.sources import transcripts as S
from dhvani.sources.inventory import audio_inventory
from dhvani.sources.listing import files_below


def lines_df(spark, lines):
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_ord long, line string")


def test_parse_transcript_lines_edge_rows(spark):
    lines = ["a/b.wav|x|y", "a/b.wav\tx", '( t_01 "hi there" )', "( t_02 none )", "id one  two", "single", "   ",
             "k|first", "k|second"]
    out = S.parse_transcript_lines(lines_df(spark, lines)).orderBy("line_ord").collect()
    got = [(r.key, r.text) for r in out]
    assert got == [("a/b.wav", "x|y"), ("b", "x"), ("t_01", "hi there"), ("id", "one two"),
                   ("k", "first"), ("k", "second")]
    lw = {r.key: r.text for r in S.last_wins(S.parse_transcript_lines(lines_df(spark, lines))).collect()}
    assert lw["k"] == "second"


def test_tab_and_festival(spark):
    tab = S.parse_tab_map(lines_df(spark, ["d/x.lab\ttext\tmore", "nofield"])).collect()
    assert [(r.key, r.text) for r in tab] == [("x", "text")]
    fest = S.parse_festival(lines_df(spark, ['( train_001 "hello (x) there" ) tail', 'x ( a "b" )'])).collect()
    assert [(r.key, r.text) for r in fest] == [("train_001", "hello (x) there")]


def test_read_lines_order_and_last_wins(spark):
    d = tempfile.mkdtemp(prefix="dhvani-lines-")
    with open(os.path.join(d, "a.txt"), "w") as f:
        f.write("k|one\nz|zz\nk|two\n")
    lines = S.read_lines(spark, os.path.join(d, "a.txt"))
    m = {r.key: r.text for r in S.last_wins(S.parse_transcript_lines(lines)).collect()}
    assert m == {"k": "two", "z": "zz"}


def test_load_transcripts_csv_and_fallback(spark):
    d = tempfile.mkdtemp(prefix="dhvani-csv-")
    p = os.path.join(d, "t.csv")
    with open(p, "w") as f:
        f.write('path,caption\nclips/a.wav,"hello, ""world"""\nclips/b.wav,"multi\nline"\nclips/a.wav,later\n')
    m = {r.key: r.text for r in S.load_transcripts(spark, p).collect()}
    assert m == {"a": "later", "b": "multi\nline"}
    q = os.path.join(d, "u.csv")
    with open(q, "w") as f:
        f.write("x|first text\ny second text\n")
    m2 = {r.key: r.text for r in S.load_transcripts(spark, q).collect()}
    assert m2 == {"x": "first text", "y": "second text"}


def test_inventory_sidecars_attach(spark):
    d = tempfile.mkdtemp(prefix="dhvani-audio-")
    os.makedirs(os.path.join(d, "s"))
    for name in ["a.wav", "b.flac", "c.WAV", "d.txt", "e.mp3"]:
        with open(os.path.join(d, "s", name), "wb") as f:
            f.write(b"\0")
    with open(os.path.join(d, "s", "b.txt"), "w") as f:
        f.write("  Side Text 2  \n")
    inv = audio_inventory(spark, d)
    assert sorted(r.stem + "." + r.ext for r in inv.collect()) == ["a.wav", "b.flac", "e.mp3"]
    side = S.read_sidecars(spark, os.path.join(d, "s", "*.txt"))
    tmap = spark.createDataFrame([("a", "Map 5"), ("e", "")], "key string, text string")
    clips = inv.select("stem", F.regexp_replace("path", r"\.[^.]+$", "").alias("clip_base"))
    got = {r.stem: r.transcript for r in attach_transcript(clips, tmap, side, "en").collect()}
    assert got == {"a": "map five", "b": "side text two", "e": ""}
    files = spark.createDataFrame([(inv.first().path,), ("/nope.wav",)], "file string")
    assert semi_existing(files, inv).count() == 1


def test_route(spark):
    df = spark.createDataFrame([("a", 4799), ("b", 4800)], "input_path string, n int")
    good, bad = route(df, F.when(F.col("n") < int(0.3 * 16000), F.lit("too_short")))
    assert [r.input_path for r in good.collect()] == ["b"]
    assert [(r.input_path, r.error) for r in bad.collect()] == [("a", "too_short")]


def test_manifest_csv_roundtrip_and_split_folders(spark):
    from dhvani.sources.manifests import read_manifest, write_manifest_table, write_splits
    rows = [("1", "/c/1.wav", 1.25, 'He said "hi",\nthen left', "en"), ("2", "/c/2.wav", 3.5, "", "hi")]
    df = spark.createDataFrame(rows, "id string, wav_path string, duration_sec double, transcript string, lang string")
    d = tempfile.mkdtemp(prefix="dhvani-man-")
    write_manifest_table(df, os.path.join(d, "m"), "csv")
    back = sorted(tuple(r) for r in read_manifest(spark, os.path.join(d, "m")).collect())
    assert back[0] == rows[0] and back[1][:3] == rows[1][:3]
    s = df.withColumn("split", F.when(F.col("id") == "1", "train").otherwise("test"))
    write_splits(s, os.path.join(d, "s"), "csv")
    got = read_manifest(spark, os.path.join(d, "s", "split=test")).collect()
    assert [r.id for r in got] == ["2"]


def test_sidecar_folders_are_listed_whole(spark):
    """No task a file before the read begins; the same rows as by paths; other names and none are left out."""
    d = tempfile.mkdtemp(prefix="dhvani-side-")
    for k in range(60):
        os.makedirs(os.path.join(d, str(k % 3)), exist_ok=True)
        with open(os.path.join(d, str(k % 3), f"{k}.txt"), "w", encoding="utf-8") as f:
            f.write(f" text {k}\n")
    with open(os.path.join(d, "0", "x.wav"), "w") as f:
        f.write("x")
    spark.sparkContext.setJobGroup("sidecar listing", "")
    side = S.read_sidecars(spark, d, "*.txt")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("sidecar listing")
    got = {(os.path.basename(r.clip_base), r.text) for r in side.collect()}
    assert got == {(str(k), f"text {k}") for k in range(60)}
    assert sorted(map(tuple, side.collect())) == sorted(map(tuple, S.read_sidecars(spark, d + "/*/*.txt").collect()))
    spark.sparkContext.setJobGroup("others", "")


def odd_sidecars(d):
    """Folders with sidecars and other files; names that are patterns or escapes elsewhere, hidden ones, links, an empty file."""
    texts = {f"{k % 3}/{k}.txt": f" text {k}\n" for k in range(40)}
    texts |= {"x[1].txt": "a", "y{1,2}.txt": "b", "z*.txt": "c", "a b%20.txt": "d", "deep/er/k=1/q.txt": "e", "_k=v/r.txt": "f",
              "_m/no.txt": "hidden", ".m/no.txt": "hidden", "_no.txt": "hidden", ".no.txt": "hidden", "_metadata.d/s.txt": "g",
              "t.txt._COPYING_": "hidden", "u.md": "other", "empty.txt": "", "back\\slash.txt": "i", "0/é.txt": "j"}
    for name, text in texts.items():
        os.makedirs(os.path.dirname(os.path.join(d, name)), exist_ok=True)
        with open(os.path.join(d, name), "w", encoding="utf-8") as f:
            f.write(text)
    os.symlink(os.path.join(d, "1"), os.path.join(d, "linked"))
    os.symlink(os.path.join(d, "gone.txt"), os.path.join(d, "nothing.txt"))


def test_files_below_are_those_that_spark_lists(spark):
    d = tempfile.mkdtemp(prefix="dhvani-side-")
    odd_sidecars(d)
    for paths, names in [([d], "*.txt"), (["file:" + d], "[!q]*.t?t"), ([d, d + "/0", d + "/.m"], "*.txt"),
                         ([d + "/[01]"], "*.txt"), ([d + "/0/0.txt", d], "*.{txt,md}")]:
        listed = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=names).load(paths)
        listed = [r.path for r in listed.select("path").collect()]
        empty = {"file:" + os.path.join(d, "empty.txt")} if d + "/[01]" not in paths else set()  # scans leave it out
        assert sorted(files_below(spark, paths, names)) == sorted({*listed, *empty})
        assert len(listed) > 14
    assert files_below(spark, [d, d + "/none"], "*.txt") is None


def test_sidecars_are_read_some_at_a_time(spark, monkeypatch):
    """The driver never has all files of the folders in a scan; the rows are those of one scan of them all."""
    d = tempfile.mkdtemp(prefix="dhvani-side-")
    odd_sidecars(d)
    rows = sorted(S.read_sidecars(spark, d, "*.txt").collect())
    assert len(rows) > 60 and ("file:" + d + "/0/3", "text 3") in rows
    monkeypatch.setattr(S, "SIDECAR_BATCH", 30, raising=False)
    listed = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    side = S.read_sidecars(spark, d, "*.txt")
    assert not [f for f in side.inputFiles() if not f.endswith(".parquet")]
    assert sorted(side.collect()) == rows
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == listed


def test_sidecars_in_a_store_are_listed_alike(spark, monkeypatch):
    """Folders that only Spark can read, here by another name of a local one."""
    d = tempfile.mkdtemp(prefix="dhvani-side-")
    odd_sidecars(d)
    monkeypatch.setattr(S, "SIDECAR_BATCH", 30, raising=False)
    local = {(r.clip_base.split(d)[1], r.text) for r in S.read_sidecars(spark, d, "*.txt").collect()}
    spark.conf.set("fs.viewfs.mounttable.sidecars.link./in", "file://" + d)
    try:
        side = S.read_sidecars(spark, "viewfs://sidecars/in", "*.txt")
        assert {(r.clip_base.split("sidecars/in")[1], r.text) for r in side.collect()} == local
        assert not [f for f in side.inputFiles() if not f.endswith(".parquet")]
    finally:
        spark.conf.unset("fs.viewfs.mounttable.sidecars.link./in")
