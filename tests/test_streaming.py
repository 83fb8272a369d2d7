"""Streaming ingest: files landing in a folder, entries appended to a table, the
latest per key read from it."""

import os
import tempfile
import time

from dhvani.streaming.transcripts import latest_transcripts, start_transcript_ingest


def test_latest_transcripts_stream(spark):
    d, out = tempfile.mkdtemp(prefix="dhvani-stream-"), tempfile.mkdtemp(prefix="dhvani-table-")
    with open(os.path.join(d, "a.txt"), "w") as f:
        f.write("k1|Hello 5\nk2|First\n")
    q = start_transcript_ingest(spark, d, out, checkpoint=tempfile.mkdtemp(prefix="dhvani-sck-"))
    try:
        q.processAllAvailable()
        assert {r.key: r.text for r in latest_transcripts(spark, out).collect()} == {"k1": "hello five", "k2": "first"}
        time.sleep(1.1)  # later modification time for the second file
        with open(os.path.join(d, "b.txt"), "w") as f:
            f.write("k2|Second 21\n")
        q.processAllAvailable()
    finally:
        q.stop()
    assert {r.key: r.text for r in latest_transcripts(spark, out).collect()} == {"k1": "hello five", "k2": "second twenty one"}


def test_numbered_lines(spark):
    """The number decides, not the file; a file is many rows and many tasks."""
    d, out = tempfile.mkdtemp(prefix="dhvani-stream-"), tempfile.mkdtemp(prefix="dhvani-table-")
    with open(os.path.join(d, "a.txt"), "w") as f:
        f.write("900000\tk1.wav\tThe last 5\n" + "".join(f"{i}\thot.wav\tline {i} of one source\r\n" for i in range(50_000)))
    time.sleep(1.1)
    with open(os.path.join(d, "b.txt"), "w") as f:
        f.write("7\tk1.wav\tearlier\n\tk1.wav\tno number\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        q = start_transcript_ingest(spark, d, out, checkpoint=tempfile.mkdtemp(prefix="dhvani-sck-"), trigger_once=True, numbered=True)
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    table = spark.read.parquet(out)
    assert table.count() == 50_003 and len(table.inputFiles()) > 4
    got = {r.key: r.text for r in latest_transcripts(spark, out).collect()}
    assert got["k1"] == "the last five" and got["hot"].startswith("line forty nine thousand nine hundred")
