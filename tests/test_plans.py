"""End-to-end plans: manifest build with error routing, evaluation, parallel corpus."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from dhvani.plans.build_manifest import clip_rows, process_clips, write_manifest, write_run
from dhvani.plans.evaluate import eval_pairs, evaluate
from dhvani.plans.parallel_corpus import build_parallel, write_parallel


def test_process_clips_routes_errors(spark):
    clips = spark.createDataFrame([
        ("/in/a/x.wav", [0.5] * 5000, 16000), ("/in/y.flac", [0.25] * 100, 16000), ("/elsewhere/z.wav", [0.1] * 9000, 16000)],
        "path string, samples array<float>, sr int")
    tmap = spark.createDataFrame([("x", "Hello 2 you")], "key string, text string")
    m, e, s = process_clips(clips, "/in", "/out", "en", tmap)
    rows = m.collect()
    assert [(r.id, r.wav_path, r.duration_sec, r.transcript, r.lang) for r in rows] == [
        ("x", "/out/a/x_proc.wav", 0.313, "hello two you", "en")]
    assert sorted((r.input_path, r.error) for r in e.collect()) == [
        ("/elsewhere/z.wav", "outside input_dir"), ("/in/y.flac", "too_short")]
    assert max(s.first().s) == pytest.approx(1.0, abs=1e-7)


def test_routing_does_not_repeat_the_signal_work(spark):
    """Good and error rows are told apart after the waveforms are gone: no filter holds their expressions."""
    clips = spark.createDataFrame([("/in/a/x.wav", [0.5] * 5000, 16000)], "path string, samples array<float>, sr int")
    for table in process_clips(clips, "/in", "/out", "en", trim=True):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        filters = [line for line in plan.split("\n") if "Filter" in line.split("(")[0].split()]
        assert filters and not any("lambda" in line for line in filters)


def test_write_manifest_skips_empty(spark):
    out = tempfile.mkdtemp(prefix="dhvani-man-")
    empty = spark.createDataFrame([], "id string, wav_path string, duration_sec double, transcript string, lang string")
    errs = spark.createDataFrame([("p", "too_short")], "input_path string, error string")
    assert write_manifest(empty, errs, out) is False
    assert not os.path.exists(os.path.join(out, "manifest")) and os.path.exists(os.path.join(out, "errors"))


def test_write_run_is_one_pass(spark):
    """Both outputs and their counts come from one evaluation of the clips."""
    clips = spark.createDataFrame([
        ("/in/a/x.wav", [0.5] * 5000, 16000), ("/in/y.flac", [0.25] * 100, 16000), ("/elsewhere/z.wav", [0.1] * 9000, 16000)],
        "path string, samples array<float>, sr int")
    seen = spark.sparkContext.accumulator(0)

    def watched(frames):
        for f in frames:
            seen.add(len(f))
            yield f
    tmap = spark.createDataFrame([("x", "Hello 2 you")], "key string, text string")
    out = tempfile.mkdtemp(prefix="dhvani-run-")
    assert write_run(clip_rows(clips.mapInPandas(watched, clips.schema), "/in", "/out", "en", tmap), out) == (1, 2)
    assert seen.value == 3
    back = {(r.kind, r.input_path, r.error, r.transcript if r.kind == "manifest" else None) for r in spark.read.parquet(out).collect()}
    assert back == {("manifest", "/in/a/x.wav", None, "hello two you"), ("errors", "/in/y.flac", "too_short", None),
                    ("errors", "/elsewhere/z.wav", "outside input_dir", None)}
    out = tempfile.mkdtemp(prefix="dhvani-run-")
    assert write_run(clip_rows(clips.where("path = '/in/y.flac'"), "/in", "/out"), out) == (0, 1)
    assert not os.path.exists(os.path.join(out, "kind=manifest"))


def test_evaluate_plan(spark):
    test = spark.createDataFrame([(0, "/a/1.wav", "The cat"), (1, "rel/2.wav", " dog "), (2, "/a/3.wav", "  ")],
                                 "row_id long, wav_path string, transcript string")
    hyps = spark.createDataFrame([("/a/1.wav", "the bat"), ("/csv/2.wav", "dog")], "audio string, hyp string")
    inv = spark.createDataFrame([("/a/1.wav",), ("/csv/2.wav",)], "path string")
    p = eval_pairs(test, hyps, "/csv/test.csv", inv)
    assert sorted((r.row_id, r.ref, r.hyp) for r in p.collect()) == [(0, "The cat", "the bat"), (1, "dog", "dog")]
    r = evaluate(p).first()
    assert r.wer == pytest.approx(1 / 3) and r.cer == pytest.approx(1 / 10)
    assert r.accuracy == pytest.approx(9 / 10)


def test_parallel_corpus_written(spark):
    hi = spark.createDataFrame([(f"hi/{i}.wav", f"h{i}") for i in range(300)], "wav_path string, text string")
    en = spark.createDataFrame([(f"en/{i}.wav", f"e{i}") for i in range(0, 300, 2)], "file string, transcript string")
    s = build_parallel(hi, en)
    out = tempfile.mkdtemp(prefix="dhvani-par-")
    write_parallel(s, out)
    back = spark.read.parquet(out)
    c = {r.split: r["count"] for r in back.groupBy("split").count().collect()}
    assert c == {"val": 100, "test": 50} and set(back.columns) == {"src", "tgt", "basename", "split"}
    assert back.filter(F.col("src").substr(2, 10) != F.col("tgt").substr(2, 10)).count() == 0


def test_rows_without_a_partner(spark):
    from dhvani.operators.align import align_report, without_partner
    hi = spark.createDataFrame([("a.wav", "h1"), ("a.wav", "h2"), ("b.wav", "h3"), ("c.wav", None), ("d.wav", "h4")], "file string, text string")
    en = spark.createDataFrame([("x/a.wav", "e1"), ("d.wav", "e2"), ("e.wav", "e3"), ("c.wav", "e4")], "file string, text string")
    rest = {(r.basename, r.side) for r in without_partner(hi, en).collect()}
    assert rest == {("a", "hi"), ("b", "hi"), ("e", "en"), ("c", "en")}
    assert {tuple(r) for r in align_report(hi, en).collect()} == {("hi", 4, 2), ("en", 4, 2)}
