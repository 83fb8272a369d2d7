"""Signal edge rows from FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from dhvani.functions import signal as SG
from dhvani.operators import frames as FR


def clip(spark, samples):
    return spark.createDataFrame([(1, [float(x) for x in samples])], "clip_id long, samples array<float>")


def test_too_short(spark):
    df = spark.createDataFrame([(1, [0.0] * 4799), (2, [0.0] * 4800)], "clip_id long, samples array<float>")
    out = [r.t for r in df.orderBy("clip_id").select(SG.too_short(F.col("samples"), 16000).alias("t")).collect()]
    assert out == [True, False]


def test_trim_all_zero_clip_whole(spark):
    df = FR.trim_silence(clip(spark, [0.0] * 1000), "samples", "t")
    assert len(df.first().t) == 1000


def test_trim_silence_cuts_quiet_edges(spark):
    loud = [0.5, -0.5] * 400
    df = FR.trim_silence(clip(spark, [0.0] * 800 + loud + [0.0] * 800), "samples", "t")
    t = df.first().t
    assert 800 <= len(t) < 2400 and max(abs(x) for x in t) == pytest.approx(0.5)


def test_peak_normalize(spark):
    r = clip(spark, [0.5, -2.0]).select(SG.peak_normalize(F.col("samples")).alias("n")).first().n
    assert r == pytest.approx([0.25, -1.0], abs=1e-8)


def test_pad_cut(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1.0] * 7,)], "s array<float>")
    out = [r.p for r in df.select(SG.pad_cut(F.col("s"), 5).alias("p")).collect()]
    assert out == [[1.0, 2.0, 3.0, 0.0, 0.0], [1.0] * 5]


def test_noise_floor(spark):
    frames = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [3.0]), (1, 2, [10.0])],
                                   "clip_id long, frame_no int, mag array<float>")
    out = {r.frame_no: r.mag[0] for r in FR.noise_floor_subtract(frames, 2, 0.8).collect()}
    assert out == pytest.approx({0: 0.0, 1: 1.4, 2: 8.4})


def test_pcm16_and_mono(spark):
    r = clip(spark, [1.5, -1.0, 0.5]).select(SG.pcm16(F.col("samples")).alias("q")).first().q
    assert r == [32767, -32767, 16384]
    ch = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],)], "c array<array<float>>")
    assert ch.select(SG.mono_mix(F.col("c")).alias("m")).first().m == [2.0, 3.0]


def test_trim_percentile_keeps_overlap(spark):
    s = [0.0] * 16 + [1.0] * 16
    t = FR.trim_percentile(clip(spark, s), "samples", "t", 0.1, 16, 8).first().t
    # frames start at 0, 8, 16, 24; the quietest (frame 0) is dropped, kept frames repeat overlaps
    assert len(t) == 16 + 16 + 8
