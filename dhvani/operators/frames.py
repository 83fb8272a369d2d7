"""Clip-level signal operators built on frame energies.

Silence split, its intervals and the percentile fallback work on per-row
arrays (a clip is one row), so they need no shuffle; intermediate arrays are
materialised as columns and reach lambdas only as zipped arrays (see
:mod:`dhvani.functions.signal`).  The spectral noise floor needs statistics
over frames stored as rows: it aggregates the first frames of each clip and
joins the (small) per-clip noise profile back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.signal import AMIN, HOP, WIN, as_double, centered_energies, frame_energies, with_each


def _db(c):
    return F.lit(10.0) * F.log10(F.greatest(F.lit(AMIN), c))


def _runs(mask: str):
    """(starts, ends) frame indices of the runs of true values in ``mask``."""
    m = F.size(mask)
    prev = F.concat(F.array(F.lit(False)), F.slice(mask, 1, F.greatest(m - 1, F.lit(0))))
    nxt = F.concat(F.slice(mask, 2, F.greatest(m - 1, F.lit(0))), F.array(F.lit(False)))
    z = F.arrays_zip(F.sequence(F.lit(0), m - 1).alias("k"), F.col(mask).alias("c"), prev.alias("p"), nxt.alias("q"))
    starts = F.transform(F.filter(z, lambda t: t["c"] & ~t["p"]), lambda t: t["k"])
    ends = F.transform(F.filter(z, lambda t: t["c"] & ~t["q"]), lambda t: t["k"])
    return starts, ends


def with_silence_intervals(df: DataFrame, samples: str = "samples", out: str = "intervals",
                           top_db: float = 30.0, win: int = WIN, hop: int = HOP) -> DataFrame:
    """Add ``out ARRAY<STRUCT<start, end>>``: the non-silent intervals in
    samples.  A centred frame is non-silent when its level is above
    ``-top_db`` dB relative to the clip's loudest frame; a run of non-silent
    frames first..last covers [first*hop, min((last+1)*hop, n))."""
    x = df.withColumn("_e", centered_energies(F.col(samples), win, hop))
    x = x.withColumn("_keep", with_each(F.col("_e"), _db(F.array_max("_e")),
                                        lambda v, r: (_db(v) - r) > -top_db))
    starts, ends = _runs("_keep")
    x = x.withColumn("_se", F.arrays_zip(starts.alias("a"), ends.alias("b")))
    iv = with_each(F.col("_se"), F.size(samples), lambda t, n: F.struct(
        (t["a"] * hop).alias("start"), F.least((t["b"] + 1) * hop, n).alias("end")))
    return x.withColumn(out, iv).drop("_e", "_keep", "_se")


def trim_silence(df: DataFrame, samples: str = "samples", out: str = "trimmed",
                 top_db: float = 30.0, win: int = WIN, hop: int = HOP) -> DataFrame:
    """Add ``out``: the non-silent intervals concatenated; the clip unchanged
    when there is none."""
    x = with_silence_intervals(df, samples, "_iv", top_db, win, hop)
    parts = F.flatten(F.transform("_iv", lambda z: F.slice(samples, z["start"] + 1, z["end"] - z["start"])))
    return x.withColumn(out, F.when(F.size("_iv") > 0, parts).otherwise(F.col(samples))).drop("_iv")


def trim_percentile(df: DataFrame, samples: str = "samples", out: str = "trimmed", q: float = 0.10,
                    win: int = WIN, hop: int = HOP) -> DataFrame:
    """Fallback trim: keep frames (starting at 0, hop, ...) whose energy
    exceeds the clip's ``q`` percentile (linear interpolation); kept frames are
    concatenated whole, so overlapping samples repeat; none kept -> unchanged."""
    x = df.withColumn("_e", frame_energies(F.col(samples), win, hop))
    srt = F.array_sort("_e")
    m = F.size("_e")
    pos = F.lit(q) * (m - 1)
    lo = F.floor(pos).cast("int")
    a, b = F.element_at(srt, lo + 1), F.element_at(srt, F.least(lo + 2, m))
    x = x.withColumn("_th", F.when(m > 0, a + (b - a) * (pos - lo)))
    x = x.withColumn("_mask", with_each(F.col("_e"), F.col("_th"), lambda v, t: v > t))
    z = F.arrays_zip(F.sequence(F.lit(0), m - 1).alias("k"), F.col("_mask").alias("c"))
    x = x.withColumn("_kept", F.transform(F.filter(z, lambda t: t["c"]), lambda t: t["k"]))
    parts = F.flatten(F.transform("_kept", lambda k: F.slice(samples, k * hop + 1,
                                                              F.least(F.size(samples) - k * hop, F.lit(win)))))
    return (x.withColumn(out, F.when(F.size("_kept") > 0, parts).otherwise(F.col(samples)))
            .drop("_e", "_th", "_mask", "_kept"))


def noise_frames(sr: int = 16000, win: int = WIN, hop: int = HOP) -> int:
    """Frames in the leading half second used as the noise profile."""
    return max(1, int((0.5 * sr - win) // hop))


def noise_floor_subtract(frames: DataFrame, k: int, prop: float = 0.8, clip: str = "clip_id",
                         frame: str = "frame_no", mag: str = "mag") -> DataFrame:
    """``mag`` minus ``prop`` x the per-(clip, bin) median over the clip's
    first ``k`` frames, floored at 0.

    Only the first ``k`` frames of each clip are exploded and aggregated
    (bounded groups of k values); the per-clip profile (one row per clip) is
    joined back on the clip id (broadcast by AQE when small)."""
    head = frames.filter(F.col(frame) < k).select(clip, F.posexplode(mag).alias("bin", "v"))
    med = head.groupBy(clip, "bin").agg(F.median(F.col("v").cast("double")).alias("med"))
    prof = med.groupBy(clip).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "med"))),
                                             lambda t: t["med"]).alias("_noise"))
    out = frames.join(prof, clip, "left")
    den = F.zip_with(as_double(F.col(mag)), F.col("_noise"),
                     lambda m, nz: F.greatest(m - F.lit(prop) * F.coalesce(nz, F.lit(0.0)), F.lit(0.0)))
    return out.withColumn(mag, den).drop("_noise")
