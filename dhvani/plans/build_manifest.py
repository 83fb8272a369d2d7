"""Build a clip manifest (the preprocessing run) as one Spark job.

clips ``(path, samples, sr)`` and an optional transcript map / sidecar table
-> per clip: mono mixdown where samples have channels, peak-normalise,
optional silence trim + renormalise, too-short check, output path,
transcript lookup + normalisation by language -> manifest rows
``(id, wav_path, duration_sec, transcript, lang)`` and error rows
``(input_path, error)`` from one tagged pass.

Threads of the reference become tasks; its transcript dict becomes a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths as P
from ..functions import signal as SG
from ..operators import frames as FR
from ..operators.lookup import attach_transcript, route, write_routed
from ..session import settled


def _processed(clips: DataFrame, input_dir: str, out_dir: str, trim: bool, top_db: float, win: int, hop: int) -> DataFrame:
    """Clips with the processed samples ``s``, the output path and the reason of rejection ``error``."""
    x = clips.withColumn("stem", P.path_stem(F.col("path")))
    x = x.withColumn("clip_base", F.regexp_replace("path", r"\.[^./]+$", ""))
    kind = clips.schema["samples"].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):  # [channel][sample]
        x = x.withColumn("samples", SG.mono_mix(F.col("samples")))
    x = x.withColumn("s", SG.peak_normalize(F.col("samples")))
    if trim:
        x = FR.trim_silence(x, "s", "s2", top_db, win, hop).withColumn("s", SG.peak_normalize(F.col("s2"))).drop("s2")
    x = x.withColumn("wav_path", P.proc_path(F.col("path"), input_dir, out_dir))
    return x.withColumn("error", F.when(F.col("samples").isNull(), F.lit("no samples"))
                        .when(F.col("wav_path").isNull(), F.lit("outside input_dir"))
                        .when(SG.too_short(F.col("s"), F.col("sr")), F.lit("too_short")))


def _slim(x: DataFrame) -> DataFrame:
    """What the rest needs of a clip, without its waveform: no array is ever joined."""
    return settled(x.select("path", "stem", "clip_base", "wav_path", SG.duration(F.col("s"), F.col("sr")).alias("duration_sec"), "error"))


def clip_rows(clips: DataFrame, input_dir: str, out_dir: str, lang: str = "en",
              tmap: DataFrame | None = None, sidecars: DataFrame | None = None,
              trim: bool = False, top_db: float = 30.0, win: int = SG.WIN, hop: int = SG.HOP) -> DataFrame:
    """All clips in one table: the manifest's columns, ``input_path`` and ``error`` (null: good)."""
    x = attach_transcript(_slim(_processed(clips, input_dir, out_dir, trim, top_db, win, hop)), tmap, sidecars, lang)
    return x.select(F.col("stem").alias("id"), "wav_path", "duration_sec", "transcript", F.lit(lang).alias("lang"),
                    F.col("path").alias("input_path"), "error")


def write_run(rows: DataFrame, out: str) -> tuple[int, int]:
    """Write the ``clip_rows`` in one pass (the signal work runs once); returns the numbers of manifest and
    error rows.  Without good rows no manifest is written, as in the reference."""
    return write_routed(rows, F.col("error"), out)


def process_clips(clips: DataFrame, input_dir: str, out_dir: str, lang: str = "en",
                  tmap: DataFrame | None = None, sidecars: DataFrame | None = None,
                  trim: bool = False, top_db: float = 30.0, win: int = SG.WIN, hop: int = SG.HOP):
    """Returns ``(manifest, errors, samples)``: manifest and error rows, and the
    processed samples keyed by ``wav_path`` (the caller writes them)."""
    x = _processed(clips, input_dir, out_dir, trim, top_db, win, hop)
    good, bad = route(_slim(x), F.col("error"))
    manifest = attach_transcript(good, tmap, sidecars, lang).select(
        F.col("stem").alias("id"), "wav_path", "duration_sec", "transcript", F.lit(lang).alias("lang"))
    errors = bad.select(F.col("path").alias("input_path"), "error")
    samples = settled(x.select("wav_path", "s", "sr", "error")).filter(F.col("error").isNull()).drop("error")
    return manifest, errors, samples


def write_manifest(manifest: DataFrame, errors: DataFrame, out: str) -> bool:
    """Write the manifest (only when it has rows, as the reference does) and
    the errors; returns whether a manifest was written."""
    wrote = not manifest.isEmpty()
    if wrote:
        manifest.write.mode("overwrite").parquet(f"{out}/manifest")
    errors.write.mode("overwrite").parquet(f"{out}/errors")
    return wrote
