"""Manifest operators: filter, language fill, combine (union + keep-first
dedupe), counters and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_DUR = 0.5
MAX_DUR = 20.0


def duration_filter(df: DataFrame, min_dur: float = MIN_DUR, max_dur: float = MAX_DUR) -> DataFrame:
    """Keep ``min_dur <= duration_sec <= max_dur``; NaN and null are dropped.
    Without a ``duration_sec`` column the input is returned unchanged."""
    if "duration_sec" not in df.columns:
        return df
    d = F.col("duration_sec")
    return df.filter(d.between(F.lit(float(min_dur)), F.lit(float(max_dur))) & ~F.isnan(d))


def add_lang(df: DataFrame, lang: str | None) -> DataFrame:
    """Add a constant ``lang`` column only when it is requested and absent."""
    if lang and "lang" not in df.columns:
        return df.withColumn("lang", F.lit(lang))
    return df


def lang_from_path(path: str) -> str | None:
    """Language implied by an input path: 'hindi' or 'hi' -> hi, else
    'english' or 'en' -> en, else None (substring test on the lower-cased path)."""
    p = path.lower()
    if "hindi" in p or "hi" in p:
        return "hi"
    if "english" in p or "en" in p:
        return "en"
    return None


def lang_from_path_col(path: Column) -> Column:
    """Column form of :func:`lang_from_path` for per-row source paths."""
    p = F.lower(path)
    return (F.when(p.contains("hindi") | p.contains("hi"), F.lit("hi"))
            .when(p.contains("english") | p.contains("en"), F.lit("en")))


def fill_lang(df: DataFrame, path: str, lang: str | None = None) -> DataFrame:
    """``lang`` for a combine input: kept when present, else ``lang`` or the
    language implied by ``path``."""
    if "lang" in df.columns:
        return df
    value = lang if lang is not None else lang_from_path(path)
    return df.withColumn("lang", F.lit(value).cast("string"))


def union_inputs(inputs: Sequence[tuple[DataFrame, str, Column]]) -> DataFrame:
    """Outer union by name of ``(df, path, row_order)`` inputs.

    Adds ``src_ord`` (input position) and ``row_ord`` (row position within the
    input: a number, or the struct that ``sources.transcripts.read_csv`` gives
    the rows of a file scan, the same kind for all inputs) so later steps can
    honour input order.  Missing columns are null.
    """
    out = None
    for i, (df, path, order) in enumerate(inputs):
        x = fill_lang(df, path).withColumn("src_ord", F.lit(i)).withColumn("row_ord", order)
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out


def keep_first(df: DataFrame, key: str, order: Sequence[str] = ("src_ord", "row_ord")) -> DataFrame:
    """First row per ``key`` in ``order`` (nulls form one key); ``order`` tells rows apart.

    The winner of each key is found on slim rows (key and order), combined map-side,
    so a key holding a third of all rows costs one row per map task; a left-semi join
    then picks the winners' rows.  Columns that nobody uses later are never read.
    """
    first = df.groupBy(F.col(key).alias("_k")).agg(F.min(F.struct(*[F.col(c) for c in order])).alias("_o"))
    first = first.select("_k", *[F.col("_o")[c].alias(f"_o_{c}") for c in order])
    same = df[key].eqNullSafe(first["_k"])
    for c in order:
        same = same & df[c].eqNullSafe(first[f"_o_{c}"])
    return df.join(first, same, "left_semi")


def combine(inputs: Sequence[tuple[DataFrame, str, Column]], key: str = "wav_path") -> DataFrame:
    """Union the inputs and keep the first row per ``wav_path``."""
    return keep_first(union_inputs(inputs), key)


def load_report(union: DataFrame) -> DataFrame:
    """Per input, before the dedupe: its rows as loaded and the language of its first row."""
    return (union.groupBy("src_ord")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.min_by(F.struct("lang"), "row_ord")["lang"].alias("src_lang"))
            .select("src_ord", "src_lang", "n_rows"))


def combine_summary(union: DataFrame, key: str = "wav_path") -> DataFrame:
    """The load report of each input, with the rows and the sorted distinct languages
    of the combined (deduplicated) table."""
    kept = keep_first(union.select(key, "lang", "src_ord", "row_ord"), key)
    total = kept.agg(F.struct(F.count(F.lit(1)).alias("n"),
                              F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs")).alias("s")).scalar()
    return load_report(union).select("src_ord", "src_lang", "n_rows", total["n"].alias("total_rows"),
                                     total["langs"].alias("languages"))


def stage_counts(df: DataFrame, min_dur: float = MIN_DUR, max_dur: float = MAX_DUR) -> DataFrame:
    """All stage counters of a manifest in one aggregate (one pass)."""
    d = F.col("duration_sec")
    in_range = d.between(F.lit(min_dur), F.lit(max_dur)) & ~F.isnan(d)
    has_text = F.coalesce(F.regexp_replace("transcript", r"(?U)^\s+|\s+$", "") != "", F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("n_loaded"),
        F.count_if(F.coalesce(in_range, F.lit(False))).alias("n_in_range"),
        F.count_if(has_text).alias("n_with_text"),
        F.count_if(F.coalesce(in_range, F.lit(False)) & has_text).alias("n_usable"),
    )


def duration_stats(df: DataFrame, by: str = "lang") -> DataFrame:
    """count / mean / sample std / min / quartiles / max of ``duration_sec`` per group.

    Quartiles are exact with linear interpolation, computed without gathering
    a group's values in one task (:mod:`dhvani.operators.quantile`)."""
    from .quantile import exact_quantiles
    d = F.col("duration_sec")
    base = df.groupBy(by).agg(
        F.count(d).alias("n"), F.avg(d).alias("mean_sec"), F.stddev_samp(d).alias("std_sec"),
        F.min(d).alias("min_sec"), F.max(d).alias("max_sec"))
    q = exact_quantiles(df, "duration_sec", (0.25, 0.5, 0.75), by=[by])
    return (base.join(q, by, "left")
            .select(by, "n", "mean_sec", "std_sec", "min_sec",
                    F.col("quantiles")[0].alias("p25_sec"), F.col("quantiles")[1].alias("p50_sec"),
                    F.col("quantiles")[2].alias("p75_sec"), "max_sec"))


def duration_histogram(df: DataFrame, width: float = 1.0, by: str = "lang") -> DataFrame:
    """Counts of ``duration_sec`` in fixed-width bins per group."""
    lo = (F.floor(F.col("duration_sec") / F.lit(width)) * F.lit(width)).cast("double")
    return (df.filter(F.col("duration_sec").isNotNull() & ~F.isnan("duration_sec"))
            .groupBy(by, lo.alias("bin_lo")).agg(F.count(F.lit(1)).alias("n")))


def split_summary(df: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows, hours and mean clip length per split (null mean without durations)."""
    if "duration_sec" in df.columns:
        hours = (F.sum("duration_sec") / F.lit(3600.0))
        mean = F.avg("duration_sec")
    else:
        hours, mean = F.lit(0.0), F.lit(None).cast("double")
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n_samples"),
                                     hours.alias("hours"), mean.alias("avg_sec"))
