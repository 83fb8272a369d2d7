"""Parallel-corpus alignment: column guessing, basename join, random-pairing
fallback, cleaning and seq2seq example building."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import path_stem
from ..functions.text import ustrip
from .rank import SEED, rank_within, seeded_rank

# Column names tried, in order.
FILE_COL_NAMES = ("wav_path", "file", "audio_path", "filename", "path", "wav")
TEXT_COL_NAMES = ("text", "asr_text", "transcript", "transcription", "sentence")
# Task prefixes of the two translation directions.
PROMPTS = {"hi-en": "translate Hindi to English: ", "en-hi": "translate English to Hindi: "}


def canonical_columns(df: DataFrame) -> DataFrame:
    """Column names stripped and lower-cased."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def guess_file_col(df: DataFrame) -> str:
    return next((c for c in FILE_COL_NAMES if c in df.columns), df.columns[0])


def guess_text_col(df: DataFrame) -> str:
    """A known name, else the first string column whose mean length (nulls
    read as 'nan') exceeds 5, else the second column (or the first).

    The fallback is one aggregate over all string columns: one small row
    comes back to the driver to choose a column at plan time."""
    for c in TEXT_COL_NAMES:
        if c in df.columns:
            return c
    str_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if str_cols:
        row = df.agg(*[F.avg(F.length(F.coalesce(F.col(c), F.lit("nan")))).alias(f"_{i}")
                       for i, c in enumerate(str_cols)]).first()
        for i, c in enumerate(str_cols):
            v = row[f"_{i}"]
            if v is not None and v > 5:
                return c
    return df.columns[1] if len(df.columns) > 1 else df.columns[0]


def keyed_side(df: DataFrame, text_name: str) -> DataFrame:
    """``(basename, <text_name>)`` from a side table with guessed columns."""
    df = canonical_columns(df)
    f, t = guess_file_col(df), guess_text_col(df)
    return df.select(path_stem(F.col(f).cast("string")).alias("basename"), F.col(t).cast("string").alias(text_name))


def basename_pairs(hi: DataFrame, en: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """``(pairs, rest)``: the equi-join on basename, rows with any null dropped (null
    stems never join), and the rows of repeated stems that found no partner.

    A stem that occurs more than once is paired by occurrence: the i-th row of the
    stem on one side (in the seeded order of its text) with the i-th on the other, so
    the output is linear in the input and no group emits all its pairs.  The rows of
    the longer side that are left are ``rest``: (basename, side, text), side 'hi' or
    'en'.  Nothing else of a matching stem is lost.  Stem counts (combined map-side)
    find the stems that match and repeat (one small job decides at plan time whether
    there are any); only their rows are ranked (:func:`rank_within`, skew-safe), all
    other rows join directly, each side shuffled once by basename."""
    hi, en = hi.dropna(), en.dropna()
    hc = hi.groupBy("basename").agg(F.count(F.lit(1)).alias("_nh"))
    ec = en.groupBy("basename").agg(F.count(F.lit(1)).alias("_ne"))
    multi = hc.join(ec, "basename").filter((F.col("_nh") > 1) | (F.col("_ne") > 1)).select("basename")
    rest_schema = "basename string, side string, text string"
    if multi.isEmpty():  # one job over the stem counts; the usual case needs no ranks
        return hi.join(en, "basename", "inner"), hi.sparkSession.createDataFrame([], rest_schema)
    plain = (hi.join(multi, "basename", "left_anti")
             .join(en.join(multi, "basename", "left_anti"), "basename", "inner"))
    h = rank_within(hi.join(multi, "basename", "left_semi"), ["basename"], ["hi_text"], seed, "_occ")
    e = rank_within(en.join(multi, "basename", "left_semi"), ["basename"], ["en_text"], seed, "_occ")
    both = h.join(e, ["basename", "_occ"], "full")
    occ = both.filter(F.col("hi_text").isNotNull() & F.col("en_text").isNotNull()).drop("_occ")
    rest = both.filter(F.col("hi_text").isNull() | F.col("en_text").isNull()).select(
        "basename", F.when(F.col("hi_text").isNull(), "en").otherwise("hi").alias("side"),
        F.coalesce("hi_text", "en_text").alias("text"))
    return plain.unionByName(occ), rest


def basename_join(hi: DataFrame, en: DataFrame, seed: int = SEED) -> DataFrame:
    """The pairs of :func:`basename_pairs`."""
    return basename_pairs(hi, en, seed)[0]


def random_pairing(hi: DataFrame, en: DataFrame, seed: int = SEED) -> DataFrame:
    """``min(n, m)`` rows drawn from each side without replacement in the
    seeded order, paired by position; basename = pair_<i>."""
    n = hi.select(F.count(F.lit(1))).scalar()
    m = en.select(F.count(F.lit(1))).scalar()
    k = F.least(n, m)
    h = seeded_rank(hi, hi.columns, seed, rank_col="_r").filter(F.col("_r") <= k)
    e = seeded_rank(en, en.columns, seed, rank_col="_r").filter(F.col("_r") <= k)
    pairs = h.select("_r", "hi_text").join(e.select("_r", "en_text"), "_r")
    return pairs.select(F.concat(F.lit("pair_"), (F.col("_r") - 1).cast("string")).alias("basename"),
                        "hi_text", "en_text")


def drop_blank(df: DataFrame, cols: Sequence[str] = ("hi_text", "en_text")) -> DataFrame:
    """Strip (Unicode whitespace) the text columns and keep rows where all are non-empty."""
    x = df
    for c in cols:
        x = x.withColumn(c, ustrip(F.col(c)))
    cond = None
    for c in cols:
        cc = F.coalesce(F.col(c) != "", F.lit(False))
        cond = cc if cond is None else cond & cc
    return x.filter(cond)


def align(hi_df: DataFrame, en_df: DataFrame, fallback: str = "random", seed: int = SEED) -> DataFrame:
    """Aligned, cleaned ``(basename, hi_text, en_text)`` pairs.

    With ``fallback='random'`` and no basename match, sides are paired at
    random (one job over the distinct stems decides)."""
    hi = keyed_side(hi_df, "hi_text")
    en = keyed_side(en_df, "en_text")
    if fallback == "random":
        # any stem with a non-null text on both sides?  decided on distinct
        # stems (combined map-side), not by running the text join
        stems_h = hi.dropna().select("basename").distinct()
        stems_e = en.dropna().select("basename").distinct()
        if stems_h.join(stems_e, "basename", "left_semi").isEmpty():
            return drop_blank(random_pairing(hi, en, seed).dropna())
    return drop_blank(basename_join(hi, en, seed))


def without_partner(hi_df: DataFrame, en_df: DataFrame, seed: int = SEED) -> DataFrame:
    """``(basename, side, text)``: the rows with a stem and a text that :func:`basename_join` pairs with nothing:
    stems that the other side lacks, and what is left of repeated ones.  Slim semi-joins on the stems."""
    hi, en = keyed_side(hi_df, "hi_text").dropna(), keyed_side(en_df, "en_text").dropna()
    rest = basename_pairs(hi, en, seed)[1]
    for x, other, side in ((hi, en, "hi"), (en, hi, "en")):
        alone = x.join(other.select("basename").distinct(), "basename", "left_anti")
        rest = rest.unionByName(alone.select("basename", F.lit(side).alias("side"), F.col(f"{side}_text").alias("text")))
    return rest


def align_report(hi_df: DataFrame, en_df: DataFrame, seed: int = SEED) -> DataFrame:
    """Per side: its rows with a stem and a text (``n_rows``), and those that found no partner (``n_rest``)."""
    rest = without_partner(hi_df, en_df, seed).groupBy("side").agg(F.count(F.lit(1)).alias("n_rest"))
    rows = [keyed_side(df, "text").dropna().agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(side).alias("side"), "n_rows")
            for df, side in ((hi_df, "hi"), (en_df, "en"))]
    return rows[0].unionByName(rows[1]).join(rest, "side", "left").select("side", "n_rows", F.coalesce("n_rest", F.lit(0)).cast("long").alias("n_rest"))


def seq2seq_examples(pairs: DataFrame, direction: str = "hi-en") -> DataFrame:
    """``(source, target)`` for a translation direction; null pairs dropped."""
    src, tgt = ("hi_text", "en_text") if direction == "hi-en" else ("en_text", "hi_text")
    x = pairs.dropna(subset=[src, tgt])
    return x.select(F.concat(F.lit(PROMPTS[direction]), F.col(src)).alias("source"), F.col(tgt).alias("target"))
