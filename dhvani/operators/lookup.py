"""Lookups: transcript attachment, existence semi-join, good/error routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import normalize_by_lang


def attach_transcript(clips: DataFrame, tmap: DataFrame | None, sidecars: DataFrame | None = None,
                      lang: Column | str = "en", stem: str = "stem", clip_base: str = "clip_base") -> DataFrame:
    """Add ``transcript``: the map entry for the clip's stem, else its sidecar
    text, else ''; the chosen text is normalised by language.

    ``tmap`` must be one row per key (see ``last_wins``), so the left join
    cannot multiply clips; Spark picks broadcast or sort-merge at run time."""
    x = clips
    if tmap is not None:
        x = x.join(tmap.select(F.col("key").alias(stem), F.col("text").alias("_map_text")), stem, "left")
    else:
        x = x.withColumn("_map_text", F.lit(None).cast("string"))
    if sidecars is not None:
        x = x.join(sidecars.select(F.col("clip_base").alias(clip_base), F.col("text").alias("_side_text")),
                   clip_base, "left")
    else:
        x = x.withColumn("_side_text", F.lit(None).cast("string"))
    chosen = F.coalesce(F.col("_map_text"), F.col("_side_text"), F.lit(""))
    return x.withColumn("transcript", normalize_by_lang(chosen, lang)).drop("_map_text", "_side_text")


def semi_existing(df: DataFrame, inventory: DataFrame, path_col: str = "file",
                  inv_path: str = "path") -> DataFrame:
    """Rows whose ``path_col`` is in the inventory (left semi join; no per-row stat)."""
    inv = inventory.select(F.col(inv_path).alias("_p"))
    return df.join(inv, df[path_col] == inv["_p"], "left_semi")


def route(df: DataFrame, error: Column):
    """(good rows, error rows) as two tables of one tagged plan: each evaluates ``df`` when it
    is used.  ``write_routed`` writes both in one pass."""
    tagged = df.withColumn("error", error)
    good = tagged.filter(F.col("error").isNull()).drop("error")
    bad = tagged.filter(F.col("error").isNotNull())
    return good, bad


def write_routed(df: DataFrame, error: Column, out: str, good: str = "manifest", bad: str = "errors") -> tuple[int, int]:
    """Write good and error rows in one job, to ``out/kind=manifest`` and ``out/kind=errors``
    (a kind without rows has no folder); returns how many there are of each, counted on the way."""
    seen = Observation()
    x = df.withColumn("error", error)
    is_bad = F.col("error").isNotNull()
    x = x.observe(seen, F.count_if(~is_bad).alias("good"), F.count_if(is_bad).alias("bad"))
    x.withColumn("kind", F.when(is_bad, bad).otherwise(good)).write.mode("overwrite").partitionBy("kind").parquet(out)
    return seen.get["good"], seen.get["bad"]


def error_sample(errors: DataFrame, n: int = 5, order: str = "input_path") -> DataFrame:
    """The first ``n`` error rows in an explicit order (a top-k, no full sort)."""
    return errors.orderBy(order).limit(n)
