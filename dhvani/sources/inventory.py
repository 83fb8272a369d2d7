"""Audio file inventory: a recursive listing of audio files, contents unread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import path_stem

# The audio extensions the inventory lists (lower case only).
AUDIO_EXTS = ("wav", "flac", "mp3", "m4a", "aac", "ogg")


def audio_inventory(spark: SparkSession, root: str) -> DataFrame:
    """``(path, stem, ext, length)`` for every audio file under ``root``.

    ``binaryFile`` with only metadata columns selected: Spark lists files in
    parallel and never reads their contents."""
    df = (spark.read.format("binaryFile")
          .option("recursiveFileLookup", "true")
          .option("pathGlobFilter", "*.{" + ",".join(AUDIO_EXTS) + "}")
          .load(root))
    p = F.col("path")
    return df.select(p.alias("path"), path_stem(p).alias("stem"),
                     F.regexp_extract(p, r"\.([^./]+)$", 1).alias("ext"), F.col("length"))
