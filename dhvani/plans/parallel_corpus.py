"""Parallel corpus: two transcript tables -> aligned pairs -> seeded
train/val/test slices, written partitioned by split with columns
``(src, tgt, basename)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.align import align
from ..operators.rank import SEED
from ..operators.split import parallel_split


def build_parallel(hi: DataFrame, en: DataFrame, fallback: str = "random", seed: int = SEED) -> DataFrame:
    pairs = align(hi, en, fallback, seed)
    s = parallel_split(pairs, seed)
    return s.select(F.col("hi_text").alias("src"), F.col("en_text").alias("tgt"), "basename", "split")


def write_parallel(splits: DataFrame, out: str, fmt: str = "parquet") -> None:
    w = splits.write.mode("overwrite").partitionBy("split")
    if fmt == "csv":
        from ..sources.transcripts import CSV_OPTS
        w.options(**CSV_OPTS).csv(out)
    else:
        w.parquet(out)
