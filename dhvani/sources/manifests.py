"""Manifest files: read (CSV with header, explicit schema when known) and
write (Parquet, or CSV that round-trips quoted multi-line text), split
outputs partitioned by ``split``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .transcripts import CSV_OPTS, read_csv

MANIFEST_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("wav_path", T.StringType()),
    T.StructField("duration_sec", T.DoubleType()), T.StructField("transcript", T.StringType()),
    T.StructField("lang", T.StringType())])


def read_manifest(spark: SparkSession, path: str, schema: T.StructType | None = MANIFEST_SCHEMA, order: bool = False) -> DataFrame:
    """Manifest CSV with a header.  With ``schema=None`` column types are
    inferred (one extra pass), for manifests whose columns vary; with ``order`` the
    column ``line_ord`` gives the place of each row."""
    return read_csv(spark, path, schema, order, infer=schema is None)


def write_manifest_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.options(**CSV_OPTS).csv(path)
    else:
        w.parquet(path)


def write_splits(df: DataFrame, path: str, fmt: str = "parquet", split_col: str = "split") -> None:
    """One folder per split (``split=train`` ...); reading one split back
    prunes the others."""
    w = df.write.mode("overwrite").partitionBy(split_col)
    if fmt == "csv":
        w.options(**CSV_OPTS).csv(path)
    else:
        w.parquet(path)
