"""The driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Key used to spread a table whose scan yields fewer partitions than cores.
SPREAD_KEYS = {"documents": "doc_id", "embeddings": "vec_id", "conversations": "conv_id",
               "pages": "page_id", "labels": "doc_id", "benchmark": "item_id"}


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it.

    A table stored as one small file scans as a single task; then (and only
    then) it is hash-partitioned on its key over the cores so the per-row
    work downstream runs in parallel.  Large inputs already have many splits
    and are left alone."""
    if name not in TABLES:
        raise KeyError(name)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    key = SPREAD_KEYS.get(name)
    if spread and key:
        from ..operators.rank import num_partitions
        cores = spark.sparkContext.defaultParallelism
        if num_partitions(df, cores) < cores:
            df = df.repartition(cores, key)
    return df
