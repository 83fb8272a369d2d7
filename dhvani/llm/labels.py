"""Bounded training sets from ``labels``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(key, mod: int):
    """crc32 of the id as text, modulo ``mod`` (null id: null)."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(mod))


def training_rows(labels: DataFrame, target: str, keep, rows: int) -> dict[int, int]:
    """{doc_id: label} of at most ``rows`` labelled rows that pass ``keep`` (a
    condition over doc_id), drawn by a hash of the id, so the draw doesn't
    depend on the layout of the table.  Rows without an id or label don't
    count; of several labels of an id the largest does."""
    df = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
    df = df.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & keep)
    df = df.groupBy("doc_id").agg(F.max("y").alias("y"))
    got = df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    return {r["doc_id"]: int(r["y"] > 0) for r in got}


def only(docs: DataFrame, ids: dict[int, int]) -> DataFrame:
    """(doc_id, text, y) of the documents in ``ids``; the map is broadcast and
    bounded by the ``rows`` of :func:`training_rows`."""
    spark = docs.sparkSession
    small = spark.createDataFrame(sorted(ids.items()) or [(0, 0)], "doc_id long, y int")
    if not ids:
        small = small.limit(0)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.join(F.broadcast(small), "doc_id")
