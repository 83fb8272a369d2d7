"""A training corpus from ``documents``: five stages, each on what the last one kept.

toxic documents go; one document of each near-duplicate group stays; passages that
another document has already are cut; documents with passages of the benchmark go;
the rest is encoded.  Every stage is written as Parquet in the shared folder and
read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dhvani.llm import bpe, decontam, jaccard, substring, toxicity
from dhvani.session import scratch_path

STAGES = [
    ("toxicity", toxicity.stage),
    ("ngram_jaccard_join", jaccard.stage),
    ("substring_dedup", substring.stage),
    ("benchmark_decontamination", decontam.stage),
    ("bpe", bpe.stage),
]

#: SQL can express neither the trained stage nor the byte-pair merges; tests/llm
#: compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
