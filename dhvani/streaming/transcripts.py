"""Transcript files arriving over time, processed incrementally.

The reference processes a folder once; here new transcript files in a folder
are picked up as they land.  Per-line parsing and normalisation are stateless
expressions, so they run unchanged on the stream, which appends the entries to a
Parquet table (exactly once, by the file sink's log).  "Later entries win" is decided
when the table is read: ``max_by`` over the arrival order (file modification time,
file path, line number), combined map-side.  No entry passes through the driver.
Files of numbered lines are read line by line, so no file is one row or one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_by_lang
from ..session import scratch_path
from ..sources.transcripts import last_wins, parse_transcript_lines


def line_stream(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None, numbered: bool = False) -> DataFrame:
    """New text files in ``folder`` -> ``(src_path, line_ord, line)``.

    Each arriving file is read whole and split into numbered lines (row ids
    are not available on streams); a transcript file is one unit of work and
    many files spread over many tasks.

    ``numbered``: each line begins with its number in the folder and a tab.  The numbers
    are the arrival order, and files of any size are split into lines by many tasks."""
    r = spark.readStream.format("text")
    r = r.option("lineSep", "\n") if numbered else r.option("wholetext", "true")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    df = r.load(folder)
    if numbered:
        order = F.struct(F.substring_index("value", "\t", 1).cast("long").alias("i"))
        line = F.substr("value", F.instr("value", "\t") + F.lit(1))
        return df.select(F.col("_metadata.file_path").alias("src_path"), order.alias("line_ord"), F.regexp_replace(line, "\ufffd", "").alias("line"))
    x = df.select(F.col("_metadata.file_path").alias("src_path"),
                  F.col("_metadata.file_modification_time").alias("t"),
                  F.posexplode(F.split(F.col("value"), "\n")).alias("pos", "line"))
    order = F.struct(F.col("t"), F.col("src_path").alias("f"), F.col("pos").cast("long").alias("i"))
    return x.select("src_path", order.alias("line_ord"), F.regexp_replace("line", "\ufffd", "").alias("line"))


def normalized_entries(lines: DataFrame, lang: Column | str = "en") -> DataFrame:
    """Stateless: parsed ``(key, text, line_ord)`` with ``text`` normalised."""
    p = parse_transcript_lines(lines)
    return p.withColumn("text", normalize_by_lang(F.col("text"), lang))


def start_transcript_ingest(spark: SparkSession, folder: str, table: str, lang: str = "en",
                            checkpoint: str | None = None, trigger_once: bool = False, numbered: bool = False):
    """Append the entries of new files to the Parquet table at path ``table``; returns
    the ``StreamingQuery``."""
    entries = normalized_entries(line_stream(spark, folder, numbered=numbered), lang)
    w = (entries.writeStream.outputMode("append").format("parquet").option("path", table)
         .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-log")))
    return (w.trigger(availableNow=True) if trigger_once else w).start()


def latest_transcripts(spark: SparkSession, table: str) -> DataFrame:
    """One row per key: its latest entry among all that the stream has appended."""
    return last_wins(spark.read.parquet(table))
