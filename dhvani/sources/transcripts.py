"""Transcript sources: line scans with a stable order key, and parsers.

Every scan is split in two: ``read_*`` turns files into a lines table
``(src_path, line_ord, line)`` and ``parse_*`` turns lines into
``(key, text, line_ord)``.  The parsers are pure column expressions, so they
run on any lines table (files, or lines Spark derives from other tables).

``line_ord`` orders lines as the files list them: (file path, split offset,
position within the split).  The position is ``monotonically_increasing_id``
taken directly at the scan, where a retried task re-reads the same split in
the same order and therefore yields the same values.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain, islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import path_stem
from ..functions.text import ustrip
from ..session import scratch_path, settings
from .csv_records import fields, first_header, parsed, read_quoted_csv, read_records, unclosed
from .listing import batches, files_below

WS_SPLIT = r"(?U)\s+"


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Text files -> ``(src_path, line_ord STRUCT, line)``.  Undecodable bytes
    (read as U+FFFD) are dropped."""
    df = spark.read.text(paths if isinstance(paths, str) else list(paths))
    return df.select(
        F.col("_metadata.file_path").alias("src_path"),
        F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                 F.monotonically_increasing_id().alias("i")).alias("line_ord"),
        F.regexp_replace(F.col("value"), "�", "").alias("line"))


def parse_transcript_lines(lines: DataFrame, line: str = "line", order: str = "line_ord") -> DataFrame:
    """Generic transcript lines -> ``(key, text, line_ord)``.

    Per stripped, non-blank line, first rule that applies:
    ``key|text`` (key stripped, not stemmed) · ``path<TAB>text`` (key = stem) ·
    ``( id "text" )`` (last quoted string; skipped without one) ·
    ``key word word ...`` (needs two tokens; words joined by one space).
    """
    s = ustrip(F.col(line))
    pipe = F.split(s, r"\|", 2)
    tab = F.split(s, "\t", 2)
    quoted = F.regexp_extract_all(s, F.lit(r'"([^"]+)"'), F.lit(1))
    paren_parts = F.split(ustrip(F.regexp_replace(s, "[()]", "")), WS_SPLIT)
    words = F.split(s, WS_SPLIT)
    is_pipe, is_tab, is_paren = s.contains("|"), s.contains("\t"), s.startswith("(")
    key = (F.when(is_pipe, ustrip(pipe[0]))
           .when(is_tab, path_stem(ustrip(tab[0])))
           .when(is_paren, F.when(F.size(quoted) > 0,
                                  F.regexp_replace(paren_parts[0], '^"+|"+$', "")))
           .when(F.size(words) >= 2, words[0]))
    text = (F.when(is_pipe, ustrip(pipe[1]))
            .when(is_tab, ustrip(tab[1]))
            .when(is_paren, F.element_at(quoted, -1))
            .otherwise(F.array_join(F.slice(words, 2, F.size(words) - 1), " ")))
    return (lines.filter(s != "")
            .select(key.alias("key"), text.alias("text"), F.col(order).alias("line_ord"))
            .filter(F.col("key").isNotNull()))


def parse_tab_map(lines: DataFrame, line: str = "line", order: str = "line_ord") -> DataFrame:
    """``path<TAB>text[<TAB>...]`` -> ``(key = stem(path), text = strip(field 2))``;
    lines with fewer than two tab fields are dropped."""
    parts = F.split(ustrip(F.col(line)), "\t")
    return (lines.filter(F.size(parts) >= 2)
            .select(path_stem(parts[0]).alias("key"), ustrip(parts[1]).alias("text"),
                    F.col(order).alias("line_ord")))


# Fixed value: the form of a Festival entry.
FESTIVAL_RE = r'(?dU)^\(\s*(\S+)\s+"(.+?)"\s*\)'


def parse_festival(lines: DataFrame, line: str = "line", order: str = "line_ord") -> DataFrame:
    """``( id "text" )`` anchored at the line start -> ``(key, text)``; other lines dropped."""
    s = ustrip(F.col(line))
    return (lines.filter(s.rlike(FESTIVAL_RE))
            .select(F.regexp_extract(s, FESTIVAL_RE, 1).alias("key"),
                    ustrip(F.regexp_extract(s, FESTIVAL_RE, 2)).alias("text"),
                    F.col(order).alias("line_ord")))


def last_wins(entries: DataFrame, key: str = "key", value: str = "text", order: str = "line_ord") -> DataFrame:
    """One row per key with the value of its last entry (dict assignment order).

    ``max_by`` is combined map-side before the shuffle, so a key holding a
    third of all lines costs one row per map task, not one task."""
    return entries.groupBy(key).agg(F.max_by(F.col(value), F.col(order)).alias(value))


# The column names that are tried, in order.
FILE_COLS = ("file", "wav", "path", "audio")
TEXT_COLS = ("transcript", "text", "caption")

CSV_OPTS = {"header": "true", "escape": '"', "quote": '"',
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_csv(spark: SparkSession, path: str, schema=None, order: bool = False, infer: bool = False) -> DataFrame:
    """Header CSV (RFC 4180 quoting, fields may hold line ends), read in splits; with ``order``
    the column ``line_ord`` (file, split, position) is added."""
    df = read_quoted_csv(spark, path, schema, infer)
    return df if order else df.drop("line_ord")


def transcript_map_from_csv(df: DataFrame) -> DataFrame | None:
    """CSV branch: file column = first of file/wav/path/audio, text column =
    first of transcript/text/caption, key = stem(file).  ``None`` when a
    column is missing (the caller falls back to line parsing)."""
    fcol = next((c for c in FILE_COLS if c in df.columns), None)
    tcol = next((c for c in TEXT_COLS if c in df.columns), None)
    if not (fcol and tcol):
        return None
    return df.select(path_stem(F.col(fcol).cast("string")).alias("key"),
                     F.col(tcol).cast("string").alias("text"), F.col("line_ord"))


def csv_entries(spark: SparkSession, path: str) -> DataFrame | None:
    """Entries ``(key, text, line_ord)`` of a transcript CSV; ``None`` where it isn't one, which
    its rows tell too: one has more fields than the header, or a quote is never closed."""
    records = read_records(spark, path)
    names = first_header(records)
    if not names:
        return None
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    entries = transcript_map_from_csv(parsed(records, schema))
    if entries is None:
        return None
    wide = records.agg(F.max(fields(F.col("record"))).alias("n"), F.bool_or(unclosed(F.col("record"))).alias("open")).first()
    return None if wide["n"] > len(names) or wide["open"] else entries


def load_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcript map ``(key, text)`` from a CSV (when it has the columns and can be
    read) or a free-form text file; later entries win."""
    entries = csv_entries(spark, path) if path.lower().endswith(".csv") else None
    if entries is None:
        entries = parse_transcript_lines(read_lines(spark, path))
    return last_wins(entries)


#: Tasks that read sidecar files, at most, for each core: a scan gives a task only some 30 small files.
SIDECAR_TASKS = 16
#: Sidecar files that the driver holds at a time, at most, and those a task reads of so many.
SIDECAR_BATCH = 25_000
SIDECAR_TASK_FILES = 1_000


def _sidecar_texts(df: DataFrame, tasks: int) -> DataFrame:
    """Whole files -> ``(clip_base, text)``."""
    df = df.select("value", "_metadata").coalesce(tasks)
    p = F.col("_metadata.file_path")
    return df.select(F.regexp_replace(p, r"\.txt$", "").alias("clip_base"),
                     ustrip(F.regexp_replace("value", "�", "")).alias("text"))


def read_sidecars(spark: SparkSession, paths: str | Sequence[str], names: str | None = None) -> DataFrame:
    """``<clip>.txt`` files -> ``(clip_base, text)``: whole (small) file,
    stripped; ``clip_base`` is the path without its extension.

    With a pattern ``names`` the paths are folders, and files of such names anywhere below them are read: folders are
    listed whole.  A pattern in the paths themselves becomes a path a file, which Spark lists one by one.

    A scan keeps all its files in the driver.  Where folders have over ``SIDECAR_BATCH`` files, as many at a time are
    read and their rows written to the shared folder; what is returned reads those."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    tasks = SIDECAR_TASKS * spark.sparkContext.defaultParallelism
    if names is None:
        return _sidecar_texts(spark.read.text(paths, wholetext=True), tasks)

    def scan(paths: list[str], **options) -> DataFrame:
        return spark.read.options(recursiveFileLookup="true", pathGlobFilter=names, **options).text(paths, wholetext=True)

    found = batches(files_below(spark, paths, names) or iter(()), SIDECAR_BATCH)
    first = list(islice(found, 2))
    if len(first) < 2:
        return _sidecar_texts(scan(paths), tasks)
    out = scratch_path(spark, "sidecar-texts")
    tasks = min(tasks, -(-SIDECAR_BATCH // SIDECAR_TASK_FILES))
    # else Spark lists by a task a file, and keeps what it listed for later reads
    with settings(spark, {"spark.sql.sources.parallelPartitionDiscovery.parallelism": tasks,
                          "spark.sql.hive.filesourcePartitionFileCacheSize": 0}):
        for files in chain(first, found):
            texts = _sidecar_texts(scan(files, __globPaths__="false"), tasks)
            texts.write.mode("append").parquet(out, compression="zstd")
    return spark.read.schema("clip_base string, text string").parquet(out)


__all__ = ["read_lines", "parse_transcript_lines", "parse_tab_map", "parse_festival", "last_wins",
           "read_csv", "csv_entries", "transcript_map_from_csv", "load_transcripts", "read_sidecars"]
