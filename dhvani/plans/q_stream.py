"""Streaming ingest as a query: transcript files land in a folder, the stream
parses, normalises and keeps the latest entry per key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..session import scratch_path
from ..sources.tables import read_table
from ..streaming.transcripts import latest_transcripts, start_transcript_ingest
from ..sources import views as V
from .catalog import register
from .q_ingest import FLAT_SQL, _PARSE_SQL


@register("stream_last_wins", V.with_views(
    f"select key, {TX.normalize_en_sql('arg_max(text, line_no)')} as text from parsed where key is not null group by key",
    ctes=["lines as (select doc_id as line_no, concat(source, '.wav', chr(9), " + FLAT_SQL + ") as line from documents)",
          _PARSE_SQL]))
def q_stream_last_wins(spark, d):
    folder = scratch_path(spark, "stream-in")
    doc = read_table(spark, d, "documents")
    line = F.concat(F.col("source"), F.lit(".wav\t"), F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))
    # the files are cut as the table is scanned; the arrival order of a key's entries
    # is the number of the line, so a hot source is spread over files and tasks
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    doc.select(F.concat(number, F.lit("\t"), line).alias("value")).write.text(folder)
    table = scratch_path(spark, "stream-out")
    start_transcript_ingest(spark, folder, table, "en", trigger_once=True, numbered=True).awaitTermination()
    return latest_transcripts(spark, table).filter(F.col("key").isNotNull()).select("key", "text")
