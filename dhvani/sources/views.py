"""Views that present the driver's tables in the shapes the operators consume.

Each view has a Spark builder (DataFrame API over a whole table) and the same
definition as SQL text, inlined as a CTE by the DuckDB oracles.  Subsets are
chosen by data attributes (language, role), never by id arithmetic, and texts
are used whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# Latin letters mapped to Devanagari to make Hindi-script text
# from the (Latin-script) documents table.
LATIN = "abcdefghijklmnopqrstuvwxyz."
DEVANAGARI = "अआइईउऊएऐओऔकखगघचछजझटठडढणतथद।"

# Names given to the two inputs of the combine step; the path-based language
# rule reads them.
COMBINE_PATHS = ("/data/english/manifest.csv", "/data/hindi/manifest.csv")


def manifest_v(spark: SparkSession, d: str) -> DataFrame:
    doc = read_table(spark, d, "documents")
    idc = F.col("doc_id").cast("string")
    return doc.select(
        idc.alias("id"),
        F.concat(F.lit("/clips/"), F.col("source"), F.lit("/"), idc, F.lit(".wav")).alias("wav_path"),
        (F.col("n_chars") / F.lit(128.0)).alias("duration_sec"),
        F.col("text").alias("transcript"),
        F.col("lang"),
    )


def manifest_a_v(spark, d):
    """First combine input: English and French rows, no ``lang`` column."""
    m = manifest_v(spark, d)
    return m.filter(F.col("lang").isin("en", "fr")).select("wav_path", "duration_sec", "transcript", "id")


def manifest_b_v(spark, d):
    """Second combine input: all non-English rows with ``lang``; overlaps the first on French."""
    m = manifest_v(spark, d)
    return m.filter(F.col("lang") != "en").select("wav_path", "duration_sec", "transcript", "lang", "id")


def deva_text(c):
    return F.translate(c, LATIN, DEVANAGARI)


def deva_v(spark, d):
    doc = read_table(spark, d, "documents")
    return doc.select("doc_id", deva_text(F.col("text")).alias("text"))


def hi_side_v(spark, d):
    doc = read_table(spark, d, "documents").filter(F.col("lang") != "de")
    return doc.select(F.concat(F.lit("hi/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("wav_path"),
                      deva_text(F.col("text")).alias("text"))


def en_side_v(spark, d):
    doc = read_table(spark, d, "documents").filter(F.col("lang") != "fr")
    return doc.select(F.concat(F.lit("en/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("file"),
                      F.col("text").alias("transcript"))


def ascii_words(c):
    """Lower-case, keep a-z and spaces, collapse runs (a scoring fixture rule)."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z]+", " "))


def pairs_v(spark, d):
    """(row_id, ref, hyp): hyp drops every 7th word of ref and writes 'the' as 'teh'."""
    doc = read_table(spark, d, "documents")
    ref = ascii_words(F.col("text"))
    return (doc.filter(F.lower("text").rlike("[a-z]"))   # ref isn't empty; it isn't made twice to tell
            .select(F.col("doc_id").alias("row_id"), ref.alias("ref"))
            .withColumn("hyp", F.array_join(
                F.filter(F.transform(F.split("ref", " "),
                                     lambda w: F.when(w == "the", F.lit("teh")).otherwise(w)),
                         lambda w, i: (i + 1) % 7 != 0), " ")))


def clips_v(spark, d):
    emb = read_table(spark, d, "embeddings")
    return emb.select(F.col("vec_id").alias("clip_id"), F.col("embedding").alias("samples"))


FRAMES_PER_CLIP = 50


def spec_v(spark, d):
    """Magnitude frames: consecutive embeddings form clips of 50 frames x 64 bins."""
    emb = read_table(spark, d, "embeddings")
    return emb.select(
        F.floor(F.col("vec_id") / FRAMES_PER_CLIP).cast("long").alias("clip_id"),
        (F.col("vec_id") % FRAMES_PER_CLIP).cast("int").alias("frame_no"),
        F.transform("embedding", lambda x: F.abs(x)).alias("mag"))


# ---- SQL text of the same views (DuckDB oracle CTEs) ------------------------

SQL = {
    "manifest_v": (
        "select cast(doc_id as varchar) as id, concat('/clips/', source, '/', cast(doc_id as varchar), '.wav') as wav_path, "
        "n_chars / cast(128 as double) as duration_sec, text as transcript, lang from documents"),
    "manifest_a_v": "select wav_path, duration_sec, transcript, id from manifest_v where lang in ('en', 'fr')",
    "manifest_b_v": "select wav_path, duration_sec, transcript, lang, id from manifest_v where lang <> 'en'",
    "deva_v": f"select doc_id, translate(text, '{LATIN}', '{DEVANAGARI}') as text from documents",
    "hi_side_v": (f"select concat('hi/', cast(doc_id as varchar), '.wav') as wav_path, "
                  f"translate(text, '{LATIN}', '{DEVANAGARI}') as text from documents where lang <> 'de'"),
    "en_side_v": ("select concat('en/', cast(doc_id as varchar), '.wav') as file, text as transcript "
                  "from documents where lang <> 'fr'"),
    "pairs_v": (
        "select row_id, ref, array_to_string(list_filter(list_transform(string_split(ref, ' '), "
        "lambda w: case when w = 'the' then 'teh' else w end), lambda w, i: i % 7 <> 0), ' ') as hyp from ("
        "select doc_id as row_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z ]+', ' ', 'g'), ' +', ' ', 'g')) as ref "
        "from documents) where ref <> ''"),
    "clips_v": "select vec_id as clip_id, embedding as samples from embeddings",
    "spec_v": (f"select cast(floor(vec_id / {FRAMES_PER_CLIP}) as bigint) as clip_id, "
               f"cast(vec_id % {FRAMES_PER_CLIP} as integer) as frame_no, "
               "list_transform(embedding, lambda x: abs(x)) as mag from embeddings"),
}

# Views that other views read.
_DEPS = {"manifest_a_v": ["manifest_v"], "manifest_b_v": ["manifest_v"]}


def with_views(body: str, *names: str, ctes=()) -> str:
    """Prefix ``body`` with the view CTEs it needs (dependencies first) and
    then with the extra CTE texts in ``ctes``."""
    order: list[str] = []

    def add(n):
        for dep in _DEPS.get(n, []):
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} as ({SQL[n]})" for n in order] + [c.strip() for c in ctes]
    if not parts:
        return body
    return "with " + ",\n".join(parts) + "\n" + body
