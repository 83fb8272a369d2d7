"""Ingest queries: transcript parsing, CSV and file sources, lookups, routing.

Lines are derived from the documents table (one line per document, whole text
with newlines read as spaces); file-based queries first write their input
under the shared checkpoint folder and scan it back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import lookup as L
from ..operators.align import canonical_columns
from ..operators.rank import dense_row_ids
from ..session import local_path, scratch_path
from ..sources import transcripts as S
from ..sources import views as V
from ..sources.inventory import audio_inventory
from ..sources.manifests import read_manifest, write_manifest_table, write_splits
from ..sources.tables import read_table
from .catalog import register

S_CLS = TX.SQL_S


def ustrip_sql(x):
    return f"regexp_replace({x}, '^[{S_CLS}]+|[{S_CLS}]+$', '', 'g')"


def stem_sql(p):
    return f"regexp_replace(regexp_extract({p}, '([^/]*)/*$', 1), '^(.+)\\.[^.]+$', '\\1')"


FLAT_SQL = "replace(text, chr(10), ' ')"


def _flat():
    return F.replace(F.col("text"), F.lit("\n"), F.lit(" "))


def _docs(spark, d):
    return read_table(spark, d, "documents")


# ---- A4 free-form transcript lines --------------------------------------------

_LINES_SQL = f"""lines as (select doc_id as line_no, case
  when lang = 'en' then concat(source, '/', cast(doc_id as varchar), '.wav|', {FLAT_SQL})
  when lang = 'fr' then concat('/audio/', source, '/', cast(doc_id as varchar), '.wav', chr(9), {FLAT_SQL})
  when lang = 'de' then concat('( ', source, '_', cast(doc_id as varchar), ' "', replace({FLAT_SQL}, '"', ''), '" )')
  else concat(cast(doc_id as varchar), ' ', {FLAT_SQL}) end as line from documents)"""


def _lines(spark, d):
    doc, flat = _docs(spark, d), _flat()
    did = F.col("doc_id").cast("string")
    line = (F.when(F.col("lang") == "en", F.concat(F.col("source"), F.lit("/"), did, F.lit(".wav|"), flat))
            .when(F.col("lang") == "fr", F.concat(F.lit("/audio/"), F.col("source"), F.lit("/"), did, F.lit(".wav\t"), flat))
            .when(F.col("lang") == "de", F.concat(F.lit("( "), F.col("source"), F.lit("_"), did, F.lit(' "'),
                                                  F.replace(flat, F.lit('"'), F.lit("")), F.lit('" )')))
            .otherwise(F.concat(did, F.lit(" "), flat)))
    return doc.select(F.col("doc_id").alias("line_ord"), line.alias("line"))


_PARSE_SQL = f"""s as (select line_no, {ustrip_sql('line')} as s from lines),
parsed as (select line_no,
  case when contains(s, '|') then {ustrip_sql("split_part(s, '|', 1)")}
       when contains(s, chr(9)) then {stem_sql(ustrip_sql("split_part(s, chr(9), 1)"))}
       when starts_with(s, '(') then case when len(regexp_extract_all(s, '"([^"]+)"', 1)) > 0 then
         regexp_replace(regexp_split_to_array({ustrip_sql("replace(replace(s, '(', ''), ')', '')")}, '[{S_CLS}]+')[1], '^"+|"+$', '', 'g') end
       when len(regexp_split_to_array(s, '[{S_CLS}]+')) >= 2 then regexp_split_to_array(s, '[{S_CLS}]+')[1] end as key,
  case when contains(s, '|') then {ustrip_sql("substr(s, strpos(s, '|') + 1)")}
       when contains(s, chr(9)) then {ustrip_sql("substr(s, strpos(s, chr(9)) + 1)")}
       when starts_with(s, '(') then regexp_extract_all(s, '"([^"]+)"', 1)[-1]
       else array_to_string(regexp_split_to_array(s, '[{S_CLS}]+')[2:], ' ') end as text
  from s where s <> '')"""


@register("transcript_lines", V.with_views(
    "select line_no, key, text from parsed where key is not null", ctes=[_LINES_SQL, _PARSE_SQL]))
def q_transcript_lines(spark, d):
    p = S.parse_transcript_lines(_lines(spark, d))
    return p.select(F.col("line_ord").alias("line_no"), "key", "text")


# ---- E2 last-wins -----------------------------------------------------------------

@register("transcript_last_wins", V.with_views(
    "select key, arg_max(text, line_no) as text from parsed where key is not null group by key",
    ctes=["lines as (select doc_id as line_no, concat(source, '.wav', chr(9), " + FLAT_SQL + ") as line from documents)",
          _PARSE_SQL]))
def q_transcript_last_wins(spark, d):
    doc = _docs(spark, d)
    lines = doc.select(F.col("doc_id").alias("line_ord"),
                       F.concat(F.col("source"), F.lit(".wav\t"), _flat()).alias("line"))
    return S.last_wins(S.parse_transcript_lines(lines))


# ---- A5 tab map, A6 Festival map ---------------------------------------------------

def _tab_lines(spark, d):
    return _docs(spark, d).select(
        F.col("doc_id").alias("line_ord"),
        F.concat(F.lit("/raw/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".lab\t"),
                 _flat(), F.lit("\t"), F.col("lang")).alias("line"))


_TAB_SQL = f"""tl as (select doc_id as line_no, string_split({ustrip_sql(
    "concat('/raw/', source, '/', cast(doc_id as varchar), '.lab', chr(9), " + FLAT_SQL + ", chr(9), lang)")}, chr(9)) as parts from documents),
tab_map as (select line_no, {stem_sql('parts[1]')} as key, {ustrip_sql('parts[2]')} as text from tl where len(parts) >= 2)"""


@register("map_tab_transcripts", V.with_views(
    "select line_no, concat('/wav/', key, '.wav') as file, text as transcript from tab_map", ctes=[_TAB_SQL]))
def q_map_tab(spark, d):
    m = S.parse_tab_map(_tab_lines(spark, d))
    return m.select(F.col("line_ord").alias("line_no"),
                    F.concat(F.lit("/wav/"), F.col("key"), F.lit(".wav")).alias("file"),
                    F.col("text").alias("transcript"))


_FEST_RE_SQL = f'^\\([{S_CLS}]*([^{S_CLS}]+)[{S_CLS}]+"(.+?)"[{S_CLS}]*\\)'


@register("map_festival_transcripts", f"""select line_no, concat('/wav/', regexp_extract(s, '{_FEST_RE_SQL}', 1), '.wav') as file,
  {ustrip_sql(f"regexp_extract(s, '{_FEST_RE_SQL}', 2)")} as transcript
from (select doc_id as line_no, {ustrip_sql(f"concat('( ', source, '_', cast(doc_id as varchar), ' \"', replace({FLAT_SQL}, '\"', ''), '\" ) tail')")} as s
      from documents) where regexp_matches(s, '{_FEST_RE_SQL}')""")
def q_map_festival(spark, d):
    doc = _docs(spark, d)
    lines = doc.select(F.col("doc_id").alias("line_ord"), F.concat(
        F.lit("( "), F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(' "'),
        F.replace(_flat(), F.lit('"'), F.lit("")), F.lit('" ) tail')).alias("line"))
    m = S.parse_festival(lines)
    return m.select(F.col("line_ord").alias("line_no"),
                    F.concat(F.lit("/wav/"), F.col("key"), F.lit(".wav")).alias("file"),
                    F.col("text").alias("transcript"))


# ---- C3 existence semi-join -----------------------------------------------------------

@register("semi_existing", V.with_views(
    """select concat('/wav/', key, '.wav') as file, text as transcript from tab_map
where concat('/wav/', key, '.wav') in (select concat('/wav/', cast(doc_id as varchar), '.wav') from documents where lang <> 'es')""",
    ctes=[_TAB_SQL]))
def q_semi_existing(spark, d):
    m = S.parse_tab_map(_tab_lines(spark, d)).select(
        F.concat(F.lit("/wav/"), F.col("key"), F.lit(".wav")).alias("file"), F.col("text").alias("transcript"))
    inv = _docs(spark, d).filter(F.col("lang") != "es").select(
        F.concat(F.lit("/wav/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("path"))
    return L.semi_existing(m, inv, "file", "path")


# ---- C2 transcript attachment ------------------------------------------------------------

@register("attach_transcript", f"""with m as (select cast(doc_id as varchar) as key,
    case when lang = 'en' then {ustrip_sql(FLAT_SQL)} else '' end as text from documents where lang in ('en', 'fr')),
  sc as (select concat('/clips/', source, '/', cast(doc_id as varchar)) as clip_base, {ustrip_sql('text')} as text
    from documents where lang in ('fr', 'de'))
select d.doc_id as id, {TX.normalize_en_sql("coalesce(m.text, sc.text, '')")} as transcript
from documents d left join m on m.key = cast(d.doc_id as varchar)
  left join sc on sc.clip_base = concat('/clips/', d.source, '/', cast(d.doc_id as varchar))""")
def q_attach_transcript(spark, d):
    doc = _docs(spark, d)
    did = F.col("doc_id").cast("string")
    map_lines = doc.filter(F.col("lang").isin("en", "fr")).select(
        F.col("doc_id").alias("line_ord"),
        F.when(F.col("lang") == "en", F.concat(did, F.lit("|"), _flat())).otherwise(F.concat(did, F.lit("|"))).alias("line"))
    tmap = S.last_wins(S.parse_transcript_lines(map_lines))
    side = doc.filter(F.col("lang").isin("fr", "de")).select(
        F.concat(F.lit("/clips/"), F.col("source"), F.lit("/"), did).alias("clip_base"),
        TX.ustrip(F.col("text")).alias("text"))
    clips = doc.select(F.col("doc_id").alias("id"), did.alias("stem"),
                       F.concat(F.lit("/clips/"), F.col("source"), F.lit("/"), did).alias("clip_base"))
    return L.attach_transcript(clips, tmap, side, "en").select("id", "transcript")


# ---- A11 good/error routing, F3 first errors -----------------------------------------

SR_ROUTE = 1000  # samples per second of the routing fixture (n_chars read as samples)


def _routed(spark, d):
    m = V.manifest_v(spark, d).withColumn("n_samples", F.col("duration_sec") * 128)
    err = F.when(F.col("n_samples") < int(0.3 * SR_ROUTE), F.lit("too_short"))
    good, bad = L.route(m, err)
    return good, bad.select(F.col("wav_path").alias("input_path"), "error")


@register("route_errors", V.with_views(
    f"select wav_path as input_path, 'too_short' as error from manifest_v where duration_sec * 128 < {int(0.3 * SR_ROUTE)}",
    "manifest_v"))
def q_route_errors(spark, d):
    return _routed(spark, d)[1]


@register("error_sample", V.with_views(
    f"""select wav_path as input_path, 'too_short' as error from manifest_v where duration_sec * 128 < {int(0.3 * SR_ROUTE)}
order by wav_path limit 5""", "manifest_v"))
def q_error_sample(spark, d):
    return L.error_sample(_routed(spark, d)[1], 5)


# ---- A1 manifest CSV scan, A2 header canonicalisation, A3 transcript CSV -------------

def _write_csv(df, path):
    write_manifest_table(df, path, "csv")


@register("manifest_scan", V.with_views(
    "select id, wav_path, round(duration_sec, 6) as duration_sec, transcript, lang from manifest_v", "manifest_v"))
def q_manifest_scan(spark, d):
    path = scratch_path(spark, "manifest_csv")
    _write_csv(V.manifest_v(spark, d), path)
    m = read_manifest(spark, path)
    return m.select("id", "wav_path", F.round("duration_sec", 6).alias("duration_sec"), "transcript", "lang")


@register("canonical_columns", """select concat('hi/', cast(doc_id as varchar), '.wav') as wav_path, text from documents""")
def q_canonical_columns(spark, d):
    path = scratch_path(spark, "hi_csv")
    wav = F.concat(F.lit("hi/"), F.col("doc_id").cast("string"), F.lit(".wav"))
    _write_csv(_docs(spark, d).select(wav.alias("  WAV_Path"), F.col("text").alias("Text ")), path)
    return canonical_columns(S.read_csv(spark, path)).select("wav_path", "text")


# ---- dense row ids of a scan ------------------------------------------------------------

@register("dense_row_ids", """select doc_id, row_number() over (order by doc_id) - 1 as row_id from documents""")
def q_dense_row_ids(spark, d):
    path = scratch_path(spark, "rows_csv")
    parts = max(1, spark.sparkContext.defaultParallelism)
    _write_csv(_docs(spark, d).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").select("doc_id", "text"), path)
    rows = S.read_csv(spark, path, "doc_id long, text string", order=True)
    return dense_row_ids(rows).select("doc_id", "row_id")


@register("transcript_csv", f"""select key, arg_max(text, doc_id) as text from (
  select doc_id, case when lang = 'en' then cast(doc_id as varchar) else source end as key, text from documents)
group by key""")
def q_transcript_csv(spark, d):
    doc = _docs(spark, d)
    key = F.when(F.col("lang") == "en", F.col("doc_id").cast("string")).otherwise(F.col("source"))
    src = doc.select("doc_id", F.concat(F.lit("clips/"), key, F.lit(".wav")).alias("wav"), "text")
    path = scratch_path(spark, "transcripts_csv")
    # Range-partitioned and sorted so the files list rows in doc_id order.
    nparts = max(1, spark.sparkContext.defaultParallelism)
    _write_csv(src.repartitionByRange(nparts, "doc_id").sortWithinPartitions("doc_id").select("wav", "text"), path)
    return S.load_transcripts(spark, path + "/*.csv")


# ---- A9 split sink (partitioned by split) and read-back ---------------------------------

@register("split_roundtrip", None)
def q_split_roundtrip(spark, d):
    from .q_manifest import _combine_inputs
    from .combine_split import combine_filter_split
    path = scratch_path(spark, "splits")
    write_splits(combine_filter_split(_combine_inputs(spark, d)), path)
    return spark.read.parquet(path).select("id", "split")


# ---- A7 audio inventory -------------------------------------------------------------------

_EXT_SQL = "case lang when 'en' then 'wav' when 'fr' then 'flac' when 'de' then 'mp3' else 'WAV' end"


@register("audio_inventory", f"""select cast(doc_id as varchar) as stem, {_EXT_SQL} as ext from documents where lang <> 'es'""")
def q_audio_inventory(spark, d):
    root = local_path(scratch_path(spark, "audio"))
    doc = _docs(spark, d)
    ext = (F.when(F.col("lang") == "en", "wav").when(F.col("lang") == "fr", "flac")
           .when(F.col("lang") == "de", "mp3").otherwise("WAV"))
    files = doc.select(F.concat(F.lit(root + "/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"),
                                F.lit("."), ext).alias("p"))
    side = doc.filter(F.col("lang") == "de").select(F.concat(
        F.lit(root + "/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("p"))
    def touch(rows):  # local, so it is shipped by value to the Python workers
        import os
        for r in rows:
            os.makedirs(os.path.dirname(r.p), exist_ok=True)
            with open(r.p, "wb") as f:  # one byte: file scans skip empty files
                f.write(b"\0")

    files.unionByName(side).foreachPartition(touch)
    return audio_inventory(spark, root).select("stem", "ext")


# ---- A8 sidecar transcript files ----------------------------------------------------------

@register("sidecar_scan", f"""select cast(doc_id as varchar) as stem, {ustrip_sql('text')} as text from documents""")
def q_sidecar_scan(spark, d):
    root = local_path(scratch_path(spark, "sidecars"))
    doc = _docs(spark, d).select(
        F.concat(F.lit(root + "/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("p"),
        "text")

    def write(rows):  # local, so it is shipped by value to the Python workers
        import os
        for r in rows:
            os.makedirs(os.path.dirname(r.p), exist_ok=True)
            with open(r.p, "w", encoding="utf-8") as f:
                f.write(r.text)

    doc.foreachPartition(write)
    side = S.read_sidecars(spark, root, "*.txt")
    return side.select(F.regexp_extract("clip_base", r"([^/]+)$", 1).alias("stem"), "text")
