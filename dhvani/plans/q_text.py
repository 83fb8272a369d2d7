"""Text normalisation and path queries (whole texts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..sources import views as V
from ..sources.tables import read_table
from .catalog import register


@register("normalize_en", f"select doc_id, {T.normalize_en_sql('text')} as norm from documents")
def q_normalize_en(spark, d):
    return read_table(spark, d, "documents").select("doc_id", T.normalize_en(F.col("text")).alias("norm"))


@register("normalize_hi", V.with_views(f"select doc_id, {T.normalize_hi_sql('text')} as norm from deva_v", "deva_v"))
def q_normalize_hi(spark, d):
    return V.deva_v(spark, d).select("doc_id", T.normalize_hi(F.col("text")).alias("norm"))


_MIXED_SQL = (f"select doc_id, case when lang = 'en' then 'en' when lang = 'fr' then 'hi' "
              f"when lang = 'de' then 'hi-IN' else 'es' end as lang2, "
              f"case when lang in ('fr', 'de') then translate(text, '{V.LATIN}', '{V.DEVANAGARI}') else text end as text2 "
              f"from documents")


def _mixed(spark, d):
    doc = read_table(spark, d, "documents")
    lang = F.col("lang")
    return doc.select(
        "doc_id",
        F.when(lang == "en", "en").when(lang == "fr", "hi").when(lang == "de", "hi-IN").otherwise("es").alias("lang2"),
        F.when(lang.isin("fr", "de"), V.deva_text(F.col("text"))).otherwise(F.col("text")).alias("text2"))


@register("normalize_by_lang", f"""with m as ({_MIXED_SQL})
select doc_id, lang2, case when starts_with(lang2, 'hi') then {T.normalize_hi_sql('text2')}
  else {T.normalize_en_sql('text2')} end as norm from m""")
def q_normalize_by_lang(spark, d):
    m = _mixed(spark, d)
    return m.select("doc_id", "lang2", T.normalize_by_lang(F.col("text2"), F.col("lang2")).alias("norm"))


@register("number_words", f"""select doc_id, k, num, {T.number_words_sql('num')} as words from (
  select doc_id, unnest(range(1, len(l) + 1)) as k, unnest(l) as num from (
    select doc_id, regexp_extract_all(text, '[0-9]+') as l from documents))""")
def q_number_words(spark, d):
    doc = read_table(spark, d, "documents")
    x = doc.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("p", "num"))
    return x.select("doc_id", (F.col("p") + 1).alias("k"), "num", T.number_words(F.col("num")).alias("words"))


# Numbers of 1 to about 320 digits, made of the text's digest: all scale words occur.
@register("number_words_long", f"""select doc_id, num, {T.number_words_sql('num')} as words from (
  select doc_id, substr(repeat(translate(md5(text), 'abcdef', '012345'), 10), 1, cast(1 + length(text) % 320 as integer)) as num
  from documents)""")
def q_number_words_long(spark, d):
    digest = F.translate(F.md5(F.col("text").cast("binary")), "abcdef", "012345")
    x = read_table(spark, d, "documents").select("doc_id", F.substring(
        F.repeat(digest, 10), F.lit(1), (F.length("text") % 320 + 1).cast("int")).alias("num"))
    return x.select("doc_id", "num", T.number_words(F.col("num")).alias("words"))


_STEM_SQL = "regexp_replace(regexp_extract({p}, '([^/]*)/*$', 1), '^(.+)\\.[^.]+$', '\\1')"


@register("path_stem", V.with_views(
    f"""select 'page' as src, cast(page_id as varchar) as key, {_STEM_SQL.format(p='url')} as stem from pages
union all select 'clip', id, {_STEM_SQL.format(p='wav_path')} from manifest_v""", "manifest_v"))
def q_path_stem(spark, d):
    pages = read_table(spark, d, "pages").select(
        F.lit("page").alias("src"), F.col("page_id").cast("string").alias("key"), P.path_stem(F.col("url")).alias("stem"))
    clips = V.manifest_v(spark, d).select(F.lit("clip").alias("src"), F.col("id").alias("key"),
                                          P.path_stem(F.col("wav_path")).alias("stem"))
    return pages.unionByName(clips)


@register("proc_path", V.with_views(
    f"""select id, case when rel <> '' then concat_ws('/', '/proc', nullif(regexp_extract(rel, '^(.*)/[^/]*$', 1), ''),
  {_STEM_SQL.format(p='rel')} || '_proc.wav') end as proc_path
from (select id, regexp_extract(wav_path, '^/clips/+(.*)$', 1) as rel from manifest_v)""", "manifest_v"))
def q_proc_path(spark, d):
    return V.manifest_v(spark, d).select("id", P.proc_path(F.col("wav_path"), "/clips", "/proc").alias("proc_path"))


_REL_SQL = "select id, case when lang = 'en' then wav_path else concat(source_dir, '/', id, '.wav') end as path from (select *, regexp_extract(wav_path, '^/clips/([^/]+)/', 1) as source_dir from manifest_v)"


@register("resolve_path", V.with_views(
    f"""select id, case when starts_with(path, '/') then path else '/data/splits/' || regexp_extract(path, '[^/]*$') end as audio
from ({_REL_SQL})""", "manifest_v"))
def q_resolve_path(spark, d):
    m = V.manifest_v(spark, d)
    path = F.when(F.col("lang") == "en", F.col("wav_path")).otherwise(
        F.concat(F.regexp_extract("wav_path", "^/clips/([^/]+)/", 1), F.lit("/"), F.col("id"), F.lit(".wav")))
    return m.select("id", P.resolve_path(path, "/data/splits/test.csv").alias("audio"))
