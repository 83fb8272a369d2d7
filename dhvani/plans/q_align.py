"""Parallel-corpus queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align as A
from ..operators.split import parallel_split, sample_n
from ..sources import views as V
from ..sources.tables import read_table
from .catalog import register
from .q_ingest import ustrip_sql

STEM = "regexp_replace(regexp_extract({p}, '([^/]*)/*$', 1), '^(.+)\\.[^.]+$', '\\1')"

_PAIRS = f"""hk as (select {STEM.format(p='wav_path')} as basename, text as hi_text from hi_side_v),
ek as (select {STEM.format(p='file')} as basename, transcript as en_text from en_side_v),
merged as (select basename, hi_text, en_text from hk join ek using (basename)
  where basename is not null and hi_text is not null and en_text is not null),
pairs as (select basename, {ustrip_sql('hi_text')} as hi_text, {ustrip_sql('en_text')} as en_text from merged
  where {ustrip_sql('hi_text')} <> '' and {ustrip_sql('en_text')} <> '')"""


def _pairs(spark, d):
    return A.align(V.hi_side_v(spark, d), V.en_side_v(spark, d))


@register("parallel_align", V.with_views("select basename, hi_text, en_text from pairs",
                                         "hi_side_v", "en_side_v", ctes=[_PAIRS]))
def q_parallel_align(spark, d):
    return _pairs(spark, d)


# ---- C1 on repeated stems: both the pairs and the rows without a partner ---------

def _turn_side(spark, d, role, text):
    c = read_table(spark, d, "conversations").filter(F.col("role") == role)
    return c.select(F.col("conv_id").cast("string").alias("basename"), F.col("text").alias(text))


_RANKED = "row_number() over (partition by conv_id order by md5(concat(coalesce(text, ''), '|', '42')), text)"


@register("parallel_repeated", f"""with h as (select cast(conv_id as varchar) as b, text, {_RANKED} as k from conversations where role = 'user'),
e as (select cast(conv_id as varchar) as b, text, {_RANKED} as k from conversations where role = 'assistant')
select 'pair' as kind, b as basename, h.text as hi_text, e.text as en_text from h join e using (b, k)
union all select 'hi', b, text, null from h where b in (select b from e) and (b, k) not in (select (b, k) from e)
union all select 'en', b, null, text from e where b in (select b from h) and (b, k) not in (select (b, k) from h)""")
def q_parallel_repeated(spark, d):
    pairs, rest = A.basename_pairs(_turn_side(spark, d, "user", "hi_text"), _turn_side(spark, d, "assistant", "en_text"))
    p = pairs.select(F.lit("pair").alias("kind"), "basename", "hi_text", "en_text")
    side = F.col("side")
    r = rest.select(side.alias("kind"), "basename", F.when(side == "hi", F.col("text")).alias("hi_text"),
                    F.when(side == "en", F.col("text")).alias("en_text"))
    return p.unionByName(r)


# ---- C1 in the whole alignment: rows and rows without a partner, by side ------------

@register("align_report", """with n as (select cast(conv_id as varchar) as b, count(*) filter (where role = 'user' and text is not null) as h,
  count(*) filter (where role = 'assistant' and text is not null and conv_id % 3 <> 0) as e from conversations group by b)
select 'hi' as side, cast(sum(h) as bigint) as n_rows, cast(sum(greatest(h - e, 0)) as bigint) as n_rest from n
union all select 'en', cast(sum(e) as bigint), cast(sum(greatest(e - h, 0)) as bigint) from n""")
def q_align_report(spark, d):
    c = read_table(spark, d, "conversations").select(F.concat(F.lit("c/"), F.col("conv_id").cast("string"), F.lit(".wav")).alias("file"), "text", "role", "conv_id")
    hi, en = c.where("role = 'user'"), c.where("role = 'assistant' and conv_id % 3 <> 0")
    return A.align_report(hi.select("file", "text"), en.select("file", "text"))


# ---- C4 random pairing (sides share no basename) --------------------------------

def _conv_side(spark, d):
    c = read_table(spark, d, "conversations")
    return c.select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("_"),
                             F.col("turn").cast("string"), F.lit(".wav")).alias("file"),
                    F.col("text").alias("transcript"))


def _doc_side(spark, d):
    doc = read_table(spark, d, "documents")
    return doc.select(F.concat(F.lit("hi/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("wav_path"),
                      V.deva_text(F.col("text")).alias("text"))


_RP = f"""hk as (select {STEM.format(p="concat('hi/', cast(doc_id as varchar), '.wav')")} as basename,
    translate(text, '{V.LATIN}', '{V.DEVANAGARI}') as hi_text from documents),
ek as (select {STEM.format(p="concat('conv/', cast(conv_id as varchar), '_', cast(turn as varchar), '.wav')")} as basename,
    text as en_text from conversations),
k as (select least((select count(*) from hk), (select count(*) from ek)) as k),
hr as (select hi_text, row_number() over (order by md5(concat(coalesce(basename, ''), '|', coalesce(hi_text, ''), '|', '42')), basename, hi_text) as r from hk),
er as (select en_text, row_number() over (order by md5(concat(coalesce(basename, ''), '|', coalesce(en_text, ''), '|', '42')), basename, en_text) as r from ek),
rp as (select 'pair_' || cast(hr.r - 1 as varchar) as basename, {ustrip_sql('hi_text')} as hi_text, {ustrip_sql('en_text')} as en_text
  from hr join er using (r) where r <= (select k from k))"""


@register("random_pairing", V.with_views(
    "select basename, hi_text, en_text from rp where hi_text <> '' and en_text <> ''", ctes=[_RP]))
def q_random_pairing(spark, d):
    return A.align(_doc_side(spark, d), _conv_side(spark, d))


# ---- B9 column guessing ----------------------------------------------------------------

_GUESS_V = "select concat('c', cast(conv_id as varchar), '_', cast(turn as varchar)) as clip_ref, role as speaker, text as utterance from conversations"


@register("guess_columns", f"""with v as ({_GUESS_V}),
a as (select avg(len(clip_ref)) as l1, avg(len(speaker)) as l2, avg(len(utterance)) as l3 from v)
select clip_ref as file, case when l1 > 5 then clip_ref when l2 > 5 then speaker when l3 > 5 then utterance
  else speaker end as text from v, a""")
def q_guess_columns(spark, d):
    c = read_table(spark, d, "conversations")
    v = c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("clip_ref"),
                 F.col("role").alias("speaker"), F.col("text").alias("utterance"))
    f, t = A.guess_file_col(v), A.guess_text_col(v)
    return v.select(F.col(f).alias("file"), F.col(t).alias("text"))


# ---- B4 drop nulls, B5 drop blanks (consecutive turns) ----------------------------------

def turns_v(spark, d):
    """Each turn with the next turn of its conversation (null at the last turn).
    An equi-join on (conv_id, turn), so a long conversation is no hot key."""
    c = read_table(spark, d, "conversations")
    a = c.select("conv_id", "turn", F.col("text").alias("hi_text"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("en_text"))
    return a.join(b, ["conv_id", "turn"], "left")


_TURNS = """turns as (select a.conv_id, a.turn, a.text as hi_text, b.text as en_text
  from conversations a left join conversations b on a.conv_id = b.conv_id and b.turn - 1 = a.turn)"""


@register("drop_null_pairs", V.with_views(
    "select conv_id, turn from turns where hi_text is not null and en_text is not null", ctes=[_TURNS]))
def q_drop_null_pairs(spark, d):
    return turns_v(spark, d).dropna(how="any", subset=["hi_text", "en_text"]).select("conv_id", "turn")


@register("drop_blank", V.with_views(
    f"""select conv_id, turn, hi_text, en_text from (select conv_id, turn, {ustrip_sql('hi_text')} as hi_text,
  {ustrip_sql('en_text')} as en_text from turns) where hi_text <> '' and en_text <> ''""", ctes=[_TURNS]))
def q_drop_blank(spark, d):
    return A.drop_blank(turns_v(spark, d)).select("conv_id", "turn", "hi_text", "en_text")


# ---- B11 seq2seq examples ---------------------------------------------------------------

@register("seq2seq_examples", V.with_views(
    f"""select 'hi-en' as direction, '{A.PROMPTS['hi-en']}' || hi_text as source, en_text as target from pairs
union all select 'en-hi', '{A.PROMPTS['en-hi']}' || en_text, hi_text from pairs""",
    "hi_side_v", "en_side_v", ctes=[_PAIRS]))
def q_seq2seq(spark, d):
    p = _pairs(spark, d)
    a = A.seq2seq_examples(p, "hi-en").withColumn("direction", F.lit("hi-en"))
    b = A.seq2seq_examples(p, "en-hi").withColumn("direction", F.lit("en-hi"))
    return a.unionByName(b).select("direction", "source", "target")


# ---- E6 parallel split, F1 seeded shuffle -----------------------------------------------

@register("parallel_split", V.with_views(
    """select basename, case when r <= ntr then 'train' when r <= ntr + nv then 'val' when r <= ntr + nv + nt then 'test' end as split
from (select basename, row_number() over (order by md5(concat(coalesce(basename, ''), '|', coalesce(hi_text, ''), '|',
    coalesce(en_text, ''), '|', '42')), basename, hi_text, en_text) as r,
  greatest(100, cast(floor(0.1 * count(*) over ()) as bigint)) as nv,
  greatest(100, cast(floor(0.1 * count(*) over ()) as bigint)) as nt,
  greatest(0, count(*) over () - 2 * greatest(100, cast(floor(0.1 * count(*) over ()) as bigint))) as ntr from pairs)""",
    "hi_side_v", "en_side_v", ctes=[_PAIRS]))
def q_parallel_split(spark, d):
    return parallel_split(_pairs(spark, d)).select("basename", "split")


# ---- F2 fixed-size sample (F4: six examples) -------------------------------------------

@register("sample_n", V.with_views(
    "select id from manifest_v order by md5(concat(coalesce(wav_path, ''), '|', '42')), id limit 6", "manifest_v"))
def q_sample_n(spark, d):
    m = V.manifest_v(spark, d)
    return sample_n(m, 6, key_cols=["wav_path"]).select("id")
