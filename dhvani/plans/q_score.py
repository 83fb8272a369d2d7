"""Scoring queries over pairs derived from whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import score as SC
from ..sources import views as V
from ..sources.tables import read_table
from .catalog import r6, register
from ..functions.text import SQL_S


# Closed form of the word edit distance on pairs_v: hyp deletes every 7th word
# and substitutes each kept 'the' by 'teh', a word that never occurs in ref.
# Every kept 'teh' must be substituted or inserted and every deleted word must
# go, so no alignment beats deletions + substitutions, which the natural
# alignment reaches.
_WER_PARTS = """wp as (select row_id, len(string_split(ref, ' ')) as n_ref,
  len(string_split(ref, ' ')) // 7
  + len(list_filter(string_split(ref, ' '), lambda w, i: w = 'the' and i % 7 <> 0)) as edits from pairs_v)"""


@register("wer", V.with_views(
    """select round(sum(edits) / sum(n_ref), 6) as wer, sum(edits) as edits, sum(n_ref) as ref_words,
  count(*) as n_pairs from wp""", "pairs_v", ctes=[_WER_PARTS]))
def q_wer(spark, d):
    w = SC.wer(V.pairs_v(spark, d))
    return w.select(r6("wer").alias("wer"), "edits", "ref_words", "n_pairs")


@register("cer", V.with_views(
    """select round(sum(levenshtein(ref, hyp)) / sum(length(ref)), 6) as cer, sum(levenshtein(ref, hyp)) as edits,
  sum(length(ref)) as ref_chars, count(*) as n_pairs from pairs_v""", "pairs_v"))
def q_cer(spark, d):
    c = SC.cer(V.pairs_v(spark, d))
    return c.select(r6("cer").alias("cer"), "edits", "ref_chars", "n_pairs")


def _safe_pairs(spark, d):
    """Pairs whose German hypotheses are missing (could not be decoded)."""
    doc = read_table(spark, d, "documents").select("doc_id", "lang")
    p = V.pairs_v(spark, d).join(doc.withColumnRenamed("doc_id", "row_id"), "row_id")
    return p.withColumn("hyp", F.when(F.col("lang") == "de", F.lit(None)).otherwise(F.col("hyp")))


@register("wer_percent_safe", V.with_views(
    """select 'with_missing' as pair_set, 100.0 as wer, 100.0 as cer
union all select 'decoded', round(100.0 * sum(edits) / sum(n_ref), 6),
  round(100.0 * sum(levenshtein(p.ref, p.hyp)) / sum(length(p.ref)), 6)
from wp join pairs_v p using (row_id) join documents d on d.doc_id = p.row_id where d.lang <> 'de'""",
    "pairs_v", ctes=[_WER_PARTS]))
def q_wer_percent_safe(spark, d):
    p = _safe_pairs(spark, d)
    a = SC.error_rates_percent_safe(p.drop("lang")).select(F.lit("with_missing").alias("pair_set"), "wer", "cer")
    b = SC.error_rates_percent_safe(p.filter(F.col("lang") != "de").drop("lang")).select(
        F.lit("decoded").alias("pair_set"), "wer", "cer")
    return a.unionByName(b).select("pair_set", r6("wer").alias("wer"), r6("cer").alias("cer"))


# ---- D13: rows with a blank reference don't count (all blank: an error, see tests) ------

@register("wer_blank_references", V.with_views(
    """select round(sum(edits) / sum(n_ref), 6) as wer, sum(edits) as edits, sum(n_ref) as ref_words, count(*) as n_pairs
from wp join documents d on d.doc_id = wp.row_id where d.lang <> 'fr'""", "pairs_v", ctes=[_WER_PARTS]))
def q_wer_blank_references(spark, d):
    doc = read_table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "lang")
    p = V.pairs_v(spark, d).join(doc, "row_id")
    p = p.withColumn("ref", F.when(F.col("lang") == "fr", F.lit(" \t\u00a0")).otherwise(F.col("ref"))).drop("lang")
    w = SC.wer(p)
    return w.select(r6("wer").alias("wer"), "edits", "ref_words", "n_pairs")


@register("char_offsets", V.with_views(
    "select row_id, coalesce(sum(length(ref)) over (order by row_id rows between unbounded preceding and 1 preceding), 0) as offset from pairs_v",
    "pairs_v"))
def q_char_offsets(spark, d):
    p = SC.prepare(V.pairs_v(spark, d))
    return SC.char_offsets(p, "row_id", "ref").select("row_id", "offset")


_CONF = """cr as (select string_agg(ref, '' order by row_id) as s from pairs_v),
ch as (select string_agg(hyp, '' order by row_id) as s from pairs_v),
nn as (select least(length(cr.s), length(ch.s)) as n from cr, ch),
rt as (select unnest(regexp_extract_all(cr.s, '.')) as t, generate_subscripts(regexp_extract_all(cr.s, '.'), 1) as i from cr),
ht as (select unnest(regexp_extract_all(ch.s, '.')) as p, generate_subscripts(regexp_extract_all(ch.s, '.'), 1) as i from ch),
conf as (select t, p, count(*) as n from rt join ht using (i) where i <= (select n from nn) group by t, p)"""


@register("char_accuracy", V.with_views(
    "select round(sum(case when t = p then n else 0 end) / sum(n), 6) as accuracy, sum(n) as n_positions from conf",
    "pairs_v", ctes=[_CONF]))
def q_char_accuracy(spark, d):
    a = SC.char_accuracy(SC.char_confusion(V.pairs_v(spark, d)))
    return a.select(r6("accuracy").alias("accuracy"), "n_positions")


@register("char_macro_prf", V.with_views(
    """, lab as (select c, coalesce(nt, 0) as n_true, coalesce(np, 0) as n_pred, coalesce(tp, 0) as tp from
  (select t as c, sum(n) as nt from conf group by t) full join (select p as c, sum(n) as np from conf group by p) using (c)
  left join (select t as c, n as tp from conf where t = p) using (c))
select round(avg(case when n_pred > 0 then tp / n_pred else 0 end), 6) as precision,
  round(avg(case when n_true > 0 then tp / n_true else 0 end), 6) as recall,
  round(avg(case when tp > 0 then 2 * tp / (n_true + n_pred) else 0 end), 6) as f1, count(*) as n_labels from lab""".lstrip(", ")
    .replace("lab as", "lab as", 1), "pairs_v", ctes=[_CONF]).replace("\nlab as", ",\nlab as"))
def q_char_macro_prf(spark, d):
    m = SC.char_macro_prf(SC.char_confusion(V.pairs_v(spark, d)))
    return m.select(r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"), "n_labels")


# ---- BLEU / chrF over raw document text ---------------------------------------------

def mt_pairs_v(spark, d):
    """(row_id, ref, hyp): ref = raw text; hyp = its whitespace tokens with
    every 7th dropped and 'the' written 'teh'."""
    doc = read_table(spark, d, "documents")
    toks = F.transform(F.split(F.col("text"), r"\s+"), lambda w: F.when(w == "the", F.lit("teh")).otherwise(w))
    hyp = F.array_join(F.filter(toks, lambda w, i: (i + 1) % 7 != 0), " ")
    return doc.select(F.col("doc_id").alias("row_id"), F.col("text").alias("ref"), hyp.alias("hyp"))


_MT = """mt as (select doc_id as row_id, text as ref, array_to_string(list_filter(list_transform(
  regexp_split_to_array(text, '\\s+'), lambda w: case when w = 'the' then 'teh' else w end), lambda w, i: i % 7 <> 0), ' ') as hyp
  from documents)"""


def _tok13a_sql(x):
    t = f"regexp_replace({x}, '[{SQL_S}]+$', '')"
    t = f"replace(replace(replace({t}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for a, b in SC.TOK13A_UNESCAPE:
        t = f"replace({t}, '{a}', '{b}')"
    t = f"(' ' || {t} || ' ')"
    rules = [(r"([\{-\~\[-\`\ -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "),
             (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")]
    for pat, rep in rules:
        t = f"regexp_replace({t}, '{pat}', '{rep}', 'g')"
    return f"list_filter(regexp_split_to_array({t}, '[{SQL_S}]+'), lambda w: length(w) > 0)"


def _bleu_sql():
    grams = []
    for n in range(1, SC.MAX_ORDER + 1):
        for side, col in (("r", "rt"), ("h", "ht")):
            grams.append(f"""select row_id, {n} as n, '{side}' as side, unnest(list_transform(range(1, len({col}) - {n} + 2),
  lambda i: array_to_string({col}[i:i + {n - 1}], ' '))) as g from tok""")
    st = " union all ".join(grams)
    body = f""", tok as (select row_id, {_tok13a_sql('ref')} as rt, {_tok13a_sql('hyp')} as ht from mt),
lens as (select sum(len(ht)) as sys_len, sum(len(rt)) as ref_len from tok),
grams as ({st}),
per as (select n, g, row_id, count(*) filter (where side = 'h') as h, count(*) filter (where side = 'r') as r
  from grams group by n, g, row_id),
st as (select n, sum(h) as tot, sum(least(h, r)) as cor from per group by n),
w as (select {", ".join(f"coalesce(max(case when n = {k} then tot end), 0) as t{k}, coalesce(max(case when n = {k} then cor end), 0) as c{k}" for k in range(1, 5))} from st),
pr as (select *,
  case when t1 = 0 then 0 when c1 = 0 then 100.0 / (2 * t1) else 100.0 * c1 / t1 end as p1,
  (case when c1 = 0 then 2 else 1 end) as s1 from w),
pr2 as (select *, case when t1 = 0 or t2 = 0 then 0 when c2 = 0 then 100.0 / (s1 * 2 * t2) else 100.0 * c2 / t2 end as p2,
  s1 * (case when c2 = 0 and t2 > 0 then 2 else 1 end) as s2 from pr),
pr3 as (select *, case when t1 = 0 or t2 = 0 or t3 = 0 then 0 when c3 = 0 then 100.0 / (s2 * 2 * t3) else 100.0 * c3 / t3 end as p3,
  s2 * (case when c3 = 0 and t3 > 0 then 2 else 1 end) as s3 from pr2),
pr4 as (select *, case when t1 = 0 or t2 = 0 or t3 = 0 or t4 = 0 then 0 when c4 = 0 then 100.0 / (s3 * 2 * t4) else 100.0 * c4 / t4 end as p4 from pr3),
sc as (select p1, p2, p3, p4, sys_len, ref_len,
  case when sys_len >= ref_len then 1.0 when sys_len > 0 then exp(1 - ref_len / sys_len) else 0.0 end as bp from pr4, lens)
select round(bp * exp(((case when p1 > 0 then ln(p1) else -9999999999 end) + (case when p2 > 0 then ln(p2) else -9999999999 end)
  + (case when p3 > 0 then ln(p3) else -9999999999 end) + (case when p4 > 0 then ln(p4) else -9999999999 end)) / 4), 6) as bleu,
  round(bp, 6) as bp, round(p1, 6) as p1, round(p2, 6) as p2, round(p3, 6) as p3, round(p4, 6) as p4, sys_len, ref_len from sc"""
    return V.with_views(body.lstrip(", "), ctes=[_MT]).replace("\ntok as", ",\ntok as", 1)


@register("bleu", _bleu_sql())
def q_bleu(spark, d):
    b = SC.bleu(mt_pairs_v(spark, d))
    return b.select(*[r6(c).alias(c) for c in ("bleu", "bp", "p1", "p2", "p3", "p4")], "sys_len", "ref_len")


def _chrf_sql():
    grams = []
    for n in range(1, SC.CHAR_ORDER + 1):
        for side, col in (("r", "rs"), ("h", "hs")):
            grams.append(f"""select row_id, {n} as n, '{side}' as side, unnest(list_transform(range(1, length({col}) - {n} + 2),
  lambda i: substring({col}, i, {n}))) as g from cs""")
    body = f"""cs as (select row_id, regexp_replace(ref, '[{SQL_S}]+', '', 'g') as rs, regexp_replace(hyp, '[{SQL_S}]+', '', 'g') as hs from mt),
grams as ({" union all ".join(grams)}),
per as (select n, g, row_id, count(*) filter (where side = 'h') as h, count(*) filter (where side = 'r') as r
  from grams group by n, g, row_id),
st as (select n, sum(h) as ht, sum(r) as rt, sum(least(h, r)) as m from per group by n),
a as (select sum(case when ht > 0 and rt > 0 then m / ht end) as sp, sum(case when ht > 0 and rt > 0 then m / rt end) as sr,
  count(*) filter (where ht > 0 and rt > 0) as k from st),
b as (select case when k > 0 then sp / k else 0 end as pr, case when k > 0 then sr / k else 0 end as rc from a)
select round(case when pr + rc > 0 then 100.0 * 5 * pr * rc / (4 * pr + rc) else 0 end, 6) as chrf,
  round(pr, 6) as char_precision, round(rc, 6) as char_recall from b"""
    return V.with_views(body, ctes=[_MT]).replace("\ncs as", ",\ncs as", 1)


@register("chrf", _chrf_sql())
def q_chrf(spark, d):
    c = SC.chrf(mt_pairs_v(spark, d))
    return c.select(*[r6(x).alias(x) for x in ("chrf", "char_precision", "char_recall")])

