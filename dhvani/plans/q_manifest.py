"""Manifest, combine, filter, bin and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import manifest as M
from ..operators import split as S
from ..session import scratch_path
from ..sources import views as V
from ..sources.manifests import read_manifest, write_manifest_table
from .catalog import r6, register
from .combine_split import combine_filter_split, split_report

VT = 0.05 + 0.05          # val + test fraction (double, as the library computes it)
T_SHARE = 0.05 / VT       # test share of the rest

# ---- shared oracle fragments ------------------------------------------------

_COMBINED = f"""u as (
  select wav_path, duration_sec, transcript, id, 'en' as lang, 0 as src_ord, cast(id as bigint) as row_ord from manifest_a_v
  union all by name
  select wav_path, duration_sec, transcript, lang, id, 1 as src_ord, cast(id as bigint) as row_ord from manifest_b_v),
combined as (select wav_path, duration_sec, transcript, id, lang, src_ord, row_ord from (
  select *, row_number() over (partition by wav_path order by src_ord, row_ord) as rn from u) where rn = 1),
kept as (select * from combined where duration_sec >= 0.5 and duration_sec <= 20.0 and not isnan(duration_sec))"""

_EDGES = """edges as (select list_sort(list_distinct(quantile_cont(greatest(duration_sec, 0.5),
  [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) as e from kept),
binned as (select k.*, 1 + len(list_filter(e[2:len(e)-1], lambda v: v < greatest(k.duration_sec, 0.5))) as dur_bin
  from kept k, edges)"""

_SPLIT = f"""cnt as (select dur_bin, count(*) as c from binned group by dur_bin),
q1 as (select *, (rest * c) // n as fl, (rest * c) % n as rem from (
  select dur_bin, c, sum(c) over () as n, cast(ceil(cast({VT!r} as double) * sum(c) over ()) as bigint) as rest from cnt)),
q2 as (select dur_bin, fl + case when row_number() over (order by rem desc, dur_bin) <= rest - sum(fl) over () then 1 else 0 end as rest_b from q1),
q3 as (select *, (tt * rest_b) // n2 as fl2, (tt * rest_b) % n2 as rem2 from (
  select *, sum(rest_b) over () as n2, cast(ceil(cast({T_SHARE!r} as double) * sum(rest_b) over ()) as bigint) as tt from q2)),
q4 as (select dur_bin, rest_b, fl2 + case when row_number() over (order by rem2 desc, dur_bin) <= tt - sum(fl2) over () then 1 else 0 end as test_b from q3),
ranked as (select b.*, row_number() over (partition by dur_bin order by md5(concat(coalesce(cast(wav_path as varchar), ''), '|', '42'))) as rk from binned b),
splitted as (select r.*, case when rk <= test_b then 'test' when rk <= rest_b then 'val' else 'train' end as split
  from ranked r join q4 using (dur_bin))"""


def _combine_inputs(spark, d):
    a = V.manifest_a_v(spark, d)
    b = V.manifest_b_v(spark, d)
    return [(a, V.COMBINE_PATHS[0], F.col("id").cast("long")),
            (b, V.COMBINE_PATHS[1], F.col("id").cast("long"))]


def _kept(spark, d):
    c = M.combine(_combine_inputs(spark, d)).drop("src_ord", "row_ord")
    return M.duration_filter(c)


# ---- D1 split summary (flagship) -------------------------------------------

@register("split_summary", V.with_views("""
select split, count(*) as n_samples, round(sum(duration_sec) / 3600.0, 6) as hours, round(avg(duration_sec), 6) as avg_sec
from splitted group by split""", "manifest_a_v", "manifest_b_v", ctes=[_COMBINED, _EDGES, _SPLIT]))
def q_split_summary(spark, d):
    s = split_report(_combine_inputs(spark, d))
    return s.select("split", "n_samples", r6("hours").alias("hours"), r6("avg_sec").alias("avg_sec"))


# ---- E4 stratified split ------------------------------------------------------

@register("stratified_split", V.with_views("select id, split from splitted", "manifest_a_v", "manifest_b_v",
                                           ctes=[_COMBINED, _EDGES, _SPLIT]))
def q_stratified_split(spark, d):
    return combine_filter_split(_combine_inputs(spark, d)).select("id", "split")


# ---- B3 duration filter -------------------------------------------------------

@register("duration_filter", V.with_views(
    "select id, round(duration_sec, 6) as duration_sec from manifest_v "
    "where duration_sec >= 0.5 and duration_sec <= 20.0 and not isnan(duration_sec)", "manifest_v"))
def q_duration_filter(spark, d):
    return M.duration_filter(V.manifest_v(spark, d)).select("id", r6("duration_sec").alias("duration_sec"))


# ---- D3 quantile edges, E3 bins -----------------------------------------------

@register("duration_edges", V.with_views(
    "select i as edge_no, round(e[i], 9) as edge from edges, range(1, len(e) + 1) t(i)",
    "manifest_a_v", "manifest_b_v", ctes=[_COMBINED, _EDGES.split("),\nbinned")[0] + ")"]))
def q_duration_edges(spark, d):
    e = S.duration_edges(_kept(spark, d))
    return e.select(F.posexplode("edges").alias("p", "v")).select(
        (F.col("p") + 1).alias("edge_no"), F.round("v", 9).alias("edge"))


@register("duration_bins", V.with_views("select id, dur_bin from binned", "manifest_a_v", "manifest_b_v",
                                        ctes=[_COMBINED, _EDGES]))
def q_duration_bins(spark, d):
    return S.duration_bins(_kept(spark, d)).select("id", "dur_bin")


# ---- G1 union, E1 keep-first dedupe, D2 summary, B7 language fill ------------

@register("combine_union", V.with_views(
    "select src_ord, row_ord, id, wav_path, lang, round(duration_sec, 6) as duration_sec from u",
    "manifest_a_v", "manifest_b_v", ctes=[_COMBINED]))
def q_combine_union(spark, d):
    u = M.union_inputs(_combine_inputs(spark, d))
    return u.select("src_ord", "row_ord", "id", "wav_path", "lang", r6("duration_sec").alias("duration_sec"))


@register("combine_dedupe", V.with_views(
    "select src_ord, id, wav_path, lang from combined", "manifest_a_v", "manifest_b_v", ctes=[_COMBINED]))
def q_combine_dedupe(spark, d):
    return M.combine(_combine_inputs(spark, d)).select("src_ord", "id", "wav_path", "lang")


@register("combine_summary", V.with_views(
    """select src_ord, arg_min(lang, row_ord) as src_lang, count(*) as n_rows,
  (select count(distinct wav_path) from u) as total_rows,
  (select array_to_string(list_sort(list_distinct(list(lang))), ',') from combined) as languages
from u group by src_ord""", "manifest_a_v", "manifest_b_v", ctes=[_COMBINED]))
def q_combine_summary(spark, d):
    return M.combine_summary(M.union_inputs(_combine_inputs(spark, d)))


@register("combine_from_csv", V.with_views(
    "select src_ord, id, wav_path, lang, md5(transcript) as transcript_md5 from combined", "manifest_a_v", "manifest_b_v", ctes=[_COMBINED]))
def q_combine_from_csv(spark, d):
    """Both inputs written as CSV and read again: the order of the rows is that of the files."""
    inputs = []
    for df, path, order in _combine_inputs(spark, d):
        out = scratch_path(spark, "combine-csv")
        write_manifest_table(df.orderBy(order), out, "csv")
        scan = read_manifest(spark, out, df.schema, order=True)
        inputs.append((scan, path, F.col("line_ord")))
    c = M.combine(inputs)
    return c.select("src_ord", "id", "wav_path", "lang", F.md5(F.col("transcript").cast("binary")).alias("transcript_md5"))


@register("lang_fill", V.with_views(
    """select id, 0 as src_ord, 'en' as lang from manifest_a_v
union all select id, 1 as src_ord, lang from manifest_b_v
union all select id, 2 as src_ord, 'hi' as lang from manifest_a_v""", "manifest_a_v", "manifest_b_v"))
def q_lang_fill(spark, d):
    a, b = V.manifest_a_v(spark, d), V.manifest_b_v(spark, d)
    parts = [M.fill_lang(a, V.COMBINE_PATHS[0]).select("id", F.lit(0).alias("src_ord"), "lang"),
             M.fill_lang(b, V.COMBINE_PATHS[1]).select("id", F.lit(1).alias("src_ord"), "lang"),
             # 'archive' contains 'hi': the path rule reads it as Hindi
             M.fill_lang(a, "/data/archive/manifest.csv").select("id", F.lit(2).alias("src_ord"), "lang")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- D4 stage counters ------------------------------------------------------------

@register("stage_counts", V.with_views(
    """select count(*) as n_loaded,
  count(*) filter (where duration_sec >= 0.5 and duration_sec <= 20.0 and not isnan(duration_sec)) as n_in_range,
  count(*) filter (where coalesce(regexp_replace(transcript, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') <> '', false)) as n_with_text,
  count(*) filter (where duration_sec >= 0.5 and duration_sec <= 20.0 and not isnan(duration_sec)
                   and coalesce(regexp_replace(transcript, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') <> '', false)) as n_usable
from combined""", "manifest_a_v", "manifest_b_v", ctes=[_COMBINED]))
def q_stage_counts(spark, d):
    return M.stage_counts(M.combine(_combine_inputs(spark, d)))


# ---- D11 duration statistics and histogram -------------------------------------

@register("duration_stats", V.with_views(
    """select lang, count(duration_sec) as n, round(avg(duration_sec), 6) as mean_sec,
  round(stddev_samp(duration_sec), 6) as std_sec, round(min(duration_sec), 6) as min_sec,
  round(quantile_cont(duration_sec, 0.25), 6) as p25_sec, round(quantile_cont(duration_sec, 0.5), 6) as p50_sec,
  round(quantile_cont(duration_sec, 0.75), 6) as p75_sec, round(max(duration_sec), 6) as max_sec
from kept group by lang""", "manifest_a_v", "manifest_b_v", ctes=[_COMBINED]))
def q_duration_stats(spark, d):
    s = M.duration_stats(_kept(spark, d))
    return s.select("lang", "n", *[r6(c).alias(c) for c in
                                   ("mean_sec", "std_sec", "min_sec", "p25_sec", "p50_sec", "p75_sec", "max_sec")])


@register("duration_histogram", V.with_views(
    """select lang, cast(floor(duration_sec / 1.0) * 1.0 as double) as bin_lo, count(*) as n
from kept group by all""", "manifest_a_v", "manifest_b_v", ctes=[_COMBINED]))
def q_duration_histogram(spark, d):
    return M.duration_histogram(_kept(spark, d), 1.0)


# ---- E5 plain split (no duration column) ------------------------------------------

@register("random_split", V.with_views(
    f"""select id, case when rk <= tt then 'test' when rk <= rest then 'val' else 'train' end as split from (
  select id, row_number() over (order by md5(concat(coalesce(cast(wav_path as varchar), ''), '|', '42'))) as rk,
    cast(ceil(cast({VT!r} as double) * count(*) over ()) as bigint) as rest,
    cast(ceil(cast({T_SHARE!r} as double) * cast(ceil(cast({VT!r} as double) * count(*) over ()) as bigint)) as bigint) as tt
  from combined)""", "manifest_a_v", "manifest_b_v", ctes=[_COMBINED]))
def q_random_split(spark, d):
    c = M.combine(_combine_inputs(spark, d)).drop("src_ord", "row_ord", "duration_sec")
    return S.stratified_split(c, key_cols=("wav_path",), unique_key=True).select("id", "split")


# ---- B1 projection, B2 rename ---------------------------------------------------

@register("project_asr", V.with_views("select wav_path, transcript from manifest_v", "manifest_v"))
def q_project_asr(spark, d):
    return V.manifest_v(spark, d).select("wav_path", "transcript")


@register("rename_eval", V.with_views(
    "select id, wav_path as audio, transcript as text, lang from manifest_v", "manifest_v"))
def q_rename_eval(spark, d):
    return (V.manifest_v(spark, d).withColumnsRenamed({"wav_path": "audio", "transcript": "text"})
            .select("id", "audio", "text", "lang"))
