"""End-to-end plan queries (build a manifest; evaluate hypotheses)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..session import scratch_path
from ..sources import views as V
from ..sources.tables import read_table
from .build_manifest import clip_rows, process_clips, write_run
from .catalog import r6, register
from .evaluate import eval_pairs, evaluate
from .q_score import _CONF, _WER_PARTS
from .q_signal import _GATED, _SILENCE, HOP, SR, TOP_DB, WIN, _gated


def _clips_and_texts(spark, d):
    emb = read_table(spark, d, "embeddings").select("vec_id", "label")
    clips = _gated(spark, d).join(emb.withColumnRenamed("vec_id", "clip_id"), "clip_id").select(
        F.concat(F.lit("/in/"), F.col("label").cast("string"), F.lit("/"), F.col("clip_id").cast("string"),
                 F.lit(".wav")).alias("path"), "samples", F.lit(SR).alias("sr"))
    return clips, read_table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), "text")


_BUILT = f"""with {_GATED}, {_SILENCE},
lens as (select clip_id, count(*) as n from trimmed group by clip_id)
select cast(g.clip_id as varchar) as id,
  concat('/out/', cast(e.label as varchar), '/', cast(g.clip_id as varchar), '_proc.wav') as wav_path,
  round(n / {SR}.0, 3) as duration_sec, {TX.normalize_en_sql("coalesce(d.text, '')")} as transcript, 'en' as lang
from lens g join embeddings e on e.vec_id = g.clip_id left join documents d on d.doc_id = g.clip_id
where n >= {int(0.3 * SR)}"""


@register("build_manifest", _BUILT)
def q_build_manifest(spark, d):
    clips, tmap = _clips_and_texts(spark, d)
    manifest, _, _ = process_clips(clips, "/in", "/out", "en", tmap, None, trim=True, top_db=TOP_DB, win=WIN, hop=HOP)
    return manifest


@register("write_run", _BUILT)
def q_write_run(spark, d):
    """Manifest and errors written in one pass; the manifest as it reads back."""
    clips, tmap = _clips_and_texts(spark, d)
    out = scratch_path(spark, "run")
    write_run(clip_rows(clips, "/in", "/out", "en", tmap, None, trim=True, top_db=TOP_DB, win=WIN, hop=HOP), out)
    return spark.read.parquet(out).where("kind = 'manifest'").select("id", "wav_path", "duration_sec", "transcript", "lang")


@register("write_run_without_manifest", """select 'errors' as kind, count(*) as n_rows, cast(0 as bigint) as n_manifest, count(*) as n_errors
from embeddings""")
def q_write_run_without_manifest(spark, d):
    """Every clip is too short at this sample rate, so no manifest is written: the kinds that read back
    and the numbers counted while they were written."""
    clips = V.clips_v(spark, d).select(F.concat(F.lit("/in/"), F.col("clip_id").cast("string"), F.lit(".wav")).alias("path"), "samples", F.lit(16_000).alias("sr"))
    out = scratch_path(spark, "run")
    good, bad = write_run(clip_rows(clips, "/in", "/out"), out)
    kinds = spark.read.parquet(out).groupBy("kind").agg(F.count(F.lit(1)).alias("n_rows"))
    return kinds.select("kind", "n_rows", F.lit(good).cast("long").alias("n_manifest"), F.lit(bad).cast("long").alias("n_errors"))


_EV = "ev as (select p.* from pairs_v p join documents d on d.doc_id = p.row_id where d.lang <> 'es')"


@register("evaluate_run", V.with_views(f""", wpe as (select sum(edits) as e, sum(n_ref) as n from wp),
ce as (select sum(levenshtein(ref, hyp)) as e, sum(length(ref)) as n from ev),
lab as (select c, coalesce(nt, 0) as n_true, coalesce(np, 0) as n_pred, coalesce(tp, 0) as tp from
  (select t as c, sum(n) as nt from conf group by t) full join (select p as c, sum(n) as np from conf group by p) using (c)
  left join (select t as c, n as tp from conf where t = p) using (c))
select round((select e / n from wpe), 6) as wer, round((select e / n from ce), 6) as cer,
  round((select sum(case when t = p then n else 0 end) / sum(n) from conf), 6) as accuracy,
  round(avg(case when n_pred > 0 then tp / n_pred else 0 end), 6) as precision,
  round(avg(case when n_true > 0 then tp / n_true else 0 end), 6) as recall,
  round(avg(case when tp > 0 then 2 * tp / (n_true + n_pred) else 0 end), 6) as f1 from lab""".lstrip(", "),
    "pairs_v", ctes=[_EV, _WER_PARTS.replace("from pairs_v", "from ev"), _CONF.replace("from pairs_v", "from ev")]
).replace("\nwpe as", ",\nwpe as", 1))
def q_evaluate_run(spark, d):
    doc = read_table(spark, d, "documents").select("doc_id", "lang", "source")
    p = V.pairs_v(spark, d).join(doc.withColumnRenamed("doc_id", "row_id"), "row_id")
    audio = F.concat(F.lit("/clips/"), F.col("source"), F.lit("/"), F.col("row_id").cast("string"), F.lit(".wav"))
    test = p.select("row_id", audio.alias("wav_path"), F.col("ref").alias("transcript"))
    hyps = p.select(audio.alias("audio"), "hyp")
    inventory = p.filter(F.col("lang") != "es").select(audio.alias("path"))
    pairs = eval_pairs(test, hyps, "/data/splits/test.csv", inventory)
    e = evaluate(pairs)
    return e.select(*[r6(c).alias(c) for c in ("wer", "cer", "accuracy", "precision", "recall", "f1")])
