"""Signal queries over clips made from the embeddings table (64-sample clips:
window 16 and hop 8 stand in for 400 and 160; rate 100 samples/s)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signal as SG
from ..operators import frames as FR
from ..sources import views as V
from ..sources.tables import read_table
from .catalog import r6, register

WIN, HOP, SR, TOP_DB = 16, 8, 100, 30.0
NOISE_K = 5

_CLIPS = "clips as (select vec_id as clip_id, list_transform(embedding, lambda x: cast(x as double)) as s from embeddings)"


def _clips(spark, d):
    return V.clips_v(spark, d)


def _explode(df, arr, vname="v", rnd=True):
    """One row per array element.  ``posexplode_outer`` plus an explicit filter:
    a plain ``posexplode`` makes the optimiser infer ``size(arr) > 0`` and push
    it below the projections, where the whole array pipeline is inlined again."""
    x = df.select("clip_id", F.posexplode_outer(arr).alias("i", vname)).filter(F.col("i").isNotNull())
    return x.select("clip_id", (F.col("i") + 1).alias("i"), r6(vname).alias(vname) if rnd else F.col(vname))


def _unnest_sql(arr_expr, src, v="v", rnd=True):
    val = f"round({v}, 6)" if rnd else v
    return (f"select clip_id, i, {val} as {v} from (select clip_id, unnest(range(1, len({arr_expr}) + 1)) as i, "
            f"unnest({arr_expr}) as {v} from {src})")


# ---- I1 mono mixdown: consecutive embeddings as the two channels of a clip ------------

@register("mono_mix", """select clip_id, i, round(avg(v), 6) as v from (
  select vec_id // 2 as clip_id, unnest(range(1, len(embedding) + 1)) as i, unnest(embedding) as v from embeddings)
group by clip_id, i""")
def q_mono_mix(spark, d):
    emb = read_table(spark, d, "embeddings")
    ch = emb.groupBy((F.col("vec_id") / 2).cast("long").alias("clip_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda t: t["embedding"]).alias("ch"))
    return _explode(ch.select("clip_id", SG.mono_mix(F.col("ch")).alias("m")), "m")


# ---- I2 peak normalisation, I3 16-bit quantisation, I9 pad/cut --------------------------

@register("peak_normalize", "with " + _CLIPS + ", pk as (select clip_id, list_transform(s, lambda x: x / (list_max(list_transform(s, lambda y: abs(y))) + 1e-8)) as n from clips)\n"
          + _unnest_sql("n", "pk"))
def q_peak_normalize(spark, d):
    c = _clips(spark, d)
    return _explode(c.select("clip_id", SG.peak_normalize(F.col("samples")).alias("n")), "n")


@register("pcm16", "with " + _CLIPS + ", q as (select clip_id, list_transform(s, lambda x: cast(round_even(greatest(-1.0, least(1.0, x)) * 32767, 0) as integer)) as q from clips)\n"
          + _unnest_sql("q", "q", rnd=False))
def q_pcm16(spark, d):
    c = _clips(spark, d)
    x = c.select("clip_id", F.posexplode_outer(SG.pcm16(F.col("samples"))).alias("i", "v")).filter(F.col("i").isNotNull())
    return x.select("clip_id", (F.col("i") + 1).alias("i"), F.col("v").cast("int").alias("v"))


@register("pad_cut", """with p as (select vec_id as clip_id, list_resize(list_transform(embedding, lambda x: cast(x as double)), 48 + 8 * label, 0.0) as p from embeddings)
""" + _unnest_sql("p", "p"))
def q_pad_cut(spark, d):
    emb = read_table(spark, d, "embeddings")
    x = emb.select(F.col("vec_id").alias("clip_id"), SG.pad_cut(F.col("embedding"), F.lit(48) + 8 * F.col("label")).alias("p"))
    return _explode(x.select("clip_id", SG.as_double(F.col("p")).alias("p")), "p")


# ---- I4 frame energies -------------------------------------------------------------------

_FRAMES = f"""fe as (select clip_id, st // {HOP} as frame_no,
  list_sum(list_transform(s[st + 1: least(st + {WIN}, len(s))], lambda v: v * v)) / (least(st + {WIN}, len(s)) - st) as energy
  from (select clip_id, s, unnest(range(0, len(s), {HOP})) as st from clips))"""


@register("frame_energy", f"with {_CLIPS}, {_FRAMES}\nselect clip_id, frame_no, round(energy, 6) as energy from fe")
def q_frame_energy(spark, d):
    c = _clips(spark, d).select("clip_id", F.posexplode_outer(SG.frame_energies(F.col("samples"), WIN, HOP)).alias(
        "frame_no", "e")).filter(F.col("frame_no").isNotNull())
    return c.select("clip_id", "frame_no", r6("e").alias("energy"))


# ---- E8 silence intervals, I5 silence trim, I6 duration, B6 too-short -----------------------

_GATED = """gated as (select vec_id as clip_id, list_transform(embedding, lambda x, i:
  cast(cast(x * case when ((i - 1) // 16 + label) % 3 = 0 then 0.001 else 1.0 end as float) as double)) as s from embeddings)"""

_SILENCE = f"""ce as (select clip_id, k, n, list_sum(list_transform(s[greatest(k * {HOP} - {WIN // 2}, 0) + 1: least(k * {HOP} + {WIN // 2}, n)],
    lambda v: v * v)) / {WIN} as e
  from (select clip_id, s, len(s) as n, unnest(range(0, len(s) // {HOP} + 1)) as k from gated)),
kp as (select clip_id, k, n, 10 * log10(greatest(1e-10, e)) - 10 * log10(greatest(1e-10, max(e) over (partition by clip_id))) > -{TOP_DB} as keep from ce),
isl as (select clip_id, n, k, k - row_number() over (partition by clip_id order by k) as g from kp where keep),
iv as (select clip_id, min(k) * {HOP} as "start", least((max(k) + 1) * {HOP}, min(n)) as "end" from isl group by clip_id, g),
ivk as (select clip_id, row_number() over (partition by clip_id order by "start") - 1 as k, "start", "end" from iv),
smp as (select clip_id, unnest(range(0, len(s))) as j, unnest(s) as v from gated),
trimmed as (select smp.clip_id, row_number() over (partition by smp.clip_id order by smp.j) as i, smp.v from smp
  join iv on smp.clip_id = iv.clip_id and iv."start" <= smp.j and smp.j < iv."end")"""


def _gated(spark, d):
    """Clips with silent stretches: 16-sample blocks whose index plus the
    clip's label is a multiple of 3 are attenuated by 60 dB."""
    emb = read_table(spark, d, "embeddings")
    g = F.transform("embedding", lambda x, i: (x * F.when(((F.floor(i / 16) + F.col("label")) % 3) == 0, F.lit(0.001))
                                               .otherwise(F.lit(1.0))).cast("float"))
    return emb.select(F.col("vec_id").alias("clip_id"), g.alias("samples"))


def _trimmed(spark, d):
    return FR.trim_silence(_gated(spark, d), "samples", "t", TOP_DB, WIN, HOP).select("clip_id", "t")


@register("silence_intervals", f"with {_GATED}, {_SILENCE}\nselect clip_id, k, \"start\", \"end\" from ivk")
def q_silence_intervals(spark, d):
    c = FR.with_silence_intervals(_gated(spark, d), "samples", "iv", TOP_DB, WIN, HOP).select(
        "clip_id", F.posexplode_outer("iv").alias("k", "iv")).filter(F.col("k").isNotNull())
    return c.select("clip_id", "k", F.col("iv.start").alias("start"), F.col("iv.end").alias("end"))


@register("trim_silence", f"with {_GATED}, {_SILENCE}\nselect clip_id, i, round(v, 6) as v from trimmed")
def q_trim_silence(spark, d):
    return _explode(_trimmed(spark, d).select("clip_id", SG.as_double(F.col("t")).alias("t")), "t")


@register("clip_duration", f"with {_GATED}, {_SILENCE}\nselect clip_id, round(count(*) / {SR}.0, 3) as duration_sec from trimmed group by clip_id")
def q_clip_duration(spark, d):
    return _trimmed(spark, d).select("clip_id", SG.duration(F.col("t"), SR).alias("duration_sec"))


@register("too_short", f"""with {_GATED}, {_SILENCE}
select clip_id, case when count(*) < {int(0.3 * SR)} then 'too_short' end as error from trimmed group by clip_id""")
def q_too_short(spark, d):
    t = _trimmed(spark, d)
    return t.select("clip_id", F.when(SG.too_short(F.col("t"), SR), F.lit("too_short")).alias("error"))


# ---- I7 percentile trim ------------------------------------------------------------------

@register("trim_percentile", f"""with {_CLIPS}, {_FRAMES},
th as (select clip_id, quantile_cont(energy, 0.1) as th from fe group by clip_id),
kept as (select fe.clip_id, fe.frame_no from fe join th using (clip_id) where energy > th),
parts as (select k.clip_id, k.frame_no, unnest(range(k.frame_no * {HOP}, least(k.frame_no * {HOP} + {WIN}, len(c.s)))) as j, c.s
  from kept k join clips c using (clip_id)),
tp as (select clip_id, row_number() over (partition by clip_id order by frame_no, j) as i, s[j + 1] as v from parts),
none as (select c.clip_id, unnest(range(1, len(c.s) + 1)) as i, unnest(c.s) as v from clips c where c.clip_id not in (select clip_id from kept))
select clip_id, i, round(v, 6) as v from tp union all select clip_id, i, round(v, 6) from none""")
def q_trim_percentile(spark, d):
    c = FR.trim_percentile(_clips(spark, d), "samples", "t", 0.10, WIN, HOP)
    return _explode(c.select("clip_id", SG.as_double(F.col("t")).alias("t")), "t")


# ---- I8 spectral noise floor ----------------------------------------------------------------

@register("noise_floor_subtract", V.with_views(f"""ex as (select clip_id, frame_no, unnest(range(0, len(mag))) as bin, unnest(mag) as v from spec_v),
nz as (select clip_id, bin, median(cast(v as double)) as med from ex where frame_no < {NOISE_K} group by clip_id, bin)
select clip_id, frame_no, bin, round(greatest(cast(v as double) - 0.8 * med, 0), 6) as value from ex join nz using (clip_id, bin)""",
                                                "spec_v").replace("\nex as", ",\nex as", 1))
def q_noise_floor(spark, d):
    out = FR.noise_floor_subtract(V.spec_v(spark, d), NOISE_K, 0.8)
    x = out.select("clip_id", "frame_no", F.posexplode("mag").alias("bin", "value"))
    return x.select("clip_id", "frame_no", "bin", r6("value").alias("value"))
