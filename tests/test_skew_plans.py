"""Hot keys are combined map-side: keep-first and last-wins run a partial
aggregate before their shuffle, and a key holding a third of all rows still
gives the right answer."""

from pyspark.sql import functions as F

from dhvani.operators.manifest import keep_first
from dhvani.sources.transcripts import last_wins


def _partial_before_exchange(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    ex = [i for i, l in enumerate(lines) if "Exchange hashpartitioning" in l]
    assert ex, plan
    below = "\n".join(lines[ex[0]:])
    return "partial_" in below or "Partial" in below


def test_keep_first_hot_key(spark):
    hot = spark.range(3000).select(F.lit("/hot.wav").alias("wav_path"), F.col("id").alias("row_ord"),
                                   F.lit(0).alias("src_ord"))
    rest = spark.range(6000).select(F.col("id").cast("string").alias("wav_path"), F.col("id").alias("row_ord"),
                                    F.lit(1).alias("src_ord"))
    out = keep_first(hot.unionByName(rest), "wav_path")
    assert _partial_before_exchange(out)
    r = out.filter(F.col("wav_path") == "/hot.wav").collect()
    assert len(r) == 1 and r[0].row_ord == 0 and out.count() == 6001


def test_last_wins_hot_key(spark):
    e = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("key"),
                                 F.col("id").cast("string").alias("text"), F.col("id").alias("line_ord"))
    out = last_wins(e)
    assert _partial_before_exchange(out)
    assert out.filter(F.col("key") == "hot").first().text == "8997"
