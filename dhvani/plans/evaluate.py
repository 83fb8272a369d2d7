"""Evaluation run: test manifest + hypotheses -> WER, CER, character accuracy
and macro precision / recall / F1, as one-row DataFrames.

rename -> drop blank references -> resolve audio paths -> keep rows whose
audio exists (semi join with the inventory) -> strip + lower -> metrics.
The hypotheses table ``(audio, hyp)`` stands in for the model's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import resolve_path
from ..functions.text import ustrip
from ..operators import score as SC
from ..operators.lookup import semi_existing
from ..session import cut_lineage


def eval_pairs(test: DataFrame, hyps: DataFrame, csv_path: str, inventory: DataFrame | None = None,
               order: str = "row_id") -> DataFrame:
    """``(row_id, ref, hyp)`` ready for scoring."""
    t = test.withColumnsRenamed({"wav_path": "audio", "transcript": "text"})
    t = t.withColumn("text", ustrip(F.col("text").cast("string"))).filter(F.col("text") != "")
    t = t.withColumn("audio", resolve_path(F.col("audio"), csv_path))
    if inventory is not None:
        t = semi_existing(t, inventory, "audio", "path")
    # One hypothesis per path (the smallest of several), so a join can't multiply references.
    one = hyps.groupBy("audio").agg(F.min("hyp").alias("hyp"))
    j = t.join(one, "audio", "left")
    return j.select(F.col(order).alias("row_id"), F.col("text").alias("ref"), F.col("hyp"))


def evaluate(pairs: DataFrame, lowercase: bool = True) -> DataFrame:
    """One row: wer, cer, accuracy, precision, recall, f1.

    The prepared pairs are written once (``checkpoint``); both edit distances come
    from one pass over them, all character scores from one confusion table."""
    p = cut_lineage(SC.prepare(pairs, lowercase=lowercase))
    m = SC.char_macro_prf(SC.char_confusion(p, lowercase=False))
    rates = SC.error_rates(p).select(F.struct("wer", "cer").alias("s")).scalar()
    return m.select(rates["wer"].alias("wer"), rates["cer"].alias("cer"), "accuracy", "precision", "recall", "f1")
