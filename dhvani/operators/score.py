"""Corpus scoring: CER, WER, character accuracy and macro P/R/F1, BLEU, chrF.

Inputs are pair tables ``(row_id, ref, hyp)``; outputs are one-row DataFrames.

Scale notes
* CER/WER: one per-row edit distance (bit-parallel kernel on Arrow batches,
  see :mod:`dhvani.functions.kernels`) and a global sum: partial aggregation
  only, no shuffle of the texts.
* Character accuracy / macro scores compare the concatenated corpora position
  by position.  :func:`~dhvani.operators.prefix.text_blocks` puts the pairs into
  ranges of the row id and cuts both sides into blocks of ``BLOCK``
  characters in the task that holds the range; a block gathers at most ``BLOCK``
  characters of each side and is compared; only the (true, predicted, count)
  confusion table (at most alphabet^2 rows) leaves the tasks.
* BLEU/chrF: clipped n-gram matches are per-row statistics (sentence-level
  clipping), counted by a linear kernel per row and summed over the corpus
  with a partial aggregate: no n-gram is shuffled, so frequent n-grams cannot
  skew anything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import char_ngram_stats, edit_counts, facing_counts, word_ngram_stats
from ..functions.text import urstrip, ustrip
from ..session import cut_lineage, settled
from . import edit
from .prefix import prefix_sum, text_blocks

BLOCK = 4096


def _u_strip(c: Column) -> Column:
    return ustrip(c)


def prepare(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp", lowercase: bool = False) -> DataFrame:
    """Strip both sides (optionally lower-case); drop rows with a blank reference.
    A null hypothesis is read as empty."""
    r = _u_strip(F.col(ref))
    h = _u_strip(F.coalesce(F.col(hyp), F.lit("")))
    if lowercase:
        r, h = F.lower(r), F.lower(h)
    cols = [c for c in pairs.columns if c not in (ref, hyp)]
    return settled(pairs.select(*cols, r.alias("ref"), h.alias("hyp"))).filter(F.col("ref") != "")


def _collapse(c: Column) -> Column:
    """Runs of two or more whitespace characters -> one space, then strip: the metric
    library's rule.  A single tab or line end stays, so it joins two words, as there."""
    return _u_strip(F.regexp_replace(c, r"(?U)\s\s+", " "))


def _words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: F.length(w) > 0)


def guard(n_rows: Column, value: Column) -> Column:
    return F.when(n_rows > 0, value).otherwise(
        F.raise_error(F.lit("all references are empty: cannot compute metrics")))


def edits(pairs: DataFrame, units: Sequence[str] = ("word", "char")) -> DataFrame:
    """Per prepared pair and unit: its edits and reference tokens (``w_edits``, ``w_ref``, ``c_edits``, ``c_ref``).

    One pass writes these numbers.  Pairs whose sides both have more than ``edit.HUGE``
    tokens have none there yet; if there are any, they are cut into blocks that many
    tasks share (:mod:`dhvani.operators.edit`)."""
    names = {"word": ("w_edits", "w_ref"), "char": ("c_edits", "c_ref")}
    if "row_id" in pairs.columns:    # a scan may have few tasks with rows, whatever its splits
        pairs = pairs.repartition(4 * pairs.sparkSession.sparkContext.defaultParallelism, "row_id")
    rows = pairs.select(_collapse(F.col("ref")).alias("ref"), _collapse(F.col("hyp")).alias("hyp"))
    small, size = {}, {}
    for u in units:
        small[u] = F.least(edit.token_count(F.col("ref"), u), edit.token_count(F.col("hyp"), u)) <= edit.HUGE
        size[u] = edit.token_count(F.col("ref"), u).cast("long").alias(names[u][1])
    found = ", ".join(f"{c} long" for u in units for c in names[u])
    out = cut_lineage(rows.mapInArrow(edit_counts(list(units), edit.HUGE), found))
    for u in units:
        if out.where(F.col(names[u][0]).isNull()).isEmpty():
            continue
        huge = cut_lineage(rows.where(~small[u]).withColumn("h", F.monotonically_increasing_id()))
        late = huge.join(edit.block_distances(huge, u), "h").select(F.col("distance").alias(names[u][0]), size[u])
        # The rows without a number count nothing; the late ones bring it and their length.
        known = F.col(names[u][0]).isNotNull()
        out = out.withColumn(names[u][1], F.when(known, F.col(names[u][1]))).unionByName(late, allowMissingColumns=True)
    return out


def error_rates(pairs: DataFrame, guarded: bool = True) -> DataFrame:
    """One row of prepared pairs: ``wer``, ``cer`` and their number ``n``."""
    n = F.count("c_ref")
    rates = [F.sum(f"{u}_edits") / F.sum(f"{u}_ref") for u in "wc"]
    return edits(pairs).agg(*[(guard(n, r) if guarded else r).alias(c) for r, c in zip(rates, ("wer", "cer"))], n.alias("n"))


def wer(pairs: DataFrame, lowercase: bool = False) -> DataFrame:
    """Corpus WER = sum of word edits / sum of reference words (one row)."""
    e = edits(prepare(pairs, lowercase=lowercase), ["word"])
    n = F.count("w_ref")
    return e.agg(guard(n, F.sum("w_edits") / F.sum("w_ref")).alias("wer"),
                 F.sum("w_edits").alias("edits"), F.sum("w_ref").alias("ref_words"), n.alias("n_pairs"))


def cer(pairs: DataFrame, lowercase: bool = False) -> DataFrame:
    """Corpus CER = sum of character edits / sum of reference characters (one row)."""
    e = edits(prepare(pairs, lowercase=lowercase), ["char"])
    n = F.count("c_ref")
    return e.agg(guard(n, F.sum("c_edits") / F.sum("c_ref")).alias("cer"),
                 F.sum("c_edits").alias("edits"), F.sum("c_ref").alias("ref_chars"), n.alias("n_pairs"))


def error_rates_percent_safe(pairs: DataFrame, lowercase: bool = False) -> DataFrame:
    """WER and CER in percent; 100.0 for both when any hypothesis is missing
    (undecodable), mirroring the training-time metric's fallback.  Then no distance is computed.
    Without a missing one, references that are all blank are an error."""
    missing = pairs.agg(F.coalesce(F.max(F.col("hyp").isNull().cast("int")), F.lit(0)).alias("m")).scalar()
    e = error_rates(prepare(pairs.where(missing == 0), lowercase=lowercase), guarded=False)
    return e.select(*[F.when(missing == 1, F.lit(100.0)).otherwise(guard(F.col("n"), 100.0 * F.col(c))).alias(c) for c in ("wer", "cer")])


# ---- character accuracy and macro scores over the concatenated corpora ----------

def char_offsets(df: DataFrame, row: str = "row_id", text: str = "text") -> DataFrame:
    """``(row, length, offset)``: offset = characters of all earlier rows."""
    x = df.select(F.col(row).alias("row_id"), F.length(F.col(text)).cast("long").alias("len"),
                  F.col(text).alias("text"))
    return prefix_sum(x, "row_id", "len", "offset")


def char_confusion(pairs: DataFrame, lowercase: bool = True) -> DataFrame:
    """``(t, p, n)``: how often reference character t faces hypothesis
    character p at the same position of the concatenated corpora (cut to the
    shorter one), in ``row_id`` order."""
    pieces = text_blocks(prepare(pairs, lowercase=lowercase), "row_id", ("ref", "hyp"), BLOCK)
    parts = F.array_sort(F.collect_list(F.struct("side", "s", "piece")))
    blocks = pieces.groupBy("blk").agg(parts.alias("x"))
    text = [F.array_join(F.transform(F.filter("x", on), lambda t: t["piece"]), "") for on in (lambda t: t["side"] == 0, lambda t: t["side"] == 1)]
    # Both corpora start at position 0, so a position survives the cut to the
    # shorter corpus exactly when the block holds a character of both there.
    facing = blocks.select(text[0].alias("rc"), text[1].alias("hc")).where("rc <> '' and hc <> ''")
    return facing.mapInArrow(facing_counts, "t string, p string, n long").groupBy("t", "p").agg(F.sum("n").alias("n"))


def char_accuracy(conf: DataFrame) -> DataFrame:
    """Share of aligned positions whose characters agree (one row)."""
    return conf.agg((F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"),
                    F.sum("n").alias("n_positions"))


def char_macro_prf(conf: DataFrame) -> DataFrame:
    """Unweighted mean over labels (characters on either side) of precision,
    recall and F1; a zero denominator gives 0.  With the accuracy, which the same
    totals give."""
    # each (t, p, n) counts n toward label t's true total (and its hits when
    # t = p) and toward label p's predicted total: one aggregate, no joins
    contrib = F.explode(F.array(
        F.struct(F.col("t").alias("c"), F.col("n").alias("nt"), F.lit(0).cast("long").alias("np"),
                 F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).cast("long").alias("hit")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("nt"), F.col("n").alias("np"),
                 F.lit(0).cast("long").alias("hit"))))
    labels = (conf.select(contrib.alias("x")).groupBy(F.col("x.c").alias("c"))
              .agg(F.sum("x.nt").alias("n_true"), F.sum("x.np").alias("n_pred"), F.sum("x.hit").alias("tp")))
    prec = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)
    rec = F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).otherwise(0.0)
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("n_true") + F.col("n_pred"))).otherwise(0.0)
    return labels.agg(F.avg(prec).alias("precision"), F.avg(rec).alias("recall"), F.avg(f1).alias("f1"),
                      F.count(F.lit(1)).alias("n_labels"), (F.sum("tp") / F.sum("n_true")).alias("accuracy"))


# ---- BLEU ------------------------------------------------------------------------

# The 13a tokeniser's rules (applied in this order).
TOK13A_UNESCAPE = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
TOK13A_RULES = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]
MAX_ORDER = 4
CHAR_ORDER = 6
BETA = 2.0


def _rstrip(c: Column) -> Column:
    return urstrip(c)


def tokenize_13a(c: Column) -> Column:
    """13a tokenisation -> single-space separated tokens."""
    t = F.replace(_rstrip(c), F.lit("<skipped>"), F.lit(""))
    t = F.replace(t, F.lit("-\n"), F.lit(""))
    t = F.replace(t, F.lit("\n"), F.lit(" "))
    for a, b in TOK13A_UNESCAPE:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    for pat, rep in TOK13A_RULES:
        t = F.regexp_replace(t, pat, rep)
    return _u_strip(F.regexp_replace(t, r"(?U)\s+", " "))


def _ngram_sums(pairs: DataFrame, stats: Column, orders: int) -> DataFrame:
    """One row, ``hyp_total_n``, ``ref_total_n``, ``matches_n`` for n = 1..orders: per-row
    statistics summed over the corpus (partial aggregation; nothing is shuffled but the
    sums, and the corpus is read once)."""
    names = [f"{c}_{n}" for n in range(1, orders + 1) for c in ("hyp_total", "ref_total", "matches")]
    return pairs.select(stats.alias("_s")).agg(*[F.sum(F.col("_s")[i]).alias(c) for i, c in enumerate(names)])


def bleu(pairs: DataFrame) -> DataFrame:
    """Corpus BLEU (13a tokens, 4-grams, exponential smoothing, one
    reference), 0-100 scale, with its parts."""
    p = pairs.select("row_id", tokenize_13a(F.coalesce("ref", F.lit(""))).alias("rt"),
                     tokenize_13a(F.coalesce("hyp", F.lit(""))).alias("ht"))
    w = _ngram_sums(p, word_ngram_stats(F.col("rt"), F.col("ht"), MAX_ORDER), MAX_ORDER)
    # sequential precision rule: a zero count doubles the smoothing divisor;
    # an order with no n-grams (and all above it) scores 0
    precs = []
    smooth = F.lit(1.0)
    alive = F.lit(True)
    for k in range(1, MAX_ORDER + 1):
        tot, cor = F.coalesce(F.col(f"hyp_total_{k}"), F.lit(0)), F.coalesce(F.col(f"matches_{k}"), F.lit(0))
        alive = alive & (tot > 0)
        smooth = F.when(alive & (cor == 0), smooth * 2).otherwise(smooth)
        precs.append(F.when(~alive, F.lit(0.0))
                     .when(cor == 0, F.lit(100.0) / (smooth * tot))
                     .otherwise(F.lit(100.0) * cor / tot))
    logs = [F.when(pr > 0, F.log(pr)).otherwise(F.lit(-9999999999.0)) for pr in precs]
    mean_log = sum(logs[1:], logs[0]) / MAX_ORDER
    sys_len, ref_len = F.col("hyp_total_1"), F.col("ref_total_1")
    bp = (F.when(sys_len >= ref_len, F.lit(1.0))
          .when(sys_len > 0, F.exp(F.lit(1.0) - ref_len / sys_len)).otherwise(F.lit(0.0)))
    return w.select((bp * F.exp(mean_log)).alias("bleu"), bp.alias("bp"),
                    *[pr.alias(f"p{k}") for k, pr in enumerate(precs, 1)],
                    sys_len.alias("sys_len"), ref_len.alias("ref_len"))


def chrf(pairs: DataFrame) -> DataFrame:
    """Corpus chrF (character 1..6-grams, whitespace removed, beta 2), 0-100 scale."""
    nows = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")
    p = pairs.select("row_id", nows(F.col("ref")).alias("rs"), nows(F.col("hyp")).alias("hs"))
    sums = _ngram_sums(p, char_ngram_stats(F.col("rs"), F.col("hs"), CHAR_ORDER), CHAR_ORDER)
    rows = [F.struct(*[F.col(f"{c}_{n}").alias(c) for c in ("hyp_total", "ref_total", "matches")]) for n in range(1, CHAR_ORDER + 1)]
    st = sums.select(F.inline(F.array(*rows)))
    ok = (F.col("hyp_total") > 0) & (F.col("ref_total") > 0)
    agg = st.agg(F.sum(F.when(ok, F.col("matches") / F.col("hyp_total"))).alias("_p"),
                 F.sum(F.when(ok, F.col("matches") / F.col("ref_total"))).alias("_r"),
                 F.count_if(ok).alias("_k"))
    prec = F.when(F.col("_k") > 0, F.col("_p") / F.col("_k")).otherwise(0.0)
    rec = F.when(F.col("_k") > 0, F.col("_r") / F.col("_k")).otherwise(0.0)
    f = F.lit(BETA * BETA)
    score = F.when(prec + rec > 0, 100.0 * (1 + f) * prec * rec / (f * prec + rec)).otherwise(0.0)
    return agg.select(score.alias("chrf"), prec.alias("char_precision"), rec.alias("char_recall"))
