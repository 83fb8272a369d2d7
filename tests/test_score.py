"""Scoring: edge rows and brute-force checks written from the metric definitions."""

import math
import re
from collections import Counter

import pytest

from dhvani.functions.kernels import edit_distance_seq
from dhvani.operators import score as SC
from dhvani.plans.q_score import mt_pairs_v
from dhvani.sources import views as V


def pairs(spark, rows):
    return spark.createDataFrame([(i, r, h) for i, (r, h) in enumerate(rows)], "row_id long, ref string, hyp string")


def test_wer_cer_edge_rows(spark):
    w = SC.wer(pairs(spark, [("the cat sat on mat", "the cat sit on the mat")])).first()
    assert (w.edits, w.ref_words, w.wer) == (2, 5, 0.4)
    c = SC.cer(pairs(spark, [("abc", "abd")])).first()
    assert c.cer == pytest.approx(1 / 3)
    c2 = SC.cer(pairs(spark, [("नमस्ते", "नमस्त")])).first()
    assert c2.cer == pytest.approx(1 / 6)


def test_empty_references_raise(spark):
    with pytest.raises(Exception):
        SC.wer(pairs(spark, [("  ", "x")])).collect()


def test_char_accuracy_edge(spark):
    conf = SC.char_confusion(pairs(spark, [("ab", "b"), ("cd", "cd")]))
    a = SC.char_accuracy(conf).first()
    assert (a.accuracy, a.n_positions) == (0.0, 3)


def _dp(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            cur[j] = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y))
        prev = cur
    return prev[-1]


def test_wer_brute_force_sf0001(spark):
    p = V.pairs_v(spark, "/root/testdata/sf0.001").orderBy("row_id").limit(40)
    rows = p.collect()
    edits = sum(_dp(r.ref.split(), r.hyp.split()) for r in rows)
    words = sum(len(r.ref.split()) for r in rows)
    w = SC.wer(p).first()
    assert (w.edits, w.ref_words) == (edits, words)
    assert all(edit_distance_seq(r.ref[:300], r.hyp[:300]) == _dp(r.ref[:300], r.hyp[:300]) for r in rows[:10])


# ---- BLEU / chrF written from the definitions (sentence stats summed over the corpus)

def tok13a(line):
    line = line.rstrip().replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    if "&" in line:
        for a, b in [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]:
            line = line.replace(a, b)
    line = f" {line} "
    line = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", line)
    line = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", line)
    line = re.sub(r"([\.,])([^0-9])", r" \1 \2", line)
    line = re.sub(r"([0-9])(-)", r"\1 \2 ", line)
    return line.split()


def ref_bleu(refs, hyps):
    correct, total = [0] * 4, [0] * 4
    sys_len = ref_len = 0
    for r, h in zip(refs, hyps):
        rt, ht = tok13a(r), tok13a(h)
        sys_len, ref_len = sys_len + len(ht), ref_len + len(rt)
        for n in range(1, 5):
            rc = Counter(tuple(rt[i:i + n]) for i in range(len(rt) - n + 1))
            hc = Counter(tuple(ht[i:i + n]) for i in range(len(ht) - n + 1))
            correct[n - 1] += sum(min(c, rc[g]) for g, c in hc.items())
            total[n - 1] += max(0, len(ht) - n + 1)
    precs, smooth = [0.0] * 4, 1.0
    for n in range(4):
        if total[n] == 0:
            break
        if correct[n] == 0:
            smooth *= 2
            precs[n] = 100.0 / (smooth * total[n])
        else:
            precs[n] = 100.0 * correct[n] / total[n]
    bp = 1.0 if sys_len >= ref_len else (math.exp(1 - ref_len / sys_len) if sys_len > 0 else 0.0)
    return bp * math.exp(sum(math.log(p) if p > 0 else -9999999999 for p in precs) / 4)


def ref_chrf(refs, hyps, order=6, beta=2.0):
    stats = [[0, 0, 0] for _ in range(order)]
    for r, h in zip(refs, hyps):
        r, h = "".join(r.split()), "".join(h.split())
        for n in range(1, order + 1):
            rc = Counter(r[i:i + n] for i in range(len(r) - n + 1))
            hc = Counter(h[i:i + n] for i in range(len(h) - n + 1))
            stats[n - 1][0] += max(0, len(h) - n + 1)
            stats[n - 1][1] += max(0, len(r) - n + 1)
            stats[n - 1][2] += sum(min(c, rc[g]) for g, c in hc.items())
    p = rc_ = k = 0
    for ht, rt, m in stats:
        if ht > 0 and rt > 0:
            p, rc_, k = p + m / ht, rc_ + m / rt, k + 1
    if k == 0:
        return 0.0
    p, rc_ = p / k, rc_ / k
    f = beta * beta
    return 100 * (1 + f) * p * rc_ / (f * p + rc_) if p + rc_ else 0.0


SENTS = [("The cat sat on the mat.", "The cat sat on a mat!"),
         ("Prices rose 3.5% in 2019-2020, &quot;sharply&quot;.", "Prices rose 3.5 % in 2019 - 2020 \"sharply\"."),
         ("(a) b/c d:e", "a b c d e"), ("x", ""), ("नमस्ते दुनिया", "नमस्ते")]


def test_bleu_chrf_small(spark):
    df = pairs(spark, SENTS)
    b = SC.bleu(df).first().bleu
    c = SC.chrf(df).first().chrf
    refs, hyps = [r for r, _ in SENTS], [h for _, h in SENTS]
    assert b == pytest.approx(ref_bleu(refs, hyps), abs=1e-9)
    assert c == pytest.approx(ref_chrf(refs, hyps), abs=1e-9)


def test_bleu_chrf_identical_and_documents(spark):
    same = pairs(spark, [("a b c d e", "a b c d e")])
    assert SC.bleu(same).first().bleu == pytest.approx(100.0)
    assert SC.chrf(same).first().chrf == pytest.approx(100.0)
    df = mt_pairs_v(spark, "/root/testdata/sf0.001").orderBy("row_id").limit(30)
    rows = df.collect()
    refs, hyps = [r.ref for r in rows], [r.hyp for r in rows]
    assert SC.bleu(df).first().bleu == pytest.approx(ref_bleu(refs, hyps), abs=1e-9)
    assert SC.chrf(df).first().chrf == pytest.approx(ref_chrf(refs, hyps), abs=1e-9)


def test_char_macro_brute(spark):
    rows = [("abca", "abcb"), ("xyz", "xz")]
    conf = SC.char_confusion(pairs(spark, rows))
    m = SC.char_macro_prf(conf).first()
    t, p = "abcaxyz", "abcbxz"
    n = min(len(t), len(p))
    t, p = t[:n], p[:n]
    labels = sorted(set(t) | set(p))
    precs, recs, f1s = [], [], []
    for lab in labels:
        tp = sum(1 for a, b in zip(t, p) if a == b == lab)
        npred, ntrue = p.count(lab), t.count(lab)
        precs.append(tp / npred if npred else 0.0)
        recs.append(tp / ntrue if ntrue else 0.0)
        f1s.append(2 * tp / (npred + ntrue) if tp else 0.0)
    assert m.precision == pytest.approx(sum(precs) / len(labels))
    assert m.recall == pytest.approx(sum(recs) / len(labels))
    assert m.f1 == pytest.approx(sum(f1s) / len(labels))


def test_char_offsets_sparse_keys(spark):
    df = spark.createDataFrame([(5, "ab"), (70000, "c"), (2 ** 33, "def"), (2 ** 33 + 1, "")], "row_id long, text string")
    got = {r.row_id: r.offset for r in SC.char_offsets(df).collect()}
    assert got == {5: 0, 70000: 2, 2 ** 33: 3, 2 ** 33 + 1: 6}


def test_texts_are_prepared_once(spark):
    """No filter holds the expressions that make the texts, and few full scan tasks don't keep the pairs together."""
    for table in (V.pairs_v(spark, "/root/testdata/sf0.001"), SC.prepare(V.pairs_v(spark, "/root/testdata/sf0.001"))):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert not any("regexp_replace" in line for line in plan.split("\n") if "Filter" in line.split("(")[0].split())
    one = pairs(spark, [("a b c", "a b")] * 200).coalesce(1)
    assert SC.edits(one, ["word"]).rdd.glom().map(len).filter(lambda n: n > 0).count() > 4


def test_facing_counts_of_a_task_are_one_table():
    import pyarrow as pa

    from dhvani.functions.kernels import facing_counts
    batch = pa.RecordBatch.from_pydict({"rc": ["abc" * 200_000] * 6, "hc": ["abd" * 200_000 + "x"] * 6})
    out = [b.to_pydict() for b in facing_counts([batch, batch])]
    assert len(out) == 1 and dict(zip(zip(out[0]["t"], out[0]["p"]), out[0]["n"])) == {("a", "a"): 2_400_000, ("b", "b"): 2_400_000, ("c", "d"): 2_400_000}
