"""Edit distances against the table by definition: bands, blocks and blocks dealt to tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dhvani.functions import kernels as K
from dhvani.operators import edit, score


def plain(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def pairs(n: int, seed: int = 1):
    r = random.Random(seed)
    for _ in range(n):
        letters = "ab" if r.random() < 0.3 else "abcdefgé 𝔘"
        a = "".join(r.choice(letters) for _ in range(r.choice((0, 1, 5, 40, 150))))
        if r.random() < 0.5:
            b = "".join(r.choice(letters) for _ in range(r.choice((0, 1, 7, 60))))
        else:
            b = "".join(c for x in a for c in r.choice([[x]] * 8 + [[], ["z"], [x, "y"]]))
        yield a, b


@pytest.mark.parametrize("band, stripe", [(32, 1024), (1, 3), (2, 1)])
def test_bands_against_the_table(monkeypatch, band, stripe):
    monkeypatch.setattr(K, "BAND", band)
    monkeypatch.setattr(K, "STRIPE", stripe)
    for a, b in pairs(400):
        assert K.edit_distance_seq(a, b) == plain(a, b)
    words = [(a.split(" "), b.split(" ")) for a, b in pairs(60, 2)]
    for a, b in words:
        assert K.edit_distance_seq(a, b) == plain(a, b)


def test_a_band_proves_its_result_or_gives_none():
    for a, b in pairs(300, 3):
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        want = plain(a, b)
        for e in (0, 1, 3, 9, len(b)):
            if b:
                got = K.banded_distance(a, b, min(e, len(b)))
                assert got == (want if want <= len(a) - len(b) + 2 * min(e, len(b)) + 1 else None)


def test_masks_of_long_rows():
    r = random.Random(4)
    a = "".join(r.choice("abcdef") for _ in range(1000))
    assert K._masks(a, set("abcx")) == {c: sum(1 << i for i, x in enumerate(a) if x == c) for c in "abc"}


def test_blocks_pass_borders_on():
    r = random.Random(5)
    for _ in range(40):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(1, 50))) for _ in range(2))
        cut_a, cut_b = r.randint(1, 20), r.randint(1, 20)
        rows, cols = [a[k:k + cut_a] for k in range(0, len(a), cut_a)], [b[k:k + cut_b] for k in range(0, len(b), cut_b)]
        right = {i: ((1 << len(x)) - 1, 0) for i, x in enumerate(rows)}
        total = len(a)
        for y in cols:
            low = ((1 << len(y)) - 1, 0)
            for i, x in enumerate(rows):
                vp, vn, *low = K.block_distance(K._masks(x, set(y)), len(x), y, *right[i], *low)
                right[i] = vp, vn
            total += low[0].bit_count() - low[1].bit_count()
        assert total == plain(a, b)


@pytest.mark.parametrize("unit", ["char", "word"])
def test_huge_pairs_by_blocks(spark, monkeypatch, unit):
    monkeypatch.setattr(edit, "BLOCK", 60 if unit == "char" else 20)
    r = random.Random(6)
    texts = []
    for k, n in enumerate((1, 20, 21, 45, 60)):
        words = [r.choice(["ab", "c", "dé", "the"]) for _ in range(n)]
        other = [w for w in words if r.random() < 0.8] or ["x"]
        texts.append((k, " ".join(words), " ".join(other)))
    texts += [(10, "a" * 70, "b" * 20), (11, "x y z", " ".join(["q"] * 55)), (12, "same text " * 9 + "x", "same text " * 9 + "x")]
    df = spark.createDataFrame(texts, "h long, ref string, hyp string")
    got = {x.h: x.distance for x in edit.block_distances(df, unit).collect()}
    cut = (lambda t: t) if unit == "char" else (lambda t: t.split(" "))
    assert got == {h: plain(cut(a), cut(b)) for h, a, b in texts}
    assert edit.block_distances(df.where("h < 0"), unit).count() == 0


def test_rates_with_huge_pairs(spark, monkeypatch):
    rows = [(k, a or "r", b) for k, (a, b) in enumerate(pairs(40, 7))] + [(99, "a b c", None)]
    df = spark.createDataFrame(rows, "row_id long, ref string, hyp string")
    want = score.cer(df).collect(), score.wer(df).collect(), score.error_rates(score.prepare(df)).collect()
    monkeypatch.setattr(edit, "HUGE", 20)
    monkeypatch.setattr(edit, "BLOCK", 100)
    assert (score.cer(df).collect(), score.wer(df).collect(), score.error_rates(score.prepare(df)).collect()) == want


def test_a_long_pair_is_shared_by_tasks(spark, monkeypatch):
    """No task gets more than a block of a pair; the distance is that of the kernel."""
    monkeypatch.setattr(edit, "BLOCK", 2048)
    r = np.random.default_rng(8)
    a = "".join(r.choice(list("abcdefgh "), 8_000))
    b = "".join(c for k, c in enumerate(a) if k % 9)
    df = spark.createDataFrame([(0, a, b)], "h long, ref string, hyp string")
    seen = spark.sparkContext.accumulator(0)
    step = edit._step("char")

    def watched(unit):
        def run(frames):
            for f in frames:
                for rows in f["rows"]:
                    assert len(rows) <= 2048
                seen.add(len(f))
                yield from step([f])
        return run
    monkeypatch.setattr(edit, "_step", watched)
    assert edit.block_distances(df).first()["distance"] == K.edit_distance_seq(a, b)
    assert seen.value >= 10


def test_no_distance_where_a_hypothesis_is_missing(spark):
    """The metric's fallback; and its guard against blank references."""
    df = spark.createDataFrame([(0, "a b", "a"), (1, "c d", None)], "row_id long, ref string, hyp string")
    called = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: called.add(1) or x, "string")
    out = score.error_rates_percent_safe(df.withColumn("ref", count("ref"))).first()
    assert (out.wer, out.cer) == (100.0, 100.0)
    assert called.value == 0
    with pytest.raises(Exception, match="references are empty"):
        score.error_rates_percent_safe(df.where("hyp is not null").withColumn("ref", F.lit(" "))).collect()


@pytest.mark.parametrize("band, words", [(32, 1 << 14), (1, 1 << 14), (3, 40)])
def test_pairs_filled_together(monkeypatch, band, words):
    """Many pairs a step: bands of one and of many words, pairs that end early, carries through full words."""
    monkeypatch.setattr(K, "BAND", band)
    monkeypatch.setattr(K, "NEAR", 1 << 30)
    monkeypatch.setattr(K, "BATCH_WORDS", words)
    together, batch = [0], K._banded_batch

    def counted(items, e, words):
        together[0] += len(items)
        return batch(items, e, words)
    monkeypatch.setattr(K, "_banded_batch", counted)
    some = list(pairs(600, 12)) + [("x" * 900 + str(k), "y" * k) for k in range(1, 200, 7)] * 2
    some += [("ab" * 300 + "c" * k, "ba" * 150 + "d" * k) for k in range(60)]
    assert K.edit_distances(some) == [K.edit_distance_seq(a, b) for a, b in some]
    assert words == 40 or together[0] > 200
    split = [(a.split(" "), b.split(" ")) for a, b in some]
    assert K.edit_distances(split) == [K.edit_distance_seq(a, b) for a, b in split]
    assert K.edit_distances([]) == []


def test_batch_alone_against_the_table():
    r = random.Random(13)
    rows = []
    for _ in range(40):
        a = [r.randrange(5) for _ in range(r.randint(60, 300))]
        rows.append((a, [x for x in a if r.random() < 0.8] or [0]))
    rows.sort(key=lambda x: -len(x[1]))
    items = [(np.array(a), np.array(b), 5) for a, b in rows]
    slant = max(len(a) - len(b) for a, b in rows)
    for e in (40, 300):
        got = K._banded_batch(items, e, (slant + 2 * e) // 64 + 1).tolist()
        for (a, b), d in zip(rows, got):
            want = plain(a, b)
            assert d == want or (want > len(a) - len(b) + 2 * e + 1 and d > want)


def test_batches_are_taken_in_slices():
    """A kernel holds the strings of a bounded part of a batch, whatever the batch's rows."""
    import pyarrow as pa
    texts = ["a" * n for n in (10, 0, 5, 50, 3, 3, 90, 1)] + [None]
    batch = pa.RecordBatch.from_pydict({"k": list(range(9)), "t": pa.array(texts, pa.string())})
    parts = [p.to_pydict() for p in K.sliced(batch, 20)]
    assert [t for p in parts for t in p["t"]] == texts
    assert all(len(p["t"]) == 1 or sum(len(t or "") for t in p["t"]) <= 20 for p in parts)
