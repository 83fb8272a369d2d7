import hashlib
import random

import llm_cases as C
import pytest
from dhvani.llm import substring


@pytest.fixture
def rows():
    r = random.Random(5)
    text = lambda n: " ".join(f"v{r.randrange(500)}" for _ in range(n))
    passages = [text(n) for n in (49, 50, 51, 80, 200)]
    rows = list(C.EDGE)
    rows += [(100 + k, text(r.randint(0, 40)) + " " + r.choice(passages) + " " + text(r.randint(0, 40))) for k in range(80)]
    rows += [(300, "same " * 300), (299, "same " * 60), (301, passages[3]), (302, passages[3]), (302, passages[3]), (302, passages[4])]
    rows += [(400, passages[4] + "\n" + passages[2]), (None, passages[4]), (50, passages[0]), (401, passages[1])]
    return rows


def digests(rows, window):
    out = []
    for (i, t), gone in zip(rows, C.cut_words(rows, window)):
        kept = [w for w, g in zip(C.ascii_words(t, False), gone) if not g]
        out.append((i or 0, len(gone), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def test_against_brute_force(spark, tmp_path, rows):
    d = C.write(str(tmp_path), documents=C.docs_of(rows))
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.op4_substring_dedup(spark, d).collect())
    assert got == digests(rows, 50)


@pytest.mark.parametrize("window, subtree", [(16, 40), (50, 10), (20, 1 << 20)])
def test_other_windows_and_small_subtrees(spark, rows, window, subtree):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    spans = {}
    for r in substring.repeats(docs, window, subtree).collect():
        spans.setdefault(r["doc_id"], []).append(r["spans"])
    want = C.cut_words(rows, window)
    for (i, t), gone in zip(rows, want):
        lists = [[k for a, b in zip(s[::2], s[1::2]) for k in range(a, b)] for s in spans.get(i, [])]
        assert [k for k, g in enumerate(gone) if g] in (lists or [[]]) or not any(gone)


def test_driver_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in C.read("documents")]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.op4_substring_dedup(spark, C.SF).collect())
    assert got == digests(rows, 50)


def test_stage_cuts_words_out_of_the_text(spark, tmp_path, rows):
    d = C.write(str(tmp_path), documents=C.docs_of(rows))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = substring.stage(spark, docs, d)
    assert out.schema == docs.schema
    got = {r["row"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for k, ((_, t), gone) in enumerate(zip(rows, C.cut_words(rows, 50))):
        if not any(gone):
            assert got[k]["text"] == t
        else:
            assert C.ascii_words(got[k]["text"], False) == [w for w, g in zip(C.ascii_words(t, False), gone) if not g]
            assert got[k]["n_chars"] == len(got[k]["text"])


def test_empty_table(spark, tmp_path):
    assert substring.op4_substring_dedup(spark, C.write(str(tmp_path), documents=C.docs_of([]))).count() == 0
