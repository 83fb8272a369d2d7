import random
import zlib

import llm_cases as C
import numpy as np
import pytest
from pyspark.sql import functions as F
from dhvani.llm import quality, toxicity

SF1 = "/root/testdata/sf0.1"


def held_out(rows, sf, label, mod, rest):
    y = {r["doc_id"]: r[label] for r in C.read("labels", sf)}
    out = []
    for r in rows:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == rest)
        if r["held_out"] and r["doc_id"] in y:
            out.append((y[r["doc_id"]], r["predicted"]))
    return np.array(out)


def test_quality_held_out(spark):
    rows = quality.op9_quality(spark, SF1).collect()
    assert len(rows) == len(C.read("documents", SF1))
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)
    got = held_out(rows, SF1, "quality", 5, 0)
    assert len(got) > 300 and (got[:, 0] == got[:, 1]).mean() >= 0.97


def test_toxicity_held_out(spark):
    rows = toxicity.op10_toxicity(spark, SF1).collect()
    assert len(rows) == len(C.read("documents", SF1))
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)
    got = held_out(rows, SF1, "toxic", 3, 1)
    toxic, clean = got[got[:, 0] == 1], got[got[:, 0] == 0]
    assert toxic[:, 1].mean() >= 0.7 and clean[:, 1].mean() <= 0.01


@pytest.mark.parametrize("op", [quality.op9_quality, toxicity.op10_toxicity])
def test_labels_held_out_are_not_read(spark, tmp_path, op):
    """Turning the labels of held-out rows round changes no score."""
    mod, rest, label = (5, 0, "quality") if op is quality.op9_quality else (3, 1, "toxic")
    docs = [(r["doc_id"], r["text"]) for r in C.read("documents")]
    labels = C.read("labels")
    scores = []
    for turn in (False, True):
        folder = tmp_path / str(turn)
        folder.mkdir()
        rows = [r | {label: 1 - r[label]} if turn and zlib.crc32(str(r["doc_id"]).encode()) % mod == rest else r for r in labels]
        d = C.write(str(folder), documents=C.docs_of(docs), labels=(rows, C.LABELS))
        scores.append({r["doc_id"]: r["score"] for r in op(spark, d).collect()})
    assert scores[0] == scores[1]


@pytest.mark.parametrize("op", [quality.op9_quality, toxicity.op10_toxicity])
@pytest.mark.parametrize("labels", [[], [{"doc_id": 1, "quality": 1, "toxic": 0}],
                                    [{"doc_id": None, "quality": 1, "toxic": 0}, {"doc_id": 2, "quality": None, "toxic": None},
                                     {"doc_id": 1, "quality": 0, "toxic": 1}, {"doc_id": 1, "quality": 1, "toxic": 1},
                                     {"doc_id": 6, "quality": 1, "toxic": 0}, {"doc_id": 77, "quality": 1, "toxic": 0}]])
def test_cases(spark, tmp_path, op, labels):
    d = C.write(str(tmp_path), documents=C.docs_of(C.EDGE), labels=(labels, C.LABELS))
    rows = op(spark, d).collect()
    assert sorted(r["doc_id"] or 0 for r in rows) == sorted(i or 0 for i, _ in C.EDGE)
    assert all(0 <= r["score"] <= 1 for r in rows)
    d = C.write(str(tmp_path), documents=C.docs_of([]), labels=(labels, C.LABELS))
    assert op(spark, d).count() == 0


def maximal_segments(x):
    """All maximal-scoring segments by their recursive definition: the best segment,
    the shortest of equals, then the same to its left and right."""
    def of(a, b):
        best = (0, 0, 0, 0)
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += x[j]
                best = max(best, (round(total, 9), -(j - i), i, j))
        if best[0] <= 0:
            return []
        _, _, i, j = best
        return of(a, i) + [(i, j, best[0])] + of(j + 1, b)
    return of(0, len(x))


def test_segments_against_definition():
    r = random.Random(3)
    for _ in range(300):
        n = r.randint(1, 30)
        dense = [r.choice([-0.25, -0.25, -0.25, r.uniform(-3, 3)]) for _ in range(n)]
        at = [k for k, v in enumerate(dense) if v != -0.25]
        got = toxicity.segments(np.array(at, int), np.array([dense[k] for k in at], float), -0.25)
        want = maximal_segments(dense)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_passages_are_the_toxic_words(spark):
    docs = spark.createDataFrame([(i, ("plain text goes here " * 20) + ("awful slur " if i % 4 == 0 else "") + f"more words {i} here")
                                  for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    for r in toxicity.passages(docs, model).collect():
        text = ("plain text goes here " * 20) + ("awful slur " if r["doc_id"] % 4 == 0 else "") + f"more words {r['doc_id']} here"
        assert [text[p["start"]:p["end"]] for p in r["passages"]] == (["awful slur"] if r["doc_id"] % 4 == 0 else [])
        assert r["predicted"] == int(r["doc_id"] % 4 == 0)


def test_toxicity_stage(spark, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in C.read("documents")] + C.EDGE
    d = C.write(str(tmp_path), documents=C.docs_of(rows), labels=(C.read("labels"), C.LABELS))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = toxicity.stage(spark, docs, d)
    assert out.schema == docs.schema
    model = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"), toxicity.train_fold(F.col("doc_id")))
    bad = [(r["doc_id"], r["n_tokens"]) for r in toxicity.passages(docs, model).collect() if r["predicted"]]
    assert out.count() == len(rows) - len(bad)


def test_pair_tables_learn_what_features_alone_can_not():
    r = np.random.default_rng(0)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert {model.pairs[0][0], model.pairs[0][1]} == {0, 1}
