import numpy as np
import pyarrow as pa
import pytest
from dhvani.llm import negatives
from harness import compare, duck

import llm_cases as C

SCHEMA = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32()), ("bucket", pa.string())])


def brute(rows):
    ok = {(i, (lab + 1) % 10 if i % 7 == 0 else lab, tuple(int(c) for c in np.floor(256 * np.asarray(x, float))))
          for i, x, lab in rows if i is not None and x is not None and lab is not None and None not in x and np.isfinite(x).all()}
    out = []
    for a in {i for i, _, _ in ok if i % 50 == 0}:
        _, lab, v = min((r for r in ok if r[0] == a), key=lambda r: (r[1], negatives.pack(np.array(r[2], np.int64))))
        scored = sorted((-sum(x * y for x, y in zip(v, u)), i, m) for i, m, u in ok if i != a)
        for s, p, _ in [r for r in scored if r[2] == lab][:5]:
            found = [(-t, n) for t, n, m in scored if m != lab and -50 * s <= -100 * t <= -95 * s][:3]
            out += [(a, p, k + 1, n, -s, t) for k, (t, n) in enumerate(found)]
    return sorted(out)


def got(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def rows():
    r = np.random.default_rng(1)
    base = r.normal(size=(6, 8))
    rows = [(i, ((base[i % 6] + 0.4 * r.normal(size=8)) * (1 + i % 5)).tolist(), int(r.integers(0, 4))) for i in range(800)]
    same = [0.25] * 8
    rows += [(i, same, i % 3) for i in range(1000, 1300)]  # one vector, many ids: ties
    rows += [(i, [0.25] * 7 + [0.1], 3) for i in range(1300, 1400)]
    rows += [(50, rows[50][1], rows[50][2]), (2000, [0.0] * 8, 1), (None, same, 1), (2050, None, 1), (2100, [float("nan")] * 8, 1), (2150, [None] * 8, 1)]
    rows += [(2200, [float("inf")] + [0.0] * 7, 2), (2250, same, None), (2300, [0.3] * 5, 2), (2350, [900.0] * 8, 2), (-50, same, 0), (2400, [], 0)]
    return rows


@pytest.mark.parametrize("page, queries", [(1 << 15, 1 << 13), (40, 3)])
def test_against_brute_force(spark, tmp_path, rows, monkeypatch, page, queries):
    monkeypatch.setattr(negatives, "PAGE", page)
    monkeypatch.setattr(negatives, "QUERIES", queries)
    monkeypatch.setattr(negatives, "GROUPS", 2)
    d = C.write(str(tmp_path), embeddings=([{"vec_id": i, "embedding": x, "label": m} for i, x, m in rows], SCHEMA))
    want = brute(rows)
    assert len(want) > 200
    assert got(negatives.op13_hard_negatives(spark, d)) == want


def test_against_sql(spark):
    ok, why = compare(spark, C.SF, negatives.op13_hard_negatives(spark, C.SF), negatives.SQL, duck(C.SF))
    assert ok, why


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0], 1)], [(0, [1.0], 1), (1, [2.0], 1)], [(0, [1.0], 1), (1, [2.0], 1), (2, [1.5], 2)]])
def test_small_tables(spark, tmp_path, rows):
    d = C.write(str(tmp_path), embeddings=([{"vec_id": i, "embedding": x, "label": m} for i, x, m in rows], SCHEMA))
    assert got(negatives.op13_hard_negatives(spark, d)) == brute(rows)


def test_packed_vectors():
    r = np.random.default_rng(2)
    rows = [r.integers(-300, 300, 6), r.integers(-2 ** 40, 2 ** 40, 6), np.array([], np.int64), np.array([-32768, 32767])]
    assert negatives.unpack([negatives.pack(x) for x in rows]).tolist() == [list(x) + [0] * (6 - len(x)) for x in map(list, rows)]


def test_coordinates_prune_and_lose_nothing():
    """Clustered vectors: feasible ranges leave few rows, and all that reach the threshold."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(50, 32))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    v = (1000 * (np.repeat(centres, 80, axis=0) + 0.01 * r.normal(size=(4000, 32)))).astype(np.int64)
    page = negatives.Page(np.arange(4000), np.zeros(4000, np.int64), v)
    total = 0
    for q in v[::400].astype(float):
        scores = page.float @ q
        for least in (np.sort(scores)[-40], 0.97 * scores.max(), 0.5 * scores.max()):
            rows = page.candidates(q, float(np.sqrt(q @ q)), float(least))
            want = np.flatnonzero(scores >= least)
            assert rows is None or set(want) <= set(rows.tolist())
            total += (4000 if rows is None else len(rows)) * (least > 0.9 * scores.max())
    assert total < 0.15 * 2 * 10 * 4000
    assert page.candidates(v[0].astype(float), 1.0, 1e12).tolist() == []


def test_rows_are_sent_for_the_queries_that_ask(spark, rows):
    """Short rows can't reach the thresholds of the second pass, so they aren't sent again."""
    long = [(i, [float(i % 7 + 50), 1.0 + i % 3], 1) for i in range(600)]
    short = [(1000 + i, [0.5, 0.5 + i % 2], 1) for i in range(600)]
    df = spark.createDataFrame(long + short, "id long, v array<double>, label long")
    table = negatives.quantised(df.select("id", "label", "v"))
    out = negatives.hard_negatives(table, "id % 50 = 0").collect()
    assert out == []
    first = table.where("id % 50 = 0").selectExpr("id as q", "label", "length", "v")
    ends = "array(named_struct('w', 0, 'low', 2000000L, 'high', 9223372036854775807L))"
    from pyspark.sql import functions as F
    hits = negatives.search(table, first.withColumn("windows", F.expr(ends)), 3, True).collect()
    assert hits and all(h["id"] < 1000 for h in hits)
