import numpy as np
import pyarrow as pa
import pytest
from dhvani.llm import topk
from harness import compare, duck

import llm_cases as C

SCHEMA = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32()), ("pivot", pa.string())])


def brute(rows, k=10):
    ok = [(i, np.floor(1024 * np.asarray(x, float)).astype(int)) for i, x in rows
          if i is not None and x is not None and None not in x and np.isfinite(x).all()]
    out = []
    for q, v in {(i, tuple(x)) for i, x in ok if i % 100 == 0}:
        best = sorted({(-int(np.dot(v, x)), i) for i, x in ok if i != q})[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.fixture
def rows():
    r = np.random.default_rng(1)
    base = r.normal(size=(6, 8))
    rows = [(i, (base[i % 6] + 0.3 * r.normal(size=8)).tolist()) for i in range(900)]
    same = [0.25] * 8
    rows += [(i, same) for i in range(1000, 1400)]  # one vector, many ids: ties
    rows += [(5, rows[5][1]), (2000, [0.0] * 8), (None, same), (2001, None), (2002, [float("nan")] * 8), (2003, [None] * 8),
             (2004, [float("inf")] + [0.0] * 7)]
    return rows


@pytest.mark.parametrize("subtree, queries, page", [(4096, 1024, 128), (64, 3, 8)])
def test_against_brute_force(spark, tmp_path, rows, monkeypatch, subtree, queries, page):
    monkeypatch.setattr(topk, "SUBTREE", subtree)
    monkeypatch.setattr(topk, "QUERIES", queries)
    monkeypatch.setattr(topk, "PAGE", page)
    d = C.write(str(tmp_path), embeddings=([{"vec_id": i, "embedding": x, "label": None} for i, x in rows], SCHEMA))
    assert sorted(tuple(r) for r in topk.op2_exact_topk(spark, d).collect()) == brute(rows)


def test_against_sql(spark):
    ok, why = compare(spark, C.SF, topk.op2_exact_topk(spark, C.SF), topk.SQL, duck(C.SF))
    assert ok, why


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(0, [1.0]), (1, [2.0])]])
def test_small_tables(spark, tmp_path, rows):
    d = C.write(str(tmp_path), embeddings=([{"vec_id": i, "embedding": x} for i, x in rows], SCHEMA))
    assert sorted(tuple(r) for r in topk.op2_exact_topk(spark, d).collect()) == brute(rows)


def test_bounds_save_distances():
    """Best-first search of clustered points computes few of the scores."""
    r = np.random.default_rng(2)
    v = (1000 * (np.repeat(r.normal(size=(40, 16)), 100, axis=0) + 0.02 * r.normal(size=(4000, 16)))).astype(np.int64)
    top = float((v.astype(float) ** 2).sum(axis=1).max())
    tree = topk.MTree(topk.lifted(v, top))
    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            seen.append(np.size(at))
            return np.asarray(self)[at]
    got = tree.search(v[7], 7, v.view(Counted), np.arange(4000), float((v[7].astype(float) ** 2).sum()), top, 10, -np.inf)
    s = v @ v[7]
    want = sorted(((int(s[i]), -i) for i in range(4000) if i != 7), reverse=True)[:10]
    assert sorted(got, reverse=True) == want
    assert sum(seen) < 2000
