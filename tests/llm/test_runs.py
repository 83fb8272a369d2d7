import hashlib
import random
import zlib

import llm_cases as C
import numpy as np
import pytest
from dhvani.llm import runs


def brute(w: list, shortest: int, exponent: int) -> list[tuple]:
    """(start, length, period) by definition: every period, every stretch, the smallest period of each."""
    n, best = len(w), {}
    for q in range(n // exponent, 0, -1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(shortest, exponent * q):
                best[(s, i + q)] = q
    return sorted((s, e - s, q) for (s, e), q in best.items())


def kept(w: list, found: list[tuple]) -> list:
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def sequences():
    r = random.Random(3)
    out = [[], [0], [0] * 5, [0] * 6, [0] * 500, [0, 1] * 3, [0, 1] * 4, [0, 1] * 4 + [0], [0, 0, 1] * 9, list(range(60))]
    for k in range(120):
        w = []
        while len(w) < r.randint(1, 200):
            unit = [r.randrange(r.choice((1, 2, 3, 50))) for _ in range(r.randint(1, 12))]
            w += unit * r.choice((1, 1, 2, 4, 5, 9)) + unit[:r.randint(0, len(unit))]
        out.append(w)
    out += [[r.randrange(2) for _ in range(n)] for n in (10, 100, 1000)]
    inner = [7, 7, 7, 7, 7, 7, 3] * 5 + [1, 2] * 6  # runs inside the periods of a run
    return out + [inner * 4 + [9], inner * 7]


@pytest.mark.parametrize("shortest, exponent", [(6, 4), (2, 2), (9, 3)])
@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_runs_against_definition(monkeypatch, shortest, exponent, piece):
    monkeypatch.setattr(runs, "SLICE", piece)
    texts = sequences()
    ids = np.array([x for w in texts for x in w], np.int32)
    first = np.concatenate(([0], np.cumsum([len(w) for w in texts])))
    got = list(zip(*(x.tolist() for x in runs.runs_of(ids, first, shortest, exponent))))
    want = [(d, *r) for d, w in enumerate(texts) for r in brute(w, shortest, exponent)]
    assert got == want


def test_lce_both_ways():
    r = np.random.default_rng(4)
    for sym in (np.zeros(300, np.int32), np.tile(np.arange(7), 50), r.integers(0, 2, 400), r.integers(0, 9, 400), np.repeat(r.integers(0, 3, 90), r.integers(1, 9, 90))):
        sym = np.concatenate(([98], sym, [99])).astype(np.int32)
        g = runs.Grammar(sym)
        i, j = (x.ravel() for x in np.meshgrid(np.arange(1, len(sym) - 1), np.arange(1, len(sym))))
        i, j = i[i < j], j[i < j]

        def plain(t, a, b):
            k = 0
            while max(a, b) + k < len(t) and t[a + k] == t[b + k]:
                k += 1
            return k
        pick = r.integers(0, len(i), 500)
        i, j = i[pick], j[pick]
        assert g.lce(i, j).tolist() == [plain(sym, a, b) for a, b in zip(i, j)]
        back = g.mirror().lce(len(sym) - i, len(sym) - j)
        assert back.tolist() == [plain(sym[::-1], len(sym) - a, len(sym) - b) for a, b in zip(i, j)]


def test_grammar_expands_and_shrinks():
    r = np.random.default_rng(5)
    sym = np.concatenate(([50], r.integers(0, 20, 20_000), [51])).astype(np.int32)
    g = runs.Grammar(sym, 1)
    for low, high in zip(g.levels, [*(v.sym for v in g.levels[1:]), g.top]):
        means: dict[int, tuple] = {}
        for k, name in enumerate(high.tolist()):
            part = tuple(low.sym[low.child[k]:low.child[k + 1]].tolist())
            assert means.setdefault(name, part) == part
    assert len(g.top) <= 2 and len(g.levels) < 60
    one = runs.Grammar(np.array([1] + [0] * 100_000 + [2], np.int32), 1)
    assert len(one.top) <= 2 and len(one.levels) < 6


def expected(rows):
    out = []
    for i, t in rows:
        w = C.ascii_words(t, False)
        n = len(w)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        found = brute(w, 6, 4) if n <= 5000 else []
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(found, key=lambda r: (r[0], r[2])))
        tail = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        out.append((i, len(found), *tail, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept(w, found))).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert df.columns == names
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_on_edge_rows(spark, tmp_path):
    rows = list(C.EDGE) + [(20 + k, " ".join(f"u{j % (k + 1)}" for j in range(60 + k))) for k in range(60)]
    rows += [(500, "a b " * 100 + "c"), (500, "a b " * 100 + "c"), (None, "same " * 50), (501, "same\t\n" * 700), (502, "é ü " * 5)]
    d = C.write(str(tmp_path), documents=C.docs_of(rows))
    assert got(runs.op11_periodic_runs(spark, d)) == expected(rows)


def test_driver_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in C.read("documents")]
    want = expected(rows)
    assert got(runs.op11_periodic_runs(spark, C.SF)) == want
    assert sum(r[1] > 0 for r in want) > 5


def test_empty_table_and_operator(spark, tmp_path):
    assert runs.op11_periodic_runs(spark, C.write(str(tmp_path), documents=C.docs_of([]))).count() == 0
    docs = spark.createDataFrame([(1, "x a b a b a b a b y", "z")], "doc_id long, text string, runs string")
    r = runs.find_runs(docs).collect()[0]
    assert [tuple(x) for x in r["runs"]] == [(1, 8, 2)] and r["collapsed"] == "x a b y" and r["n_words"] == 10


def test_long_periodic_text_is_near_linear():
    import time

    t0 = time.perf_counter()
    for ids in (np.zeros(1_000_000, np.int32), np.tile(np.arange(1000, dtype=np.int32), 1000)):
        _, s, n, q = runs.runs_of(ids, np.array([0, len(ids)]))
        assert (s.tolist(), n.tolist()) == ([0], [len(ids)])
    assert time.perf_counter() - t0 < 60
