import random

import llm_cases as C
import pytest
from dhvani.llm import jaccard


def near_copies(base, count, edits, start, r):
    out = []
    for k in range(count):
        w = base.split()
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"e{r.randrange(10 ** 6)}"
        out.append((start + k, " ".join(w)))
    return out


@pytest.fixture
def rows():
    r = random.Random(7)
    word = lambda: f"v{int(r.paretovariate(0.6)) % 3000}"
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)
    rows = list(C.EDGE)
    rows += near_copies(text(120), 60, 6, 1000, r)  # a large group around the threshold
    rows += near_copies(text(30), 25, 2, 2000, r)
    rows += [(3000 + k, passage + " " + text(r.randint(20, 90))) for k in range(40)]  # a passage that many share
    rows += [(4000 + k, text(r.randint(1, 12))) for k in range(60)]
    rows += [(5000, "a b"), (5001, "A B"), (5002, "a b c"), (5003, "c b a")]
    return rows


def ids(rows):
    return sorted(((i is None, i or 0, n, g) for i, n, g in rows), key=str)


@pytest.mark.parametrize("n, t, page", [(3, 0.9, 512), (3, 0.9, 8), (5, 0.8, 16), (1, 0.8, 512)])
def test_against_all_pairs(spark, rows, monkeypatch, n, t, page):
    monkeypatch.setattr(jaccard, "PAGE", page)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = C.near_groups(rows, n, round(100 * t))
    got = [tuple(r) for r in jaccard.near_groups(docs, n, t).collect()]
    assert ids(got) == ids([(rows[k][0], *v) for k, v in want.items()])


def test_query_on_the_driver_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in C.read("documents")]
    want = C.near_groups(rows, 3, 90)
    got = [tuple(r) for r in jaccard.op3_ngram_jaccard_join(spark, C.SF).collect()]
    assert ids(got) == ids([(rows[k][0], *v) for k, v in want.items()])


def test_stage_keeps_the_first_of_each_group(spark, tmp_path, rows):
    d = C.write(str(tmp_path), documents=C.docs_of(rows))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = jaccard.stage(spark, docs, d)
    assert out.schema == docs.schema
    want = C.near_groups(rows, 5, 80)
    keep = sorted(k for k, (_, g) in want.items() if rows[k][0] is None or g == rows[k][0])
    assert sorted(r["row"] for r in out.collect()) == keep


def test_empty_table(spark):
    assert jaccard.near_groups(spark.createDataFrame([], "doc_id long, text string"), 3, 0.9).count() == 0


def test_tree_finds_what_a_scan_finds():
    import numpy as np
    r = np.random.default_rng(0)
    p = r.poisson(5, size=(700, jaccard.GROUPS)).astype(np.int32)
    p[350:] = np.maximum(p[:350] + r.integers(-1, 2, size=(350, jaccard.GROUPS)) * (r.random((350, jaccard.GROUPS)) < 0.1), 0)
    size = p.sum(axis=1)
    tree = jaccard.RTree(p, size)
    for i in range(0, 700, 13):
        want = np.flatnonzero(np.minimum(p, p[i]).sum(axis=1) >= jaccard.least_overlap(size, size[i], 0.9))
        assert sorted(tree.search(p[i], int(size[i]), 0.9)) == want.tolist()


@pytest.mark.parametrize("t", [0.8, 0.9])
def test_linked_pairs_share_a_signature(t):
    import numpy as np
    r, sets = np.random.default_rng(3), []
    num = round(100 * t)
    for _ in range(12_000):
        a = int(r.integers(4, 31))
        b = int(r.integers(-(-a * num // 100), a + 1))
        shared = int(jaccard.least_overlap(a, b, t))
        if shared > b or shared == a:
            continue
        x = r.integers(0, 2 ** 64, a + b - shared, dtype=np.uint64)
        sets += [np.sort(x[:a]), np.sort(x[a - shared:])]
    first = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    sig, own = jaccard.signatures(np.concatenate(sets), first, t)
    side = [set(), set()]
    for s, o in zip(sig.tolist(), own.tolist()):
        side[o % 2].add((o // 2, s))
    assert len({p for p, _ in side[0] & side[1]}) == len(sets) // 2 > 3000


def test_stage_decides_by_row(spark, tmp_path):
    """An id with two texts, and copies that carry the same id."""
    r = random.Random(5)
    text = lambda: " ".join(f"u{r.randrange(10 ** 6)}" for _ in range(40))
    x, y, z = text(), text(), text()
    rows = [(1, x), (2, x), (2, y), (3, z), (3, z), (3, z), (4, z + " end"), (5, text()), (None, y)]
    rows += [(6, ""), (6, ""), (7, y)]
    d = C.write(str(tmp_path), documents=C.docs_of(rows))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = [(q["doc_id"], q["text"]) for q in jaccard.stage(spark, docs.drop("row", "s"), d).collect()]
    assert sorted(kept, key=str) == sorted([(1, x), (2, y), (3, z), (5, rows[7][1]), (None, y), (6, ""), (6, "")], key=str)
    kept = sorted(q["row"] for q in jaccard.stage(spark, docs, d).collect())
    assert len(kept) == 7 and len({3, 4, 5} & set(kept)) == 1
