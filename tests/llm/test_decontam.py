import random

import llm_cases as C
import pyarrow.parquet as pq
import pytest
from dhvani.llm import decontam


def distance(item: str, text: str) -> int:
    """Least edit distance of a passage of ``text``, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_nearest_passage():
    r = random.Random(1)
    for _ in range(150):
        a = "".join(r.choice("abc ") for _ in range(r.randint(1, 90)))
        b = "".join(r.choice("abc ") for _ in range(r.randint(0, 120)))
        assert decontam.nearest(a, b)[0] == distance(a, b)


@pytest.fixture
def tables(tmp_path):
    r = random.Random(2)
    items = C.read("benchmark")
    clean = [(x["doc_id"], x["text"]) for x in C.read("documents")]
    joined = [" ".join(i["text"].lower().split()) for i in items]
    clean = [(i, t) for i, t in clean if not any(j in " ".join(t.lower().split()) for j in joined)][:120]
    rows, want, near = list(C.EDGE) + clean, set(), set()
    for k, it in enumerate(items):
        for n, share in enumerate((0.0, 0.05, 0.1, 0.15)):
            doc = 10_000 + 10 * k + n
            body = C.edited(it["text"], share, r)
            body = body.upper() if n == 0 and k % 3 == 0 else body.replace(" ", " \n ") if k % 3 == 1 else body
            text = f"{clean[k % len(clean)][1][:200]} {body} {clean[(k + 7) % len(clean)][1][:150]}"
            rows.append((doc, text))
            goal = joined[k]
            if distance(goal, " ".join(body.lower().split())) <= 0.2 * len(goal):
                (near if n else want).add((doc, it["item_id"]))
    items += [{"item_id": None, "text": "a null id of an item that nothing holds"}, {"item_id": 900, "text": None}, {"item_id": 901, "text": ""}]
    d = C.write(str(tmp_path), documents=C.docs_of(rows), benchmark=(items, C.ITEMS))
    return d, rows, want, near, {i for i, _ in clean}


def test_planted_passages(spark, tables):
    d, rows, want, near, clean = tables
    got = decontam.op8_benchmark_decontamination(spark, d).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    assert want <= pairs
    assert len(near & pairs) >= 0.97 * len(near)
    assert not {i for i, _ in pairs} & clean
    assert all(r["similarity"] >= 0.8 for r in got)


def test_blocks_of_items(spark, tables, monkeypatch):
    d, *_ = tables
    whole = {tuple(r) for r in decontam.op8_benchmark_decontamination(spark, d).collect()}
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 15)
    assert {tuple(r) for r in decontam.op8_benchmark_decontamination(spark, d).collect()} == whole


def test_stage(spark, tables):
    d, rows, *_ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    hit = {r["doc_id"] for r in decontam.op8_benchmark_decontamination(spark, d).collect()}
    out = decontam.stage(spark, docs, d)
    assert out.schema == docs.schema
    assert sorted(r["row"] for r in out.collect()) == [k for k, (i, _) in enumerate(rows) if i not in hit]


def test_short_items_and_empty_tables(spark, tmp_path):
    d = C.write(str(tmp_path), documents=C.docs_of([(1, "say cheese now"), (2, "chess")]), benchmark=([{"item_id": 1, "text": "Cheese"}], C.ITEMS))
    assert [(r["doc_id"], r["item_id"]) for r in decontam.op8_benchmark_decontamination(spark, d).collect()] == [(1, 1)]
    pq.write_table(pq.read_table(f"{d}/benchmark.parquet").slice(0, 0), f"{d}/benchmark.parquet")
    assert decontam.op8_benchmark_decontamination(spark, d).count() == 0
    assert decontam.stage(spark, spark.read.parquet(f"{d}/documents.parquet"), d).count() == 2


def test_recall_by_item_length():
    """All items of 2 words or more with one word in five changed (one at least) are met."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9)))
    items, texts, want = [], [], set()
    for n in [*range(2, 31)] * 12:
        item = [word() for _ in range(n)]
        body = list(item)
        for k in r.sample(range(n), max(1, n // 5)):
            w = body[k]
            at = r.randrange(len(w))
            body[k] = r.choice((w[:at] + "z" + w[at + 1:], w[:at] + w[at + 1:], w + " zq", "zz" + w[2:]))
        item, body = " ".join(item), " ".join(body)
        if distance(item, body) <= 0.2 * len(item) + 1e-9:
            want.add((len(texts), len(items)))
        items.append((len(items), item))
        texts.append(" ".join(word() for _ in range(20)) + f" {body} " + " ".join(word() for _ in range(20)))
    got = {m[:2] for m in decontam.Index(items).matches(texts)}
    assert len(want) > 300 and want <= got


def test_runs_cover_items():
    import numpy as np

    for n in range(1, 200):
        runs = decontam.run_lengths(np.arange(n), np.full(n, n))
        assert runs.sum() == n and np.count_nonzero(runs) == (max(1, n // 5) + 1 if n > 1 else 1)


def test_windows_lose_no_passage():
    """Windows that are not verified, for want of characters, hold no passage; letters
    whose lower case is another alphabet's count for nothing."""
    import random

    import numpy as np
    from dhvani.llm import decontam, kit

    r = random.Random(4)
    words = ["the", "bridge", "Kelvin", "İndex", "straße", "naïve", "of", "a1b2", "x", "committee"]
    items = [(k, " ".join(r.choice(words) for _ in range(r.randint(1, 9)))) for k in range(40)]
    texts = [" ".join("".join(c for c in r.choice(words) if r.random() > 0.05) for _ in range(200)) for _ in range(10)]
    index, w = decontam.Index(items), kit.Words(kit.to_bytes(texts, lower=True))
    found = index.candidates(w)
    kept = {tuple(x) for x in index.windows(w, found)[:, :3].tolist()}
    assert 0 < len(kept) < len(found)
    for d, i, start in found.tolist():
        if (d, i, start) not in kept:
            slack, size, first = max(2, index.size[i] // 4), index.size[i], w.first[d]
            a, b = max(first + start - slack, first), min(first + start + size + slack + slack // 2, w.first[d + 1])
            text = " ".join(w.buf[w.start[k]:w.end[k]].decode().lower() for k in range(a, b))
            assert decontam.nearest(index.items[i][1], text)[0] > index.limit[i]
    assert len(index.windows(w, np.zeros((0, 3), np.int64))) == 0
