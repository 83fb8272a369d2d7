import hashlib
import random

import llm_cases as C
import numpy as np
import pytest
from dhvani.llm import factors
from harness import compare, duck


def gone(rows, length):
    """Which bytes go, by row: every string of every text."""
    first: dict[bytes, tuple] = {}
    data = [(t or "").encode() for _, t in rows]
    places = [lambda p, i=i: (i is None, i or 0, p) for i, _ in rows]
    for t, place in zip(data, places):
        for p in range(len(t) - length + 1):
            x = t[p:p + length]
            first[x] = min(first.get(x, place(p)), place(p))
    out = []
    for t, place in zip(data, places):
        flags = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if first[t[p:p + length]] < place(p):
                flags[p:p + length] = True
        out.append(flags)
    return data, out


def expected(rows, length):
    out = []
    for (i, _), t, flags in zip(rows, *gone(rows, length)):
        kept = bytes(np.frombuffer(t, np.uint8)[~flags])
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], flags.astype(int)))) == 1))
        out.append((i, len(t), int(flags.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def rows():
    r = random.Random(7)
    text = lambda n: "".join(r.choice("abcde  é") for _ in range(n))
    passages = [text(n) for n in (90, 99, 100, 101, 160, 400)]
    rows = [(i, t) for i, t in C.EDGE if t is None or len(t) < 6000]
    rows += [(100 + k, text(r.randint(0, 120)) + r.choice(passages) + text(r.randint(0, 90)) + r.choice(passages)) for k in range(60)]
    rows += [(300, "ab" * 400), (299, "ab" * 160), (298, "x" * 700), (297, "x" * 99), (296, "x" * 100), (295, "y" * 101)]
    rows += [(400, passages[5]), (401, passages[5]), (401, passages[5]), (401, "z" + passages[5]), (None, passages[4]), (None, passages[5] + "!"), (50, passages[4])]
    same = text(300)
    return rows + [(500 + k, same[:r.randint(200, 300)] + text(3) + same) for k in range(40)] + [(-5, "\0" * 150 + same), (600, "\0" * 130)]


def test_query_against_brute_force(spark, tmp_path, rows):
    d = C.write(str(tmp_path), documents=C.docs_of(rows))
    assert got(factors.op12_first_copies(spark, d)) == expected(rows, 100)


@pytest.mark.parametrize("length, common, flush, group", [(100, 0, 1, 1 << 10), (16, 1, 1 << 12, 1 << 12), (17, 16, 1, 1 << 24), (40, 0, 1 << 30, 1 << 14)])
def test_other_lengths_salts_and_small_groups(spark, rows, monkeypatch, length, common, flush, group):
    monkeypatch.setattr(factors, "COMMON", common)
    monkeypatch.setattr(factors, "FLUSH", flush)
    monkeypatch.setattr(factors, "GROUP", group)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, cls string").repartition(5)
    data, flags = gone(rows, length)
    want = sorted((repr(i), hashlib.sha256(t).hexdigest(), bytes(np.frombuffer(t, np.uint8)[~f])) for (i, _), t, f in zip(rows, data, flags))
    out = factors.first_copies(docs, length).collect()
    texts = {}
    for (i, _), t in zip(rows, data):
        texts.setdefault((i, len(t)), []).append(t)
    have = []
    for r in out:
        cut = np.ones(r["n_bytes"], bool)
        for s in r["spans"]:
            cut[s["start"]:s["stop"]] = False
        source = next(t for t in texts[r["doc_id"], r["n_bytes"]] if bytes(np.frombuffer(t, np.uint8)[cut]) == bytes(r["kept"]))
        have.append((repr(r["doc_id"]), hashlib.sha256(source).hexdigest(), bytes(r["kept"])))
        assert all(a["stop"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
    assert [x[2] for x in sorted(have)] == [x[2] for x in want] or sorted((a, c) for a, _, c in have) == sorted((a, c) for a, _, c in want)


def test_long_texts_are_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(factors.kit, "CHUNK_BYTES", 997)
    r = random.Random(8)
    long = "".join(r.choice("abcdefgh") for _ in range(9000))
    rows = [(1, long), (2, long[4000:5100] + "-" + long[100:199] + "-" + long[:7000]), (3, long[:150] * 20)]
    d = C.write(str(tmp_path), documents=C.docs_of(rows))
    assert got(factors.op12_first_copies(spark, d)) == expected(rows, 100)


def test_factors_are_longest_previous_factors():
    """Flags against LPF by its definition, for every anchor distance."""
    r = np.random.default_rng(9)
    length = 24
    for trial in range(30):
        unit = r.integers(97, 99 + trial % 3, 60).astype(np.uint8)
        text = np.concatenate([unit[r.integers(0, 30):r.integers(30, 60)] for _ in range(12)])
        buf, c = factors.segments([(0, 0, text.tobytes())], length, None)
        spans = np.zeros(len(text), bool)
        n = c["hi"] - c["lo"] + 1
        assert n.sum() == len(text) - length + 1
        segs = factors.Segments(c["own"], c["own"] > 0, c["own"], c["place"], c["lo"], c["hi"], c["hash"], c["hot"], n - 1 + length, buf)
        segs.begin = c["begin"]
        found, left = segs.judged(length)
        for a, b in zip(found["start"], found["stop"]):
            spans[a:b] = True
        assert (spans == gone([(1, text.tobytes().decode())], length)[1][0]).all()
        again = factors.Segments.unpack([segs.take(left).pack()])
        assert (again.place == c["place"][left]).all() and again.data.tobytes() == segs.take(left).data.tobytes()


def test_previous_smaller_by_definition():
    r = np.random.default_rng(10)
    for n in (1, 2, 50, 300):
        place, lcp = r.permutation(n), np.append(0, r.integers(0, 9, n - 1))
        want = []
        for i in range(n):
            j, m = i - 1, 99
            while j >= 0:
                m = min(m, lcp[j + 1])
                if place[j] < place[i]:
                    break
                j -= 1
            want.append(m if j >= 0 and m >= 3 else 0)
        assert factors.smaller(place, lcp, 3).tolist() == want


def test_copies_in_one_flush_are_not_sent():
    r = random.Random(11)
    text = "".join(r.choice("abcdefghij") for _ in range(3000)).encode()
    part = [(k, 0, text) for k in range(50)]
    buf, c = factors.segments(part, 100, None)
    segs = factors.Segments(c["own"], c["own"] < 0, c["own"], c["place"], c["lo"], c["hi"], c["hash"], c["hot"], c["hi"] - c["lo"] + 100, buf)
    segs.begin = c["begin"]
    spans, left = segs.judged(100)
    assert set(c["own"][left]) == {0} and len(set(spans["id"])) == 49


def test_against_sql(spark):
    ok, why = compare(spark, C.SF, factors.op12_first_copies(spark, C.SF), factors.SQL, duck(C.SF))
    assert ok, why


def test_empty_table(spark, tmp_path):
    assert factors.op12_first_copies(spark, C.write(str(tmp_path), documents=C.docs_of([]))).count() == 0
    d = tmp_path / "short"
    d.mkdir()
    assert got(factors.op12_first_copies(spark, C.write(str(d), documents=C.docs_of([(1, "short"), (None, None)])))) == expected([(1, "short"), (None, None)], 100)
