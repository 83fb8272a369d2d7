import random

import llm_cases as C
import pytest
from dhvani.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def expected(reference, text):
    ids = reference.encode(text or "", add_special_tokens=False).ids
    decoded = reference.decode(ids, skip_special_tokens=False)
    return len(ids), bpe._sha(" ".join(map(str, ids))), bpe._sha(decoded)


def test_query_against_library(spark, tmp_path, reference):
    rows = C.EDGE + [(r["doc_id"] + 100, r["text"]) for r in C.read("documents")]
    d = C.write(str(tmp_path), documents=C.docs_of(rows))
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op1_bpe(spark, d).collect())
    assert got == sorted((i or 0, *expected(reference, t)) for i, t in rows)


def test_pieces_over_spark(spark, tmp_path, reference, monkeypatch):
    monkeypatch.setattr(bpe, "LEAF", 50)
    d = C.write(str(tmp_path), documents=C.docs_of(C.EDGE))
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op1_bpe(spark, d).collect())
    assert got == sorted((i or 0, *expected(reference, t)) for i, t in C.EDGE)


def test_tree_concatenation(reference, monkeypatch):
    monkeypatch.setattr(bpe, "LEAF", 37)
    enc, r = bpe.Encoder(bpe.load()), random.Random(3)
    for _ in range(400):
        letters = r.choice(["ab'srevelmd!?1 .,é́Σßẞ", "ab", "'rel ", "abcdefghijklmnop", "é!'", "\x1c a"])
        text = "".join(r.choice(letters) for _ in range(r.choice([5, 60, 300, 1500])))
        out = []
        for special, part in enc.segments(text):
            cut = bpe.halves(part)
            pieces = [enc.piece(p, k == len(cut) - 1) for k, p in enumerate(cut)]
            out += [special] if special >= 0 else [i for t in bpe.tree(enc, pieces).tokens for i in t]
        assert out == reference.encode(text, add_special_tokens=False).ids


def test_long_unsplit_word(reference):
    enc, r = bpe.Encoder(bpe.load()), random.Random(4)
    text = "".join(r.choice("etaoinshr") for _ in range(200_000))
    pieces = bpe.halves(text)
    assert len(pieces) > 2
    got = bpe.tree(enc, [enc.piece(p, k == len(pieces) - 1) for k, p in enumerate(pieces)]).tokens
    assert got == [reference.encode(text, add_special_tokens=False).ids]


def test_encode_then_decode(spark, reference):
    df = spark.createDataFrame([(1, "Hello, wörld!  It's 42"), (2, None)], "doc_id long, text string")
    ids = bpe.encode(df)
    assert {r["doc_id"]: r["ids"] for r in ids.collect()} == {
        1: reference.encode("Hello, wörld!  It's 42", add_special_tokens=False).ids, 2: []}
    text = {r["doc_id"]: r["text"] for r in bpe.decode(ids).collect()}
    assert text[2] == "" and text[1].replace("</w>", "").replace(" ", "").startswith("hello,w")


def test_empty_table(spark, tmp_path):
    assert bpe.op1_bpe(spark, C.write(str(tmp_path), documents=C.docs_of([]))).count() == 0
