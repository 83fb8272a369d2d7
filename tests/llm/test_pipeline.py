import llm_cases as C
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from dhvani.llm import bpe  # noqa: E402


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pipeline"))
    rows = [(r["doc_id"] + 1000, r["text"]) for r in C.read("documents")] + C.EDGE
    labels = [r | {"doc_id": r["doc_id"] + 1000} for r in C.read("labels")]
    return C.write(d, documents=C.docs_of(rows), labels=(labels, C.LABELS), benchmark=(C.read("benchmark"), C.ITEMS))


def test_stages_one_by_one(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "bpe"]
    columns, before = docs.schema, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        rows = {r["row"]: r for r in docs.collect()} if name != "bpe" else docs.collect()
        if name != "bpe":
            assert docs.schema == columns
        if name == "ngram_jaccard_join":
            given = [(r["doc_id"], r["text"]) for r in before.values()]
            want = C.near_groups(given, 5, 80)
            assert len(rows) == sum(given[i][0] is None or given[i][0] == g for i, (_, g) in want.items())
        if name == "substring_dedup":
            given = list(before.values())
            for r, gone in zip(given, C.cut_words([(r["doc_id"], r["text"]) for r in given], 50)):
                kept = [w for w, g in zip(C.ascii_words(r["text"], False), gone) if not g]
                assert C.ascii_words(rows[r["row"]]["text"], False) == kept
        if name == "benchmark_decontamination":
            items = [" ".join(i["text"].lower().split()) for i in C.read("benchmark")]
            for n, r in before.items():
                if any(i in " ".join((r["text"] or "").lower().split()) for i in items):
                    assert n not in rows
        if name == "bpe":
            enc = bpe.Encoder(bpe.load())
            want = sorted((r["doc_id"] or 0, *bpe._digest(enc.text(r["text"] or ""))) for r in before.values())
            assert sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want
        before = rows


def test_run_and_empty_table(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).columns[:2] == ["doc_id", "n_tokens"]
    for t in ("documents", "labels", "benchmark"):
        pq.write_table(pq.read_table(f"{folder}/{t}.parquet").slice(0, 0), tmp_path / f"{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
