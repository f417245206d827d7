"""The pipeline's stages against the operators' own brute force."""

import corpus_pipeline
from quillon.llm import quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_hand_documents_on(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    verdict = {r["doc_id"]: r["kept"] for r in quality.score(docs).collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == COLUMNS
        if name == "quality_rules":
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == {i for i, kept in verdict.items() if kept}
        if name in ("ngram_jaccard", "secret_scans"):
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert docs.columns == ["doc_id", "n_tokens", "ids"] and docs.count() > 0
    assert docs.filter("size(ids) <> n_tokens").count() == 0


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
