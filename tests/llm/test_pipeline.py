import corpus_pipeline
from sextant.llm.shared import materialise

from .conftest import rows


def test_stages_keep_the_columns_and_clean_documents(spark, docs):
    d = docs
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, d, ""), "stage")
        if name == corpus_pipeline.STAGES[-1][0]:
            assert {x.doc_id for x in out.select("doc_id").distinct().collect()} <= {x[0] for x in rows()}
            break
        assert out.columns == docs.columns
        ids = sorted((x.doc_id or 0) for x in out.select("doc_id").collect())
        if name == "quality_rules":
            assert {5, 6, 7, 8, 12} <= set(ids) and not set(ids) & {1, 2, 3, 4, 10, 11}
        if name == "near_dedup":
            assert ids.count(5) == 1 and not set(ids) & {6, 7} and ids.count(12) == 1 and 0 in ids
        d = out


def test_an_empty_table_passes_all_stages(spark, no_docs):
    d = no_docs
    for _, stage in corpus_pipeline.STAGES:
        d = materialise(stage(spark, d, ""), "stage")
    assert d.count() == 0


def test_run_reads_documents(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
