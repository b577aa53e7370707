import __spark_entry__
import corpus_pipeline
from bazaarflow.llm.bindings import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_all_operators_are_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names and set(QUERIES) <= set(names)


def test_stages_return_documents(spark):
    from bazaarflow.llm.common import materialise, table

    docs = table(spark, FOLDER, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, FOLDER), "stage")
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
