"""The corpus pipeline, and the registered queries of the subpackage."""

import corpus_pipeline as pipeline
from corpus_pipeline import STAGES

from incidentia.llm.queries import llm_oracles, llm_queries
from incidentia.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in llm_queries())
    assert numbers == list(range(1, 14))
    assert set(llm_oracles()) <= set(llm_queries())


def test_stages_hand_on_documents(spark, work):
    docs = read_table(spark, SF, "documents")
    columns, kept = docs.columns, docs.count()
    for name, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, SF), name)
        assert docs.columns == columns
        assert docs.count() <= kept
        kept = docs.count()
    pieces = work.table(pipeline.packed(spark, docs, SF), "pieces")
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}
    assert kept > 100


def test_stages_of_odd_rows(spark, odd, none, work):
    odd = odd.withColumn("n_chars", odd["ids"])
    for docs in (odd, none.withColumn("n_chars", none["ids"])):
        docs = work.table(docs, "docs")
        columns = docs.columns
        for name, stage in STAGES[:-1]:
            docs = work.table(stage(spark, docs, SF), name)
            assert docs.columns == columns
        assert pipeline.packed(spark, docs, SF).count() >= docs.count()
