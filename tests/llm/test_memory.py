"""What a worker and the pipeline hold beside the heap."""

import re
from pathlib import Path

import corpus_pipeline as pipeline

from incidentia.llm import common

SF = "/root/testdata/sf0.001"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def private_mb() -> float:
    found = re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())
    return int(found[1]) / 1024


def test_the_next_operator_finds_the_memory_given_back(monkeypatch):
    monkeypatch.setattr(common, "_SLOT", {})
    kept = []
    common.in_slot("first", lambda: [bytes(2_000) for _ in range(60_000)])
    kept.append(bytes(2_000))  # the last block: a heap with a live end does not shrink by itself
    before = private_mb()
    common.in_slot("second", list)
    assert before - private_mb() > 80


def test_the_pipeline_hands_small_batches_to_workers(spark, monkeypatch):
    before, seen = spark.conf.get(BATCH), []

    def stage(spark, docs, sf_dir):
        seen.append(int(spark.conf.get(BATCH)))
        return docs.limit(3)

    monkeypatch.setattr(pipeline, "STAGES", [("one", stage)])
    assert pipeline.run(spark, SF).count() == 3
    assert seen == [pipeline.BATCH_ROWS] and seen[0] < 10_000
    assert spark.conf.get(BATCH) == before


def test_the_pipeline_remembers_fewer_stretches(spark, monkeypatch):
    given = []
    monkeypatch.setattr(pipeline.packing, "pack_documents", lambda docs, **more: given.append(more) or docs)
    docs = spark.createDataFrame([(1, b"")], "doc_id long, ids binary")
    pipeline.packed(spark, docs, SF)
    assert given == [{"cache_entries": pipeline.CACHE_ENTRIES}]
    assert pipeline.CACHE_ENTRIES < pipeline.packing.CACHE_ENTRIES
