"""Flat token files of a bounded number of documents."""

import re

from pyspark.sql import functions as F

from incidentia.llm import queries, separators
from incidentia.llm.common import batches_of
from incidentia.llm.tokens import encoder

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_files_are_bounded_and_documents_found_across_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(separators, "FILE_DOCS", 7)
    texts = [None if i % 11 == 5 else "word and number " * (i % 5) for i in range(60)]
    rows = [(i % 50, text) for i, text in enumerate(texts)]  # ids repeat
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    made, real = [], separators.scan_separators
    monkeypatch.setattr(separators, "scan_separators", lambda s, path, w: made.append(path) or real(s, path, w))
    found = queries.op10_token_counts(spark, str(tmp_path)).collect()
    ids = encoder(separators.VOCABULARY, True)
    want = sorted((i, len(ids.encode([text])[0]) // 4) for i, text in rows)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in found) == want
    starts = sorted((r["start"], r["n_tokens"]) for r in found)
    assert starts[0][0] == 0 and all(b == a + n + 1 for (a, n), (b, _) in zip(starts, starts[1:]))
    files = spark.read.format("binaryFile").load(made[0]).select("path", "content").collect()
    ends = [sum(f["content"][i : i + 2] == b"\0\0" for i in range(0, len(f["content"]), 2)) for f in files]
    assert max(ends) <= 7 and sum(ends) == 60
    assert any(re.search(r"-c001", f["path"]) for f in files)


def test_one_file_crosses_to_python_at_a_time(spark):
    seen = spark.range(40, numPartitions=1)

    def sizes(batches):
        for batch in batches:
            yield batch.from_pydict({"n": [batch.num_rows]})

    before = spark.conf.get(_ROWS)
    with batches_of(spark, separators.FILE_BATCH):
        assert [r["n"] for r in seen.mapInArrow(sizes, "n long").collect()] == [1] * 40
    assert spark.conf.get(_ROWS) == before
    assert seen.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] == 40


def test_the_number_of_a_file_ends_its_name(spark):
    names = ["part-00000-0c1b2c3d-c123-4c56-c789-c00000000001-c002.txt", "part-00001-a-c000.txt.gz", "part-3-c012"]
    df = spark.createDataFrame([(name, 4) for name in names], "file string, at long")
    found = df.select(separators.place_in_part(F.col("file"), F.col("at")).alias("n")).collect()
    assert [r["n"] for r in found] == [separators.FILE_DOCS * k + 4 for k in (2, 0, 12)]
