"""From documents to training windows: language, repeated lines, near copies, benchmark text, packing.

Each stage is one operator on all that the stage before it kept. ``run`` writes what a stage returns
and reads it again for the next, so a lost executor costs no more than the stage at work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentia.llm import decontamination, language, line_dedup, near_dedup, packing
from incidentia.llm.common import Work, unsigned_crc32
from incidentia.sources.tables import read_table

#: Stretches a worker remembers and rows of an Arrow batch. Executors have the heap of all stages filled
#: by the last one, and little room beside it.
CACHE_ENTRIES = 200_000
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, null texts, and texts far from every learned language."""
    work = Work(spark, "language")
    learned = docs.filter(~language.is_held_out(F.col("doc_id")))
    profiles = work.table(language.learn_profiles(learned), "profiles")
    bounds = language.learn_bounds(learned, profiles)
    return language.keep_identified(docs, profiles, bounds=bounds)


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first of lines that are alike; documents left without text go."""
    cut = line_dedup.drop_repeated_lines(docs, Work(spark, "lines"))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each class of near copies."""
    return near_dedup.drop_near_duplicates(docs, Work(spark, "copies"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training windows with their ids."""
    pieces = packing.pack_documents(docs, cache_entries=CACHE_ENTRIES)
    return pieces.withColumn("ids_crc32", unsigned_crc32(F.col("ids")))


STAGES = [
    ("language", known_language),
    ("lines", first_lines),
    ("near_copies", one_of_each),
    ("benchmark", without_benchmark),
    ("packing", packed),
]

#: SQL has no tokenizer, no learned profiles and no signatures.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    work = Work(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_ROWS))
    try:
        for name, stage in STAGES:
            docs = work.table(stage(spark, docs, sf_dir), name)
    finally:
        spark.conf.set(_BATCH, before)
    return docs
