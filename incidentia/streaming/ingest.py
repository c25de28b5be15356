"""Incremental ingestion: landed pages to the accumulated table, each page read once."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incidentia.operators.merge import dedup_batch, new_only
from incidentia.operators.records import flatten_records
from incidentia.schema import REPORT
from incidentia.session import Scratch
from incidentia.sources.pages import explode_parsed, page_number, parsed_pages
from incidentia.sources.reports import load_accumulated, save_accumulated
from incidentia.streaming.keys import KeyStore


@dataclass
class IngestSummary:
    batch_returned: int = 0
    new_records_added: int = 0
    total_accumulated: int = 0
    retrain_triggered: bool = False
    pages_rejected: int = 0

    def as_dict(self) -> dict:
        return asdict(self)


def rejected_path(accumulated_path: str) -> str:
    """Where the pages that are no JSON go, with their file and batch."""
    return f"{accumulated_path}_rejected"


def add_batch(
    spark: SparkSession,
    batch: DataFrame,
    accumulated_path: str,
    batch_id: int,
    dedup_within: bool = False,
) -> tuple[int, int]:
    """Append the reports of ``batch`` the table does not hold; ``(returned, added)``.

    Known numbers come from the table's key store, so the reports themselves are not read. A replay
    overwrites its own ``batch_id`` and does not take its earlier rows for known ones. Rows are
    counted as they are written.
    """
    store = KeyStore(spark, accumulated_path)
    store.index_missing()
    one = F.count(F.lit(1)).alias("n")
    returned, added = Observation(), Observation()
    with Scratch(spark) as scratch:
        batch = scratch.table(batch.select(*REPORT.names).observe(returned, one), "batch")
        rows = dedup_batch(batch) if dedup_within else batch
        new = new_only(store.held(rows, batch_id), rows).observe(added, one)
        new = scratch.table(new, "added")
        save_accumulated(new, accumulated_path, batch_id)
        store.add(new, batch_id)
    return returned.get["n"], added.get["n"]


def take_pages(
    spark: SparkSession,
    pages: DataFrame,
    accumulated_path: str,
    batch_id: int,
    dedup_within: bool = False,
) -> tuple[int, int, int]:
    """Add the reports of pages (value, page_no, file); ``(returned, added, pages set aside)``.

    A page that is no JSON is written to ``rejected_path`` and stops no other page.
    """
    parsed = parsed_pages(pages)
    seen = Observation()
    broken = F.col("doc").isNull()
    good = parsed.observe(seen, F.count_if(broken).alias("broken")).filter(~broken)
    returned, added = add_batch(
        spark, flatten_records(explode_parsed(good)), accumulated_path, batch_id, dedup_within
    )
    rejected = seen.get["broken"]
    if rejected:
        aside = parsed.filter(broken).select("file", "page_no", "value")
        where = f"{rejected_path(accumulated_path)}/batch_id={batch_id}"
        aside.write.mode("overwrite").parquet(where)
    return returned, added, rejected


def ingest_available(
    spark: SparkSession,
    pages_path: str,
    accumulated_path: str,
    checkpoint_path: str,
    max_files_per_batch: int = 1000,
    dedup_within: bool = False,
    page_per_line: bool = False,
) -> IngestSummary:
    """Take in every page landed since the last call, then stop.

    The stream's checkpoint remembers the files already read, so no cycle asks for old ones again.
    A file holds one page, or with ``page_per_line`` one page on each line.
    """
    summary = IngestSummary()

    def take(pages: DataFrame, batch_id: int) -> None:
        returned, added, rejected = take_pages(
            spark, pages, accumulated_path, batch_id, dedup_within
        )
        summary.batch_returned += returned
        summary.new_records_added += added
        summary.pages_rejected += rejected

    page_schema = T.StructType([T.StructField("value", T.StringType())])
    file = F.col("_metadata.file_name")
    pages = (
        spark.readStream.format("text")
        .schema(page_schema)
        .option("wholetext", str(not page_per_line).lower())
        .option("maxFilesPerTrigger", max_files_per_batch)
        .load(pages_path)
        .select("value", page_number(file).alias("page_no"), file.alias("file"))
    )
    query = (
        pages.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    summary.total_accumulated = load_accumulated(spark, accumulated_path).count()
    return summary
