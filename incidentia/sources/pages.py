"""Landed report pages: one JSON object per file with the page's reports under ``results``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentia.operators.records import flatten_records
from incidentia.schema import PAGE_LIMIT


def page_number(file_name: Column) -> Column:
    """Last run of digits in a page file's name; null if it has none."""
    return F.regexp_extract(file_name, r"(\d+)\D*$", 1).try_cast("long")


def parsed_pages(pages: DataFrame, body: str = "value") -> DataFrame:
    """Adds ``doc``, the page as a VARIANT; null where the body is no JSON."""
    return pages.withColumn("doc", F.try_parse_json(F.col(body)))


def explode_parsed(parsed: DataFrame, page: str = "page_no") -> DataFrame:
    """One row ``(page_no, pos, record)`` per report of each parsed page; other pages give none."""
    results = F.try_variant_get("doc", "$.results", "array<variant>")
    return parsed.select(F.col(page).alias("page_no"), F.posexplode(results).alias("pos", "record"))


def explode_pages(pages: DataFrame, body: str = "value", page: str = "page_no") -> DataFrame:
    """``explode_parsed`` of page bodies.

    A body that is no JSON fails, as a page that was cut short has lost reports; the stream sets such
    pages aside instead.
    """
    return explode_parsed(pages.withColumn("doc", F.parse_json(F.col(body))), page)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Reports of a folder of page files, each file read whole by the task that holds it."""
    pages = spark.read.text(path, wholetext=True).select(
        "value", page_number(F.col("_metadata.file_name")).alias("page_no")
    )
    return explode_pages(pages)


def page_size_for(page_size: int, remaining: int) -> int:
    """Reports to ask for on the next page."""
    return min(page_size, remaining, PAGE_LIMIT)


def first_reports(records: DataFrame, total_records: int = 5000) -> DataFrame:
    """The first ``total_records`` usable reports in page order; dropped ones do not count."""
    flat = flatten_records(records, keep=["page_no", "pos"])
    return flat.orderBy("page_no", "pos").limit(total_records).drop("page_no", "pos")


def fetch_reports(spark: SparkSession, path: str, total_records: int = 5000) -> DataFrame:
    return first_reports(read_pages(spark, path), total_records)
