"""Raw nested reports to flat rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentia.functions import parse
from incidentia.functions.labels import severity_of


def record_columns(record: Column, full_event_name: bool = False) -> list[Column]:
    event = parse.event_type(record, full_event_name)
    return [
        parse.scalar_text(record, "report_number").alias("report_number"),
        parse.scalar_text(record, "date_received").alias("date_received"),
        event.alias("event_type"),
        severity_of(event).alias("severity_label"),
        parse.device_name(record).alias("device_name"),
        parse.narrative(record).alias("narrative_text"),
    ]


def flatten_records(
    records: DataFrame,
    record: str = "record",
    keep: Sequence[str] = (),
    full_event_name: bool = False,
) -> DataFrame:
    """Flat reports of a VARIANT column; malformed reports and those without text drop out."""
    value = F.col(record)
    return records.filter(parse.reject_reason(value).isNull()).select(
        *keep, *record_columns(value, full_event_name)
    )


def rejected_records(records: DataFrame, record: str = "record") -> DataFrame:
    """Number of dropped reports per reason."""
    reason = parse.reject_reason(F.col(record)).alias("reject_reason")
    return (
        records.select(reason)
        .filter(F.col("reject_reason").isNotNull())
        .groupBy("reject_reason")
        .agg(F.count("*").alias("n"))
    )


def with_narrative(records: DataFrame, record: str = "record") -> DataFrame:
    """Reports that carry the narrative field at all."""
    return records.filter(F.try_variant_get(record, "$.mdr_text", "variant").isNotNull())
