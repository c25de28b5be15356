"""Exploring and scoring report tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from incidentia.functions.text import clean_text, strip
from incidentia.operators.filters import display_columns, search, with_labels
from incidentia.operators.models import TextModel
from incidentia.sources.reports import write_csv


def explore(
    reports: DataFrame,
    labels: Iterable[str] | None = None,
    term: str | None = None,
    literal: bool = False,
) -> DataFrame:
    """Reports of the chosen labels whose narrative matches the search term, all columns."""
    view = reports if labels is None else with_labels(reports, labels)
    return search(view, term, literal) if term else view


def explore_view(reports: DataFrame, **filters) -> DataFrame:
    return display_columns(explore(reports, **filters))


def export(reports: DataFrame, path: str, **filters) -> None:
    """Write the explored reports as CSV."""
    write_csv(explore(reports, **filters), path)


def score_reports(
    reports: DataFrame, model: TextModel, text_col: str = "narrative_text"
) -> DataFrame:
    """Predicted label and class scores of raw narratives; blank ones are left out."""
    cleaned = reports.withColumn("clean_text", clean_text(F.col(text_col)))
    return model.transform(cleaned.filter(F.coalesce(F.length(strip(F.col(text_col))), F.lit(0)) > 0))


def severity_overview(cleaned: DataFrame) -> DataFrame:
    """Per label: reports, average cleaned length and share of all; the flagship summary."""
    per_label = cleaned.groupBy("severity_label").agg(
        F.count("*").alias("n_reports"), F.avg(F.length("clean_text")).alias("avg_clean_length")
    )
    share = F.col("n_reports") / F.sum("n_reports").over(Window.partitionBy(F.lit(0)))
    return per_label.withColumn("share", share)
