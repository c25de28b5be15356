"""One ingestion cycle: take in landed pages, then retrain if that brought anything new."""

from __future__ import annotations

from pyspark.sql import SparkSession

from incidentia.plans.train import ModelStore, train_job
from incidentia.schema import REPORT
from incidentia.sources.reports import load_accumulated, path_exists
from incidentia.streaming.ingest import ingest_available


def run_ingestion(
    spark: SparkSession,
    pages_path: str,
    accumulated_path: str,
    checkpoint_path: str,
    store: ModelStore,
    retrain: bool = True,
    model_type: str | None = None,
    **train_options,
) -> dict:
    """Ingest and, given new records or no model yet, run the training job on everything held."""
    summary = ingest_available(spark, pages_path, accumulated_path, checkpoint_path)
    model = store.champion_path(spark)
    missing = model is None or not path_exists(spark, model)
    result = None
    if retrain and (summary.new_records_added > 0 or missing):
        reports = load_accumulated(spark, accumulated_path).select(*REPORT.names)
        train_options.setdefault("remove_unknown", True)
        result = train_job(reports, store, model_type, **train_options)
        summary.retrain_triggered = True
    return {**summary.as_dict(), "training": result}
