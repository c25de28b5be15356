"""Incident-report text analytics on Spark: ingest, clean, deduplicate, classify, promote, explore."""

__version__ = "0.1.0"
