"""Small tables next to the models: the champion's record and the log of training runs."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentia.functions.promotion import champion_score
from incidentia.schema import CHAMPION, RUN
from incidentia.sources.reports import path_exists


def champion_table(spark: SparkSession, path: str) -> DataFrame:
    """The champion's record: one row, or none before the first promotion."""
    versions = _versions(spark, path)
    if versions:
        return spark.read.schema(CHAMPION).json(f"{path}/{versions[-1]}")
    return spark.createDataFrame([], CHAMPION)


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the completely written records under ``path``, oldest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    done = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "version=*/_SUCCESS"))
    return sorted(status.getPath().getParent().getName() for status in done or [])


def champion_metrics(spark: SparkSession, path: str) -> dict:
    row = champion_table(spark, path).first()
    return row.asDict() if row else {}


def champion_f1(spark: SparkSession, path: str) -> float:
    """Cross-validated F1 of the champion, hold-out F1 in its place, zero without a champion."""
    score = champion_score(F.col("cv_f1_mean"), F.col("f1_weighted")).alias("score")
    row = champion_table(spark, path).select(score).first()
    return row["score"] if row else 0.0


def save_champion(spark: SparkSession, metrics: dict, path: str) -> None:
    """Replace the champion's record. ``val_f1_weighted`` stands in for ``f1_weighted``.

    The new record is a version of its own, and readers take the latest that is complete: a job lost
    on the way leaves the champion as it was.
    """
    row = {name: metrics.get(name) for name in CHAMPION.names}
    if row["f1_weighted"] is None:
        row["f1_weighted"] = metrics.get("val_f1_weighted")
    row["model_type"] = row["model_type"] or "tfidf"
    table = spark.createDataFrame([tuple(row[name] for name in CHAMPION.names)], CHAMPION)
    version = f"{path}/version={time.time_ns():020d}"
    table.coalesce(1).write.option("ignoreNullFields", "false").json(version)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    if path_exists(spark, path):
        return spark.read.schema(RUN).parquet(path)
    return spark.createDataFrame([], RUN)


class RunLog:
    """Collects one training run's params, metrics, tags and texts; ``close`` appends the row."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.run_id = uuid.uuid4().hex
        self.start_time = int(time.time() * 1000)
        self.params: dict[str, str] = {}
        self.metrics: dict[str, float] = {}
        self.tags: dict[str, str] = {}
        self.texts: dict[str, str] = {}

    def log_params(self, **values) -> None:
        self.params.update({k: str(v) for k, v in values.items()})

    def log_metrics(self, **values) -> None:
        self.metrics.update({k: float(v) for k, v in values.items()})

    def set_tag(self, key: str, value) -> None:
        self.tags[key] = str(value)

    def log_text(self, name: str, text: str) -> None:
        self.texts[name] = text

    def close(self) -> None:
        row = (self.run_id, self.start_time, self.params, self.metrics, self.tags, self.texts)
        self.spark.createDataFrame([row], RUN).coalesce(1).write.mode("append").parquet(self.path)
