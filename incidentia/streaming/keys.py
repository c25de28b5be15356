"""The report numbers that the accumulated table holds, kept beside it by batch and hash bucket.

A micro-batch looks its numbers up in the buckets they fall into and never scans the reports. A batch's
numbers are one folder that a replay overwrites, written after the reports; a batch that has reports but
no numbers yet, because a run broke off or the table is older than the store, is indexed from the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentia.operators.merge import KEY
from incidentia.sources.reports import path_exists

#: Fixed for the life of a store: where a number is looked up depends on it.
BUCKETS = 64


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class KeyStore:
    """Numbers of one accumulated table, in ``<table>_keys``."""

    def __init__(self, spark: SparkSession, table_path: str):
        self.spark = spark
        self.table_path = table_path
        self.path = f"{table_path}_keys"

    def add(self, reports: DataFrame, batch_id: int) -> None:
        """Write the numbers of a batch, in place of what was written for it before."""
        key = F.col(KEY).cast("string")
        keys = reports.select(key.alias(KEY)).filter(F.coalesce(F.col(KEY) != "", F.lit(False)))
        (
            keys.distinct()
            .withColumn("bucket", bucket_of(F.col(KEY)))
            .repartition("bucket")
            .write.mode("overwrite")
            .partitionBy("bucket")
            .parquet(f"{self.path}/batch_id={batch_id}")
        )

    def held(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Numbers of other batches, read from the buckets that ``batch``'s own numbers fall into."""
        empty = self.spark.createDataFrame([], f"{KEY} string")
        if not path_exists(self.spark, self.path):
            return empty
        key = F.col(KEY).cast("string")
        # At most BUCKETS rows.
        asked = [r[0] for r in batch.filter(key != "").select(bucket_of(key)).distinct().collect()]
        schema = f"{KEY} string, bucket int, batch_id long"
        keys = self.spark.read.schema(schema).parquet(self.path)
        return keys.filter(F.col("bucket").isin(asked) & (F.col("batch_id") != batch_id)).select(KEY)

    def index_missing(self) -> list[int]:
        """Index the batches of the table that have no numbers in the store; which ones they were."""
        missing = sorted(_batches(self.spark, self.table_path) - _batches(self.spark, self.path))
        if missing:
            table = self.spark.read.schema(f"{KEY} string, batch_id long").parquet(self.table_path)
            for batch_id in missing:
                self.add(table.filter(F.col("batch_id") == batch_id), batch_id)
        return missing


def _batches(spark: SparkSession, path: str) -> set[int]:
    """Batch ids that have a folder under ``path``, from the file system's listing alone."""
    if not path_exists(spark, path):
        return set()
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = (entry.getPath().getName() for entry in found)
    return {int(n.removeprefix("batch_id=")) for n in names if n.startswith("batch_id=")}
