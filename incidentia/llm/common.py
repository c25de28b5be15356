"""What several operators share: written tables, text columns, hashes, positions."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incidentia.session import shared_dir

#: Rows of two numbers that may be sent to every task: 16 MB.
BROADCAST_ROWS = 1_000_000


#: Rows of a batch that are Python objects at a time.
SLICE_ROWS = 250

_SLOT: dict = {}


def in_slot(key: tuple, make: Callable):
    """What this worker process keeps from task to task for the operator at work.

    Workers outlive their tasks and serve one operator after another. There is one place, and what
    the next operator keeps takes it over.
    """
    if key not in _SLOT:
        if _SLOT:
            _SLOT.clear()
            give_back()
        _SLOT[key] = make()
    return _SLOT[key]


def give_back() -> None:
    """Returns freed memory to the system; allocators keep it for the process otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows; an empty batch stays one."""
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(at, rows)


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs begun inside hand Python at most ``rows`` rows at a time, for rows that may be large."""
    before = spark.conf.get(_BATCH_ROWS)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(_BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)


class Work:
    """A folder in the shared folder for one run's written tables.

    Each table cuts the lineage: what was written survives a lost executor, and no later stage
    computes it again. ``drop`` removes tables that nothing reads any more; those behind a lazily
    returned frame stay.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._made = 0

    def path(self, name: str) -> str:
        self._made += 1
        return f"{self.root}/{self._made:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        where = self.path(name)
        df.write.parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def counted(self, df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict]:
        """The written table, with its ``rows`` and further sums, read from what was written."""
        table = self.table(df, name)
        counts = {"rows": F.count(F.lit(1))} | counts
        found = table.agg(*(c.alias(n) for n, c in counts.items())).first()
        return table, {n: found[n] or 0 for n in counts}

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            for file in table.inputFiles()[:1]:
                self._delete(file.rsplit("/", 1)[0])

    def clear(self) -> None:
        """Removes everything; only when no returned frame reads from here."""
        self._delete(self.root)

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow table with the broadcast hint if its counted rows are few; else Spark decides."""
    return F.broadcast(df) if rows <= limit else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def first_by(*columns: str) -> Column:
    """The least of the columns as a struct, with nulls of the first column last."""
    return F.min(F.struct(F.col(columns[0]).isNull().alias("_last"), *columns))


def unsigned_crc32(column: Column) -> Column:
    """The unsigned CRC-32 of a string's UTF-8 bytes or of bytes; null counts as empty."""
    return F.crc32(F.coalesce(column.cast("binary"), F.lit(b"")))


def id_type(df: DataFrame, column: str):
    return df.schema[column].dataType


def starts(df: DataFrame, part: str, order: list[str], size: str, out: str) -> DataFrame:
    """Adds the sum of ``size`` over all rows before each row, in the order (``part``, ``order``).

    Parts bound the work of a task; only one row per part meets in a single one.
    """
    totals = df.groupBy(part).agg(F.sum(size).alias("_total"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col(part).alias("_part"),
        F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"),
    )
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .join(offsets, F.col(part) == F.col("_part"))
        .withColumn(out, F.col("_inside") + F.col("_offset"))
        .drop("_inside", "_part", "_offset")
    )
