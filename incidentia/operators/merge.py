"""Adding a batch of reports to the accumulated table without repeating known report numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "report_number"
_KNOWN = "__known_key"


def _usable(key: str) -> Column:
    # Blank and missing report numbers identify nothing: they match no other report.
    return F.nullif(F.col(key).cast("string"), F.lit(""))


def known_keys(existing: DataFrame, new: DataFrame, key: str = KEY) -> DataFrame:
    """Keys of ``new`` that ``existing`` already holds.

    The accumulated table is scanned for its key column and reduced to the batch's keys first;
    adaptive execution broadcasts those if they are few.
    """
    batch = new.select(_usable(key).alias(_KNOWN)).filter(F.col(_KNOWN).isNotNull()).distinct()
    held = existing.select(_usable(key).alias(_KNOWN)).filter(F.col(_KNOWN).isNotNull())
    return held.join(batch, _KNOWN, "left_semi").distinct()


def new_only(existing: DataFrame, new: DataFrame, key: str = KEY) -> DataFrame:
    """Rows of ``new`` whose key is not in ``existing``; rows without a key always pass.

    Repeats inside the batch stay. Rows without a key are spread over all partitions by their
    content instead of meeting in the one that owns the null key. The spread is part of the join
    key: as a column of its own, constant on one side, the optimizer would turn it into a filter.
    """
    usable = _usable(key)
    content = F.xxhash64(*[F.col(f"`{c}`") for c in new.columns]).cast("string")
    tagged = F.when(usable.isNull(), F.concat(F.lit("spread:"), content)).otherwise(
        F.concat(F.lit("key:"), usable)
    )
    known = known_keys(existing, new, key).select(
        F.concat(F.lit("key:"), F.col(_KNOWN)).alias(_KNOWN)
    )
    return new.withColumn(_KNOWN, tagged).join(known, _KNOWN, "left_anti").drop(_KNOWN)


def append_rows(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(new, allowMissingColumns=True)


def merge_and_dedup(existing: DataFrame, new: DataFrame, key: str = KEY) -> DataFrame:
    """``existing`` followed by the truly new rows of ``new``."""
    return append_rows(existing, new_only(existing, new, key))


def count_new(existing: DataFrame, new: DataFrame, key: str = KEY) -> DataFrame:
    return new_only(existing, new, key).agg(F.count("*").alias("n_new"))


def dedup_batch(df: DataFrame, key: str = KEY, order_col: str = "date_received") -> DataFrame:
    """One row per key, the latest by ``order_col``; rows without a key all stay.

    A running maximum over whole rows combines on the map side, so a key that holds a large share
    of the batch shrinks to one row per task before the shuffle.
    """
    rest = [c for c in df.columns if c not in (key, order_col)]
    ranked = F.struct(order_col, *rest)
    keyed = (
        df.filter(_usable(key).isNotNull())
        .groupBy(key)
        .agg(F.max(ranked).alias("latest"))
        .select(key, "latest.*")
        .select(*df.columns)
    )
    return keyed.unionByName(df.filter(_usable(key).isNull()))


def ingest_summary(batch: DataFrame, added: DataFrame, merged: DataFrame, requested: int):
    """One row of stage counts: rows returned, added and held, from one pass over each side."""

    def tally(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n")

    counts = tally(batch, "returned").unionByName(tally(added, "added"))
    counts = counts.unionByName(tally(merged, "total"))

    def pick(name: str) -> Column:
        return F.max(F.when(F.col("stage") == name, F.col("n")))

    return counts.agg(
        F.lit(requested).cast("long").alias("batch_requested"),
        pick("returned").alias("batch_returned"),
        pick("added").alias("new_records_added"),
        pick("total").alias("total_accumulated"),
    )
