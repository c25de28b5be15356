"""Running values over a whole table in order, without a window over the whole table.

Rows are dealt to blocks by ranges of their order and written; one row per block carries what lies
before it, and a window runs inside each block only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidentia.session import Scratch

BLOCK = "__block"


def in_blocks(df: DataFrame, scratch: Scratch, *order: str | Column) -> DataFrame:
    """``df`` with the number of its block, in the given order of blocks and rows.

    The ranges come from a sample, so the numbers are written down before anything relies on them.
    """
    ranged = df.repartitionByRange(*order).withColumn(BLOCK, F.spark_partition_id())
    return scratch.table(ranged, "blocks")


def running(
    blocks: DataFrame,
    value: Column,
    out: str,
    order: Sequence[str | Column],
    how: str = "sum",
    by: Sequence[str] = (),
    before: bool = False,
) -> DataFrame:
    """Add the ``sum``, ``max`` or ``last`` known value of all rows up to each one, per ``by``.

    ``order`` is the one that the blocks were made with, after ``by``. With ``before`` the row itself
    does not count. Where no row counts, a sum is 0 and the others are null.
    """
    fold = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    valued = blocks.withColumn("__value", value)
    inside = Window.partitionBy(BLOCK, *by).orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    whole = F.max_by("__value", F.struct(F.col("__value").isNotNull(), F.col("__place")))
    if how == "last":
        places = Window.partitionBy(BLOCK, *by).orderBy(*order)
        valued = valued.withColumn("__place", F.row_number().over(places))
    totals = valued.groupBy(BLOCK, *by).agg((whole if how == "last" else fold("__value")).alias("__t"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy(BLOCK)
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col(BLOCK).alias("__at"),
        *(F.col(c).alias(f"__by_{c}") for c in by),
        fold("__t").over(earlier).alias("__offset"),
    )
    same = F.col(BLOCK) == F.col("__at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    own, offset = F.col("__own"), F.col("__offset")
    combined = {
        "sum": F.coalesce(own, F.lit(0)) + F.coalesce(offset, F.lit(0)),
        "max": F.greatest(own, offset),
        "last": F.coalesce(own, offset),
    }[how]
    return (
        valued.withColumn("__own", fold("__value").over(inside))
        .join(offsets, same)
        .select(*blocks.columns, combined.alias(out))
    )
