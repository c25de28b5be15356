"""Agreement beyond chance, calibration of confidences, percentiles that merge, composite scores."""

from __future__ import annotations

from collections.abc import Sequence
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CALIBRATION_BINS = 10
#: Relative error of a percentile.
PERCENTILE_ERROR = 0.01
#: Weights of the three tasks in the composite score.
COMPOSITE = (0.5, 0.3, 0.2)


def cohen_kappa(counts: DataFrame) -> DataFrame:
    """One row (observed, expected, kappa) from (label, prediction, n) counts.

    Where chance alone agrees always, kappa is 0; without rows all three are null.
    """
    n = F.col("n").cast("double")
    whole = counts.agg(
        F.sum(n).alias("n"),
        F.sum(F.when(F.col("label").eqNullSafe(F.col("prediction")), n).otherwise(0.0)).alias("same"),
    )
    sides = counts.select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("c"), n.alias("a"), F.lit(0.0).alias("b")),
                F.struct(F.col("prediction").alias("c"), F.lit(0.0).alias("a"), n.alias("b")),
            )
        )
    )
    margins = sides.groupBy("c").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    chance = margins.agg(F.sum(F.col("a") * F.col("b"))).scalar()
    observed, expected = F.col("same") / F.col("n"), chance / (F.col("n") * F.col("n"))
    return whole.select(observed.alias("observed"), expected.alias("expected")).select(
        "observed",
        "expected",
        F.when(F.col("expected") >= 1, 0.0)
        .otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected")))
        .alias("kappa"),
    )


def calibration_table(
    df: DataFrame, confidence_col: str, correct_col: str, bins: int = CALIBRATION_BINS
) -> DataFrame:
    """``(bin, n, confidence, accuracy)`` of equally wide bins of the confidence, empty bins left out.

    A bin holds its lower bound; the last one holds 1 as well. Rows without a confidence drop out.
    """
    confidence = F.col(confidence_col)
    place = F.greatest(F.lit(0), F.least(F.floor(confidence * bins), F.lit(bins - 1)))
    right = F.coalesce(F.col(correct_col).cast("boolean"), F.lit(False)).cast("double")
    return (
        df.filter(confidence.isNotNull() & ~F.isnan(confidence))
        .groupBy(place.cast("long").alias("bin"))
        .agg(F.count("*").alias("n"), F.avg(confidence).alias("confidence"), F.avg(right).alias("accuracy"))
    )


def calibration_error(table: DataFrame) -> DataFrame:
    """One row: the mean and the largest gap between confidence and accuracy, from the bins."""
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    return table.agg(
        (F.sum(gap * F.col("n")) / F.sum("n")).alias("expected_error"), F.max(gap).alias("largest_error")
    )


def merged_percentiles(
    df: DataFrame,
    value_col: str,
    shares: Sequence[float],
    by: Sequence[str] = (),
    error: float = PERCENTILE_ERROR,
) -> DataFrame:
    """``(by, share, value, n)``: the value at the rank ceil(share * n), within a relative error.

    Values are counted in buckets whose bounds grow by a constant factor, so that counts of any parts
    add up and a group has some hundred of them, however many rows. Zero and negative values count as
    0; missing ones drop out.
    """
    growth = (1 + error) / (1 - error)
    value = F.col(value_col).cast("double")
    bucket = F.when(value > 0, F.ceil(F.log(value) / log(growth)))
    counts = (
        df.filter(value.isNotNull() & ~F.isnan(value))
        .groupBy(*by, bucket.alias("bucket"))
        .agg(F.count("*").alias("k"))
    )
    part = Window.partitionBy(*(by or [F.lit(0)]))
    ranked = counts.withColumn("n", F.sum("k").over(part)).withColumn(
        "upto", F.sum("k").over(part.orderBy(F.asc_nulls_first("bucket")))
    )
    wanted = ranked.withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    rank = F.greatest(F.ceil(F.col("share") * F.col("n")), F.lit(1))
    found = wanted.filter((F.col("upto") >= rank) & (F.col("upto") - F.col("k") < rank))
    middle = F.lit(2.0) * F.pow(F.lit(growth), F.col("bucket")) / (growth + 1)
    return found.select(*by, "share", F.coalesce(middle, F.lit(0.0)).alias("value"), "n")


def composite_score(severity: Column, device: Column, patient: Column) -> Column:
    """The weighted score of the three tasks; a missing one gives null."""
    return sum(w * c for w, c in zip(COMPOSITE, (severity, device, patient)))
