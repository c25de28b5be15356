"""Scoring with linear models as tables, and what follows from class scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidentia.functions.arrays import argmax, softmax
from incidentia.functions.labels import label_name
from incidentia.operators.features import TermSpace

TOP_TERMS = 15


def linear_scores(
    docs: DataFrame,
    space: TermSpace,
    coefficients: DataFrame,
    intercepts: dict[str, float],
    key_col: str = "report_number",
    text_col: str = "clean_text",
) -> DataFrame:
    """``(key, label, score)``: weighted term sums plus intercept for each document and class.

    ``coefficients(term, coef)`` holds one array per term, in the order of ``intercepts``; terms of
    the space without one count as zero. The table, bounded by the vocabulary, reaches the tasks as
    a matrix; each row's sums are made inside the row, so missing and repeated keys stay apart and
    no document is shuffled. Documents without a known term get the intercepts.
    """
    of_term = {row["term"]: row["coef"] for row in coefficients.collect() if row["coef"] is not None}
    of_term = {term: of_term[term] for term in space.terms if term in of_term}
    sums = space.sums(F.col(text_col), of_term, docs.sparkSession)
    per_class = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                (F.coalesce(F.get("__sums", F.lit(k)), F.lit(0.0)) + F.lit(float(intercept))).alias("score"),
            )
            for k, (label, intercept) in enumerate(intercepts.items())
        ]
    )
    return docs.select(key_col, sums.alias("__sums")).select(key_col, F.inline(per_class))


def score_map(labels: Column, values: Column) -> Column:
    return F.map_from_arrays(labels, values)


def predict_from_logits(
    df: DataFrame, logits: str, labels: Sequence[str], probabilities: str = "probabilities"
) -> DataFrame:
    """Add ``predicted_label`` (first maximum) and the map of class probabilities."""
    names = F.array(*[F.lit(label) for label in labels])
    return df.withColumn(probabilities, score_map(names, softmax(F.col(logits)))).withColumn(
        "predicted_label", F.get(names, argmax(F.col(logits)).cast("int"))
    )


def ranked_scores(df: DataFrame, score_col: str = "probabilities", keep: Sequence[str] = ()):
    """``(…, label, label_name, score)``, best class first within each row's group of entries."""
    entries = F.transform(
        F.map_entries(score_col), lambda e: F.struct((-e["value"]).alias("k"), e["key"].alias("l"))
    )
    return df.select(*keep, F.posexplode(F.array_sort(entries)).alias("pos", "e")).select(
        *keep,
        (F.col("pos") + 1).alias("rank"),
        F.col("e.l").alias("label"),
        label_name(F.col("e.l"), keep_unlisted=True).alias("label_name"),
        (-F.col("e.k")).alias("score"),
    )


def top_terms(coefficients: DataFrame, n: int = TOP_TERMS) -> DataFrame:
    """The ``n`` terms with the highest coefficient per class, from ``(label, term, coef)``."""
    order = Window.partitionBy("label").orderBy(F.desc("coef"), "term")
    return (
        coefficients.withColumn("rank", F.row_number().over(order).cast("long"))
        .filter(F.col("rank") <= n)
        .select("label", "rank", "term", "coef")
    )
