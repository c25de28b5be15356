"""Reports with several labels: label sets, thresholds, and metrics over label arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentia.functions.arrays import let
from incidentia.operators.ordered import in_blocks, running
from incidentia.schema import LABELS
from incidentia.session import Scratch, written_table

THRESHOLD = 0.5


def multi_hot(
    df: DataFrame,
    key: str = "report_number",
    label_col: str = "severity_label",
    labels: Sequence[str] = LABELS,
) -> DataFrame:
    """``(key, label_set, multi_hot)``: the labels of all reports that share a number, in label order.

    Labels outside the domain and missing ones add nothing. Rows whose number is blank or missing
    belong to no other row and keep a set each. One flag per label combines before the shuffle, so a
    number that many rows share costs a row per task.
    """
    flags = [F.coalesce(F.col(label_col) == label, F.lit(False)).cast("int") for label in labels]
    usable = F.coalesce(F.col(key).cast("string") != "", F.lit(False))
    names = [f"__{k}" for k in range(len(labels))]
    rows = df.select(key, usable.alias("__usable"), *(f.alias(n) for f, n in zip(flags, names)))
    keyed = rows.filter("__usable").groupBy(key).agg(*(F.max(n).alias(n) for n in names))
    every = keyed.unionByName(rows.filter("NOT __usable").select(key, *names))
    hot = F.array(*names)
    return every.select(key, _labels_where(hot, labels).alias("label_set"), hot.alias("multi_hot"))


def _labels_where(flags: Column, labels: Sequence[str]) -> Column:
    domain = F.array(*map(F.lit, labels))
    return F.filter(domain, lambda label, i: F.get(flags, i) == 1)


def sigmoid(scores: Column) -> Column:
    """Independent probabilities of a score array."""
    return F.transform(scores, lambda x: 1 / (1 + F.exp(-x)))


def label_set(
    probabilities: Column,
    labels: Sequence[str] = LABELS,
    thresholds: Sequence[float] | float = THRESHOLD,
) -> Column:
    """Labels whose probability reaches their threshold, in label order; there may be none."""
    if isinstance(thresholds, float):
        thresholds = [thresholds] * len(labels)
    least = F.array(*map(F.lit, thresholds))
    domain = F.array(*map(F.lit, labels))
    return F.filter(domain, lambda label, i: F.get(probabilities, i) >= F.get(least, i))


def best_thresholds(
    df: DataFrame, label_col: str = "label", score_col: str = "score", true_col: str = "is_true"
) -> DataFrame:
    """``(label, threshold, f1, n_positive, n)``: the score from which on a label has the best F1.

    Rows (label, score, is_true); rows with a missing score count as never predicted. Of equally good
    thresholds the highest is taken, and a label without a true row gets its highest score with F1 0.
    Equal scores are counted together first. Hits and predictions down to each score are running sums
    over blocks of the (label, score) order, so a label may hold any number of rows.
    """
    true = F.coalesce(F.col(true_col).cast("boolean"), F.lit(False)).cast("int")
    counts = df.groupBy(F.col(label_col).alias("label"), F.col(score_col).cast("double").alias("score")).agg(
        F.count("*").alias("n"), F.sum(true).alias("hits")
    )
    with Scratch(df.sparkSession) as scratch:
        # Predicted first: the highest scores; missing ones come last.
        order = ["label", F.desc_nulls_last("score")]
        blocks = in_blocks(counts, scratch, *order)
        within = [F.desc_nulls_last("score")]
        summed = running(blocks, F.col("hits"), "tp", within, by=["label"])
        summed = running(summed, F.col("n"), "predicted", within, by=["label"])
        totals = counts.groupBy("label").agg(
            F.sum("hits").alias("n_positive"), F.sum("n").alias("n_rows")
        ).withColumnRenamed("label", "__label")
        joined = summed.join(totals, F.col("label").eqNullSafe(F.col("__label")))
        f1 = 2 * F.col("tp") / (F.col("predicted") + F.col("n_positive"))
        best = (
            joined.filter("score IS NOT NULL")
            .withColumn("f1", f1)
            .groupBy("label")
            .agg(
                F.max(F.struct("f1", "score")).alias("best"),
                F.first("n_positive").alias("n_positive"),
                F.first("n_rows").alias("n"),
            )
        )
        return written_table(
            best.select(
                "label", F.col("best.score").alias("threshold"), F.col("best.f1").alias("f1"),
                "n_positive", "n",
            ),
            "thresholds",
        )


def multilabel_metrics(
    df: DataFrame,
    true_col: str = "true_labels",
    predicted_col: str = "predicted_labels",
    scores_col: str | None = None,
    labels: Sequence[str] = LABELS,
) -> DataFrame:
    """One row of multi-label metrics from arrays of true and predicted labels and a score array.

    Labels outside the domain, repeats and missing arrays add nothing. ``micro_f1`` and ``macro_f1``
    pool hits over all labels or average the labels' scores, 0 where a label is neither true nor
    predicted. ``hamming_loss`` is the share of labels that differ; ``jaccard`` the mean of common
    over joint labels, 1 for two empty sets. With scores in label order, ``coverage_error`` is how far
    down the ranking the last true label comes, 0 without one, and ``ranking_precision`` the mean
    over true labels of the share of true ones at or above each, 1 if none or all labels are true;
    labels of equal score share the lowest of their ranks. A table without rows gives nulls.
    """
    domain = F.array(*map(F.lit, labels))
    size = len(labels)

    def known(column: str) -> Column:
        return F.array_intersect(domain, F.coalesce(F.col(column), F.array().cast("array<string>")))

    rows = df.select(
        known(true_col).alias("t"),
        known(predicted_col).alias("p"),
        *([F.col(scores_col).alias("s")] if scores_col else []),
    )
    both = F.size(F.array_intersect("t", "p"))
    either = F.size("t") + F.size("p") - both
    sums = [
        F.sum(both).alias("tp"),
        F.sum(F.size("t")).alias("n_true"),
        F.sum(F.size("p")).alias("n_predicted"),
        F.avg((either - both) / size).alias("hamming_loss"),
        F.avg(F.when(either == 0, 1.0).otherwise(both / either)).alias("jaccard"),
    ]
    for k, label in enumerate(labels):
        t, p = F.array_contains("t", label), F.array_contains("p", label)
        sums += [F.count_if(t & p).alias(f"tp{k}"), (F.count_if(t) + F.count_if(p)).alias(f"n{k}")]
    if scores_col:
        sums += [
            F.avg(_coverage(domain)).alias("coverage_error"),
            F.avg(_ranking(domain, size)).alias("ranking_precision"),
        ]

    def f1(tp: Column, n: Column) -> Column:
        return F.coalesce(F.try_divide(2 * tp.cast("double"), n), F.lit(0.0))

    macro = sum(f1(F.col(f"tp{k}"), F.col(f"n{k}")) for k in range(size)) / size
    return rows.agg(*sums).select(
        f1(F.col("tp"), F.col("n_true") + F.col("n_predicted")).alias("micro_f1"),
        macro.alias("macro_f1"),
        "hamming_loss",
        "jaccard",
        *(["coverage_error", "ranking_precision"] if scores_col else []),
    )


def _true_scores(domain: Column) -> Column:
    return F.transform("t", lambda x: F.get(F.col("s"), F.array_position(domain, x).cast("int") - 1))


def _at_least(scores: Column, x: Column) -> Column:
    return F.size(F.filter(scores, lambda y: y >= x))


def _coverage(domain: Column) -> Column:
    lowest = F.array_min(_true_scores(domain))
    return F.when(F.size("t") == 0, 0).otherwise(let(lowest, lambda x: _at_least(F.col("s"), x)))


def _ranking(domain: Column, size: int) -> Column:
    def mean(true: Column) -> Column:
        shares = F.transform(true, lambda x: _at_least(true, x) / _at_least(F.col("s"), x))
        return F.aggregate(shares, F.lit(0.0), lambda a, x: a + x) / F.size("t")

    plain = (F.size("t") == 0) | (F.size("t") == size)
    return F.when(plain, 1.0).otherwise(let(_true_scores(domain), mean))
