"""Classification metrics. Everything derives from one small table of (label, prediction) counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidentia.functions.rounding import round_score
from incidentia.schema import LABELS, MAX_CLASSES


def _class_rows(rows: DataFrame, most: int = MAX_CLASSES) -> DataFrame:
    """``rows``, one per class, as they are; an error in place of more than ``most`` of them.

    Reads one row beyond the bound at most, so what is gathered from the result stays bounded.
    """
    few = rows.limit(most + 1)
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    error = F.raise_error(F.lit(f"more than {most} classes")).cast("boolean")
    return few.withColumn("__few", F.when(n > most, error).otherwise(True)).filter("__few").drop("__few")


def _labels_seen(counts: DataFrame) -> Column:
    """The labels of a table of counts as one sorted array, within the class bound."""
    return _class_rows(counts.select("label").distinct()).agg(F.array_sort(F.collect_set("label"))).scalar()


def label_distribution(df: DataFrame, label_col: str = "severity_label") -> DataFrame:
    """``(label, n)`` of the non-null labels, largest first."""
    return (
        df.filter(F.col(label_col).isNotNull())
        .groupBy(label_col)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), label_col)
    )


def class_count_metrics(df: DataFrame, label_col: str = "severity_label") -> DataFrame:
    """One row: map ``class_count_<label>`` → rows of that class."""
    entry = F.struct(F.concat(F.lit("class_count_"), F.col(label_col)), F.col("n").cast("double"))
    counts = df.filter(F.col(label_col).isNotNull()).groupBy(label_col).agg(F.count("*").alias("n"))
    return _class_rows(counts).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("class_counts")
    )


def median_length(
    df: DataFrame, text_col: str = "narrative_text", label_col: str = "severity_label"
) -> DataFrame:
    """Exact median text length per label, shortest first.

    Lengths are counted first, so the percentile sees each distinct length once however many rows
    a label has.
    """
    return (
        df.filter(F.col(label_col).isNotNull())
        .groupBy(label_col, F.length(text_col).alias("len"))
        .agg(F.count("*").alias("n"))
        .groupBy(label_col)
        .agg(F.percentile("len", 0.5, F.col("n")).alias("median_length"))
        .orderBy("median_length", label_col)
    )


def class_weights(
    df: DataFrame, label_col: str = "severity_label", labels: Sequence[str] = LABELS
) -> DataFrame:
    """``(label, weight)`` balanced weights ``n / (classes present * n_class)``; absent classes 0."""
    everything = Window.partitionBy(F.lit(0))  # one row per class
    present = (
        df.filter(F.col(label_col).isNotNull())
        .groupBy(F.col(label_col).alias("label"))
        .agg(F.count("*").alias("n"))
        .withColumn(
            "weight",
            F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n")),
        )
    )
    domain = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(label) for label in labels])).alias("label")
    )
    return domain.join(present, "label", "left").select(
        "label", F.coalesce("weight", F.lit(0.0)).alias("weight")
    )


def confusion_counts(
    df: DataFrame, label_col: str = "label", prediction_col: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Rows per (label, prediction): at most classes² rows, combined on the map side."""
    return df.groupBy(
        *by, F.col(label_col).alias("label"), F.col(prediction_col).alias("prediction")
    ).agg(F.count("*").alias("n"))


def accuracy(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    hit = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    return counts.groupBy(*by).agg(F.try_divide(hit, F.sum("n")).alias("accuracy"))


def _or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator), F.lit(0.0))


def per_class(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every class seen as label or prediction."""
    same = F.col("label") == F.col("prediction")
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(
            F.col("label").alias("class"),
            F.col("n").alias("support"),
            zero.alias("predicted"),
            F.when(same, F.col("n")).otherwise(zero).alias("tp"),
        ),
        F.struct(
            F.col("prediction").alias("class"),
            zero.alias("support"),
            F.col("n").alias("predicted"),
            zero.alias("tp"),
        ),
    )
    totals = (
        counts.select(*by, F.inline(sides))
        .groupBy(*by, "class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    )
    return totals.select(
        *by,
        "class",
        _or_zero(F.col("tp"), F.col("predicted")).alias("precision"),
        _or_zero(F.col("tp"), F.col("support")).alias("recall"),
        _or_zero(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
        "tp",
        "predicted",
    )


def weighted_f1(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    weighted = F.sum(F.col("support") * F.col("f1"))
    return per_class(counts, by).groupBy(*by).agg(
        _or_zero(weighted, F.sum("support")).alias("f1_weighted")
    )


def scores(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and weighted F1 in one row (per group)."""
    hits = F.sum("tp").cast("double")
    return per_class(counts, by).groupBy(*by).agg(
        _or_zero(hits, F.sum("support")).alias("accuracy"),
        _or_zero(F.sum(F.col("support") * F.col("f1")), F.sum("support")).alias("f1_weighted"),
    )


def classification_report(counts: DataFrame) -> DataFrame:
    """Per-class rows plus ``accuracy``, ``macro avg`` and ``weighted avg``."""
    classes = per_class(counts)
    support = F.sum("support")

    def summary(name: str, pick) -> DataFrame:
        return classes.agg(
            *[pick(c).alias(c) for c in ("precision", "recall", "f1")], support.alias("support")
        ).select(F.lit(name).alias("class"), "precision", "recall", "f1", "support")

    hit_rate = _or_zero(F.sum("tp"), support)
    return (
        classes.select("class", "precision", "recall", "f1", "support")
        .unionByName(summary("accuracy", lambda c: hit_rate))
        .unionByName(summary("macro avg", F.avg))
        .unionByName(
            summary("weighted avg", lambda c: _or_zero(F.sum(F.col(c) * F.col("support")), support))
        )
    )


def report_text(report: DataFrame) -> DataFrame:
    """The report as one text, a line per row, for the run log."""
    line = F.format_string(
        "%-14s precision=%.4f recall=%.4f f1=%.4f support=%d",
        "class", *[round_score(F.col(c)) for c in ("precision", "recall", "f1")], "support",
    )
    order = F.when(F.col("class").isin("accuracy", "macro avg", "weighted avg"), 1).otherwise(0)
    # Labels and predictions have at most MAX_CLASSES values each, besides the three summary rows.
    report = _class_rows(report, 2 * MAX_CLASSES + 3)
    lines = report.select(F.struct(order, F.col("class"), line.alias("line")).alias("entry"))
    ordered = F.array_sort(F.collect_list("entry"))
    return lines.agg(F.array_join(ordered["line"], "\n").alias("classification_report"))


def confusion_matrix(counts: DataFrame, classes: Sequence[str] | None = None) -> DataFrame:
    """Dense matrix ``(label, prediction, n)`` over ``classes`` (default: the labels seen)."""
    if classes is None:
        seen = _labels_seen(counts)
    else:
        seen = F.array(*[F.lit(c) for c in classes])
    cells = (
        counts.sparkSession.range(1)
        .select(F.explode(seen).alias("label"))
        .withColumn("prediction", F.explode(seen))
    )
    return cells.join(counts, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def majority_label(train: DataFrame, label_col: str = "label") -> DataFrame:
    """The most frequent label; of equals, the smallest."""
    counts = train.filter(F.col(label_col).isNotNull()).groupBy(label_col)
    return (
        counts.agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), label_col)
        .limit(1)
        .select(label_col)
    )


def majority_baseline(train: DataFrame, test: DataFrame, label_col: str = "label") -> DataFrame:
    """Scores of always predicting the training majority."""
    guessed = test.select(
        F.col(label_col).alias("label"), majority_label(train, label_col).scalar().alias("prediction")
    )
    return scores(confusion_counts(guessed)).select(
        F.col("accuracy").alias("dummy_accuracy"), F.col("f1_weighted").alias("dummy_f1_weighted")
    )


def cv_summary(fold_scores: DataFrame) -> DataFrame:
    """Per-fold scores in order, their mean and population deviation, from ``(fold, f1)`` rows."""
    ordered = F.array_sort(F.collect_list(F.struct("fold", "f1")))
    return fold_scores.agg(
        ordered["f1"].alias("cv_f1_per_fold"),
        F.avg("f1").alias("cv_f1_mean"),
        F.stddev_pop("f1").alias("cv_f1_std"),
        F.count("*").alias("n_splits"),
    )


def majority_cross_validation(
    folded: DataFrame, label_col: str = "severity_label", fold_col: str = "fold"
) -> DataFrame:
    """``(fold, f1)`` of the majority model, all folds from one table of (fold, label) counts."""
    counts = folded.groupBy(F.col(fold_col).alias("fold"), F.col(label_col).alias("label")).agg(
        F.count("*").alias("n")
    )
    outside = F.sum("n").over(Window.partitionBy("label")) - F.col("n")
    guess = F.max_by("label", F.struct(F.col("n_train"), -F.col("code"))).over(
        Window.partitionBy("fold")
    )
    dense = confusion_dense_folds(counts).withColumn("n_train", outside)
    coded = dense.withColumn(
        "code", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("label"))
    )
    guessed = coded.withColumn("prediction", guess).filter("n > 0")
    return weighted_f1(guessed.select("fold", "label", "prediction", "n"), by=["fold"]).select(
        "fold", F.col("f1_weighted").alias("f1")
    )


def confusion_dense_folds(counts: DataFrame) -> DataFrame:
    """Every (fold, label) pair with its count, zero where a fold lacks a class."""
    folds = counts.agg(F.collect_set("fold")).scalar()
    labels = counts.select("label").distinct().withColumn("fold", F.explode(folds))
    return labels.join(counts, ["fold", "label"], "left").select(
        "fold", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def beats_baseline(model: Column, dummy: Column) -> Column:
    return model > dummy


def evaluate(predictions: DataFrame, label_col: str = "label", prediction_col: str = "prediction"):
    """One row: accuracy, weighted F1, report text, matrix cells and trained classes."""
    counts = confusion_counts(predictions, label_col, prediction_col)
    cell = F.struct("label", "prediction", "n")
    return scores(counts).select(
        "accuracy",
        "f1_weighted",
        report_text(classification_report(counts)).scalar().alias("classification_report"),
        confusion_matrix(counts)
        .agg(F.array_sort(F.collect_list(cell)).alias("m"))
        .scalar()
        .alias("confusion_matrix"),
        _labels_seen(counts).alias("classes"),
    )
