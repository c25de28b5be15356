import pytest
from pyspark.sql import functions as F

from incidentia.functions.arrays import argmax, softmax, term_counts
from incidentia.operators import linear as LI
from incidentia.operators import metrics as M
from incidentia.operators import runs as RU
from incidentia.schema import LABELS

PAIRS = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")]


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame(PAIRS, "label string, prediction string")


def test_scores(pairs):
    counts = M.confusion_counts(pairs)
    assert M.accuracy(counts).first()[0] == pytest.approx(5 / 7)
    # f1: a = 6/8, b = 4/5, c = 0
    assert M.weighted_f1(counts).first()[0] == pytest.approx((4 * 0.75 + 2 * 0.8) / 7)
    both = M.scores(counts).first()
    assert both["accuracy"] == pytest.approx(5 / 7)


def test_scores_match_the_library_evaluator(spark, pairs):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    coded = pairs.select(
        *[(F.ascii(c) - 97).cast("double").alias(c) for c in ("label", "prediction")]
    )
    evaluator = MulticlassClassificationEvaluator(metricName="f1")
    assert M.weighted_f1(M.confusion_counts(pairs)).first()[0] == pytest.approx(evaluator.evaluate(coded))


def test_report_and_matrix(pairs):
    counts = M.confusion_counts(pairs)
    report = {r["class"]: r for r in M.classification_report(counts).collect()}
    assert report["a"]["precision"] == pytest.approx(0.75)
    assert report["c"]["f1"] == 0.0 and report["c"]["support"] == 1
    assert report["macro avg"]["recall"] == pytest.approx((0.75 + 1 + 0) / 3)
    assert report["accuracy"]["f1"] == pytest.approx(5 / 7)
    matrix = {(r[0], r[1]): r[2] for r in M.confusion_matrix(counts).collect()}
    assert len(matrix) == 9 and matrix[("a", "b")] == 1 and matrix[("b", "a")] == 0
    fixed = M.confusion_matrix(counts, ["a", "z"]).collect()
    assert sorted((r[0], r[1], r[2]) for r in fixed) == [("a", "a", 3), ("a", "z", 0), ("z", "a", 0), ("z", "z", 0)]


def test_evaluate_bundle(pairs):
    row = M.evaluate(pairs).first()
    assert row["classes"] == ["a", "b", "c"]
    assert len(row["confusion_matrix"]) == 9
    assert row["classification_report"].startswith("a ") and "weighted avg" in row["classification_report"]


def test_distribution_and_counts(spark):
    df = spark.createDataFrame([("D",), ("D",), ("M",), ("I",), (None,)], "severity_label string")
    got = [tuple(r) for r in M.label_distribution(df).collect()]
    assert got == [("D", 2), ("I", 1), ("M", 1)]
    assert M.class_count_metrics(df).first()[0] == {"class_count_D": 2, "class_count_I": 1, "class_count_M": 1}
    other = spark.createDataFrame([("A",), ("B",), ("A",)], "category string")
    assert {r[0]: r[1] for r in M.label_distribution(other, "category").collect()} == {"A": 2, "B": 1}


def test_median(spark):
    df = spark.createDataFrame([("D", "a" * n) for n in (1, 2, 9, 10)] + [("M", "aaa")], "severity_label string, narrative_text string")
    assert [tuple(r) for r in M.median_length(df).collect()] == [("M", 3.0), ("D", 5.5)]


def test_class_weights(spark):
    df = spark.createDataFrame([("D",)] * 6 + [("M",)] * 2, "severity_label string")
    got = {r[0]: r[1] for r in M.class_weights(df).collect()}
    assert got == {"D": 8 / 12, "I": 0.0, "M": 2.0, "O": 0.0, "UNKNOWN": 0.0}
    assert sum(got[lb] * n for lb, n in (("D", 6), ("M", 2))) == pytest.approx(8)


def test_majority_baseline(spark):
    train = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "label string")
    test = spark.createDataFrame([("a",), ("a",), ("b",)], "label string")
    assert M.majority_label(train).first()[0] == "a"  # of equals the smallest
    row = M.majority_baseline(train, test).first()
    assert row["dummy_accuracy"] == pytest.approx(2 / 3)
    assert row["dummy_f1_weighted"] == pytest.approx(2 / 3 * 0.8)


def test_cv_summary(spark):
    row = M.cv_summary(spark.createDataFrame([(1, 0.6), (0, 0.8)], "fold int, f1 double")).first()
    assert row["cv_f1_per_fold"] == [0.8, 0.6]
    assert (row["cv_f1_mean"], row["cv_f1_std"], row["n_splits"]) == (pytest.approx(0.7), pytest.approx(0.1), 2)


def test_softmax_argmax(spark):
    df = spark.createDataFrame([([1.0, 1000.0, 1000.0],), ([0.0, 0.0, 0.0],)], "z array<double>")
    rows = df.select(softmax(F.col("z")), argmax(F.col("z"))).collect()
    assert rows[0][0] == pytest.approx([0.0, 0.5, 0.5]) and rows[0][1] == 1
    assert rows[1][0] == pytest.approx([1 / 3] * 3) and rows[1][1] == 0


def test_ranked_scores(spark):
    df = LI.predict_from_logits(
        spark.createDataFrame([(1, [0.0, 3.0, 1.0, 2.0, -1.0])], "id int, z array<double>"), "z", LABELS
    )
    assert df.first()["predicted_label"] == "I"
    ranked = [r["label"] for r in LI.ranked_scores(df, keep=["id"]).orderBy("rank").collect()]
    assert ranked == ["I", "O", "M", "D", "UNKNOWN"]


def test_term_counts(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],)], "t array<string>")
    got = [[tuple(x) for x in r[0]] for r in df.select(term_counts(F.col("t"))).collect()]
    assert got == [[("a", 1), ("b", 2)], []]


def test_best_epoch_is_the_first_maximum(spark):
    df = spark.createDataFrame([("m", 1, 0.5), ("m", 2, 0.7), ("m", 3, 0.7)], "model_id string, epoch int, f1 double")
    assert tuple(RU.best_epoch(df).first()) == ("m", 2, 0.7)


def test_classes_beyond_the_bound_are_an_error(spark):
    label = F.col("id").cast("string").alias("label")
    many = spark.range(M.MAX_CLASSES + 1).select(label, F.lit("0").alias("prediction"))
    counts = M.confusion_counts(many)
    for refused in (M.confusion_matrix(counts), M.class_count_metrics(many, "label"), M.evaluate(many)):
        with pytest.raises(Exception, match="more than 1000 classes"):
            refused.collect()
    most = M.class_count_metrics(many.limit(M.MAX_CLASSES), "label").first()["class_counts"]
    assert len(most) == M.MAX_CLASSES
