import random

import pytest
from pyspark.sql import functions as F

from incidentia.functions import promotion as PR
from incidentia.functions.rounding import round_score
from incidentia.operators import runs as RU
from incidentia.plans.train import decide_promotion
from incidentia.schema import RUN
from incidentia.sources import registry

CASES = [
    (0.50, 0.99, 100, True, True, "no_champion_exists"),
    (0.50, 0.90, 9_999, False, True, "below_min_records_threshold"),
    (0.80 + 0.005, 0.80, 10_000, False, True, "cv_f1_improved"),
    (0.800 + 0.0025, 0.800, 10_000, False, False, "insufficient_improvement"),
    (0.70, 0.85, 11_000, False, False, ""),
    (0.82, 0.78, 15_000, False, True, "cv_f1_improved"),
    (0.800 + 0.005, 0.800, 10_001, False, True, ""),
]


@pytest.mark.parametrize("new, champion, records, none, promote, words", CASES)
def test_gate(spark, new, champion, records, none, promote, words):
    got, reason = decide_promotion(spark, new, champion, records, none)
    assert got is promote and words in reason


def test_reason_wording(spark):
    _, reason = decide_promotion(spark, 0.82, 0.78, 15_000, False)
    assert reason == "cv_f1_improved (0.8200 vs 0.7800, delta=+0.0400 >= threshold=0.005)"


def test_scores_round_like_number_formatting(spark):
    rng = random.Random(1)
    values = [0.78975, 0.78125, 0.03125, 0.09375, 1.0, 0.0, 0.00005, 0.00015, -0.78125, -0.00001, 2.34565]
    values += [rng.random() for _ in range(500)] + [rng.randrange(20_000) / 20_000 for _ in range(2_000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(round_score(F.col("x"))).collect()]
    expected = [round(v, 4) for v in values]
    assert [g for g, v in zip(got, values) if abs(v) <= 1] == [e for e, v in zip(expected, values) if abs(v) <= 1]


def test_champion_scores(spark):
    df = spark.createDataFrame(
        [(0.83, 0.87), (None, 0.75), (0.0, 0.75), (None, None), (0.5, 0.0)], "cv double, f1 double"
    )
    rows = df.select(
        PR.champion_score(F.col("cv"), F.col("f1")), PR.champion_display_score(F.col("cv"), F.col("f1"))
    ).collect()
    assert [r[0] for r in rows] == [0.83, 0.75, 0.75, 0.0, 0.5]
    assert [r[1] for r in rows] == [0.87, 0.75, 0.75, 0.0, 0.5]


def test_retrain(spark):
    df = spark.createDataFrame([(True, 1, False), (True, 0, False), (True, 0, True), (False, 5, True)], "r boolean, n int, m boolean")
    got = [r[0] for r in df.select(PR.retrain_needed(F.col("r"), F.col("n"), F.col("m"))).collect()]
    assert got == [True, False, True, False]


def test_champion_record(spark, tmp_path):
    path = str(tmp_path / "champion")
    assert registry.champion_metrics(spark, path) == {}
    assert registry.champion_f1(spark, path) == 0.0
    registry.save_champion(spark, {"f1_weighted": 0.87, "accuracy": 0.9, "cv_f1_mean": 0.83, "cv_f1_std": 0.01, "training_records": 12}, path)
    saved = registry.champion_metrics(spark, path)
    assert saved["cv_f1_mean"] == 0.83 and saved["training_records"] == 12 and saved["model_type"] == "tfidf"
    assert registry.champion_f1(spark, path) == 0.83
    registry.save_champion(spark, {"val_f1_weighted": 0.75, "model_type": "embedding", "checkpoint_path": "x"}, path)
    assert registry.champion_f1(spark, path) == 0.75
    assert registry.champion_metrics(spark, path)["checkpoint_path"] == "x"


def test_history_is_a_sequence_not_a_running_maximum(spark):
    runs = [(1, 0.70, 20_000), (2, 0.704, 20_000), (3, 0.708, 20_000), (4, 0.60, 9_000), (5, 0.604, 20_000), (6, 0.61, 20_000)]
    df = spark.createDataFrame(runs, "run_no long, cv_f1 double, training_records long")
    got = [tuple(r) for r in RU.promotion_history(df).orderBy("run_no").collect()]
    assert got == [(1, True, 0.70), (2, False, 0.70), (3, True, 0.708), (4, True, 0.60), (5, False, 0.60), (6, True, 0.61)]


def test_run_log_and_history(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert registry.read_runs(spark, path).count() == 0
    log = registry.RunLog(spark, path)
    log.log_params(model_type="svm", records_fetched=10)
    log.log_metrics(f1_weighted=0.81236, cv_f1_mean=0.7)
    log.set_tag("promoted", "true")
    log.log_text("report", "words")
    log.close()
    bare = registry.RunLog(spark, path)
    bare.start_time = log.start_time + 60_000
    bare.close()
    rows = RU.run_history(registry.read_runs(spark, path)).collect()
    assert [r["run_id"] for r in rows] == [bare.run_id[:8], log.run_id[:8]]
    assert rows[0]["f1_holdout"] == 0.0 and rows[0]["cv_f1_mean"] is None and rows[0]["records"] == 0
    assert rows[1]["f1_holdout"] == 0.8124 and rows[1]["model"] == "svm" and rows[1]["records"] == 10
    history = RU.run_history(registry.read_runs(spark, path))
    assert [tuple(r)[:3] for r in RU.f1_trend(history).orderBy("run_no").collect()] == [(1, 0.8124, 0.7), (2, 0.0, None)]
    assert [tuple(r) for r in RU.cv_trend(history).collect()] == [(1, 0.7)]


def test_only_the_latest_twenty(spark):
    rows = [(f"{i:032d}", i * 60_000, {}, {}, {}, {}) for i in range(25)]
    latest = RU.latest_runs(spark.createDataFrame(rows, RUN)).collect()
    assert [r["start_time"] // 60_000 for r in latest] == list(range(24, 4, -1))


def test_dashboard_totals(spark):
    champion = spark.createDataFrame([(None, 7)], "f1_weighted double, training_records long")
    assert tuple(RU.dashboard_totals(spark.range(3), champion).first()) == (3, 0.0, 7)
    assert tuple(RU.dashboard_totals(spark.range(3), champion.limit(0)).first()) == (3, 0.0, None)
