"""The training-run log: history, trend, best epoch, and the champion over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidentia.functions.rounding import round_score
from incidentia.operators.ordered import BLOCK, in_blocks, running
from incidentia.schema import MIN_RECORDS_FOR_COMPARISON, PROMOTION_MIN_DELTA
from incidentia.session import Scratch, written_table

HISTORY = 20
# Runs of a segment that one step of the promotion history folds.
STEP_RUNS = 4096


def latest_runs(runs: DataFrame, n: int = HISTORY) -> DataFrame:
    return runs.orderBy(F.desc("start_time"), "run_id").limit(n)


def run_history(runs: DataFrame, n: int = HISTORY) -> DataFrame:
    """Display form of the latest runs. A missing cross-validated F1 stays null, others show 0."""

    def metric(name: str) -> Column:
        return F.try_element_at("metrics", F.lit(name))

    def text(column: str, name: str) -> Column:
        return F.coalesce(F.try_element_at(column, F.lit(name)), F.lit(""))

    def shown(name: str) -> Column:
        return round_score(F.coalesce(metric(name), F.lit(0.0)))

    records = F.nullif(F.try_element_at("params", F.lit("records_fetched")), F.lit(""))
    return latest_runs(runs, n).select(
        F.substring("run_id", 1, 8).alias("run_id"),
        F.date_format(F.timestamp_millis("start_time"), "yyyy-MM-dd HH:mm").alias("started"),
        shown("f1_weighted").alias("f1_holdout"),
        round_score(metric("cv_f1_mean")).alias("cv_f1_mean"),
        shown("accuracy").alias("accuracy"),
        shown("dummy_f1_weighted").alias("dummy_f1"),
        text("params", "model_type").alias("model"),
        F.coalesce(records.cast("long"), F.lit(0).cast("long")).alias("records"),
        text("tags", "promoted").alias("promoted"),
        text("tags", "promotion_reason").alias("reason"),
        F.col("start_time"),
    )


def f1_trend(history: DataFrame) -> DataFrame:
    """``(run_no, f1_holdout, cv_f1_mean, dummy_f1)``: oldest run first, baseline of the latest.

    ``history`` holds the few runs of the display, so one unpartitioned window orders them.
    """
    everything = Window.partitionBy(F.lit(0))
    oldest_first = everything.orderBy("start_time", F.desc("run_id"))
    return history.select(
        F.row_number().over(oldest_first).cast("long").alias("run_no"),
        "f1_holdout",
        "cv_f1_mean",
        F.max_by("dummy_f1", "start_time").over(everything).alias("dummy_f1"),
    )


def cv_trend(history: DataFrame) -> DataFrame:
    """The points of the cross-validation line: runs that have a value, numbered among all."""
    return f1_trend(history).filter(F.col("cv_f1_mean").isNotNull()).select("run_no", "cv_f1_mean")


def best_epoch(candidates: DataFrame, by: str = "model_id") -> DataFrame:
    """Per model the epoch with the highest score; the earliest of equals."""
    return candidates.groupBy(by).agg(
        F.max_by("epoch", F.struct(F.col("f1"), -F.col("epoch"))).alias("best_epoch"),
        F.max("f1").alias("best_f1"),
    )


def promotion_history(runs: DataFrame) -> DataFrame:
    """``(run_no, promoted, champion_cv_f1)`` per run of ``(run_no, cv_f1, training_records)``.

    Each decision depends on the champion that the runs before have left. Three facts let it be found
    without going through the log in one task. A run that is promoted whatever the champion, such as
    the first one, starts afresh, so the log falls into segments that do not touch each other. Inside
    a segment only a run whose score is above all earlier ones can be promoted. And of these, each step
    looks at no more than ``STEP_RUNS`` per segment. Running values go over blocks of the log.
    """
    cv = F.col("cv_f1")
    with Scratch(runs.sparkSession) as scratch:
        log = in_blocks(runs.select("run_no", "cv_f1", "training_records"), scratch, "run_no")
        few = F.coalesce(F.col("training_records") < MIN_RECORDS_FOR_COMPARISON, F.lit(False))

        def add(table: DataFrame, value: Column, out: str, **how) -> DataFrame:
            # Written, as the next value reads this one twice.
            return scratch.table(running(table, value, out, ["run_no"], **how), out)

        log = add(log, F.lit(1), "nth")
        # After a run without a score there is no champion, so the next one is promoted as well.
        log = add(log, cv.isNotNull().cast("int"), "scored_before", before=True)
        always = ((F.col("nth") == 1) | few).cast("int")
        log = add(log, always, "fresh", how="max", by=["scored_before"])
        log = add(log, F.col("fresh"), "segment")
        log = add(log, cv, "best_before", how="max", by=["segment"], before=True)
        log = log.select("run_no", "cv_f1", "fresh", "segment", "best_before", BLOCK)
        promoted = log.filter("fresh = 1").select("segment", "run_no", "cv_f1")
        champions = promoted.select("segment", F.col("cv_f1").alias("champion"))
        left = log.filter("fresh = 0 AND cv_f1 > best_before").select("segment", "run_no", "cv_f1")
        while True:
            better = left.join(champions, "segment").filter(_improves(cv, F.col("champion")))
            better = scratch.table(better, "better")
            if better.isEmpty():
                break
            found = scratch.table(_promoted_among_first(better), "promoted")
            promoted = promoted.unionByName(found.select("segment", F.inline("steps")))
            champions = found.select("segment", F.col("champion"))
            left = better.join(found.select("segment", "seen"), "segment").filter("run_no > seen")
            left = left.select("segment", "run_no", "cv_f1")
        marked = log.join(
            promoted.select("run_no", F.lit(True).alias("promoted")), "run_no", "left"
        ).withColumn("promoted", F.coalesce("promoted", F.lit(False)))
        champion = F.when(F.col("promoted"), cv)
        held = running(marked, champion, "champion_cv_f1", ["run_no"], how="last", by=["segment"])
        return written_table(
            held.select(F.col("run_no").cast("long").alias("run_no"), "promoted", "champion_cv_f1"),
            "promotions",
        )


def _improves(cv_f1: Column, champion: Column) -> Column:
    return cv_f1 - champion >= F.lit(PROMOTION_MIN_DELTA)


def _promoted_among_first(better: DataFrame) -> DataFrame:
    """Per segment the promotions among its first runs that beat the champion: (segment, steps,
    champion, seen), where ``seen`` is the last run looked at."""
    first = Window.partitionBy("segment").orderBy("run_no")
    some = better.withColumn("__k", F.row_number().over(first)).filter(F.col("__k") <= STEP_RUNS)
    listed = some.groupBy("segment").agg(
        F.array_sort(F.collect_list(F.struct("run_no", "cv_f1"))).alias("log"),
        F.first("champion").alias("champion"),
        F.max("run_no").alias("seen"),
    )
    kind = dict(better.dtypes)
    empty = F.array().cast(f"array<struct<run_no:{kind['run_no']},cv_f1:double>>")
    start = F.struct(F.col("champion").alias("champion"), empty.alias("out"))

    def step(acc: Column, run: Column) -> Column:
        return F.when(
            _improves(run["cv_f1"], acc["champion"]),
            F.struct(run["cv_f1"].alias("champion"), F.array_append(acc["out"], run).alias("out")),
        ).otherwise(acc)

    folded = listed.select("segment", "seen", F.aggregate("log", start, step).alias("end"))
    return folded.select(
        "segment", "seen", F.col("end.champion").alias("champion"), F.col("end.out").alias("steps")
    )


def dashboard_totals(accumulated: DataFrame, champion: DataFrame) -> DataFrame:
    """One row: accumulated records, champion F1 and the records it was trained on."""
    champ = champion.select(F.struct("f1_weighted", "training_records")).scalar()
    return accumulated.agg(F.count("*").alias("accumulated_records")).select(
        "accumulated_records",
        F.coalesce(champ["f1_weighted"], F.lit(0.0)).alias("champion_f1"),
        champ["training_records"].alias("champion_records"),
    )
