"""Headline timings: one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from incidentia.catalog import queries as Q  # noqa: E402
from incidentia.functions.text import clean_text  # noqa: E402
from incidentia.operators import features as FE  # noqa: E402
from incidentia.operators import models as MO  # noqa: E402
from incidentia.plans.train import ModelStore, train_job  # noqa: E402
from incidentia.session import build_session, shared_dir, written_table  # noqa: E402
from incidentia.sources import tables as TB  # noqa: E402

# Queries timed straight from the given tables.
HEADLINE = [
    "severity_overview",
    "parse_record",
    "merge_dedup",
    "intra_batch_dedup",
    "stratified_split",
    "kfold_assign",
    "cv_majority",
    "evaluate_bundle",
    "vocabulary_topk",
    "explore_filter",
    "softmax_argmax",
    "batch_predictor",
    "run_history_top20",
]


def noop(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times, rates = {}, {}

    def timed(name, action):
        start = time.perf_counter()
        out = action()
        times[name] = round(time.perf_counter() - start, 3)
        return out

    noop(TB.read_table(spark, sf, "documents").select(F.length("text")))  # start-up
    n_docs = TB.read_table(spark, sf, "documents").count()
    text = clean_text(F.col("narrative_text"))
    timed("clean_text", lambda: noop(TB.reports(spark, sf).select(text)))
    for name in HEADLINE:
        timed(name, lambda name=name: noop(Q.all_queries()[name](spark, sf)))

    rows = timed("clean_table", lambda: written_table(Q.training_rows(spark, sf), "rows"))
    timed("term_frequency", lambda: noop(FE.term_frequency(rows)))
    model = timed("fit_logreg", lambda: MO.fit_text_model(rows))
    timed("score_logreg", lambda: noop(model.transform(rows)))
    timed("tfidf_weights", lambda: noop(FE.tfidf_weights(rows, model.space)))
    # Cleaning, one fit, five folds and the evaluation, at the defaults.
    store = ModelStore(f"{shared_dir(spark)}/bench-{time.time_ns()}")
    timed("train_job", lambda: train_job(TB.reports(spark, sf), store, remove_unknown=True))
    for name in ("clean_text", "merge_dedup", "tfidf_weights", "fit_logreg", "score_logreg"):
        rates[f"{name}_rows_per_sec"] = round(n_docs / times[name], 1)

    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rates": rates,
                "score_ms_per_record": round(1000 * times["score_logreg"] / n_docs, 4),
                "documents": n_docs,
                "sf": sf.rsplit("sf", 1)[-1].strip("/"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
