import json
import shutil

import pytest
from pyspark.sql import functions as F

from incidentia.operators import models as MO
from incidentia.plans.explore import score_reports
from incidentia.plans.ingest import run_ingestion
from incidentia.plans.train import ModelStore, train_job
from incidentia.schema import REPORT
from incidentia.sources import registry
from incidentia.sources.reports import load_accumulated, save_accumulated
from incidentia.streaming.ingest import add_batch, ingest_available, rejected_path
from incidentia.streaming.keys import KeyStore, bucket_of

TEXTS = {
    "Death": "the patient died after the pump stopped number",
    "Injury": "burn injury with pain at the implant site number",
    "Malfunction": "battery failed and the alarm kept sounding number",
    "*": "nothing is known about this event at all number",
}
QUICK = MO.Params(min_df=1, max_iter=40)


def raw(number, kind):
    return {
        "report_number": number,
        "event_type": [kind],
        "mdr_text": [{"text": f"{TEXTS[kind]} {number}"}],
    }


def land(folder, page, items):
    folder.mkdir(exist_ok=True)
    (folder / f"page_{page}.json").write_text(json.dumps({"results": items}))


def some_reports(spark, sizes):
    rows = [
        (f"{kind}{i}", "20240101", kind, {"*": "UNKNOWN"}.get(kind, kind[0]), "dev", f"{TEXTS[kind]} {chr(97 + i % 26) * 3}")
        for kind, n in sizes.items()
        for i in range(n)
    ]
    return spark.createDataFrame(rows, REPORT)


def test_stream_reads_each_page_once(spark, tmp_path):
    pages, table, checkpoint = tmp_path / "pages", str(tmp_path / "table"), str(tmp_path / "cp")
    land(pages, 1, [raw("a", "Death"), raw("b", "Injury"), raw("b", "Injury"), raw("", "Death")])
    first = ingest_available(spark, str(pages), table, checkpoint)
    assert (first.batch_returned, first.new_records_added, first.total_accumulated) == (4, 4, 4)
    land(pages, 2, [raw("b", "Malfunction"), raw("c", "Injury"), raw("", "Death"), {"mdr_text": []}])
    second = ingest_available(spark, str(pages), table, checkpoint)
    assert (second.batch_returned, second.new_records_added, second.total_accumulated) == (3, 2, 6)
    again = ingest_available(spark, str(pages), table, checkpoint)
    assert (again.batch_returned, again.total_accumulated) == (0, 6)
    kept = load_accumulated(spark, table).filter("report_number = 'b'").select("severity_label")
    assert {r[0] for r in kept.collect()} == {"I"}  # the first version of a number stays


def test_replayed_batch_replaces_itself(spark, tmp_path):
    table = str(tmp_path / "table")
    batch = some_reports(spark, {"Death": 3, "Injury": 2})
    assert add_batch(spark, batch, table, 0) == (5, 5)
    assert add_batch(spark, batch, table, 0) == (5, 5)
    assert load_accumulated(spark, table).count() == 5
    assert add_batch(spark, batch.unionByName(batch), table, 1, dedup_within=True) == (10, 0)


def test_broken_page_is_set_aside(spark, tmp_path):
    pages, table = tmp_path / "pages", str(tmp_path / "table")
    land(pages, 1, [raw("a", "Death")])
    (pages / "page_2.json").write_text('{"results": [{"report_number"')
    land(pages, 3, [raw("b", "Death"), raw("c", "Injury")])
    found = ingest_available(spark, str(pages), table, str(tmp_path / "cp"), max_files_per_batch=1)
    assert (found.batch_returned, found.new_records_added, found.pages_rejected) == (3, 3, 1)
    (aside,) = spark.read.parquet(rejected_path(table)).collect()
    assert (aside.file, aside.page_no) == ("page_2.json", 2)
    land(pages, 4, [raw("a", "Injury"), raw("d", "Injury")])
    later = ingest_available(spark, str(pages), table, str(tmp_path / "cp"))
    assert (later.batch_returned, later.new_records_added, later.pages_rejected) == (2, 1, 0)


def test_batch_reads_only_its_buckets_of_numbers(spark, tmp_path):
    table = str(tmp_path / "table")
    batch = some_reports(spark, {"Death": 200})
    add_batch(spark, batch, table, 0)
    store = KeyStore(spark, table)
    one = batch.limit(1)
    bucket = one.select(bucket_of(F.col("report_number"))).first()[0]
    held = store.held(one, 1)
    assert f"bucket#" in (plan := held._jdf.queryExecution().executedPlan().toString())
    assert f"= {bucket})" in plan.split("PartitionFilters: ")[1].split("]")[0]
    files = {r[0] for r in held.select(F.input_file_name()).collect()}
    assert files and all(f"bucket={bucket}/" in f for f in files)
    assert store.held(batch, 0).count() == 0  # a batch's own numbers are not among them
    # The reports themselves are gone, and known numbers are still known.
    shutil.rmtree(f"{table}/batch_id=0")
    assert add_batch(spark, batch, table, 1) == (200, 0)


def test_table_without_numbers_is_indexed_once(spark, tmp_path):
    table = str(tmp_path / "table")
    batch = some_reports(spark, {"Death": 5})
    save_accumulated(batch, table, -1)
    store = KeyStore(spark, table)
    assert store.index_missing() == [-1] and store.index_missing() == []
    assert add_batch(spark, batch.union(some_reports(spark, {"Injury": 2})), table, 3) == (7, 2)


def test_model_type_beside_params_must_agree(spark):
    with pytest.raises(ValueError, match="differs"):
        train_job(some_reports(spark, {"Death": 2}), ModelStore("unused"), "svm", params=QUICK)


def test_training_job_promotes_then_compares(spark, tmp_path):
    store = ModelStore(str(tmp_path / "store"))
    reports = some_reports(spark, {"Death": 30, "Injury": 20, "Malfunction": 20, "*": 20})
    result = train_job(reports, store, remove_unknown=True, n_splits=2, params=QUICK)
    assert result["training_records"] == 70 and result["class_counts"] == {"D": 30, "I": 20, "M": 20}
    assert result["promoted"] and result["promotion_reason"] == "no_champion_exists"
    assert result["beats_dummy"] and 0 <= result["accuracy"] <= 1
    assert len(result["cv_f1_per_fold"]) == 2
    champion = registry.champion_metrics(spark, store.champion)
    assert champion["cv_f1_mean"] == pytest.approx(result["cv_f1_mean"])
    assert champion["training_records"] == 70

    row = registry.read_runs(spark, store.runs).first()
    assert row["tags"]["promoted"] == "true" and row["params"]["training_records"] == "70"
    assert row["metrics"]["class_count_D"] == 30 and "cv_f1_fold_2" in row["metrics"]
    assert "weighted avg" in row["texts"]["classification_report.txt"]

    assert champion["checkpoint_path"] == store.model(result["run_id"])
    model = store.champion_model(spark)
    scored = score_reports(reports.limit(3).unionByName(reports.limit(1).withColumn("narrative_text", F.lit(" "))), model)
    assert scored.count() == 3

    registry.save_champion(spark, {**champion, "cv_f1_mean": 2.0, "training_records": 20_000}, store.champion)
    second = train_job(reports, store, remove_unknown=True, n_splits=2, params=QUICK)
    assert second["promoted"] and "below_min_records_threshold" in second["promotion_reason"]
    assert store.champion_path(spark) == store.model(second["run_id"])
    # The first model is untouched, and a record whose writing broke off changes nothing.
    assert MO.TextModel.load(spark, store.model(result["run_id"])).labels == model.labels
    (tmp_path / "store" / "champion" / "version=99999999999999999999").mkdir()
    assert store.champion_path(spark) == store.model(second["run_id"])


def test_too_few_reports_abort(spark, tmp_path):
    store = ModelStore(str(tmp_path / "store"))
    with pytest.raises(ValueError, match="not enough records"):
        train_job(some_reports(spark, {"Death": 20, "Injury": 20}), store)
    assert registry.champion_metrics(spark, store.champion) == {}
    with pytest.raises(FileNotFoundError):
        store.champion_model(spark)
    assert registry.read_runs(spark, store.runs).count() == 1


def test_ingestion_cycle_retrains_on_new_records_only(spark, tmp_path):
    pages, store = tmp_path / "pages", ModelStore(str(tmp_path / "store"))
    items = [raw(f"{k}{chr(97 + i % 26)}{i}", k) for k in ("Death", "Injury", "Malfunction") for i in range(20)]
    land(pages, 1, items)
    args = (spark, str(pages), str(tmp_path / "table"), str(tmp_path / "cp"), store)
    options = {"n_splits": 2, "params": QUICK}
    first = run_ingestion(*args, **options)
    assert first["retrain_triggered"] and first["training"]["training_records"] == 60
    second = run_ingestion(*args, **options)
    assert not second["retrain_triggered"] and second["new_records_added"] == 0
    land(pages, 2, [raw("new", "Death")])
    assert not run_ingestion(*args, retrain=False)["retrain_triggered"]
