"""Every operator as a query over the benchmark tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incidentia.functions import labels as LB
from incidentia.functions import parse
from incidentia.functions import promotion as PR
from incidentia.functions import text as TX
from incidentia.functions.arrays import total
from incidentia.operators import entities as EN
from incidentia.operators import exchange as EV
from incidentia.operators import features as FE
from incidentia.operators import filters as FI
from incidentia.operators import linear as LI
from incidentia.operators import merge as ME
from incidentia.operators import metrics as M
from incidentia.operators import models as MO
from incidentia.operators import multilabel as ML
from incidentia.operators import optimality as OP
from incidentia.operators import records as RE
from incidentia.operators import reliability as RL
from incidentia.operators import runs as RU
from incidentia.operators import splits as SP
from incidentia.plans import explore as EX
from incidentia.plans.train import ModelStore, train_job
from incidentia.schema import LABELS, MIN_DF, REPORT
from incidentia.session import shared_dir, written_table
from incidentia.sources import tables as TB
from incidentia.sources.pages import explode_pages, first_reports
from incidentia.sources.registry import save_champion
from incidentia.sources.reports import load_accumulated, path_exists, save_accumulated
from incidentia.streaming.ingest import ingest_available, rejected_path

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# --- Shared inputs ----------------------------------------------------------------------------


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return FI.clean_table(TB.reports(spark, sf))


def training_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned, labelled rows as the classifiers take them."""
    return FI.drop_unknown(cleaned(spark, sf)).select(
        "report_number", "severity_label", "clean_text"
    )


def records(spark: SparkSession, sf: str) -> DataFrame:
    return explode_pages(TB.raw_pages(spark, sf))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Labels next to the guess that a text's language alone suggests."""
    key = F.col("doc_id")
    return TB.read_table(spark, sf, "documents").select(
        key.cast("string").alias("report_number"),
        LB.severity_of(TB.event_name(F.col("lang"), key)).alias("label"),
        TB.base_label(F.col("lang")).alias("prediction"),
    )


def counts(spark: SparkSession, sf: str) -> DataFrame:
    return M.confusion_counts(predictions(spark, sf))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return predictions(spark, sf).select("report_number", F.col("label").alias("severity_label"))


def rounded(column: str | Column, places: int = 6) -> Column:
    return F.round(column, places)


def sum_key(tokens: Column) -> Column:
    return F.md5(F.array_join(tokens, " ").cast("binary"))


# --- Text -------------------------------------------------------------------------------------


@query
def strip_boilerplate(spark, sf):
    text = TX.remove_boilerplate(F.col("narrative_text"))
    return TB.reports(spark, sf).select("report_number", text.alias("text_out"))


@query
def expand_abbreviations(spark, sf):
    text = TX.expand_abbreviations(F.col("narrative_text"))
    return TB.reports(spark, sf).select("report_number", text.alias("text_out"))


@query
def clean_text_tfidf(spark, sf):
    text = TX.clean_text(F.col("narrative_text"))
    return TB.reports(spark, sf).select("report_number", text.alias("clean_text"))


@query
def clean_text_digits(spark, sf):
    text = TX.clean_text(F.col("narrative_text"), preserve_digits=True)
    return TB.reports(spark, sf).select("report_number", text.alias("clean_text"))


@query
def clean_text_cased(spark, sf):
    text = TX.clean_text(F.col("narrative_text"), lowercase=False)
    return TB.reports(spark, sf).select("report_number", text.alias("clean_text"))


@query
def clean_blank_guard(spark, sf):
    """Unnumbered and numbered texts alike; where a number is missing the text is taken as null."""
    rows = TB.incoming(spark, sf)
    text = F.when(F.col("report_number").isNotNull(), F.col("narrative_text"))
    return rows.select(TX.clean_text(text).alias("clean_text")).agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("clean_text") == "").alias("n_blank"),
        F.count_if(F.col("clean_text").isNull()).alias("n_null"),
    )


@query
def clean_table(spark, sf):
    return cleaned(spark, sf).select("report_number", "severity_label", "clean_text")


@query
def drop_short(spark, sf):
    """Stage counts of the length filter."""
    text = TX.clean_text(F.col("narrative_text"))
    rows = TB.reports(spark, sf).select("report_number", text.alias("clean_text"))
    before = rows.agg(F.count("*").alias("n_before")).scalar()
    return FI.drop_short(rows).agg(F.count("*").alias("n_after")).select(
        before.alias("n_before"), "n_after", (before - F.col("n_after")).alias("n_dropped")
    )


@query
def text_length(spark, sf):
    return TB.reports(spark, sf).select(
        "report_number", TX.text_length(F.col("narrative_text")).alias("text_length")
    )


@query
def tokens(spark, sf):
    words = TX.clean_tokens(F.col("clean_text"))
    return cleaned(spark, sf).select(
        "report_number", F.size(words).cast("long").alias("n_tokens"), sum_key(words).alias("digest")
    )


@query
def tokens_raw(spark, sf):
    words = TX.word_tokens(F.col("text"))
    return TB.read_texts(spark, sf, "documents").select(
        "doc_id", F.size(words).cast("long").alias("n_tokens"), sum_key(words).alias("digest")
    )


@query
def ngrams(spark, sf):
    grams = TX.ngrams(TX.clean_tokens(F.col("clean_text")))
    return (
        cleaned(spark, sf)
        .select("report_number", grams.alias("g"))
        .select(
            "report_number",
            F.size("g").cast("long").alias("n_grams"),
            F.size(F.array_distinct("g")).cast("long").alias("n_distinct"),
            sum_key(F.sort_array("g")).alias("digest"),
        )
    )


@query
def truncate_tokens(spark, sf):
    text = TX.clean_text(F.col("narrative_text"), preserve_digits=True)
    return TB.reports(spark, sf).select(
        "report_number",
        F.array_join(TX.truncate_tokens(text), " ").alias("kept"),
        TX.is_truncated(text).alias("is_truncated"),
    )


@query
def truncation_rate(spark, sf):
    text = TX.clean_text(F.col("narrative_text"), preserve_digits=True)
    flag = TX.is_truncated(text).cast("double")
    return TB.reports(spark, sf).agg(rounded(F.avg(flag)).alias("truncation_rate"))


# --- Raw records ------------------------------------------------------------------------------


@query
def parse_record(spark, sf):
    return RE.flatten_records(records(spark, sf), keep=["page_no"])


@query
def narrative_join(spark, sf):
    return records(spark, sf).select(
        "page_no", parse.narrative(F.col("record")).alias("narrative_text")
    )


@query
def device_name(spark, sf):
    return records(spark, sf).select(
        "page_no", parse.device_name(F.col("record")).alias("device_name")
    )


@query
def first_event_type(spark, sf):
    return records(spark, sf).select(
        "page_no", parse.event_type(F.col("record")).alias("event_type")
    )


@query
def full_event_type(spark, sf):
    return records(spark, sf).select(
        "page_no", parse.event_type(F.col("record"), full_name=True).alias("event_type")
    )


@query
def severity_map(spark, sf):
    event = parse.event_type(F.col("record"))
    return records(spark, sf).select("page_no", LB.severity_of(event).alias("severity_label"))


@query
def reject_reasons(spark, sf):
    return RE.rejected_records(records(spark, sf))


@query
def narrative_exists(spark, sf):
    return RE.with_narrative(records(spark, sf)).select("page_no")


@query
def source_bounded_prefix(spark, sf):
    return first_reports(records(spark, sf), 500)


@query
def head_rows(spark, sf):
    return FI.head_rows(TB.read_table(spark, sf, "documents"), "doc_id")


# --- Labels, filters, exploring ---------------------------------------------------------------


@query
def drop_unknown(spark, sf):
    return FI.drop_unknown(labelled(spark, sf))


@query
def label_encode(spark, sf):
    """Codes of the labels and of the raw event names, most of which are no label."""
    rows = TB.reports(spark, sf)
    return rows.select(
        "report_number",
        LB.encode_label(F.col("severity_label")).alias("label_code"),
        LB.encode_label(F.col("event_type")).alias("event_code"),
    )


@query
def label_decode(spark, sf):
    code = LB.encode_label(F.col("severity_label"))
    return labelled(spark, sf).select("report_number", LB.decode_label(code).alias("label"))


@query
def label_name(spark, sf):
    return TB.reports(spark, sf).select(
        "report_number",
        LB.label_name(F.col("severity_label")).alias("label_name"),
        LB.label_name(F.col("event_type")).alias("event_name"),
        LB.label_name(F.col("event_type"), keep_unlisted=True).alias("event_or_name"),
    )


@query
def label_distribution(spark, sf):
    return M.label_distribution(cleaned(spark, sf))


@query
def class_count_metrics(spark, sf):
    return M.class_count_metrics(labelled(spark, sf)).select(
        F.explode("class_counts").alias("metric", "value")
    )


@query
def distinct_labels(spark, sf):
    return FI.distinct_labels(labelled(spark, sf))


@query
def severity_filter(spark, sf):
    return FI.with_labels(labelled(spark, sf), ["D", "I"])


@query
def narrative_search(spark, sf):
    return FI.search(TB.reports(spark, sf), r"device|pt[s ]|Model \d+").select(
        "report_number", "narrative_text"
    )


@query
def literal_search(spark, sf):
    return FI.search(TB.reports(spark, sf), "w/h/o PT", literal=True).select("report_number")


@query
def explore_filter(spark, sf):
    """Browsing the stored table of cleaned reports."""
    rows = cleaned(spark, sf).drop("narrative_text")
    return EX.explore_view(rows, labels=["D", "M"], term="patient|the ")


@query
def median_length_by_label(spark, sf):
    return M.median_length(TB.reports(spark, sf))


@query
def severity_overview(spark, sf):
    return EX.severity_overview(FI.drop_unknown(cleaned(spark, sf))).select(
        "severity_label",
        "n_reports",
        rounded("avg_clean_length").alias("avg_clean_length"),
        rounded("share").alias("share"),
    )


# --- Merge ------------------------------------------------------------------------------------


@query
def anti_join_new(spark, sf):
    return ME.new_only(TB.accumulated(spark, sf), TB.incoming(spark, sf))


@query
def merge_dedup(spark, sf):
    return ME.merge_and_dedup(TB.accumulated(spark, sf), TB.incoming(spark, sf))


@query
def append_rows(spark, sf):
    """Appending where each side lacks a column of the other."""
    left = TB.accumulated(spark, sf).drop("device_name", "narrative_text")
    right = TB.conversation_reports(spark, sf).drop("event_type", "narrative_text")
    return ME.append_rows(left, right)


@query
def count_new(spark, sf):
    return ME.count_new(TB.accumulated(spark, sf), TB.incoming(spark, sf))


@query
def intra_batch_dedup(spark, sf):
    return ME.dedup_batch(TB.incoming(spark, sf))


@query
def ingest_summary(spark, sf):
    held, batch = TB.accumulated(spark, sf), TB.incoming(spark, sf)
    added = ME.new_only(held, batch)
    return ME.ingest_summary(batch, added, ME.append_rows(held, added), 10_000)


@query
def retrain_decision(spark, sf):
    held, batch = TB.accumulated(spark, sf), TB.incoming(spark, sf)
    new = F.col("n_new")
    return ME.count_new(held, batch).select(
        PR.retrain_needed(F.lit(True), new, F.lit(False)).alias("after_new"),
        PR.retrain_needed(F.lit(True), new - new, F.lit(False)).alias("after_none"),
        PR.retrain_needed(F.lit(True), new - new, F.lit(True)).alias("no_model"),
        PR.retrain_needed(F.lit(False), new, F.lit(True)).alias("switched_off"),
    )


@query
def incremental_ingest(spark, sf):
    """The stream over landed pages, on top of the reports already held."""
    root = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    TB.raw_pages(spark, sf).select("value").write.text(f"{root}/pages")
    save_accumulated(TB.accumulated(spark, sf), f"{root}/table", -1)
    ingest_available(
        spark, f"{root}/pages", f"{root}/table", f"{root}/checkpoint", page_per_line=True
    )
    return load_accumulated(spark, f"{root}/table").select(*REPORT.names)


@query
def page_records(spark, sf):
    """Reports of pages that hold many, with their place in the page."""
    return RE.flatten_records(explode_pages(TB.many_record_pages(spark, sf)), keep=["page_no", "pos"])


@query
def ingest_broken_pages(spark, sf):
    """Counts of a cycle over pages of many reports of which some are cut short."""
    root = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    page = F.col("page_no")
    cut = F.when(TB.digit("z", page) < 3, F.expr("left(value, length(value) - 2)")).otherwise(F.col("value"))
    TB.many_record_pages(spark, sf).select(cut.alias("value")).write.text(f"{root}/pages")
    save_accumulated(TB.accumulated(spark, sf), f"{root}/table", -1)
    summary = ingest_available(
        spark, f"{root}/pages", f"{root}/table", f"{root}/checkpoint", page_per_line=True
    )
    where = rejected_path(f"{root}/table")
    aside = spark.read.parquet(where) if path_exists(spark, where) else spark.range(0)
    aside = aside.agg(F.count("*").alias("pages_aside"))
    counts = summary.as_dict()
    names = ["batch_returned", "new_records_added", "total_accumulated", "pages_rejected"]
    return aside.select("pages_aside", *(F.lit(counts[n]).cast("long").alias(n) for n in names))


# --- Splits -----------------------------------------------------------------------------------


@query
def stratified_split(spark, sf):
    return SP.stratified_split(labelled(spark, sf))


def _side_counts(rows: DataFrame, side: Column) -> DataFrame:
    return rows.groupBy("severity_label", side.alias("side")).agg(F.count("*").alias("n"))


@query
def stratified_split_repeated_keys(spark, sf):
    """Rows per label and side where numbers are blank, missing or repeated."""
    rows = SP.stratified_split(TB.incoming(spark, sf))
    return _side_counts(rows, F.col("is_test").cast("int"))


@query
def kfold_repeated_keys(spark, sf):
    return _side_counts(SP.kfold_assign(TB.incoming(spark, sf), 5), F.col("fold").cast("int"))


@query
def kfold_assign(spark, sf):
    rows = SP.kfold_assign(labelled(spark, sf), 5)
    return rows.withColumn("fold", F.col("fold").cast("long"))


@query
def positional_split(spark, sf):
    keys = TB.read_table(spark, sf, "documents").select("doc_id")
    return SP.positional_split(keys, "doc_id")


# --- Metrics ----------------------------------------------------------------------------------


@query
def class_weights(spark, sf):
    return M.class_weights(FI.drop_unknown(labelled(spark, sf))).select(
        "label", rounded("weight").alias("weight")
    )


@query
def binary_class_weights(spark, sf):
    rows = TB.read_table(spark, sf, "labels").select(F.col("toxic").cast("string").alias("toxic"))
    return M.class_weights(rows, "toxic", ["0", "1"]).select(
        "label", rounded("weight").alias("weight")
    )


@query
def accuracy(spark, sf):
    return M.accuracy(counts(spark, sf)).select(rounded("accuracy").alias("accuracy"))


@query
def weighted_f1(spark, sf):
    return M.weighted_f1(counts(spark, sf)).select(rounded("f1_weighted").alias("f1_weighted"))


@query
def class_report(spark, sf):
    return M.classification_report(counts(spark, sf)).select(
        F.col("class").alias("class_name"),
        *[rounded(c).alias(c) for c in ("precision", "recall", "f1")],
        "support",
    )


@query
def confusion_matrix(spark, sf):
    return M.confusion_matrix(counts(spark, sf))


@query
def evaluate_bundle(spark, sf):
    return M.evaluate(predictions(spark, sf)).select(
        rounded("accuracy").alias("accuracy"),
        rounded("f1_weighted").alias("f1_weighted"),
        F.array_join("classes", ",").alias("classes"),
        F.array_join(
            F.transform("confusion_matrix", lambda cell: cell["n"].cast("string")), ","
        ).alias("matrix"),
        F.md5(F.col("classification_report").cast("binary")).alias("report_digest"),
    )


@query
def majority_baseline(spark, sf):
    parts = SP.stratified_split(labelled(spark, sf))
    train, test = parts.filter("NOT is_test"), parts.filter("is_test")
    return M.majority_baseline(train, test, "severity_label").select(
        rounded("dummy_accuracy").alias("dummy_accuracy"),
        rounded("dummy_f1_weighted").alias("dummy_f1_weighted"),
    )


@query
def beats_baseline(spark, sf):
    """The language guess against the majority guess, on all rows."""
    rows = predictions(spark, sf)
    dummy = M.majority_baseline(rows, rows).select("dummy_f1_weighted").scalar()
    model = M.weighted_f1(M.confusion_counts(rows)).select("f1_weighted")
    return model.select(
        M.beats_baseline(F.col("f1_weighted"), dummy).alias("beats_dummy"),
        rounded(F.col("f1_weighted") - dummy).alias("delta"),
    )


@query
def cv_majority(spark, sf):
    folded = SP.kfold_assign(labelled(spark, sf), 5)
    return M.majority_cross_validation(folded).select(
        F.col("fold").cast("long").alias("fold"), rounded("f1").alias("f1")
    )


@query
def cv_summary(spark, sf):
    folded = SP.kfold_assign(labelled(spark, sf), 5)
    summary = M.cv_summary(M.majority_cross_validation(folded))
    per_fold = F.transform("cv_f1_per_fold", lambda x: F.format_string("%.6f", x))
    return summary.select(
        F.array_join(per_fold, ",").alias("per_fold"),
        rounded("cv_f1_mean").alias("cv_f1_mean"),
        rounded("cv_f1_std").alias("cv_f1_std"),
        "n_splits",
    )


# --- Agreement, calibration, percentiles ------------------------------------------------------


@query
def chance_agreement(spark, sf):
    kappa = RL.cohen_kappa(counts(spark, sf))
    return kappa.select(*(rounded(c).alias(c) for c in kappa.columns))


def _calibration(spark: SparkSession, sf: str) -> DataFrame:
    """The confidence of each scored vector, and whether its own label was predicted."""
    own = TB.read_table(spark, sf, "embeddings").select(
        "vec_id", F.get(F.array(*map(F.lit, LABELS)), F.col("label") % len(LABELS)).alias("own")
    )
    scored = _scored_embeddings(spark, sf).join(own, "vec_id")
    return RL.calibration_table(
        scored.select(
            F.array_max(F.map_values("probabilities")).alias("confidence"),
            (F.col("predicted_label") == F.col("own")).alias("right"),
        ),
        "confidence",
        "right",
        50,
    )


@query
def calibration_bins(spark, sf):
    return _calibration(spark, sf).select(
        "bin", "n", rounded("confidence").alias("confidence"), rounded("accuracy").alias("accuracy")
    )


@query
def calibration_error(spark, sf):
    found = RL.calibration_error(_calibration(spark, sf))
    return found.select(*(rounded(c).alias(c) for c in found.columns))


@query
def latency_percentiles(spark, sf):
    """Percentiles of the events' values by type, as if they were response times."""
    events = TB.read_table(spark, sf, "events")
    found = RL.merged_percentiles(events, "value", [0.5, 0.95, 0.99], ["event_type"])
    return found.withColumn("value", rounded("value"))


@query
def composite_score(spark, sf):
    """Weighted F1, macro F1 and accuracy of the language guess in one score."""
    parts = [
        F.max(F.when(F.col("class") == name, F.col("f1")))
        for name in ("weighted avg", "macro avg", "accuracy")
    ]
    report = M.classification_report(counts(spark, sf))
    return report.agg(rounded(RL.composite_score(*parts)).alias("composite"))


# --- Several labels ---------------------------------------------------------------------------


@query
def multi_hot_labels(spark, sf):
    """The labels of all reports that share a number, folded to counts per label set."""
    rows = ML.multi_hot(TB.incoming(spark, sf))
    return rows.groupBy(
        F.array_join("label_set", ",").alias("label_set"),
        F.array_join(F.transform("multi_hot", lambda x: x.cast("string")), "").alias("multi_hot"),
    ).agg(F.count("*").alias("n"), F.max("report_number").alias("last_number"))


def _label_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with five probabilities, and the labels they truly have by a digit per label."""
    key = F.col("vec_id")
    true = F.filter(
        F.array(*(F.when(TB.digit(f"{label}?", key) < 5, F.lit(label)) for label in LABELS)),
        lambda x: x.isNotNull(),
    )
    scores = F.transform(ML.sigmoid(embedding_logits(F.col("embedding"))), lambda p: F.round(p, 3))
    return TB.read_table(spark, sf, "embeddings").select(
        "vec_id", true.alias("true_labels"), scores.alias("scores")
    )


@query
def sigmoid_label_sets(spark, sf):
    rows = _label_scores(spark, sf)
    return rows.select(
        "vec_id",
        F.array_join("true_labels", ",").alias("true_labels"),
        F.array_join(ML.label_set(F.col("scores")), ",").alias("above_half"),
        F.array_join(ML.label_set(F.col("scores"), thresholds=[0.3, 0.4, 0.5, 0.6, 0.7]), ",").alias(
            "above_own"
        ),
    )


@query
def best_thresholds(spark, sf):
    rows = _label_scores(spark, sf)
    pairs = F.arrays_zip(F.array(*map(F.lit, LABELS)).alias("label"), F.col("scores"))
    each = rows.select("true_labels", F.inline(pairs)).toDF("true_labels", "label", "score")
    found = ML.best_thresholds(each.withColumn("is_true", F.array_contains("true_labels", F.col("label"))))
    return found.withColumn("f1", rounded("f1"))


@query
def multilabel_metrics(spark, sf):
    rows = _label_scores(spark, sf).withColumn("predicted_labels", ML.label_set(F.col("scores")))
    found = ML.multilabel_metrics(rows, scores_col="scores")
    return found.select(*(rounded(c).alias(c) for c in found.columns))


# --- Entities ---------------------------------------------------------------------------------

ENTITY_TYPES = ["ADVERSE_EVENT", "BODY_PART", "DEVICE"]


def rule_spans(spark: SparkSession, sf: str, guessed: bool) -> DataFrame:
    """Five spans per document by digits of its id; they overlap, and the last repeats the fourth.

    Guesses miss some, move some, and change the type of some.
    """
    docs = TB.read_table(spark, sf, "documents").select("doc_id")
    rows = docs.select("doc_id", F.explode(F.array(*map(F.lit, [0, 1, 2, 3, 3]))).alias("k"))
    key = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("k").cast("string"))
    start = 7 * TB.digit("a", key) + TB.digit("b", key)
    kind = TB.digit("c", key)
    if guessed:
        start = start + F.greatest(TB.digit("g", key) - 10, F.lit(0))
        kind = kind + F.when(TB.digit("y", key) == 0, 1).otherwise(0)
        rows = rows.filter(TB.digit("h", key) > 2)
    return rows.select(
        "doc_id",
        F.get(F.array(*map(F.lit, ENTITY_TYPES)), (kind % 3).cast("int")).alias("type"),
        start.cast("int").alias("start"),
        (start + 4 + TB.digit("l", key)).cast("int").alias("end"),
    )


@query
def entity_scores(spark, sf):
    found = EN.entity_scores(rule_spans(spark, sf, False), rule_spans(spark, sf, True))
    exact = ["n_true", "n_predicted", "strict_hits"]
    return found.select(
        F.coalesce("type", F.lit("all")).alias("type"),
        *exact,
        *(rounded(c).alias(c) for c in found.columns if c not in ("type", *exact)),
    )


def phrases(spark: SparkSession, sf: str) -> DataFrame:
    """A dictionary out of the benchmark's items: the first one, two or three words of each."""
    words, key = TX.plain_words(F.col("text")), F.col("item_id")
    kind = (TB.digit("c", key) % 3).cast("int")
    return TB.read_table(spark, sf, "benchmark").select(
        F.array_join(F.slice(words, 1, TB.digit("l", key) % 3 + 1), " - ").alias("phrase"),
        F.get(F.array(*map(F.lit, ENTITY_TYPES)), kind).alias("type"),
    )


@query
def dictionary_entities(spark, sf):
    return EN.label_entities(TB.read_texts(spark, sf, "documents"), phrases(spark, sf))


# --- Exchange ---------------------------------------------------------------------------------


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Resources of a batch in which numbers, devices and severities are missing here and there."""
    score = F.round(F.length("narrative_text") % 100 / 100.0, 2)
    return EV.adverse_events(TB.incoming(spark, sf), score, "v1")


@query
def exchange_resources(spark, sf):
    events = _events(spark, sf)
    return events.select(
        "report_number", "resource", F.array_join("missing", ",").alias("missing"), "complete"
    )


@query
def exchange_pass_rate(spark, sf):
    rates = EV.pass_rate(_events(spark, sf))
    return rates.select(
        F.coalesce("severity_label", F.lit("all")).alias("severity_label"),
        "n",
        "n_complete",
        rounded("pass_rate").alias("pass_rate"),
    )


# --- Features ---------------------------------------------------------------------------------


def text_rows(spark: SparkSession, sf: str) -> DataFrame:
    return cleaned(spark, sf).select("report_number", "clean_text")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned texts as a table: they are read more than once."""
    return written_table(text_rows(spark, sf), "texts")


def _vocabulary(rows: DataFrame) -> DataFrame:
    """Terms are counted once; their table is read twice."""
    stats = FE.text_term_stats(rows).filter(F.col("df") >= MIN_DF)
    return FE.vocabulary(written_table(stats, "terms"), FE.document_count(rows).scalar())


@query
def term_frequency(spark, sf):
    """Counts per report and term, folded to a digest per report.

    Each text's counts stay together until the reports of one number meet. Reports without a term go
    afterwards: a filter on the counts would be moved below them, and every text counted twice.
    """
    texts = text_rows(spark, sf).select("report_number", FE.counted_terms(F.col("clean_text")).alias("terms"))
    entries = F.transform("terms", lambda t: F.concat_ws(":", t["term"], t["tf"].cast("string")))
    zero = F.lit(0).cast("long")
    rows = texts.select(
        "report_number",
        F.size("terms").cast("long").alias("n_terms"),
        F.aggregate("terms", zero, lambda n, t: n + t["tf"]).alias("n_grams"),
        F.aggregate("terms", zero, lambda n, t: F.greatest(n, t["tf"])).alias("max_tf"),
        entries.alias("entries"),
    )
    folded = rows.groupBy("report_number").agg(
        F.sum("n_terms").alias("n_terms"),
        F.sum("n_grams").alias("n_grams"),
        F.max("max_tf").alias("max_tf"),
        sum_key(F.sort_array(F.flatten(F.collect_list("entries")))).alias("digest"),
    )
    return folded.filter("n_terms > 0")


@query
def document_frequency(spark, sf):
    rows = _texts(spark, sf)
    n_docs = FE.document_count(rows).scalar()
    return FE.within_document_frequency(FE.text_term_stats(rows), n_docs)


@query
def vocabulary_topk(spark, sf):
    return _vocabulary(_texts(spark, sf)).select("term", "df", "cf", rounded("idf").alias("idf"))


@query
def sublinear_idf(spark, sf):
    """Term statistics and both weight factors for the largest vocabulary."""
    return _vocabulary(_texts(spark, sf)).select(
        "term",
        rounded(FE.sublinear(F.col("cf"))).alias("log_cf"),
        rounded("idf").alias("idf"),
    )


@query
def tfidf_weights(spark, sf):
    rows = _texts(spark, sf)
    space = FE.TermSpace.fit(_vocabulary(rows))
    return FE.tfidf_weights(rows, space).select(
        "report_number", "term", rounded("weight").alias("weight")
    )


def rule_coefficient(term: Column, label: str) -> Column:
    """A coefficient any engine can compute: a hex digit of md5, centred."""
    return (TB.digit(f"{label}:", term) - 7.5) / 10.0


@query
def linear_score(spark, sf):
    rows = _texts(spark, sf)
    vocab = _vocabulary(rows)
    coefficients = vocab.select(
        "term", F.array(*[rule_coefficient(F.col("term"), lb) for lb in LABELS]).alias("coef")
    )
    intercepts = {label: 0.1 * i for i, label in enumerate(LABELS)}
    return LI.linear_scores(rows, FE.TermSpace.fit(vocab), coefficients, intercepts).select(
        "report_number", "label", rounded("score").alias("score")
    )


@query
def top_terms_per_class(spark, sf):
    vocab = _vocabulary(_texts(spark, sf))
    # The rule's coefficients repeat; the document frequency tells them apart.
    entries = F.array(
        *[
            F.struct(
                F.lit(lb).alias("label"),
                (rule_coefficient(F.col("term"), lb) * F.col("idf")).alias("coef"),
            )
            for lb in LABELS
        ]
    )
    top = LI.top_terms(vocab.select("term", F.inline(entries)).withColumn("coef", rounded("coef")))
    return top


# --- Scores -----------------------------------------------------------------------------------


def embedding_logits(embedding: Column) -> Column:
    """Five scores per vector, each the sum of every fifth component."""

    def share(c: int) -> Column:
        def pick(x: Column, i: Column) -> Column:
            return F.when(i % 5 == c, x.cast("double")).otherwise(0.0)

        return total(F.transform(embedding, pick))

    return F.array(*[share(c) for c in range(5)])


def _scored_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    rows = TB.read_table(spark, sf, "embeddings")
    return LI.predict_from_logits(
        rows.select("vec_id", embedding_logits(F.col("embedding")).alias("logits")), "logits", LABELS
    )


@query
def softmax_argmax(spark, sf):
    return _scored_embeddings(spark, sf).select(
        "vec_id",
        "predicted_label",
        *[rounded(F.col("probabilities")[lb]).alias(f"p_{lb}") for lb in LABELS],
    )


@query
def rank_class_scores(spark, sf):
    ranked = LI.ranked_scores(_scored_embeddings(spark, sf), keep=["vec_id"])
    return ranked.select(
        "vec_id",
        F.col("rank").cast("long").alias("rank"),
        "label",
        "label_name",
        rounded("score").alias("score"),
    )


def cosine_predictor(n_classes: int, size: int):
    """A stand-in for a model that only Python can run.

    Returns the loader as a closure, so tasks need nothing but numpy to unpack it.
    """

    def load():
        grid = np.arange(n_classes * size, dtype=np.float64).reshape(n_classes, size)
        weights = np.cos(grid)

        def predict(vectors) -> list:
            return list(np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) @ weights.T)

        return predict

    return load


@query
def batch_predictor(spark, sf):
    rows = TB.read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    logits = MO.predict_batches(rows, cosine_predictor(len(LABELS), 64), "embedding").drop("embedding")
    return LI.predict_from_logits(logits, "logits", LABELS).select(
        "vec_id",
        "predicted_label",
        *[rounded(F.col("probabilities")[lb]).alias(f"p_{lb}") for lb in LABELS],
    )


# --- Run log ----------------------------------------------------------------------------------


@query
def latest_runs(spark, sf):
    return RU.latest_runs(TB.run_log(spark, sf)).select("run_id", "start_time")


@query
def run_history_top20(spark, sf):
    return RU.run_history(TB.run_log(spark, sf))


@query
def f1_trend(spark, sf):
    return RU.f1_trend(RU.run_history(TB.run_log(spark, sf)))


@query
def cv_trend(spark, sf):
    return RU.cv_trend(RU.run_history(TB.run_log(spark, sf)))


@query
def best_epoch(spark, sf):
    """Days as epochs, event types as models."""
    epochs = (
        TB.read_table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("model_id"), F.dayofmonth("ts").alias("epoch"))
        .agg(F.round(F.avg("value") / 100, 2).alias("f1"))
    )
    return RU.best_epoch(epochs).select(
        "model_id", F.col("best_epoch").cast("long").alias("best_epoch"), "best_f1"
    )


@query
def promotion_gate(spark, sf):
    """Each run against the one before it as champion."""
    runs = TB.scored_runs(spark, sf).withColumn(
        "champion", F.lag("cv_f1").over(Window.partitionBy(F.lit(0)).orderBy("run_no"))
    )
    args = [
        F.col("cv_f1"),
        F.coalesce("champion", F.lit(0.0)),
        F.col("training_records"),
        F.col("champion").isNull(),
    ]
    return runs.select(
        "run_no", PR.should_promote(*args).alias("promote"), PR.promotion_reason(*args).alias("reason")
    )


@query
def champion_score(spark, sf):
    """Runs as champions; every third lacks its cross-validated score, every seventh has zero."""
    cv = (
        F.when(F.col("run_no") % 3 == 0, F.lit(None).cast("double"))
        .when(F.col("run_no") % 7 == 0, F.lit(0.0))
        .otherwise(F.col("cv_f1"))
    )
    f1 = F.when(F.col("run_no") % 2 == 0, F.col("f1"))
    return TB.scored_runs(spark, sf).select(
        "run_no",
        PR.champion_score(cv, f1).alias("score"),
        PR.champion_display_score(cv, f1).alias("shown"),
    )


@query
def promotion_history(spark, sf):
    return RU.promotion_history(TB.scored_runs(spark, sf))


@query
def dashboard_totals(spark, sf):
    champion = (
        TB.scored_runs(spark, sf)
        .orderBy(F.desc("run_no"))
        .limit(1)
        .select(F.col("f1").alias("f1_weighted"), "training_records")
    )
    return RU.dashboard_totals(TB.accumulated(spark, sf), champion)


# --- Fitted models (no SQL counterpart) -------------------------------------------------------

def stored_training_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Training rows as a table: every step of fitting reads them again."""
    return written_table(training_rows(spark, sf), "training")


def _judged(scored: DataFrame, scores: str, key: str) -> DataFrame:
    """What holds for right scores, whatever the solver: a score per class, probabilities that sum
    to one, and the best class predicted."""
    values = F.map_values(scores)
    return scored.select(
        key,
        F.size(values).cast("long").alias("n_classes"),
        rounded(total(values)).alias("total"),
        (F.col(scores)[F.col("predicted_label")] == F.array_max(values)).alias("is_best"),
    )


@query
def fit_logreg(spark, sf):
    """Coefficients of the default classifier, the highest fifteen per class."""
    model = MO.fit_text_model(stored_training_rows(spark, sf))
    return LI.top_terms(model.coefficients(spark))


def _held_out(model, parts: DataFrame, scores: str, key: str, label_col: str) -> DataFrame:
    """Scored rows of the held-out part, judged one by one and, as a whole, against the majority.

    A model that has learned nothing predicts one class, so it cannot exceed the majority's score.
    """
    test = parts.filter("is_test")
    scored = written_table(model.transform(test), "scored")
    counts = M.confusion_counts(scored, label_col, "predicted_label")
    dummy = M.majority_baseline(parts.filter("NOT is_test"), test, label_col)
    majority = dummy.select("dummy_f1_weighted").scalar()
    return _judged(scored, scores, key).withColumns(
        {
            "majority_f1": rounded(majority),
            "beats_majority": M.weighted_f1(counts).scalar() > majority,
        }
    )


@query
def predict_scores(spark, sf):
    parts = written_table(SP.stratified_split(stored_training_rows(spark, sf)), "split")
    model = MO.fit_text_model(parts.filter("NOT is_test"))
    return _held_out(model, parts, "probabilities", "report_number", "severity_label")


@query
def fit_svm(spark, sf):
    parts = written_table(SP.stratified_split(stored_training_rows(spark, sf)), "split")
    model = MO.fit_text_model(parts.filter("NOT is_test"), MO.Params("svm"))
    judged = _judged(model.transform(parts.filter("is_test")), "decision_scores", "report_number")
    return judged.drop("total")


#: Share of its first length that the gradient of a finished fit may have.
GRADIENT_SHARE = {"svm": 1e-3, "logreg": 1e-2}


def _optimality(spark: SparkSession, sf: str, model_type: str) -> DataFrame:
    """Per class the gradient's length at zero coefficients, and whether the fit has brought it down."""
    rows = stored_training_rows(spark, sf)
    model = MO.fit_text_model(rows, MO.Params(model_type))
    weights = written_table(FE.weight_lists(rows, model.space), "weights")
    places = model.space.term_table(spark).withColumnRenamed("term", "spelled")
    found = model.coefficients(spark).withColumnRenamed("term", "spelled").join(places, "spelled")
    coefficients = written_table(found.select("label", F.col("index").alias("term"), "coef"), "coefficients")
    intercepts = dict(zip(model.labels, model.head.intercepts()))
    norms = OP.gradient_norms(
        weights, rows.select("report_number", "severity_label"), coefficients, intercepts, model_type
    )
    small = F.col("norm") <= GRADIENT_SHARE[model_type] * F.col("start_norm")
    return norms.select(
        "label", "n", F.round("start_norm", 4).alias("start_norm"), small.alias("is_minimum")
    )


@query
def svm_optimality(spark, sf):
    return _optimality(spark, sf, "svm")


@query
def logreg_optimality(spark, sf):
    return _optimality(spark, sf, "logreg")


@query
def cross_validate_logreg(spark, sf):
    return MO.cross_validate(stored_training_rows(spark, sf))


@query
def grid_search(spark, sf):
    """Mean score of every setting of the grid."""
    return MO.grid_scores(stored_training_rows(spark, sf), MO.param_grid())


@query
def embedding_head(spark, sf):
    rows = TB.read_table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    parts = written_table(SP.stratified_split(rows, "label", "vec_id"), "split")
    model = MO.fit_embedding_model(parts.filter("NOT is_test"))
    return _held_out(model, parts, "probabilities", "vec_id", "label")


@query
def embedding_head_cv(spark, sf):
    return MO.cross_validate_embeddings(TB.read_table(spark, sf, "embeddings"))


@query
def training_job(spark, sf):
    """A cycle against a champion that no score can beat: promoted only below the size compared from."""
    store = ModelStore(f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    save_champion(spark, {"cv_f1_mean": 2.0, "checkpoint_path": "before"}, store.champion)
    result = train_job(TB.reports(spark, sf), store, remove_unknown=True)
    result |= {
        "n_classes": len(result["class_counts"]),
        "n_folds": len(result["cv_f1_per_fold"]),
        "dummy_f1": round(result["dummy_f1_weighted"], 6),
        "reason": result["promotion_reason"].split(" ")[0],
        "switched": store.champion_path(spark) == store.model(result["run_id"]),
    }
    schema = (
        "training_records long, n_classes long, n_folds long, dummy_f1 double, beats_dummy boolean, "
        "promoted boolean, reason string, switched boolean"
    )
    names = [part.split(" ")[0] for part in schema.split(", ")]
    return spark.createDataFrame([tuple(result[n] for n in names)], schema)
