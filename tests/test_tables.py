import pytest
from pyspark.sql import functions as F

from incidentia.functions import labels as LB
from incidentia.operators import filters as FI
from incidentia.operators import merge as ME
from incidentia.plans.explore import explore, explore_view, export
from incidentia.schema import LABELS, REPORT
from incidentia.sources import reports as SR


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


KEYED = "report_number string, v int"


def values(df):
    return sorted(tuple(r) for r in df.select("report_number", "v").collect())


# Merge


def test_new_only_keeps_repeats_and_unnumbered_rows(spark):
    existing = frame(spark, [("a", 0), ("b", 0), (None, 0), ("", 0)], KEYED)
    new = frame(spark, [("a", 1), ("c", 2), ("c", 3), (None, 4), ("", 5)], KEYED)
    got = ME.new_only(existing, new)
    assert got.columns == ["report_number", "v"]
    assert {tuple(r) for r in got.collect()} == {("c", 2), ("c", 3), (None, 4), ("", 5)}
    assert ME.merge_and_dedup(existing, new).count() == 8
    assert ME.count_new(existing, new).first()[0] == 4


def test_merge_with_nothing_held_or_nothing_new(spark):
    none = frame(spark, [], KEYED)
    rows = frame(spark, [("a", 1), ("a", 2)], KEYED)
    assert values(ME.merge_and_dedup(none, rows)) == [("a", 1), ("a", 2)]
    assert values(ME.merge_and_dedup(rows, rows)) == [("a", 1), ("a", 2)]
    assert values(ME.merge_and_dedup(rows, none)) == [("a", 1), ("a", 2)]


def test_hot_key_and_hot_null(spark):
    rows = [("hot", i) for i in range(300)] + [(None, i) for i in range(300)] + [(str(i), i) for i in range(300)]
    new = frame(spark, rows, KEYED)
    existing = frame(spark, [("hot", -1), ("5", -1)], KEYED)
    assert ME.new_only(existing, new).count() == 599
    assert ME.dedup_batch(new, order_col="v").count() == 1 + 300 + 300


def test_dedup_batch_takes_the_latest(spark):
    rows = [("a", "20240101", "x"), ("a", "20240301", "y"), ("b", "20240101", "z"), (None, "1", "p"), (None, "1", "p")]
    df = frame(spark, rows, "report_number string, date_received string, device_name string")
    got = sorted((tuple(r) for r in ME.dedup_batch(df).collect()), key=str)
    assert got == sorted([rows[1], rows[2], rows[3], rows[4]], key=str)


def test_append_fills_missing_columns(spark):
    left = frame(spark, [("a", 1)], KEYED)
    right = frame(spark, [("b",)], "report_number string")
    assert {tuple(r) for r in ME.append_rows(left, right).collect()} == {("a", 1), ("b", None)}


def test_ingest_summary(spark):
    batch, added = frame(spark, [("a", 1)] * 5, KEYED), frame(spark, [("a", 1)] * 2, KEYED)
    row = ME.ingest_summary(batch, added, frame(spark, [("a", 1)] * 9, KEYED), 10).first()
    assert tuple(row) == (10, 5, 2, 9)


# Labels


def test_severity_and_names(spark):
    df = frame(spark, [("Death",), ("Serious Injury",), ("death",), ("*",), (None,)], "e string")
    assert [r[0] for r in df.select(LB.severity_of(F.col("e"))).collect()] == ["D", "I"] + ["UNKNOWN"] * 3
    names = frame(spark, [("D",), ("UNKNOWN",), ("Q",), (None,)], "l string").select(
        LB.label_name(F.col("l")), LB.label_name(F.col("l"), keep_unlisted=True)
    )
    assert [tuple(r) for r in names.collect()] == [("Death", "Death"), ("Unknown", "Unknown"), (None, "Q"), (None, None)]


def test_encode_decode(spark):
    df = frame(spark, [(lb,) for lb in LABELS] + [("Q",), (None,)], "l string")
    codes = [r[0] for r in df.select(LB.encode_label(F.col("l"))).collect()]
    assert codes == [0, 1, 2, 3, 4, 4, 4]
    back = df.select(LB.decode_label(LB.encode_label(F.col("l"))))
    assert [r[0] for r in back.collect()] == LABELS + ["UNKNOWN", "UNKNOWN"]


# Filters and exploring


def test_drop_unknown_keeps_null(spark):
    df = frame(spark, [("D",), ("UNKNOWN",), (None,)], "severity_label string")
    assert {r[0] for r in FI.drop_unknown(df).collect()} == {"D", None}
    assert FI.distinct_labels(df).count() == 3


def test_require_rows(spark):
    FI.require_rows(spark.range(50))
    with pytest.raises(ValueError, match="49 < 50"):
        FI.require_rows(spark.range(49))


EXPLORE = [
    ("1", "20240101", "Death", "D", "pump", "Burn at the site"),
    ("2", "20240102", "Malfunction", "M", "lead", "No burn. (a+b)"),
    ("3", "20240103", "Other", "O", "", None),
]


def test_search_is_a_caseless_regular_expression(spark):
    df = spark.createDataFrame(EXPLORE, REPORT)

    def found(term, **options):
        return [r[0] for r in FI.search(df, term, **options).collect()]

    assert found("BURN") == ["1", "2"]
    assert found("^burn|a.b") == ["1", "2"]
    assert found("a+b") == []
    assert found("A+B", literal=True) == ["2"]


def test_search_does_not_clean_twice(spark):
    df = frame(spark, [("1", "Burned hand of the patient")], "report_number string, narrative_text string")
    cleaned = FI.clean_table(df)
    found = FI.search(cleaned, "burned")
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in cleaned.collect()]

    def calls(frame):
        return frame._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace")

    assert calls(found) == calls(cleaned)


def test_search_prefers_cleaned_text(spark):
    df = spark.createDataFrame(EXPLORE, REPORT).withColumn("clean_text", F.lit("nothing"))
    assert FI.search(df, "burn").count() == 0
    assert FI.display_columns(df).columns[-1] == "clean_text"


def test_explore_and_export(spark, tmp_path):
    df = spark.createDataFrame(EXPLORE, REPORT)
    assert explore(df).count() == 3
    assert [r[0] for r in explore_view(df, labels=["D", "O"], term="burn").collect()] == ["1"]
    export(df, str(tmp_path / "out"), labels=["M"])
    assert [tuple(r) for r in SR.read_csv(spark, str(tmp_path / "out")).collect()] == [EXPLORE[1]]


def test_head_rows(spark):
    assert [r[0] for r in FI.head_rows(spark.range(20), "id").collect()] == [0, 1, 2, 3, 4]


# Files


def test_csv_round_trip(spark, tmp_path):
    rows = [("1", "20240101", "Death", "D", 'say "x", y', "line one\nline two, end"), ("2", "", "O", "O", "", "t")]
    path = str(tmp_path / "raw")
    SR.write_csv(spark.createDataFrame(rows, REPORT), path)
    back = sorted(tuple(r) for r in SR.read_csv(spark, path).collect())
    assert back == [rows[0], ("2", None, "O", "O", None, "t")]


def test_cached_or_fetch(spark, tmp_path):
    calls = []

    def fetch():
        calls.append(1)
        return spark.createDataFrame(EXPLORE, REPORT)

    path = str(tmp_path / "cache")
    assert SR.cached_or(spark, path, fetch).count() == 3
    assert SR.cached_or(spark, path, fetch).count() == 3
    assert len(calls) == 1
    SR.cached_or(spark, path, fetch, use_cached=False)
    assert len(calls) == 2


def test_accumulated_table(spark, tmp_path):
    path = str(tmp_path / "acc")
    empty = SR.load_accumulated(spark, path)
    assert empty.count() == 0 and empty.columns == REPORT.names + ["batch_id"]
    df = spark.createDataFrame(EXPLORE, REPORT)
    SR.save_accumulated(df, path, 0)
    SR.save_accumulated(df.limit(1), path, 1)
    SR.save_accumulated(df.limit(2), path, 1)  # the same batch again
    counts = {r["batch_id"]: r["count"] for r in SR.load_accumulated(spark, path).groupBy("batch_id").count().collect()}
    assert counts == {0: 3, 1: 2}
