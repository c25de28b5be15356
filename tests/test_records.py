import json

import pytest
from pyspark.sql import functions as F

from incidentia.operators.records import flatten_records, rejected_records, with_narrative
from incidentia.schema import REPORT
from incidentia.sources.pages import explode_pages, fetch_reports, page_size_for, read_pages


def records(spark, items):
    pages = spark.createDataFrame([(1, json.dumps({"results": items}))], "page_no long, value string")
    return explode_pages(pages)


def flat(spark, *items, **options):
    rows = flatten_records(records(spark, list(items)), keep=["pos"], **options).orderBy("pos")
    return [r.asDict() for r in rows.drop("pos").collect()]


def report(**fields):
    return {"mdr_text": [{"text": "some text"}], **fields}


def test_empty_narrative_drops_the_record(spark):
    assert flat(spark, {"mdr_text": [], "event_type": ["Malfunction"]}) == []


def test_full_record(spark):
    (row,) = flat(
        spark,
        {
            "mdr_text": [{"text": "Patient died after device failure."}],
            "event_type": ["Death"],
            "device": [{"brand_name": "TestDevice"}],
            "report_number": "12345",
            "date_received": "20230101",
        },
    )
    assert row == {
        "report_number": "12345",
        "date_received": "20230101",
        "event_type": "Death",
        "severity_label": "D",
        "device_name": "TestDevice",
        "narrative_text": "Patient died after device failure.",
    }


def test_missing_fields_become_blank(spark):
    (row,) = flat(spark, report(event_type=["Other"], device=[]))
    assert (row["report_number"], row["date_received"], row["device_name"]) == ("", "", "")
    assert row["severity_label"] == "O"


def test_event_types(spark):
    cases = [
        (["Serious Injury"], "Serious Injury", "I"),
        (["Malfunction", "Death"], "Malfunction", "M"),
        ("Malfunction", "M", "M"),
        ("Serious Injury", "S", "UNKNOWN"),
        ([], "Other", "O"),
        (None, "Other", "O"),
        ("", "Other", "O"),
        ([""], "", "UNKNOWN"),
        ([None], None, "UNKNOWN"),
        (["*"], "*", "UNKNOWN"),
        (["No Answer Provided"], "No Answer Provided", "UNKNOWN"),
        (["banana"], "banana", "UNKNOWN"),
    ]
    rows = flat(spark, report(), *[report(event_type=c[0]) for c in cases])
    got = [(r["event_type"], r["severity_label"]) for r in rows]
    assert got == [("Other", "O")] + [c[1:] for c in cases]


def test_full_event_name_option(spark):
    (row,) = flat(spark, report(event_type="Serious Injury"), full_event_name=True)
    assert (row["event_type"], row["severity_label"]) == ("Serious Injury", "I")


def test_device_fallbacks(spark):
    devices = [
        [{"brand_name": "", "generic_name": "pump"}],
        [{"brand_name": None, "generic_name": "pump"}],
        [{"generic_name": None}],
        [{}],
        "text",
        [{"brand_name": "A"}, {"brand_name": "B"}],
    ]
    rows = flat(spark, *[report(device=d) for d in devices])
    assert [r["device_name"] for r in rows] == ["pump", "pump", None, "", "", "A"]


def test_narrative_parts(spark):
    rows = flat(
        spark,
        {"mdr_text": [{"text": "a"}, {"kind": "x"}, {"text": "b"}]},
        {"mdr_text": ["loose", {"text": " c  d\n"}]},
    )
    assert [r["narrative_text"] for r in rows] == ["a  b", "c  d"]


def test_malformed_records_are_dropped_and_counted(spark):
    bad = [
        None,
        {"mdr_text": [{"text": None}]},
        {"mdr_text": [{"text": 5}]},
        {"mdr_text": None},
        {"mdr_text": "words"},
        {},
        report(device=["x"]),
        report(event_type=7),
        report(event_type={"a": 1}),
        report(event_type=[["Death"]]),
    ]
    assert flat(spark, *bad) == []
    reasons = {r[0]: r[1] for r in rejected_records(records(spark, bad)).collect()}
    assert reasons == {
        "not_an_object": 1,
        "malformed_narrative": 3,
        "no_narrative": 2,
        "malformed_device": 1,
        "malformed_event_type": 3,
    }


def test_narrative_exists(spark):
    assert with_narrative(records(spark, [report(), {"device": []}])).count() == 1


def test_page_size():
    assert [page_size_for(100, 5000), page_size_for(100, 30), page_size_for(5000, 9000)] == [100, 30, 1000]


def land(folder, pages):
    folder.mkdir(exist_ok=True)
    for number, items in pages.items():
        (folder / f"page_{number}.json").write_text(json.dumps({"results": items}, indent=1))


def test_pages_in_order_and_bounded(spark, tmp_path):
    numbered = [report(report_number=str(i)) for i in range(7)]
    numbered[1]["mdr_text"] = []  # unusable: must not count
    land(tmp_path / "p", {2: numbered[3:6], 10: numbered[6:], 1: numbered[:3], 3: []})
    path = str(tmp_path / "p")
    assert read_pages(spark, path).count() == 7
    got = fetch_reports(spark, path, 4)
    assert got.columns == REPORT.names
    assert [r["report_number"] for r in got.collect()] == ["0", "2", "3", "4"]
    assert fetch_reports(spark, path, 100).count() == 6


def test_no_results_give_a_typed_empty_table(spark, tmp_path):
    land(tmp_path / "e", {1: []})
    (tmp_path / "e" / "page_2.json").write_text('{"error": {"code": "NOT_FOUND"}}')
    empty = fetch_reports(spark, str(tmp_path / "e"))
    assert empty.count() == 0 and empty.columns == REPORT.names
    assert all(t == "string" for _, t in empty.dtypes)


def test_page_that_is_no_json_fails(spark, tmp_path):
    land(tmp_path / "e", {1: [report()]})
    (tmp_path / "e" / "page_2.json").write_text("not json")
    with pytest.raises(Exception, match="(?i)json"):
        fetch_reports(spark, str(tmp_path / "e")).count()


def test_label_counts_of_fetched_reports(spark):
    rows = flatten_records(records(spark, [report(event_type=["Death"]), report(event_type=["D"])]))
    assert [tuple(r) for r in rows.groupBy("severity_label").agg(F.count("*")).collect()] == [("D", 2)]
