"""Entities, several labels, reliability and the promotion history against plain versions."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from incidentia.functions.arrays import running_totals
from incidentia.operators import entities as EN
from incidentia.operators import exchange as EV
from incidentia.operators import multilabel as ML
from incidentia.operators import reliability as RL
from incidentia.operators import runs as RU
from incidentia.operators.ordered import in_blocks, running
from incidentia.schema import REPORT
from incidentia.session import Scratch

SPANS = "doc_id long, type string, start int, end int"


def plain_matches(true, guess):
    """Strict hits, and credits of greedy one-to-one matches of the rest."""
    true, guess = list(true), list(guess)
    strict = 0
    for span in list(true):
        if span in guess:
            true.remove(span)
            guess.remove(span)
            strict += 1
    credit = 0.0
    while True:
        best = []
        for t in true:
            for g in guess:
                shared = min(t[3], g[3]) - max(t[2], g[2])
                if t[:2] == g[:2] and shared > 0:
                    spanned = max(t[3], g[3]) - min(t[2], g[2])
                    best.append(((-shared, spanned, t[2:], g[2:]), t, g, shared / spanned))
        if not best:
            return strict, strict + credit
        _, t, g, share = min(best)
        true.remove(t)
        guess.remove(g)
        credit += share


@pytest.mark.parametrize("seed", range(3))
def test_entity_scores(spark, seed):
    rng = random.Random(seed)

    def spans(n):
        rows = []
        for _ in range(n):
            start = rng.randrange(150)
            rows.append((rng.randrange(3), rng.choice("AB"), start, start + rng.randrange(1, 90)))
        return rows + rows[: n // 3]

    true, guess = spans(24), spans(21)
    guess += true[:5]
    found = {r.type: r for r in EN.entity_scores(
        spark.createDataFrame([*true, (1, "A", 5, 5), (1, "A", None, 4)], SPANS),
        spark.createDataFrame(guess, SPANS),
    ).collect()}
    sums = [0, 0.0]
    for kind in "AB":
        strict, partial = plain_matches(
            [s for s in true if s[1] == kind], [s for s in guess if s[1] == kind]
        )
        sums = [sums[0] + strict, sums[1] + partial]
        assert found[kind].strict_hits == strict
        assert math.isclose(found[kind].partial_hits, partial)
        assert found[kind].n_true == sum(s[1] == kind for s in true)
    every = found[None]
    assert every.strict_hits == sums[0] and math.isclose(every.partial_hits, sums[1])
    assert math.isclose(every.partial_f1, 2 * sums[1] / (len(true) + len(guess)))


def test_entity_scores_without_spans(spark):
    none = spark.createDataFrame([], SPANS)
    assert EN.entity_scores(none, none).count() == 0
    (row, every) = EN.entity_scores(spark.createDataFrame([(1, "A", 0, 4)], SPANS), none).collect()
    assert row.strict_f1 == row.partial_precision == every.boundary_accuracy == 0.0


def test_repeated_spans_do_not_meet_in_pairs(spark):
    true = spark.createDataFrame([(1, "A", 0, 10)] * 500, SPANS)
    guess = spark.createDataFrame([(1, "A", 1, 10)] * 400, SPANS)
    pairs = EN.overlapping(EN.counted_spans(true), EN.counted_spans(guess))
    assert pairs.count() == 1
    row = EN.entity_scores(true, guess).filter("type = 'A'").first()
    assert row.strict_hits == 0 and math.isclose(row.partial_hits, 400 * 0.9)


def test_best_thresholds(spark):
    rng = random.Random(7)
    rows = [(rng.choice("xyz"), rng.choice([round(rng.random(), 2), None]), rng.random() < 0.4) for _ in range(900)]
    rows += [("never", 0.5, False), ("never", 0.7, None), (None, 0.1, True)]
    found = {r.label: r for r in ML.best_thresholds(
        spark.createDataFrame(rows, "label string, score double, is_true boolean").repartition(6)
    ).collect()}
    assert set(found) == {"x", "y", "z", "never", None}
    for label, r in found.items():
        mine = [(s, bool(t)) for name, s, t in rows if name == label]
        positive = sum(t for _, t in mine)

        def f1(least):
            kept = [t for s, t in mine if s is not None and s >= least]
            return 2 * sum(kept) / (len(kept) + positive)

        best = max((f1(s), s) for s, _ in mine if s is not None)
        assert (r.f1, r.threshold, r.n_positive, r.n) == (*best, positive, len(mine))


def test_multilabel_metrics_of_odd_sets(spark):
    rows = [
        (["D", "D", "elsewhere"], ["D"], [0.9, 0.1, 0.1, 0.1, 0.1]),
        ([], [], [0.5, 0.5, 0.5, 0.5, 0.5]),
        (None, ["I"], [0.2, 0.3, 0.2, 0.1, 0.1]),
        (["I", "M"], ["M"], [0.4, 0.4, 0.9, 0.1, 0.4]),
    ]
    df = spark.createDataFrame(rows, "true_labels array<string>, predicted_labels array<string>, s array<double>")
    row = ML.multilabel_metrics(df, scores_col="s").first()
    assert math.isclose(row.micro_f1, 2 * 2 / (3 + 3))
    assert math.isclose(row.macro_f1, (1 + 0 + 1) / 5)
    assert math.isclose(row.hamming_loss, (0 + 0 + 1 + 1) / 20)
    assert math.isclose(row.jaccard, (1 + 1 + 0 + 0.5) / 4)
    assert math.isclose(row.coverage_error, (1 + 0 + 0 + 4) / 4)
    assert math.isclose(row.ranking_precision, (1 + 1 + 1 + (1 + 2 / 4) / 2) / 4)
    assert ML.multilabel_metrics(df.limit(0), scores_col="s").first().jaccard is None


def test_multi_hot_keeps_rows_without_number(spark):
    rows = [("a", "D"), ("a", "I"), ("a", "I"), ("", "M"), ("", "D"), (None, "X"), ("b", None)]
    df = spark.createDataFrame(rows, "report_number string, severity_label string")
    found = sorted((r.report_number or "", r.label_set, r.multi_hot) for r in ML.multi_hot(df).collect())
    assert found == [
        ("", [], [0, 0, 0, 0, 0]),
        ("", ["D"], [1, 0, 0, 0, 0]),
        ("", ["M"], [0, 0, 1, 0, 0]),
        ("a", ["D", "I"], [1, 1, 0, 0, 0]),
        ("b", [], [0, 0, 0, 0, 0]),
    ]


def test_kappa_and_calibration(spark):
    counts = spark.createDataFrame(
        [("a", "a", 20), ("a", "b", 5), ("b", "a", 10), ("b", "b", 15)], "label string, prediction string, n long"
    )
    assert math.isclose(RL.cohen_kappa(counts).first().kappa, 0.4)
    assert RL.cohen_kappa(counts.filter("label = prediction AND label = 'a'")).first().kappa == 0.0
    assert RL.cohen_kappa(counts.limit(0)).first().kappa is None
    rows = [(1.0, True), (0.95, False), (0.15, True), (0.1, None), (None, True), (float("nan"), True)]
    table = RL.calibration_table(spark.createDataFrame(rows, "c double, ok boolean"), "c", "ok")
    bins = {r.bin: (r.n, r.accuracy) for r in table.collect()}
    assert bins == {9: (2, 0.5), 1: (2, 0.5)}
    error = RL.calibration_error(table).first()
    assert math.isclose(error.expected_error, (0.475 + 0.375) / 2)


def test_percentiles_within_their_error(spark):
    rng = random.Random(3)
    values = [rng.lognormvariate(0, 3) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in [*values, 0.0, -2.0, None]], "v double")
    found = RL.merged_percentiles(df, "v", [0.0001, 0.5, 0.95, 1.0]).collect()
    ordered = sorted([*values, 0.0, 0.0])
    for r in found:
        exact = ordered[max(math.ceil(r.share * len(ordered)), 1) - 1]
        assert abs(r.value - exact) <= 0.0101 * exact and r.n == len(ordered)


# --- Values in order, and the promotions ------------------------------------------------------


@pytest.mark.parametrize("before", [False, True])
def test_running_values(spark, before):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), rng.choice([None, rng.randrange(50)])) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, g string, v long").repartition(7)
    with Scratch(spark) as scratch:
        blocks = in_blocks(df, scratch, "i")
        for by in ([], ["g"]):
            for how in ("sum", "max", "last"):
                found = running(blocks, F.col("v"), "out", ["i"], how, by, before).collect()
                assert len(found) == len(rows)
                for r in found:
                    seen = [
                        v for i, g, v in rows
                        if (i < r.i or (i == r.i and not before)) and v is not None and (not by or g == r.g)
                    ]
                    plain = {"sum": sum(seen), "max": max(seen, default=None), "last": seen[-1] if seen else None}
                    assert r.out == plain[how]


def plain_history(log):
    champion, out = None, []
    for number, cv, records in sorted(log):
        better = cv is not None and champion is not None and cv - champion >= 0.005
        promoted = champion is None or (records is not None and records < 10_000) or better
        champion = cv if promoted else champion
        out.append((number, promoted, champion))
    return out


@pytest.mark.parametrize("case", ["mixed", "rising", "no scores", "one", "none"])
def test_promotion_history(spark, case, monkeypatch):
    rng = random.Random(4)
    log = {
        "mixed": [
            (i, rng.choice([None, round(rng.random(), 3), 0.5 + i / 1000]), rng.choice([5, 20_000, 20_000, None]))
            for i in range(400)
        ],
        "rising": [(i, i / 1000, 50_000) for i in range(300)],
        "no scores": [(i, None, 50_000) for i in range(9)],
        "one": [(3, 0.4, 50_000)],
        "none": [],
    }[case]
    monkeypatch.setattr(RU, "STEP_RUNS", 16)
    df = spark.createDataFrame(log, "run_no long, cv_f1 double, training_records long").repartition(5)
    found = sorted(tuple(r) for r in RU.promotion_history(df).collect())
    assert found == plain_history(log)


# --- Dictionary labels and resources ----------------------------------------------------------


def plain_labels(text, phrases):
    words = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
    out, at = [], 0
    while at < len(words):
        for n in range(4, 0, -1):
            said = " ".join(w for w, _, _ in words[at : at + n])
            if len(words) - at >= n and said in phrases:
                out.append((phrases[said], words[at][1], words[at + n - 1][2], said))
                at += n - 1
                break
        at += 1
    return out


def test_dictionary_labels(spark):
    dictionary = [
        ("Heart  Valve", "DEVICE"), ("heart", "BODY_PART"), ("valve leak", "ADVERSE_EVENT"),
        ("a b a b", "X"), ("a b", "Y"), ("heart", "ADVERSE_EVENT"), ("--", "X"), (None, "X"), ("b", None),
    ]
    phrases = {"heart valve": "DEVICE", "heart": "ADVERSE_EVENT", "valve leak": "ADVERSE_EVENT", "a b a b": "X", "a b": "Y"}
    texts = [
        "Heart valve leak; the HEART-VALVE, heart.", "a b a b a b, a b a", "", None, "…", "heart",
        "é heart é valve leak " * 120, "heart",
    ]
    docs = spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts)], "doc_id int, text string")
    found = EN.label_entities(docs, spark.createDataFrame(dictionary, "phrase string, type string"))
    expected = [(i % 7, *label) for i, t in enumerate(texts) for label in plain_labels(t or "", phrases)]
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    nothing = spark.createDataFrame([], "phrase string, type string")
    assert EN.label_entities(docs, nothing).count() == 0


def test_long_phrase_is_an_error(spark):
    long = spark.createDataFrame([("w " * 40, "X")], "phrase string, type string")
    docs = spark.createDataFrame([(1, "w w")], "doc_id int, text string")
    with pytest.raises(Exception, match="more than 32 words"):
        EN.label_entities(docs, long)


def test_running_totals(spark):
    values = [[], [5], list(range(200)), None]
    df = spark.createDataFrame([(v,) for v in values], "v array<int>")
    found = [r[0] for r in df.select(running_totals(F.col("v"))).collect()]
    assert found == [[], [5], [sum(range(k + 1)) for k in range(200)], []]


def test_resources(spark):
    rows = [
        ("1", "20240105", "Death", "D", "pump", "text"),
        ("", "20241341", "", "UNKNOWN", " ", "text"),
        (None, "2024-01-05", None, "M", 'a "b"', None),
    ]
    made = EV.adverse_events(spark.createDataFrame(rows, REPORT)).collect()
    first, second, third = (json.loads(r.resource) for r in made)
    assert first["category"] == [{"text": "serious"}] and first["date"] == "2024-01-05"
    assert first["identifier"] == {"value": "1"} and first["seriousness"] is True
    assert (made[0].missing, made[0].complete) == ([], True)
    assert made[1].missing == ["identifier", "category", "event", "date", "suspectEntity"]
    assert set(second) == {"resourceType", "status", "actuality", "subject"}
    assert made[2].missing == ["identifier", "event", "date"] and third["seriousness"] is False
    assert third["suspectEntity"][0]["instance"]["display"] == 'a "b"'
    rates = {r.severity_label: (r.n, r.n_complete) for r in EV.pass_rate(EV.adverse_events(spark.createDataFrame(rows, REPORT))).collect()}
    assert rates == {"D": (1, 1), "UNKNOWN": (1, 0), "M": (1, 0), None: (3, 1)}
