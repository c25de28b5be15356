import pytest
from pyspark.sql import functions as F

from incidentia.functions import text as TX
from incidentia.operators.filters import clean_table, drop_short


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def test_clean_lowercases(spark):
    assert apply(spark, TX.clean_text, ["PATIENT INJURY"]) == ["patient injury"]


def test_clean_digits(spark):
    text = ["Device model 3000 malfunctioned"]
    assert apply(spark, TX.clean_text, text) == ["device model malfunctioned"]
    kept = apply(spark, lambda c: TX.clean_text(c, preserve_digits=True), text)
    assert kept == ["device model 3000 malfunctioned"]


def test_clean_punctuation(spark):
    assert apply(spark, TX.clean_text, ["Device: failed! (critical)"]) == ["device failed critical"]


def test_clean_blank_and_null(spark):
    assert apply(spark, TX.clean_text, ["", "   ", None, "　\n"]) == ["", "", "", ""]


def test_clean_keeps_case_on_request(spark):
    out = apply(spark, lambda c: TX.clean_text(c, lowercase=False), ["The MD Left"])
    assert out == ["The physician Left"]


def test_expand_known_short_forms(spark):
    cases = {
        "The pt was admitted.": "The patient was admitted.",
        "The MD reviewed the case.": "The physician reviewed the case.",
        "w/pain": "withpain",
        "w/ pain": "w/ pain",
        "w/h/o x": "withh/o x",
        "pté": "pté",
        "éptb": "éptb",
        "pt_x 3pt": "pt_x 3pt",
        "pt pt": "patient patient",
        "SOB, UNK; n/v c/o h/o": "shortness of breath, unknown; nausea vomiting complaint of history of",
        "w/s/p": "withstatus post",
        "PTS": "patients",
    }
    assert apply(spark, TX.expand_abbreviations, list(cases)) == list(cases.values())


def test_boilerplate(spark):
    cases = {
        "It was reported that the device caused injury.": "  the device caused injury.",
        "per the reporter": " er",
        "Follow-up will be requested": " ",
        "followup is requested": " ",
        "follow\nup is requested": "follow\nup is requested",
        "No further information was available.": " .",
        # The blank left by one phrase completes a later phrase of the list.
        "perit was reported thatthe report": " ",
        "nothing here": "nothing here",
    }
    assert apply(spark, TX.remove_boilerplate, list(cases)) == list(cases.values())


def test_long_enough_agrees_with_the_cleaned_length(spark):
    pieces = ["", "x", "pt", "s/p UNK", "it was reported that", "per the report", "followxup is requested",
              "abc def ghij", "abc def ghijk", "12345678901", "yyyyyyyyyyy", "wkwkwkwkwkwkwkwkwkwkwk",
              "information has been received jkxyz", "h/o n/v", None]
    rows = [(f"{a} {b}",) for a in pieces for b in pieces] + [(p,) for p in pieces]
    df = spark.createDataFrame(rows, "t string")
    cleaned = TX.clean_text(F.col("t"))
    wrong = df.select(
        TX.long_enough(F.col("t"), cleaned).alias("quick"), (F.length(cleaned) > 10).alias("plain")
    ).filter("quick <> plain")
    assert wrong.count() == 0


def test_clean_table_drops_short_rows(spark):
    rows = [("The device stopped working during the procedure.", "M"), ("", "M"), ("   ", "I"), ("x", "D")]
    df = spark.createDataFrame(rows, "narrative_text string, severity_label string")
    assert clean_table(df).count() == 1
    assert clean_table(df).columns == ["narrative_text", "severity_label", "clean_text"]


def test_length_limit_is_exclusive(spark):
    df = spark.createDataFrame([("abcdefghij",), ("abcdefghijk",)], "clean_text string")
    assert [r[0] for r in drop_short(df).collect()] == ["abcdefghijk"]


def test_cleaning_cleaned_text_changes_nothing(spark):
    texts = ["The pt had SOB w/pain.", "It was reported that DR saw 3 pts", "Plain words only"]
    once = apply(spark, TX.clean_text, texts)
    assert apply(spark, TX.clean_text, once) == once


def test_tokens_and_ngrams(spark):
    out = apply(spark, lambda c: TX.ngrams(TX.clean_tokens(c)), ["a bb c dd ee", "bb", "a", ""])
    assert out == [["bb", "dd", "ee", "bb dd", "dd ee"], ["bb"], [], []]


@pytest.mark.parametrize("rng, expected", [((1, 1), ["aa", "bb", "cc"]), ((2, 3), ["aa bb", "bb cc", "aa bb cc"])])
def test_ngram_ranges(spark, rng, expected):
    assert apply(spark, lambda c: TX.ngrams(F.split(c, " "), rng), ["aa bb cc"]) == [expected]


def test_word_tokens_of_any_text(spark):
    out = apply(spark, TX.word_tokens, ["Café ABC1 naïve x résumé foo_bar", None])
    assert out == [["cafe", "naive", "resume"], []]


def test_truncation(spark):
    # Two of the places are for marks.
    out = apply(spark, lambda c: TX.truncate_tokens(c, 4), ["a b c", "a", ""])
    assert out == [["a", "b"], ["a"], [""]]
    assert apply(spark, lambda c: TX.is_truncated(c, 4), ["a b c", "a b"]) == [True, False]
    with pytest.raises(ValueError, match="more than 2"):
        TX.truncate_tokens(F.lit("a"), 2)


def test_strip_knows_unicode_blanks(spark):
    assert apply(spark, TX.strip, ["  a b\x1f "]) == ["a b"]
