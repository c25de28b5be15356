"""Row filters, projections and small reports over the report table."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentia.functions.text import clean_text, long_enough
from incidentia.schema import MIN_CLEAN_CHARS, MIN_TRAINING_ROWS, UNKNOWN

_SEARCHED = "__searched"


def clean_table(
    df: DataFrame,
    text_col: str = "narrative_text",
    output_col: str = "clean_text",
    preserve_digits: bool = False,
) -> DataFrame:
    """Add the cleaned text and drop rows whose cleaned text is too short."""
    cleaned = clean_text(F.col(text_col), preserve_digits=preserve_digits)
    return df.filter(long_enough(F.col(text_col), cleaned)).withColumn(output_col, cleaned)


def drop_short(df: DataFrame, text_col: str = "clean_text", min_chars: int = MIN_CLEAN_CHARS):
    return df.filter(F.length(text_col) > min_chars)


def drop_unknown(df: DataFrame, label_col: str = "severity_label") -> DataFrame:
    """Drop UNKNOWN labels; missing labels stay."""
    return df.filter(~F.col(label_col).eqNullSafe(UNKNOWN))


def require_rows(df: DataFrame, minimum: int = MIN_TRAINING_ROWS) -> DataFrame:
    """Raise unless ``df`` has at least ``minimum`` rows; reads no more rows than that."""
    found = df.select(F.lit(1)).limit(minimum).count()
    if found < minimum:
        raise ValueError(f"not enough records after cleaning: {found} < {minimum}")
    return df


def with_labels(df: DataFrame, labels: Iterable[str], label_col: str = "severity_label"):
    return df.filter(F.col(label_col).isin(list(labels)))


def matches(text: Column, term: str, literal: bool = False) -> Column:
    """Case-insensitive regular-expression match; missing text never matches."""
    pattern = re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", term) if literal else term
    return F.coalesce(text.rlike(f"(?iu){pattern}"), F.lit(False))


def search(df: DataFrame, term: str, literal: bool = False) -> DataFrame:
    """Rows whose cleaned narrative (raw, where there is none) matches ``term``.

    The text goes through a generator of one row: a filter is not moved below it, which would clean
    every text a second time where the cleaned column is a projection.
    """
    once = F.inline(F.array(F.struct(F.col(_text_col(df)).alias(_SEARCHED))))
    return df.select("*", once).filter(matches(F.col(_SEARCHED), term, literal)).drop(_SEARCHED)


def display_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "report_number", "date_received", "severity_label", "device_name", _text_col(df)
    )


def distinct_labels(df: DataFrame, label_col: str = "severity_label") -> DataFrame:
    return df.select(label_col).distinct()


def head_rows(df: DataFrame, order_col: str, n: int = 5) -> DataFrame:
    return df.orderBy(order_col).limit(n)


def _text_col(df: DataFrame) -> str:
    return "clean_text" if "clean_text" in df.columns else "narrative_text"
