"""Language identification by rank-order profiles of character n-grams.

Words are runs of letters, lower-cased, with a boundary on either side; n-grams of one to three
characters stay inside a word. A profile lists a language's most frequent n-grams in order. A
document is compared by the out-of-place distance: for each of its own most frequent n-grams, how
far its rank is from the profile's, or the profile's length if it is absent there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incidentia.llm.common import id_type, in_slot, slices

#: N-grams of a profile.
PROFILE = 300
#: Languages that may be learned; their profiles go to every task.
MAX_LANGUAGES = 1_000
UNKNOWN = "und"
#: Scores of one language and length that a bound is found from at the least, and the share of
#: their lower quartile that it is.
BOUND_FROM, BOUND_SHARE = 100, 0.5

_EDGE = 1


def _is_letter() -> np.ndarray:
    """Whether each code point is a letter."""

    def make() -> np.ndarray:
        table = np.zeros(0x110000, dtype=bool)
        table[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = True
        return table

    return in_slot(("letters",), make)


def ngrams(text: str | None) -> np.ndarray:
    """The codes of all n-grams of a text, 21 bits a character; none without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    letters = np.where(_is_letter()[points], points, _EDGE).astype(np.int64)
    codes = np.concatenate(([_EDGE], letters, [_EDGE]))
    inside = codes != _EDGE
    if not inside.any():
        return np.empty(0, dtype=np.int64)
    # One boundary between words.
    codes = codes[np.concatenate(([True], inside[1:] | inside[:-1]))]
    one = codes[codes != _EDGE]
    two = (codes[:-1] << 21) | codes[1:]
    two = two[(codes[:-1] != _EDGE) | (codes[1:] != _EDGE)]
    middle = codes[1:-1] != _EDGE
    three = ((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:])[middle]
    return np.concatenate((one, two, three))


def ranked(grams: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by code."""
    values, counts = np.unique(grams, return_counts=True)
    return values[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Ranks of n-grams by language, and the distance of a document to each."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.languages = sorted({r[0] for r in rows})
        self.grams = np.array(sorted({r[1] for r in rows}), dtype=np.int64)
        self.size = size
        # Absent n-grams of a language, and the column behind the last for those of none.
        self.ranks = np.full((len(self.languages), len(self.grams) + 1), -1, dtype=np.int64)
        line = {language: i for i, language in enumerate(self.languages)}
        for language, gram, rank in rows:
            self.ranks[line[language], np.searchsorted(self.grams, gram)] = rank

    def classify(self, text: str | None) -> tuple[str, float]:
        """The nearest language and one minus the distance's share of the largest possible."""
        return self.nearest(ranked(ngrams(text), self.size))

    def nearest(self, own: np.ndarray) -> tuple[str, float]:
        """The same from a text's ranked n-grams."""
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        at[self.grams[at] != own] = len(self.grams)
        theirs = self.ranks[:, at]
        apart = np.where(theirs < 0, self.size, np.abs(theirs - np.arange(len(own))))
        distance = apart.sum(axis=1)
        best = int(distance.argmin())
        return self.languages[best], 1.0 - float(distance[best]) / (self.size * len(own))


def is_held_out(id_column: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 modulo 4."""
    text = F.coalesce(id_column.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 4 == 2


def _sample(
    labelled: DataFrame, id_col: str, text_col: str, lang_col: str, learn_from: int | None
) -> DataFrame:
    """(text, lang) of the documents that a language is learned from."""
    rows = labelled.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    ).filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; is {lang_col!r} the right column?")
    if learn_from is None:
        return rows.select("text", "lang")
    share = F.lit(1.0)
    for language, count in sizes:
        share = F.when(F.col("lang") == language, min(1.0, learn_from / count)).otherwise(share)
    place = F.pmod(F.xxhash64(F.lit("profile"), "id", "text"), F.lit(1 << 30)) / float(1 << 30)
    return rows.filter(place < share).select("text", "lang")


def learn_profiles(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    size: int = PROFILE,
    learn_from: int | None = None,
) -> DataFrame:
    """A row per language and profile n-gram: lang, gram, rank from 0.

    Rows with a null text or language are left out; all others are learned from. With ``learn_from`` a
    language with more documents than that is learned from about so many, the ones whose hashed id and
    text fall below a bound. Texts without a letter add nothing; no rows give no profiles.
    """
    rows = _sample(labelled, id_col, text_col, lang_col, learn_from)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            by_language: dict[str, list[np.ndarray]] = {}
            for text, language in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_language.setdefault(language, []).append(ngrams(text))
            for language, grams in by_language.items():
                values, counts = np.unique(np.concatenate(grams), return_counts=True)
                columns = [pa.array([language] * len(values), pa.string())]
                columns += [pa.array(values), pa.array(counts.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])

    counted = rows.mapInArrow(count, "lang string, gram long, n long")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return (
        counted.groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(order) - 1)
        .filter(F.col("rank") < size)
        .select("lang", "gram", "rank")
    )


def grade_of(own: np.ndarray) -> int:
    """Texts of about as many n-grams have comparable scores: the binary digits of their number."""
    return len(own).bit_length()


def learn_bounds(
    labelled: DataFrame,
    profiles: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    size: int = PROFILE,
    learn_from: int | None = None,
) -> DataFrame:
    """A row per language and grade of length: lang, grade, bound.

    The documents that profiles are learned from are scored, whole and by their first 1, 2, 4, ...
    words, so that short texts are judged by short texts. The bound is ``BOUND_SHARE``
    of the lower quartile; fewer than ``BOUND_FROM`` scores give none.
    """
    rows = [tuple(r) for r in profiles.limit(MAX_LANGUAGES * size).collect()]
    held = labelled.sparkSession.sparkContext.broadcast(Profiles(rows, size))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for text in batch.column(0).to_pylist():
                words = text.split()
                halves = [" ".join(words[: 1 << k]) for k in range(len(words).bit_length())]
                for piece in (*halves, text):
                    own = ranked(ngrams(piece), size)
                    found.append((*held.value.nearest(own), grade_of(own)))
            names, scores, grades = zip(*found) if found else ((), (), ())
            columns = [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            columns.append(pa.array(grades, pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, ["lang", "score", "grade"])

    scored = _sample(labelled, id_col, text_col, lang_col, learn_from)
    scored = scored.mapInArrow(score, "lang string, score double, grade int")
    low = F.percentile_approx("score", 0.25)
    return (
        scored.filter(F.col("lang") != UNKNOWN)
        .groupBy("lang", "grade")
        .agg((BOUND_SHARE * low).alias("bound"), F.count("*").alias("n"))
        .filter(F.col("n") >= BOUND_FROM)
        .select("lang", "grade", "bound")
    )


def identify_language(
    docs: DataFrame,
    profiles: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = PROFILE,
) -> DataFrame:
    """A row per document: doc_id, lang_pred, score from 0 to 1.

    Null texts, texts without a letter and all texts when there are no profiles get ``und`` and 0.
    Equally near languages: the first by name. Whole texts are read; repeated rows and ids stay rows
    of their own, further columns are ignored.
    """
    rows = [tuple(r) for r in profiles.limit(MAX_LANGUAGES * size).collect()]
    held = docs.sparkSession.sparkContext.broadcast(Profiles(rows, size))
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type(docs, id_col)),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [held.value.classify(t) for t in batch.column(1).to_pylist()]
            names, scores = zip(*found) if found else ((), ())
            columns = [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        classify, schema
    )


def keep_identified(
    docs: DataFrame,
    profiles: DataFrame,
    text_col: str = "text",
    languages: list[str] | None = None,
    size: int = PROFILE,
    bounds: DataFrame | None = None,
) -> DataFrame:
    """The rows of ``docs`` in one of ``languages``, or in any language if none are given.

    Rejected are null texts, texts without a letter, texts with none of their n-grams in any profile
    (score 0), texts whose score lies below the one of ``bounds`` for their language and length and,
    with ``languages``, texts nearest to another one. All columns stay as they are.
    """
    rows = [tuple(r) for r in profiles.limit(MAX_LANGUAGES * size).collect()]
    held = docs.sparkSession.sparkContext.broadcast(Profiles(rows, size))
    place = docs.columns.index(text_col)

    rows = bounds.limit(MAX_LANGUAGES * 64).collect() if bounds is not None else []
    least = {(r["lang"], r["grade"]): r["bound"] for r in rows}

    def good(text: str | None) -> bool:
        own = ranked(ngrams(text), size)
        name, score = held.value.nearest(own)
        near = score > 0 and score >= least.get((name, grade_of(own)), 0.0)
        return near and (languages is None or name in languages)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [good(t) for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(found, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
