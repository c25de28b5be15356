"""TF-IDF features: relational weights, and the per-row vector path used for fitting and scoring.

Words are numbered, and n-grams counted as numbers, in compiled code over stretches of Arrow batches. For
document frequencies each stretch is added up before the one shuffle, which is on the term, so that hot
terms shrink to a few rows per task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incidentia.schema import MAX_DF, MAX_FEATURES, MIN_DF, NGRAM_RANGE

#: Words, about, that a task takes at a time: it adds up their terms and hands them on.
HELD_TERMS = 500_000
#: Bytes of a word in a text.
_WORD_BYTES = 8


def text_grams(text: str | None, ngram_range: tuple[int, int]) -> list[str]:
    """``ngrams(clean_tokens(text))`` of one text; none of a missing one."""
    words = [word for word in (text or "").split(" ") if len(word) >= 2]
    grams = []
    for n in range(ngram_range[0], ngram_range[1] + 1):
        grams += words if n == 1 else map(" ".join, zip(*(words[i:] for i in range(n))))
    return grams


def counted_terms(text: Column, ngram_range: tuple[int, int] = NGRAM_RANGE) -> Column:
    """``array<struct<term, tf>>`` of a cleaned text."""

    def count(texts: pa.Array) -> pa.Array:
        counts = [Counter(text_grams(t, ngram_range)) for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, counts)]).astype(np.int32)
        terms = pa.array([term for c in counts for term in c], pa.string())
        tf = pa.array([n for c in counts for n in c.values()], pa.int64())
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([terms, tf], ["term", "tf"]))

    return F.arrow_udf(count, "array<struct<term: string, tf: bigint>>")(text)


def _stretches(texts: pa.Array) -> Iterator[range]:
    """Runs of rows of about ``HELD_TERMS`` words; a longer text is one of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        end = int(np.searchsorted(ends, before + HELD_TERMS * _WORD_BYTES, side="right"))
        yield range(start, max(end, start + 1))
        start = max(end, start + 1)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``clean_tokens`` of texts in order: the number of each word, its text, and the words by number."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
    words, owner = lists.flatten(), pc.list_parent_indices(lists)
    kept = pc.greater_equal(pc.utf8_length(words), 2)
    coded = words.filter(kept).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), owner.filter(kept).to_numpy(), coded.dictionary


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where a new value starts in sorted keys."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


def _sizes(starts: np.ndarray, total: int) -> np.ndarray:
    return np.diff(np.append(starts, total))


def _added_up(parts: np.ndarray, texts: pa.Array, ngram_range: tuple[int, int]) -> pa.RecordBatch:
    """``(part, term, df, cf)``, a row per term of each part."""
    words, owner, distinct = _words(texts)
    by_part = np.argsort(parts, kind="stable")
    place = np.empty(len(parts), dtype=np.int64)
    place[by_part] = np.arange(len(parts))
    owner = place[owner]
    part_of = np.unique(parts, return_inverse=True)[1][by_part]
    n_words, n_texts = max(len(distinct), 1), max(len(parts), 1)
    codes, bound, at = words, n_words, np.arange(len(words))
    found: list[tuple] = []
    for n in range(1, ngram_range[1] + 1):
        if n > 1:
            at_end = at + n - 1
            inside = at_end < len(words)
            inside[inside] = owner[at[inside]] == owner[at_end[inside]]
            if bound * n_words >= 2**62 // n_texts:
                codes = np.unique(codes, return_inverse=True)[1]
                bound = max(len(codes), 1)
            codes, at = codes[inside] * n_words + words[at_end[inside]], at[inside]
            bound *= n_words
        if n < ngram_range[0] or not len(codes):
            continue
        keys = codes * n_texts + owner[at]
        order = np.argsort(keys)
        # A pair of term and text is a run of equal keys, a term of a part a run of such pairs.
        pairs = _runs(keys[order])
        times, first = _sizes(pairs, len(keys)), order[pairs]
        own = part_of[owner[at[first]]]
        code = codes[first]
        new = np.concatenate(([True], (code[1:] != code[:-1]) | (own[1:] != own[:-1])))
        starts = np.flatnonzero(new)
        told = at[first[starts]]
        spelled = [distinct.take(pa.array(words[told + k])) for k in range(n)]
        terms = pc.binary_join_element_wise(*spelled, " ") if n > 1 else spelled[0]
        rows = parts[by_part[owner[told]]], terms, _sizes(starts, len(pairs)), np.add.reduceat(times, starts)
        found.append(rows)
    columns = [
        pa.array(np.concatenate([np.asarray(f[0]) for f in found] or [[]]), pa.int32()),
        pa.concat_arrays([f[1] for f in found] or [pa.array([], pa.string())]),
        *(pa.array(np.concatenate([f[k] for f in found] or [[]]), pa.int64()) for k in (2, 3)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["part", "term", "df", "cf"])


def _group_terms(
    df: DataFrame, text_col: str, ngram_range: tuple[int, int], group: Column
) -> DataFrame:
    """``(part, term, df, cf)``: sums over the texts of a part and stretch, several rows a term."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stretch in _stretches(batch.column(1)):
                parts = pc.fill_null(batch.column(0).slice(stretch.start, len(stretch)), -1).to_numpy()
                texts = batch.column(1).slice(stretch.start, len(stretch))
                packed = _added_up(parts, texts, ngram_range)
                yield from (packed.slice(at, 10_000) for at in range(0, packed.num_rows, 10_000))

    rows = df.select(group.cast("int").alias("part"), F.col(text_col).alias("text"))
    return rows.mapInArrow(add_up, "part int, term string, df long, cf long")


def term_frequency(
    df: DataFrame,
    key_col: str = "report_number",
    text_col: str = "clean_text",
    ngram_range: tuple[int, int] = NGRAM_RANGE,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``(key, term, tf)`` of every cleaned text."""
    return df.select(key_col, *keep, F.inline(counted_terms(F.col(text_col), ngram_range)))


def document_count(df: DataFrame) -> DataFrame:
    """Number of documents, those without any term included."""
    return df.agg(F.count("*").alias("n_docs"))


def term_stats(tf: DataFrame) -> DataFrame:
    """``(term, df, cf)``: documents holding the term and its count over all of them."""
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def text_term_stats(
    df: DataFrame, text_col: str = "clean_text", ngram_range: tuple[int, int] = NGRAM_RANGE
) -> DataFrame:
    """``term_stats`` straight from the texts."""
    parts = _group_terms(df, text_col, ngram_range, F.lit(0))
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def text_fold_stats(
    df: DataFrame,
    n_splits: int,
    min_df: int = MIN_DF,
    text_col: str = "clean_text",
    ngram_range: tuple[int, int] = NGRAM_RANGE,
) -> DataFrame:
    """``fold_term_stats`` straight from texts with a ``fold``."""
    parts = _group_terms(df, text_col, ngram_range, F.col("fold"))
    return _fold_sums(parts.withColumnRenamed("part", "fold"), F.col("df"), F.col("cf"), n_splits, min_df)


def fold_term_stats(tf: DataFrame, n_splits: int, min_df: int = MIN_DF) -> DataFrame:
    """``(term, df_by_fold, cf_by_fold)`` of ``(fold, term, tf)`` rows, all folds in one pass.

    Terms rarer than ``min_df`` over all folds are so in every training part and go at once.
    """

    return _fold_sums(tf, F.lit(1), F.col("tf"), n_splits, min_df)


def _fold_sums(
    rows: DataFrame, documents: Column, occurrences: Column, n_splits: int, min_df: int
) -> DataFrame:
    def per_fold(value: Column) -> Column:
        return F.array(
            *[F.sum(F.when(F.col("fold") == f, value).otherwise(0)) for f in range(n_splits)]
        )

    return (
        rows.groupBy("term")
        .agg(per_fold(documents).alias("df_by_fold"), per_fold(occurrences).alias("cf_by_fold"))
        .filter(F.aggregate("df_by_fold", F.lit(0).cast("long"), lambda a, x: a + x) >= min_df)
    )


def training_stats(fold_stats: DataFrame, fold: int, ngram_range: tuple[int, int]) -> DataFrame:
    """``(term, df, cf)`` over all folds but ``fold``, for n-grams within ``ngram_range``."""

    def others(column: str) -> Column:
        everything = F.aggregate(column, F.lit(0).cast("long"), lambda a, x: a + x)
        return everything - F.get(column, F.lit(fold))

    words = F.size(F.split("term", " "))
    return (
        fold_stats.filter(words.between(*ngram_range))
        .select("term", others("df_by_fold").alias("df"), others("cf_by_fold").alias("cf"))
        .filter("df > 0")
    )


def within_document_frequency(
    stats: DataFrame, n_docs: Column, min_df: int = MIN_DF, max_df: float = MAX_DF
) -> DataFrame:
    return stats.filter(
        (F.col("df") >= min_df) & (F.col("df").cast("double") <= F.lit(max_df) * n_docs)
    )


def most_common(stats: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """The ``max_features`` terms with the highest corpus count; equals by term.

    The count at that rank is read off a histogram of counts first. Terms below it never enter
    the final sort, which otherwise would merge ``max_features`` rows of every partition.
    """
    by_count = stats.groupBy("cf").agg(F.count("*").alias("terms"))
    ahead = F.sum("terms").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("cf")))
    last = (
        by_count.withColumn("ahead", ahead - F.col("terms"))
        .filter(F.col("ahead") < max_features)
        .agg(F.min("cf"))
        .scalar()
    )
    return stats.filter(F.col("cf") >= last).orderBy(F.desc("cf"), "term").limit(max_features)


def smoothed_idf(df_count: Column, n_docs: Column) -> Column:
    return F.log((n_docs + 1) / (df_count + 1)) + 1.0


def sublinear(tf: Column) -> Column:
    return F.log(tf.cast("double")) + 1.0


def vocabulary(
    stats: DataFrame,
    n_docs: Column,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    max_features: int = MAX_FEATURES,
) -> DataFrame:
    """``(term, df, cf, idf)`` of the retained terms."""
    kept = most_common(within_document_frequency(stats, n_docs, min_df, max_df), max_features)
    return kept.withColumn("idf", smoothed_idf(F.col("df"), n_docs))


# --- Vector path ------------------------------------------------------------------------------

_GRAMS, _COUNTS, _SUBLINEAR, _SCALED = "__grams", "__counts", "__sublinear", "__scaled"
_PARTS = "__parts"
_VECTOR = T.StructType([T.StructField("v", VectorUDT())])


def sparse_vector(size: int, parts: Column) -> Column:
    """An ML vector of indices and values.

    Built-in functions take an ML vector apart but do not put one together; the JSON reader does,
    given a schema that names the vector type.
    """
    rebuilt = F.struct(
        F.lit(0).alias("type"),
        F.lit(size).alias("size"),
        parts["indices"].alias("indices"),
        parts["values"].alias("values"),
    )
    return F.from_json(F.to_json(F.struct(rebuilt.alias("v"))), _VECTOR)["v"]


_ENTRIES = pa.struct({"indices": pa.list_(pa.int32()), "values": pa.list_(pa.float64())})


@dataclass
class _Weights:
    """A vocabulary as numbers: what a task looks words and their runs up in.

    Known words are numbered. A run of n words is known by the number of its first n - 1 words and that
    of the last: ``codes[n]`` are these pairs in order, ``runs[n]`` the run each one makes, and
    ``places[n]`` the place of a run in the vocabulary, or -1 of one that only begins a longer term.
    """

    number: dict[str, int]
    codes: dict[int, np.ndarray]
    runs: dict[int, np.ndarray]
    places: dict[int, np.ndarray]
    idf: np.ndarray
    ngram_range: tuple[int, int]

    @classmethod
    def of(cls, terms: Sequence[str], idf: np.ndarray, ngram_range: tuple[int, int]) -> _Weights:
        number: dict[str, int] = {}
        lengths = range(1, ngram_range[1] + 1)
        known: dict[int, dict] = {n: {} for n in lengths}
        place: dict[int, dict] = {n: {} for n in lengths}
        for at, term in enumerate(terms):
            words = term.split(" ")
            if not ngram_range[0] <= len(words) <= ngram_range[1]:
                continue
            run = -1
            for n, word in enumerate(words, 1):
                last = number.setdefault(word, len(number))
                run = last if n == 1 else known[n].setdefault((run, last), len(known[n]))
            place[len(words)][run] = at
        codes, runs, places = {}, {}, {}
        for n in lengths:
            pairs = np.array(list(known[n]), dtype=np.int64).reshape(-1, 2)
            code = pairs[:, 0] * len(number) + pairs[:, 1]
            runs[n] = np.argsort(code)
            codes[n] = code[runs[n]]
            places[n] = np.full(len(number) if n == 1 else len(code), -1, dtype=np.int64)
            places[n][list(place[n])] = list(place[n].values())
        return cls(number, codes, runs, places, idf, ngram_range)

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and counts of all texts' terms, and where each text's end."""
        words, owner, distinct = _words(texts)
        numbers = np.array([self.number.get(w, -1) for w in distinct.to_pylist()], dtype=np.int64)
        words = numbers[words] if len(words) else words
        at = np.flatnonzero(words >= 0)
        run, found = words[at], []
        for n in range(1, self.ngram_range[1] + 1):
            if n > 1:
                at_end = at + n - 1
                inside = at_end < len(words)
                inside[inside] = (owner[at[inside]] == owner[at_end[inside]]) & (words[at_end[inside]] >= 0)
                at, run = at[inside], run[inside] * len(self.number) + words[at_end[inside]]
                spot = np.searchsorted(self.codes[n], run)
                inside = spot < len(self.codes[n])
                inside[inside] = self.codes[n][spot[inside]] == run[inside]
                at, run = at[inside], self.runs[n][spot[inside]]
            if n >= self.ngram_range[0]:
                place = self.places[n][run]
                found.append((owner[at] * len(self.idf) + place)[place >= 0])
        keys = np.sort(np.concatenate(found))
        starts = _runs(keys)
        text, place = np.divmod(keys[starts], len(self.idf))
        ends = np.searchsorted(text, np.arange(len(texts) + 1))
        return place, _sizes(starts, len(keys)), ends

    def weigh(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and weights of all texts' terms, and where each text's end."""
        place, tf, ends = self.counts(texts)
        values = (np.log(tf.astype(np.float64)) + 1.0) * self.idf[place]
        filled = ends[np.flatnonzero(np.diff(ends))]
        if len(filled):
            lengths = np.sqrt(np.add.reduceat(values * values, filled))
            lengths[lengths == 0] = 1.0
            values /= np.repeat(lengths, _sizes(filled, len(values)))
        return place.astype(np.int32), values, ends


def term_weights(vocab: DataFrame) -> dict[str, float]:
    """The retained terms (at most ``max_features``) and their weights, on the driver."""
    idf = {row["term"]: row["idf"] for row in vocab.select("term", "idf").collect()}
    if not idf:
        raise ValueError("empty vocabulary: no term passes the document frequency limits")
    return idf


class TermSpace:
    """A fitted vocabulary: texts in, unit TF-IDF vectors out.

    Each task looks terms up in the broadcast vocabulary, which its ``max_features`` bounds;
    nothing is shuffled. Texts without a known term get an empty vector.
    """

    def __init__(self, stages: PipelineModel, ngram_range: tuple[int, int]):
        self.stages = stages
        self.ngram_range = tuple(ngram_range)

    @classmethod
    def fit(cls, vocab: DataFrame, ngram_range: tuple[int, int] = NGRAM_RANGE) -> TermSpace:
        """Index the retained terms (at most ``max_features``) and keep their weights."""
        kept = vocab.select("term", "idf").cache()
        one_row = kept.agg(F.collect_list("term").alias(_GRAMS))
        idf = term_weights(kept)
        # Fitting on the list of terms indexes them inside the JVM, whatever their order.
        counter = CountVectorizer(
            inputCol=_GRAMS, outputCol=_COUNTS, vocabSize=len(idf), minDF=1.0
        ).fit(one_row)
        kept.unpersist()
        scale = Vectors.dense([idf[term] for term in counter.vocabulary])
        stages = [
            counter,
            ElementwiseProduct(scalingVec=scale, inputCol=_SUBLINEAR, outputCol=_SCALED),
            Normalizer(p=2.0, inputCol=_SCALED, outputCol="features"),
        ]
        return cls(PipelineModel(stages), ngram_range)

    @property
    def terms(self) -> list[str]:
        return self.stages.stages[0].vocabulary

    @property
    def idf(self) -> np.ndarray:
        return self.stages.stages[1].getScalingVec().toArray()

    def _held(self, spark: SparkSession):
        idf = self.idf
        return spark.sparkContext.broadcast(_Weights.of(self.terms, idf, self.ngram_range))

    def weigh(self, text: Column, spark: SparkSession) -> Column:
        """``struct<indices, values>``: a cleaned text's known terms in order, of unit length."""
        held = self._held(spark)

        def weights(texts: pa.Array) -> pa.Array:
            found = []
            for stretch in _stretches(texts):
                at, values, ends = held.value.weigh(texts.slice(stretch.start, len(stretch)))
                ends = pa.array(ends, pa.int32())
                columns = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (at, values)]
                found.append(pa.StructArray.from_arrays(columns, ["indices", "values"]))
            return pa.concat_arrays(found) if found else pa.array([], _ENTRIES)

        return F.arrow_udf(weights, "struct<indices: array<int>, values: array<double>>")(text)

    def sums(self, text: Column, coefficients: Mapping[str, Sequence[float]], spark: SparkSession) -> Column:
        """``array<double>``: a cleaned text's weights times each of its terms' coefficients, added up.

        Terms without coefficients count as zero. They reach the tasks as one matrix, bounded by the
        vocabulary.
        """
        width = max(map(len, coefficients.values()), default=0)
        nothing = [0.0] * width
        rows = [coefficients.get(term, nothing) for term in self.terms]
        matrix = np.asfortranarray(np.array(rows, dtype=np.float64).reshape(len(rows), width))
        held, factors = self._held(spark), spark.sparkContext.broadcast(matrix)

        def added(texts: pa.Array) -> pa.Array:
            found = []
            for stretch in _stretches(texts):
                at, values, ends = held.value.weigh(texts.slice(stretch.start, len(stretch)))
                out = np.zeros((len(stretch), width))
                filled = np.flatnonzero(np.diff(ends))
                for k in range(width if len(filled) else 0):
                    out[filled, k] = np.add.reduceat(values * factors.value[at, k], ends[filled])
                lists = pa.array(np.arange(len(stretch) + 1) * width, pa.int32())
                found.append(pa.ListArray.from_arrays(lists, pa.array(out.ravel())))
            return pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.float64()))

        return F.arrow_udf(added, "array<double>")(text)

    def transform(self, df: DataFrame, text_col: str = "clean_text") -> DataFrame:
        """Add the ML vector ``features`` to every row of cleaned text."""
        weighed = df.withColumn(_PARTS, self.weigh(F.col(text_col), df.sparkSession))
        return weighed.withColumn("features", sparse_vector(len(self.terms), F.col(_PARTS))).drop(_PARTS)

    def term_table(self, spark: SparkSession) -> DataFrame:
        """``(index, term)``."""
        packed = spark.createDataFrame([(self.terms,)], "terms array<string>")
        return packed.select(F.posexplode("terms").alias("index", "term"))


def weight_lists(
    df: DataFrame, space: TermSpace, key_col: str = "report_number", text_col: str = "clean_text"
) -> DataFrame:
    """``(key, entries)``: ``tfidf_weights`` as an array per row of each term's place and its weight."""
    parts = F.col(_PARTS)
    pairs = F.arrays_zip(parts["indices"].alias("term"), parts["values"].alias("weight"))
    weighed = df.select(key_col, space.weigh(F.col(text_col), df.sparkSession).alias(_PARTS))
    return weighed.select(key_col, pairs.alias("entries"))


def tfidf_weights(
    df: DataFrame,
    space: TermSpace,
    key_col: str = "report_number",
    text_col: str = "clean_text",
) -> DataFrame:
    """``(key, term, weight)``, rows scaled to unit length over the retained terms.

    Weights are made inside each row; terms come back by a broadcast of the bounded vocabulary,
    so no exploded row is ever shuffled.
    """
    parts = F.col(_PARTS)
    pairs = F.arrays_zip(parts["indices"].alias("index"), parts["values"].alias("weight"))
    return (
        df.select(key_col, space.weigh(F.col(text_col), df.sparkSession).alias(_PARTS))
        .select(key_col, F.inline(pairs))
        .join(F.broadcast(space.term_table(df.sparkSession)), "index")
        .select(key_col, "term", "weight")
    )
