"""Entities in texts: labels from a dictionary of phrases, and scores of spans.

Scores count exact matches, and overlaps in proportion with one-to-one matching.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidentia.functions.arrays import let
from incidentia.functions.text import plain_words, positioned_words
from incidentia.session import Scratch, written_table

#: Words of a phrase, at most: as many go with each word of a text to its comparison.
MAX_PHRASE_WORDS = 32
#: Phrases that may be sent to every task.
BROADCAST_PHRASES = 100_000
#: Characters of a bin that spans are dealt to; a span is copied to each bin it touches.
BIN_CHARS = 64

_KEY = ["doc", "type"]
_TRUE, _GUESS = ["start", "end"], ["g_start", "g_end"]
_COUNTS = ("n_true", "n_predicted", "strict_hits", "partial_hits")


def phrase_table(dictionary: DataFrame, phrase_col: str = "phrase", type_col: str = "type") -> DataFrame:
    """(first, n, phrase, type): phrases as lower-case words joined by blanks, by their first word.

    A phrase under several types takes the first by name. Phrases without a word, and rows without a
    type, drop out; longer ones than ``MAX_PHRASE_WORDS`` are an error.
    """
    rows = dictionary.select(plain_words(F.col(phrase_col)).alias("words"), F.col(type_col).alias("type"))
    bound = F.when(F.size("words") <= MAX_PHRASE_WORDS, F.size("words")).otherwise(
        F.raise_error(F.lit(f"a phrase has more than {MAX_PHRASE_WORDS} words")).cast("int")
    )
    return (
        rows.filter((F.size("words") > 0) & F.col("type").isNotNull())
        .groupBy(F.array_join("words", " ").alias("phrase"))
        .agg(F.min("type").alias("type"), F.first("words").alias("words"))
        .select(F.get("words", F.lit(0)).alias("first"), bound.alias("n"), "phrase", "type")
    )


def label_entities(
    docs: DataFrame,
    dictionary: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrase_col: str = "phrase",
    type_col: str = "type",
) -> DataFrame:
    """(doc_id, type, start, end, phrase): places of dictionary phrases in whole texts.

    Words are runs of letters and digits, compared in lower case; what stands between them does not
    matter. From left to right the longest phrase at a word is taken, and the next one starts after its
    end; so labels never overlap. Words meet phrases by a join on the first word, and only what
    follows it is compared. Repeated documents and ids are labelled each on their own.
    """
    phrases = phrase_table(dictionary, phrase_col, type_col)
    with Scratch(docs.sparkSession) as scratch:
        phrases = scratch.table(phrases, "phrases")
        longest, size = phrases.agg(F.coalesce(F.max("n"), F.lit(1)), F.count("*")).first()
        if size <= BROADCAST_PHRASES:
            phrases = F.broadcast(phrases)

        def ahead(words: Column) -> Column:
            def at(w: Column, i: Column) -> Column:
                return F.struct(
                    i.alias("pos"),
                    w["word"].alias("first"),
                    w["start"].alias("start"),
                    F.slice(words, i + 1, longest).alias("ahead"),
                )

            return F.transform(words, at)

        words = let(positioned_words(F.col(text_col)), ahead)
        # Numbered before the words are laid out: a number in the same projection would count words.
        rows = docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words.alias("w")
        ).select("row", "doc_id", F.inline("w"))
        said = F.array_join(F.slice(F.col("ahead.word"), 1, F.col("n")), " ")
        found = rows.join(phrases, "first").filter(said == F.col("phrase"))
        match = F.struct(
            "pos", (-F.col("n")).alias("less"), "n", "start",
            F.get("ahead", F.col("n") - 1)["end"].alias("end"), "type", "phrase",
        )
        each = found.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(match)).alias("matches")
        )
        kind = each.select(F.get("matches", F.lit(0)).alias("m")).schema["m"].dataType.simpleString()
        start = F.struct(F.lit(0).alias("free"), F.array().cast(f"array<{kind}>").alias("out"))

        def take(acc: Column, m: Column) -> Column:
            return F.when(
                m["pos"] >= acc["free"],
                F.struct((m["pos"] + m["n"]).alias("free"), F.array_append(acc["out"], m).alias("out")),
            ).otherwise(acc)

        taken = each.select("doc_id", F.inline(F.aggregate("matches", start, take, lambda a: a["out"])))
        return written_table(taken.select("doc_id", "type", "start", "end", "phrase"), "entities")


def counted_spans(spans: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """(doc, type, start, end, n): spans with how often each occurs; empty and broken ones go."""
    return (
        spans.select(F.col(doc_col).alias("doc"), "type", "start", "end")
        .filter("end > start AND start >= 0")
        .groupBy("doc", "type", "start", "end")
        .agg(F.count("*").alias("n"))
    )


def overlapping(true: DataFrame, guess: DataFrame) -> DataFrame:
    """Pairs of different spans of one document and type that share characters.

    Spans meet in bins of the text; a pair is taken in the bin in which its overlap begins, so it is
    found once, and spans that lie far apart in a document never meet.
    """

    def bins(df: DataFrame) -> DataFrame:
        first, last = F.floor(F.col("start") / BIN_CHARS), F.floor((F.col("end") - 1) / BIN_CHARS)
        return df.withColumn("bin", F.explode(F.sequence(first, last)))

    left = bins(true).withColumnRenamed("n", "n_true")
    right = bins(guess).select(
        *_KEY, "bin", F.col("start").alias("g_start"), F.col("end").alias("g_end"),
        F.col("n").alias("n_guess"),
    )
    begins = F.greatest("start", "g_start")
    shared = F.least("end", "g_end") - begins
    return (
        left.join(right, [*_KEY, "bin"])
        .filter((shared > 0) & (F.floor(begins / BIN_CHARS) == F.col("bin")))
        .filter("start <> g_start OR end <> g_end")
        .withColumn("shared", shared)
        .withColumn("spanned", F.greatest("end", "g_end") - F.least("start", "g_start"))
        .drop("bin")
    )


def matched_overlaps(pairs: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """One-to-one matches of overlapping spans: tables of (doc, type, credit, n).

    Pairs are taken greedily: the largest overlap first, then the smallest stretch that both span,
    then by position. A round takes every pair that comes first for both of its spans, as often as
    both still occur, until no pair is left; each such pair uses up a span.
    """
    order = [F.desc("shared"), "spanned", *_TRUE, *_GUESS]
    of_true, of_guess = Window.partitionBy(*_KEY, *_TRUE), Window.partitionBy(*_KEY, *_GUESS)
    found = []
    left = scratch.table(pairs, "pairs")
    while not left.isEmpty():
        ranked = left.withColumn("__t", F.row_number().over(of_true.orderBy(*order))).withColumn(
            "__g", F.row_number().over(of_guess.orderBy(*order))
        )
        first = (F.col("__t") == 1) & (F.col("__g") == 1)
        taken = ranked.withColumn("taken", F.when(first, F.least("n_true", "n_guess")).otherwise(0))
        state = scratch.table(
            taken.withColumn("n_true", F.col("n_true") - F.sum("taken").over(of_true))
            .withColumn("n_guess", F.col("n_guess") - F.sum("taken").over(of_guess))
            .drop("__t", "__g"),
            "round",
        )
        credit = F.col("shared") / F.col("spanned")
        found.append(
            state.filter("taken > 0").select(*_KEY, credit.alias("credit"), F.col("taken").alias("n"))
        )
        left = state.filter("taken = 0 AND n_true > 0 AND n_guess > 0").drop("taken")
    return found


def entity_scores(true: DataFrame, guess: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """A row per entity type and one for all (``type`` null) with strict and partial scores.

    Spans are rows (document, type, start, end), the end excluded. Strict: both bounds and the type
    agree, each true span taken once. Partial: spans of the same type that overlap are matched one to
    one as well, and count with the share of the stretch both span that they share. Repeated spans
    count each time. ``boundary_accuracy`` is the share of true spans whose bounds are predicted under
    any type. Scores without a span to divide by are 0.
    """
    true, guess = counted_spans(true, doc_col), counted_spans(guess, doc_col)
    with Scratch(true.sparkSession) as scratch:
        sides = scratch.table(
            true.withColumnRenamed("n", "a").join(
                guess.withColumnRenamed("n", "b"), [*_KEY, *_TRUE], "full"
            ).select(
                *_KEY, *_TRUE,
                *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("a", "b")),
            ),
            "sides",
        )
        exact = F.least("a", "b")
        rest = [
            sides.select(*_KEY, *_TRUE, (F.col(c) - exact).alias("n")).filter("n > 0")
            for c in ("a", "b")
        ]
        zero = F.lit(0).cast("long")
        parts = sides.select(
            "type",
            F.col("a").alias("n_true"),
            F.col("b").alias("n_predicted"),
            exact.alias("strict_hits"),
            exact.cast("double").alias("partial_hits"),
        )
        for matches in matched_overlaps(overlapping(*rest), scratch):
            parts = parts.unionByName(
                matches.select(
                    "type",
                    *(zero.alias(c) for c in _COUNTS[:3]),
                    (F.col("credit") * F.col("n")).alias("partial_hits"),
                )
            )
        # Whatever the type: the multiset of bounds per document.
        bounds = sides.groupBy("doc", *_TRUE).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        inside = bounds.agg(F.sum(F.least("a", "b")).alias("hits"), F.sum("a").alias("n"))
        sums = parts.groupBy("type").agg(*(F.sum(c).alias(c) for c in _COUNTS))
        every = sums.agg(F.lit(None).cast("string").alias("type"), *(F.sum(c).alias(c) for c in _COUNTS))
        rows = sums.unionByName(every.select(*sums.columns)).filter("n_true IS NOT NULL").collect()
        hits, n = inside.first()
        spark, schema = true.sparkSession, sums.schema
    table = spark.createDataFrame(rows, schema).coalesce(1)

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top.cast("double"), bottom), F.lit(0.0))

    scores = []
    for kind in ("strict", "partial"):
        got = F.col(f"{kind}_hits")
        scores += [
            ratio(got, F.col("n_predicted")).alias(f"{kind}_precision"),
            ratio(got, F.col("n_true")).alias(f"{kind}_recall"),
            ratio(2 * got, F.col("n_true") + F.col("n_predicted")).alias(f"{kind}_f1"),
        ]
    accuracy = F.when(F.col("type").isNull(), F.lit(float(hits or 0) / n if n else 0.0))
    return table.select("type", *_COUNTS, *scores, accuracy.alias("boundary_accuracy"))
