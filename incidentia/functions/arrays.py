"""Small array helpers: per-row counting and vector maths without leaving the row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def term_counts(terms: Column) -> Column:
    """``array<struct<term, tf>>`` of one row's terms.

    Sorts the row's terms and measures the runs, so counting needs no shuffle on (row, term).
    """

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.transform(
                ordered,
                lambda term, i: F.when((i == 0) | (term != F.get(ordered, i - 1)), i),
            ),
            lambda i: i.isNotNull(),
        )
        return let(
            starts,
            lambda begin: F.transform(
                begin,
                lambda at, k: F.struct(
                    F.get(ordered, at).alias("term"),
                    (F.coalesce(F.get(begin, k + 1), F.size(ordered)) - at)
                    .cast("long")
                    .alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(terms), runs)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def softmax(scores: Column) -> Column:
    """Probabilities of a score array, shifted by its maximum before the exponential."""

    def probabilities(s: Column) -> Column:
        return let(
            F.transform(s, lambda x: F.exp(x - F.array_max(s))),
            lambda e: let(total(e), lambda z: F.transform(e, lambda x: x / z)),
        )

    return let(scores, probabilities)


def argmax(scores: Column) -> Column:
    """Zero-based position of the first maximum."""
    return let(scores, lambda s: F.array_position(s, F.array_max(s)) - 1)


def running_totals(values: Column, block: int = 64) -> Column:
    """Sum of an integer array up to each entry, the entry included.

    Blocks are summed first, so that an entry adds up its own block only; appending the sum of each
    entry to an array would copy that array each time.
    """

    def plus(acc: Column, x: Column) -> Column:
        return acc + x

    def extend(acc: Column, x: Column) -> Column:
        grown = F.array_append(acc["sums"], acc["sum"])
        return F.struct((acc["sum"] + x).alias("sum"), grown.alias("sums"))

    def totals(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / block).cast("int")
        blocks = F.transform(
            F.sequence(F.lit(0), last), lambda b: F.aggregate(F.slice(v, b * block + 1, block), F.lit(0), plus)
        )
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("sums"))

        def spread(before: Column) -> Column:
            def upto(x: Column, i: Column) -> Column:
                at = F.floor(i / block).cast("int")
                own = F.slice(v, at * block + 1, i - at * block + 1)
                return F.get(before, at) + F.aggregate(own, F.lit(0), plus)

            return F.transform(v, upto)

        return let(F.aggregate(blocks, start, extend, lambda acc: acc["sums"]), spread)

    return F.when(F.size(values) > 0, let(values, totals)).otherwise(F.array().cast("array<int>"))
