"""How far the sources of a language lie apart by their term counts, in exact whole numbers.

Terms are runs of letters and of bytes above 127, with A to Z lower-cased. A language keeps the
terms of at least three of its documents; each gets a share in parts of 10^9 in every source. Kept
terms are numbered inside chunks, so that a source's sorted (number, count) arrays have a bounded
length. A pair task co-groups two blocks of sources on one chunk and merges the arrays of each
unordered pair: a galloping intersection finds the terms both have, and these, the one-sided terms
and those that both lack are priced in both directions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidentia.llm.common import Work, small

#: Documents of a language that a kept term occurs in, at the least.
MIN_DOCS = 3
#: Ranks of the terms of a source that are reported.
TERM_RANKS = 200
#: Shares are in parts of this.
PARTS = 1_000_000_000
#: Terms of a chunk and sources of a block: what a pair task holds twice, about.
CHUNK_TERMS = 4096
BLOCK_SOURCES = 16
#: Entries a task counts before it hands them on.
HELD_TERMS = 200_000

_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(_LETTERS).split() if text else []


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of rows (lang, source, text): occurrences, and documents with it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, docs) in held.items():
                columns = [
                    pa.array([lang] * len(times), pa.string()),
                    pa.array([source] * len(times), pa.string()),
                    pa.array(list(times), pa.binary()).cast(pa.string()),
                    pa.array(list(times.values()), pa.int64()),
                    pa.array([docs[t] for t in times], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 250).columns)):
                    terms = terms_of(row[2])
                    times, docs = held.setdefault(row[:2], (Counter(), Counter()))
                    times.update(terms)
                    docs.update(set(terms))
                if sum(len(times) for times, _ in held.values()) > HELD_TERMS:
                    yield from hand_on()
        yield from hand_on()

    rows = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    counted = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )


def share(n: Column, size: Column) -> Column:
    """1 + floor(PARTS * (n + 1) / size) for n + 1 <= size < 9 * 10^15, by three digits at a time."""
    rest, total = n + 1, F.lit(1).cast("long")
    digits = [F.call_function("div", rest, size) * PARTS]
    for place in (1_000_000, 1_000, 1):
        rest = (rest % size) * 1000
        digits.append(F.call_function("div", rest, size) * place)
    return sum(digits, total)


def shares(n: np.ndarray, size: int) -> np.ndarray:
    """``share`` of an array."""
    rest = n + 1
    total = 1 + rest // size * PARTS
    for place in (1_000_000, 1_000, 1):
        rest = rest % size * 1000
        total += rest // size * place
    return total


def surplus(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q)."""
    return (p - q) * (p - q) // q


def gallop(few: np.ndarray, many: np.ndarray, stride: int = 1024) -> np.ndarray:
    """For each of the sorted ``few`` its place in the sorted ``many``, or -1.

    A window moves along ``many`` and doubles until it reaches past the next needles. So many needles
    go at a time that the calls cost less than the search.
    """
    places = np.full(len(few), -1, dtype=np.int64)
    start = 0
    for at in range(0, len(few), stride):
        needles = few[at : at + stride]
        width = stride
        while start + width < len(many) and many[start + width - 1] < needles[-1]:
            width *= 2
        window = many[start : start + width]
        found = np.searchsorted(window, needles)
        inside = found < len(window)
        hit = np.zeros(len(needles), dtype=bool)
        hit[inside] = window[found[inside]] == needles[inside]
        places[at : at + stride][hit] = start + found[hit]
        start += int(found[-1])
    return places


class Side:
    """A source's terms in a chunk: sorted ids, their shares, and that of a term it lacks.

    ``total`` is its occurrences and ``kept`` the number of kept terms, both in all chunks. Shares are
    found once, however many pairs the source is in.
    """

    def __init__(self, ids: np.ndarray, counts: np.ndarray, total: int, kept: int):
        self.ids = ids
        self.shares = shares(counts, total + kept)
        self.none = shares(np.zeros(1, dtype=np.int64), total + kept)


def price_pair(one: Side, two: Side, n_terms: int) -> tuple[int, int]:
    """The surplus of one over two and of two over one, summed over the ``n_terms`` of a chunk."""
    if len(one.ids) > len(two.ids):
        return price_pair(two, one, n_terms)[::-1]
    p, q, p0, q0 = one.shares, two.shares, one.none, two.none
    places = gallop(one.ids, two.ids)
    both = places >= 0
    alone = np.ones(len(q), dtype=bool)
    alone[places[both]] = False
    absent = n_terms - len(p) - int(alone.sum())
    sides = [(p[both], q[places[both]], 1), (p[~both], q0, 1), (p0, q[alone], 1), (p0, q0, absent)]
    there = sum(int(surplus(a, b).sum()) * times for a, b, times in sides)
    back = sum(int(surplus(b, a).sum()) * times for a, b, times in sides)
    return there, back


def _price_blocks(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Both directions of every unordered pair of a source on the left and one on the right."""

    def arrays(table: pa.Table, column: str) -> list[np.ndarray]:
        lists = table.column(column).combine_chunks()
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        return np.split(lists.flatten().to_numpy(), ends[:-1])

    def sides(table: pa.Table) -> list[tuple]:
        others = table.select(["source", "total", "n_terms", "kept"]).to_pylist()
        return [
            (r["source"], Side(ids, counts, r["total"], r["kept"]) if r["kept"] else None, r["n_terms"])
            for r, ids, counts in zip(others, arrays(table, "ids"), arrays(table, "counts"))
        ]

    lang, _, low, high = (k.as_py() for k in key)
    rows = []
    others = sides(right) if left.num_rows and right.num_rows else []
    for source, one, n_terms in sides(left) if others else []:
        for other, two, _ in others:
            if source < other or (low != high):
                there, back = price_pair(one, two, n_terms) if one else (0, 0)
                rows += [(lang, source, other, there), (lang, other, source, back)]
    columns = list(zip(*rows)) or [()] * 4
    types = [pa.string(), pa.string(), pa.string(), pa.int64()]
    return pa.table(
        [pa.array(c, t) for c, t in zip(columns, types)], ["lang", "source", "item", "value"]
    )


def source_divergence(
    docs: DataFrame,
    work: Work,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_docs: int = MIN_DOCS,
    term_ranks: int = TERM_RANKS,
    chunk_terms: int = CHUNK_TERMS,
    block_sources: int = BLOCK_SOURCES,
) -> DataFrame:
    """Rows lang, source, part, item, value, rank for each (lang, source) that occurs.

    With p the share of a term in the source and q the one it is compared with, a surplus is
    floor((p - q)^2 / q). Part ``pair``: the surplus over each other source of the language, summed
    over all kept terms. Part ``term``: the terms that the source has and uses more than its whole
    language does, with their surplus, up to rank ``term_ranks``. Ranks go by value descending, then
    by item. Null text, language and source count as empty strings; repeated rows count each. A
    language that keeps no term gives pairs of value 0; a source alone in its language gives no pair;
    an empty table gives no rows. Further columns are ignored.
    """

    def filled(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(""))

    docs = docs.select(
        filled(lang_col).alias("lang"), filled(source_col).alias("source"), filled(text_col).alias("text")
    )
    groups = docs.select("lang", "source").distinct()
    counts = work.table(term_counts(docs), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = work.table(kept.filter(F.col("docs") >= min_docs).drop("docs"), "kept")
    langs = groups.groupBy("lang").agg(F.count("*").alias("n_sources")).join(
        kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total")),
        "lang",
        "left",
    )
    langs, seen = work.counted(
        langs.select(
            "lang",
            F.coalesce("kept", F.lit(0)).alias("kept"),
            F.coalesce("lang_total", F.lit(0)).alias("lang_total"),
            F.greatest(F.ceil(F.coalesce("kept", F.lit(0)) / chunk_terms), F.lit(1)).alias("chunks"),
            F.ceil(F.col("n_sources") / block_sources).alias("blocks"),
        ),
        "langs",
    )
    langs = small(langs, seen["rows"])
    chunk = F.pmod(F.xxhash64("term"), F.col("chunks")).alias("chunk")
    inside = Window.partitionBy("lang", "chunk").orderBy("term")
    numbered = work.table(
        kept.join(langs, "lang")
        .select("lang", "term", "lang_n", chunk)
        .withColumn("id", F.row_number().over(inside)),
        "numbered",
    )
    entries = work.table(
        counts.drop("docs").join(numbered, ["lang", "term"]), "entries"
    )
    sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources, seen = work.counted(
        groups.join(sums, ["lang", "source"], "left")
        .withColumn("total", F.coalesce("total", F.lit(0)))
        .join(langs, "lang"),
        "sources",
    )
    pairs = _pairs(entries, numbered, small(sources, seen["rows"]))
    terms = _terms(entries, small(sources, seen["rows"]), term_ranks)
    return pairs.unionByName(terms)


def _pairs(entries: DataFrame, numbered: DataFrame, sources: DataFrame) -> DataFrame:
    pairs = F.sort_array(F.collect_list(F.struct("id", "n")))
    arrays = entries.groupBy("lang", "source", "chunk").agg(pairs.alias("pairs"))
    sizes = numbered.groupBy("lang", "chunk").agg(F.count("*").alias("n_terms"))
    cells = (
        sources.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .join(arrays, ["lang", "source", "chunk"], "left")
        .join(sizes, ["lang", "chunk"], "left")
    )
    block = F.pmod(F.xxhash64("source"), F.col("blocks"))
    nothing = F.array().cast("array<long>")

    def side(lows: Column, highs: Column) -> DataFrame:
        # Aliases keep the columns of the two sides apart.
        return cells.select(
            *(F.col(c).alias(c) for c in ("lang", "chunk", "source", "total", "kept")),
            lows.alias("low"),
            highs.alias("high"),
            F.coalesce(F.col("pairs.id").cast("array<long>"), nothing).alias("ids"),
            F.coalesce(F.col("pairs.n"), nothing).alias("counts"),
            F.coalesce("n_terms", F.lit(0)).alias("n_terms"),
        )

    zero = F.lit(0).cast("long")
    key = ["lang", "chunk", "low", "high"]
    left = side(block, F.explode(F.sequence(block, F.col("blocks") - 1))).groupBy(*key)
    right = side(F.explode(F.sequence(zero, block)), block).groupBy(*key)
    priced = left.cogroup(right).applyInArrow(
        _price_blocks, "lang string, source string, item string, value long"
    )
    value = priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return _ranked(value, "pair")


def _terms(entries: DataFrame, sources: DataFrame, ranks: int) -> DataFrame:
    p = share(F.col("n"), F.col("total") + F.col("kept"))
    q = share(F.col("lang_n"), F.col("lang_total") + F.col("kept"))
    more = F.col("p") - F.col("q")
    value = (
        entries.join(sources.drop("chunks", "blocks"), ["lang", "source"])
        .select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
        .filter("p > q")
        .select("lang", "source", "item", F.call_function("div", more * more, F.col("q")).alias("value"))
    )
    # The bound on the rank is applied in each task before the shuffle, too.
    return _ranked(value, "term").filter(F.col("rank") <= ranks)


def _ranked(value: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return value.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank")
    )
