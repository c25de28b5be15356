"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items.

Words are runs of letters and digits after lower-casing A-Z, with every byte beyond ASCII part of a
word. A text becomes its words between single blanks and is scanned once; a match begins and ends at
a blank, so it covers whole words. Word numbers lead back to places in the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incidentia.llm.common import id_type, in_slot, slices

#: Words of a window.
WINDOW = 10
#: Benchmark bytes behind one automaton (some 50 to 100 bytes of memory each in every worker).
AUTOMATON_BYTES = 4 << 20

_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


class Automaton:
    """The windows of some items, and the words of a text that their occurrences cover."""

    def __init__(self, items: list[tuple], window: int):
        import ahocorasick

        owners: dict[bytes, set[int]] = {}
        for number, (_, text) in enumerate(items):
            words = words_of(text)
            for at in range(max(1, len(words) - window + 1) if words else 0):
                owners.setdefault(b" ".join(words[at : at + window]), set()).add(number)
        self._owners = [sorted(x) for x in owners.values()]
        self._lengths = [w.count(b" ") + 1 for w in owners]
        self._find = ahocorasick.Automaton()
        for number, key in enumerate(owners):
            self._find.add_word(f" {key.decode('latin-1')} ", number)
        if owners:
            self._find.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Runs of covered words as (first, behind the last), and the items that occur."""
        if not self._owners or not words:
            return [], set()
        line = f" {b' '.join(words).decode('latin-1')} "
        found = list(self._find.iter(line))
        if not found:
            return [], set()
        blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        behind = np.searchsorted(blanks, [end for end, _ in found])
        steps = np.zeros(len(words) + 1, dtype=np.int64)
        for last, (_, number) in zip(behind, found):
            steps[last - self._lengths[number]] += 1
            steps[last] -= 1
        covered = np.concatenate(([0], (np.cumsum(steps[:-1]) > 0).astype(np.int8), [0]))
        turns = np.flatnonzero(np.diff(covered)).reshape(-1, 2)
        items = {i for number in {n for _, n in found} for i in self._owners[number]}
        return [(int(a), int(b)) for a, b in turns], items


def _automaton(held, window: int) -> Automaton:
    """The worker process's automaton; ``held`` is the items' broadcast."""
    return in_slot(("automaton", held, window), lambda: Automaton(held.value, window))


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """A row per document: doc_id, n_words, runs, items.

    ``runs`` are the covered stretches in order: first_word, n_words, and begin and end as character
    offsets of the original text. ``items`` are the ids of items with an occurring window, sorted.
    Null and empty texts have no words; an item without words has no window, and one of fewer words
    than ``window`` is one window. Null, repeated and tied ids stay rows of their own, further
    columns are ignored. Items beyond ``automaton_bytes`` are dealt out over several automata, which
    scan one after another; an empty benchmark covers nothing.
    """
    held = _held_items(benchmark, item_col, item_text_col, automaton_bytes)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if len(held) == 1:
        return source.mapInArrow(
            _scanner(held[0], window, False), _schema(docs, id_col, benchmark, item_col)
        ).drop("row")
    source = source.withColumn("row", F.monotonically_increasing_id())
    scans = [
        source.mapInArrow(_scanner(x, window, True), _schema(docs, id_col, benchmark, item_col))
        for x in held
    ]
    together = scans[0]
    for other in scans[1:]:
        together = together.unionByName(other)
    merged = together.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return merged.select("doc_id", "n_words", _merged_runs().alias("runs"), "items")


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, all columns as they are."""
    place = docs.columns.index(text_col)

    def clean(held):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(held, window)
            for batch in slices(batches):
                texts = batch.column(place).to_pylist()
                good = [not automaton.scan(words_of(t))[0] for t in texts]
                yield batch.filter(pa.array(good, pa.bool_()))

        return keep

    for held in _held_items(benchmark, item_col, item_text_col, automaton_bytes):
        docs = docs.mapInArrow(clean(held), docs.schema)
    return docs


def _held_items(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> list:
    """The items as broadcasts of about ``most`` bytes of text each, dealt out by a hash."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("words"))
    items = items.filter("words IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = int(-(-total // most)) or 1
    block = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))
    context = benchmark.sparkSession.sparkContext
    return [
        context.broadcast([tuple(r) for r in items.filter(block == b).collect()])
        for b in range(blocks)
    ]


def _schema(docs, id_col, benchmark, item_col) -> T.StructType:
    run = T.StructType(
        [T.StructField(c, T.LongType()) for c in ("first_word", "n_words", "begin", "end")]
    )
    return T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("doc_id", id_type(docs, id_col)),
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(run)),
            T.StructField("items", T.ArrayType(id_type(benchmark, item_col))),
        ]
    )


def _scanner(held, window: int, with_row: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(held, window)
        keys = [item for item, _ in held.value]
        run = pa.struct([(c, pa.int64()) for c in ("first_word", "n_words", "begin", "end")])
        for batch in batches:
            counts, runs, items = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                spans, found = automaton.scan(words)
                counts.append(len(words))
                runs.append(_placed(text, spans) if spans else [])
                items.append(sorted({keys[i] for i in found}, key=lambda x: (x is None, x)))
            rows = batch.column(2) if with_row else pa.nulls(batch.num_rows, pa.int64())
            columns = [rows, batch.column(0), pa.array(counts, pa.int64())]
            columns += [pa.array(runs, pa.list_(run)), pa.array(items)]
            if pa.types.is_null(columns[-1].type.value_type):
                columns[-1] = columns[-1].cast(pa.list_(pa.int64()))
            names = ["row", "doc_id", "n_words", "runs", "items"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return scan


def _placed(text: str, spans: list[tuple[int, int]]) -> list[dict]:
    """Runs of words with their character offsets in the text."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(raw.translate(_ONLY_LOWER))]
    # A byte starts a character unless it continues one.
    characters = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return [
        {
            "first_word": a,
            "n_words": b - a,
            "begin": int(characters[places[a][0]]) - 1,
            "end": int(characters[places[b - 1][1] - 1]),
        }
        for a, b in spans
    ]


_ONLY_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _merged_runs():
    """Sorted runs of several scans with those that overlap made one."""
    empty = F.slice("runs", 1, 0)

    def add(done, run):
        last = F.try_element_at(done, F.lit(-1))
        behind = last["first_word"] + last["n_words"]
        joined = F.struct(
            last["first_word"].alias("first_word"),
            (
                F.greatest(behind, run["first_word"] + run["n_words"]) - last["first_word"]
            ).alias("n_words"),
            last["begin"].alias("begin"),
            F.greatest(last["end"], run["end"]).alias("end"),
        )
        meets = last.isNotNull() & (run["first_word"] <= behind)
        return F.when(
            meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))
        ).otherwise(F.concat(done, F.array(run)))

    return F.when(F.size("runs") < 2, F.col("runs")).otherwise(
        F.aggregate("runs", empty, add)
    )
