"""Packing documents into training windows by the sum-of-squares rule.

Every task packs the documents of its own partition as they arrive: nothing is shuffled, and a task
that is run again on the same split gives the same windows. A task keeps one count per fill level,
N[1..size-1], and places a piece at the level where the sum of N[level]² grows least, or in a fresh
window if that is better still. Windows of documents that fit nowhere do not pile up: when more than
``max_open`` are open, and at the end, the emptiest are cut up to fill the fullest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incidentia.llm.common import id_type
from incidentia.llm.tokens import CACHE_ENTRIES, encoder

#: Ids of a window.
WINDOW = 2048
#: Id appended to each document.
END_ID = 1
VOCABULARY = "byte_bpe_50k.json"
#: Windows that one task holds open: 1024 windows of 2048 ids are 8 MB.
MAX_OPEN = 1024
# Window numbers of one task.
_NUMBERS = 1 << 36


class Piece:
    """Part of a document: its ids from ``start``."""

    __slots__ = ("doc_id", "doc_tokens", "start", "ids")

    def __init__(self, doc_id, doc_tokens: int, start: int, ids: np.ndarray):
        self.doc_id, self.doc_tokens, self.start, self.ids = doc_id, doc_tokens, start, ids

    def cut(self, length: int) -> tuple[Piece, Piece]:
        ids = self.ids
        return (
            Piece(self.doc_id, self.doc_tokens, self.start, ids[:length]),
            Piece(self.doc_id, self.doc_tokens, self.start + length, ids[length:]),
        )


class LevelArray:
    """Open windows by fill level, and the sum-of-squares choice among the levels."""

    def __init__(self, size: int):
        self.size = size
        self.counts = np.zeros(size + 1, dtype=np.int64)
        self.windows: dict[int, list[list[Piece]]] = {}
        self.open = 0

    def choose(self, length: int) -> int:
        """The level to place a piece of fewer than ``size`` ids at; 0 is a fresh window."""
        n, size = self.counts, self.size
        last = size - length
        best, at = 2 * n[length] + 1, 0
        if last > 1:
            held = n[1:last]
            growth = np.where(held > 0, 2 * (n[1 + length : size] - held) + 2, best + 1)
            low = int(growth.argmin())
            if growth[low] <= best:
                best, at = growth[low], low + 1
        if n[last] and 1 - 2 * n[last] <= best:
            at = last
        return at

    def place(self, piece: Piece) -> list[Piece] | None:
        """Places a piece and returns the window that it completes, if any."""
        length = len(piece.ids)
        level = self.choose(length) if length < self.size else 0
        return self.put(self.take(level) if level else [], level + length, piece)

    def take(self, level: int) -> list[Piece]:
        self.counts[level] -= 1
        self.open -= 1
        return self.windows[level].pop()

    def put(self, window: list[Piece], level: int, piece: Piece) -> list[Piece] | None:
        window.append(piece)
        if level == self.size:
            return window
        self.counts[level] += 1
        self.open += 1
        self.windows.setdefault(level, []).append(window)
        return None

    def settle(self, keep: int) -> Iterator[list[Piece]]:
        """Cuts up the emptiest windows to fill the fullest until ``keep`` are left open."""
        while self.open > max(keep, 1):
            levels = np.flatnonzero(self.counts)
            most, least = int(levels[-1]), int(levels[0])
            full, poor = self.take(most), self.take(least)
            room = self.size - most
            while room and poor:
                piece = poor.pop()
                if len(piece.ids) > room:
                    piece, rest = piece.cut(room)
                    poor.append(rest)
                full.append(piece)
                room -= len(piece.ids)
            for window, level in ((full, self.size - room), (poor, sum(len(p.ids) for p in poor))):
                if level == self.size:
                    yield window
                elif window:
                    self.put(window[:-1], level, window[-1])


def windows_of(documents, size: int, max_open: int) -> Iterator[list[Piece]]:
    """The windows of (doc_id, ids) pairs, in the order in which they close."""
    levels = LevelArray(size)
    for doc_id, ids in documents:
        for start in range(0, len(ids), size):
            full = levels.place(Piece(doc_id, len(ids), start, ids[start : start + size]))
            if full:
                yield full
        if levels.open > max_open:
            yield from levels.settle(max_open // 2)
    yield from levels.settle(1)
    for stack in levels.windows.values():
        yield from stack


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    size: int = WINDOW,
    end_id: int = END_ID,
    max_open: int = MAX_OPEN,
    cache_entries: int = CACHE_ENTRIES,
) -> DataFrame:
    """A row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``ids`` are little-endian unsigned 32-bit numbers. A null or empty text is the end id alone. A
    text longer than a window is cut at its multiples; other texts stay whole unless their window is
    cut up to fill others. Each partition leaves one partly filled window at most. Repeated rows and
    repeated or null ids are packed like any others, an empty table gives no rows, further columns
    are ignored. The windows depend on the order of rows in each partition, so ``docs`` should be a
    table that is read, not the outcome of a shuffle. ``cache_entries`` are the stretches of text that
    a worker remembers the ids of.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type(docs, id_col)),
            *(T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens")),
            *(T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype="<u4")
        kind = []

        def documents():
            tokens = encoder(vocabulary, cache_entries=cache_entries)
            for batch in batches:
                kind[:] = [batch.schema.field(0).type]
                keys, texts = batch.column(0).to_pylist(), batch.column(1)
                for at in range(0, len(keys), 250):
                    some = tokens.encode(texts.slice(at, 250).to_pylist())
                    for key, found in zip(keys[at : at + 250], some):
                        yield key, np.concatenate((np.frombuffer(found, "<u4"), end))

        number = TaskContext.get().partitionId() * _NUMBERS
        rows: list[tuple] = []

        def flush():
            columns = list(zip(*rows))
            types = [kind[0], *[pa.int64()] * 5, pa.binary()]
            names = schema.fieldNames()
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names
            )

        for window in windows_of(documents(), size, max_open):
            offset = 0
            for p in window:
                ids = p.ids.tobytes()
                rows.append((p.doc_id, p.start, len(p.ids), p.doc_tokens, number, offset, ids))
                offset += len(p.ids)
            number += 1
            if len(rows) >= 2000:
                yield flush()
        if rows:
            yield flush()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        pack, schema
    )
