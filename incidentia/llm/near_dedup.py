"""Near-duplicate documents by ProbMinHash signatures of weighted shingles, banding and verification.

Each distinct shingle of a text starts a Poisson process whose rate is its weight; every arrival
falls into one register of the signature, and a register keeps the shingle that arrived first. Two
texts agree in a register with the probability Jaccard similarity of their weights. Arrivals later
than the latest register can change nothing, so a shingle stops there. Texts that agree in a band of
registers are compared by the exact Jaccard similarity of their shingle sets. A text that repeats
shingles has a second signature from the same arrivals with all weights at one, as the verdict has
them; for other texts both are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incidentia.llm.common import Work, first_by, fresh, id_type, in_slot, slices, small
from incidentia.llm.decontamination import words_of
from incidentia.llm.linking import link_buckets

#: Words of a shingle, and the similarity from which texts are linked.
SHINGLE = 5
SIMILARITY = 0.8
#: At similarity 0.8, all bands of weight one miss a pair with probability (1 - 0.8^4)^20 = 3e-5.
BANDS, ROWS = 20, 4
#: Bands that are linked before all others, a round each.
EARLY_BANDS = ([0], [1], [2, 3])

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _WordHashes(dict):
    """Hashes of words, remembered for the frequent ones that are met first."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < 500_000:
            self[word] = found
        return found


def _hashes() -> _WordHashes:
    return in_slot(("word hashes",), _WordHashes)


def shingles(words: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles as sorted 64-bit hashes, and how often each occurs.

    Fewer words than a shingle are one shingle; no words have none.
    """
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    known = _hashes()
    codes = np.array(list(map(known.__getitem__, words)), dtype=np.uint64)
    size = min(size, len(codes))
    count = len(codes) - size + 1
    total = np.full(count, size, dtype=np.uint64)
    for k in range(size):
        total = total * np.uint64(0x2545F4914F6CDD1D) + codes[k : k + count]
    return np.unique(_mix(total), return_counts=True)


def signature(items: np.ndarray, weights: np.ndarray, registers: int) -> np.ndarray:
    """The shingle that arrives first in each register."""
    if len(items) == 1:
        return np.repeat(items, registers)
    first = np.full(registers, np.inf)
    names = np.zeros(registers, dtype=np.uint64)
    last = np.zeros(len(items))
    active = np.arange(len(items))
    done = 0
    # About as many arrivals as fill all registers, a few per item and turn.
    turn = int(np.clip(1.5 * registers * np.log(registers) / len(items), 2, 64))
    while len(active):
        number = np.arange(done + 1, done + turn + 1, dtype=np.uint64) * _GOLDEN
        bits = _mix(items[active][:, None] + number)
        waits = -np.log(((bits >> np.uint64(11)) + np.uint64(1)) * 2.0**-53)
        times = last[active][:, None] + np.cumsum(waits, axis=1) / weights[active][:, None]
        last[active] = times[:, -1]
        late = times.ravel()
        register = ((_mix(bits ^ _GOLDEN) >> np.uint64(32)) % np.uint64(registers)).astype(np.int64)
        owner = np.repeat(active, turn)
        # Written latest first, so that the earliest arrival stands.
        order = np.argsort(late)[::-1]
        place = register.ravel()[order]
        found, who = np.full(registers, np.inf), np.zeros(registers, dtype=np.int64)
        found[place] = late[order]
        who[place] = owner[order]
        sooner = found < first
        first[sooner] = found[sooner]
        names[sooner] = items[who[sooner]]
        active = active[last[active] < first.max()]
        done += turn
    return names


def band_keys(names: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, different from band to band."""
    keys = np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN
    for column in names.reshape(bands, rows).T:
        keys = _mix(keys ^ column) + _GOLDEN
    return keys.view(np.int64)


def search_keys(items: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys of a text: those at weight one, then those by weights from its counts, if they differ.

    Two texts agree in a register at weight one with the probability that is verified, however
    often either repeats a shingle.
    """
    plain = band_keys(signature(items, np.ones(len(items)), bands * rows), bands, rows)
    if counts.max() == 1:
        return plain
    names = signature(items, 1 + np.log(counts), bands * rows)
    return np.concatenate((plain, band_keys(names, bands, rows)))


def near_duplicates(
    docs: DataFrame,
    work: Work,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """A row per document: row, doc_id, class_id, class_size, kept.

    Words are lower-case runs of letters and digits. Texts of the same words are copies; texts
    without a word are copies if they are equal. Copies, and texts whose shingle sets have at least
    ``similarity``, are linked, and links make classes. ``class_id`` is the least id in the class;
    ``kept`` marks its first document by id and row, null ids last. Each null text is a class of its own. A shingle
    weighs one plus the logarithm of its count in one half of the search; the other half and the
    verifying similarity count each shingle once. ``row`` is the place in ``docs``, which should be a table that is
    read: it is read again for the texts that are compared. An empty table gives no rows.
    """
    source = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
    )
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("doc_id", id_type(docs, id_col)),
            T.StructField("node", T.LongType()),
            T.StructField("keys", T.ArrayType(T.LongType(), False)),
        ]
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes, keys = [], []
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                content = b" ".join(words) if words else b"\0" + (text or "").encode()
                nodes.append(None if text is None else _signed(xxhash.xxh3_64_intdigest(content)))
                items, counts = shingles(words, size)
                if len(items):
                    keys.append(search_keys(items, counts, bands, rows))
                else:
                    keys.append(())
            columns = [*batch.columns[:2], pa.array(nodes, pa.int64())]
            columns.append(pa.array(keys, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    signed = work.table(source.mapInArrow(sign, schema), "signed")
    keyed = signed.select("node", F.posexplode("keys").alias("band", "bucket"))
    # Partial results shrink the copies of a text before the shuffle.
    live = keyed.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    live, seen = work.counted(live.filter("lo < hi").select("bucket"), "live")
    members = keyed.join(small(live, seen["rows"]), "bucket").groupBy("bucket", "node")
    members, seen = work.counted(members.agg(F.min("band").alias("band")), "members")
    sets = work.table(_shingle_sets(source, signed, members, seen["rows"], size), "sets")

    def alike(x: Column, y: Column) -> Column:
        least, most = F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))
        common = F.size(F.array_intersect(x, y))
        every = F.size(x) + F.size(y) - common
        return (least >= similarity * most) & (common >= similarity * every - 1e-9)

    # Copies of one text share most bands: a few bands by themselves find their class, and the others
    # then have few texts left to compare.
    early = [members.filter(F.col("band").isin(some)) for some in EARLY_BANDS]
    _, classes = link_buckets(members, sets, alike, work, early)
    classes, seen = work.counted(classes, "classes")
    work.drop(sets, members, live)
    return _classified(signed, small(classes, seen["rows"]))


def _signed(number: int) -> int:
    return number - (1 << 64) if number >= 1 << 63 else number


def _shingle_sets(source, signed, members: DataFrame, most: int, size: int) -> DataFrame:
    """(node, item) of the nodes to be compared, from one document of each."""
    nodes = members.select("node").distinct()
    chosen = signed.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row"))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingles(words_of(t), size)[0].view(np.int64) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "item"])

    return (
        source.select("row", "text")
        .join(small(chosen, most), "row")
        .select("node", "text")
        .mapInArrow(collect, "node long, item array<long>")
    )


def _classified(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Documents with the first of their class."""
    rows = signed.select("row", "doc_id", "node").join(classes, "node", "left")
    rows = rows.select("row", "doc_id", F.coalesce("label", "node").alias("label"))
    first = first_by("doc_id", "row").alias("first")
    many = rows.filter("label IS NOT NULL").groupBy("label").agg(first, F.count("*").alias("n"))
    many = many.filter("n > 1")
    return rows.join(many, "label", "left").select(
        "row",
        "doc_id",
        F.coalesce("first.doc_id", "doc_id").alias("class_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(
    docs: DataFrame, work: Work, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """``docs`` with the first document of each class only, all columns as they are."""
    found = near_duplicates(docs, work, id_col, text_col, **options)
    row = fresh(docs, "_row")
    gone, seen = work.counted(found.filter("NOT kept").select(F.col("row").alias(row)), "gone")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    return rows.join(small(gone, seen["rows"]), row, "left_anti").select(*docs.columns)
