"""Secrets in texts: fixed patterns, and values in a credential's place that are hard to guess.

A value that follows the name of a credential is priced by the fewest guesses that reach it: it is cut
into common words, dates, repeats, walks over a keyboard and single characters, and a dynamic program
finds the cut of least cost in bits. A value of many bits is taken for a secret; placeholders and plain
words cost little. Common words are counted in the documents themselves.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import comb, log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incidentia.llm.common import Work, id_type

# --- Fixed values: the base patterns, the names of credentials and the rows of a keyboard ----------

BASE = ("assign", "access", "hex")
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I
)
ASSIGN_CHARS = 6
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ACCESS_CHARS = 20
HEX = re.compile(rb"[0-9a-f]{24,}")

CONTEXT = re.compile(
    rb"""(?:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?
    |(?:api|access|private|client|auth|signing|encryption|account|shared)[_-]?(?:key|secret|token))
    ["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*["']?
    |\bbearer[\x20\t]+)
    ([^\x00-\x20"'`,;<>()\[\]{}\x7f]+)
    |://[^\x00-\x20:/@]+:([^\x00-\x20/@]+)@""",
    re.I | re.X,
)
#: One of these is in every text that ``ASSIGN`` or ``CONTEXT`` matches, in lower case.
STEMS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"bearer", b"://")

KEY_ROWS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
SHIFTED = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./"))
LOOKALIKES = dict(zip("043157@$!", "oaeistasi"))

# -----------------------------------------------------------------------------------------------------

VALUE = "value"
#: Bits of a value that is taken for a secret: about 10^12 guesses.
SECRET_BITS = 40.0
VALUE_CHARS = 6
#: Common words that a guesser tries, and their lengths.
WORDS = 50_000
WORD_CHARS = (3, 24)
#: Characters of a repeated unit and steps of one walk, at most; longer ones are several segments.
UNIT_CHARS, WALK_STEPS = 8, 32
#: Bits for the kind of a segment.
SEGMENT_BITS = log2(5)
#: Years a guesser tries.
YEARS = range(1900, 2051)
#: Words that a task counts before it hands them on.
HELD_WORDS = 200_000


# --- Guess costs ------------------------------------------------------------------------------------


def char_bits(c: str) -> float:
    """Bits of one character among those of its sort."""
    if c.isascii():
        return log2(10) if c.isdigit() else log2(26) if c.isalpha() else log2(33)
    return log2(256)


def _case_bits(text: str) -> float:
    """Bits for the letters in upper case: none, one for the usual ways, else the ways to choose."""
    upper = sum(c.isupper() for c in text)
    lower = sum(c.islower() for c in text)
    if not upper:
        return 0.0
    if not lower or (upper == 1 and (text[0].isupper() or text[-1].isupper())):
        return 1.0
    return log2(sum(comb(upper + lower, k) for k in range(1, min(upper, lower) + 1)) + 1)


@lru_cache(maxsize=1)
def _keys() -> dict[str, tuple[float, float]]:
    """The place of each key; keys of the next row lie half a key to the right."""
    return {c: (x + y / 2, y) for y, row in enumerate(KEY_ROWS) for x, c in enumerate(row) if c != " "}


def step_of(a: str, b: str) -> tuple | None:
    """The direction from one key to a neighbour, or from a character to the next of its alphabet."""
    one, two = (SHIFTED.get(c, c.lower()) for c in (a, b))
    keys = _keys()
    if one in keys and two in keys and one != two:
        across, down = keys[two][0] - keys[one][0], keys[two][1] - keys[one][1]
        if abs(down) <= 1 and abs(across) <= 1:
            return across, down
    if one.isascii() and two.isascii() and one.isalpha() and two.isalpha():
        if abs(ord(one) - ord(two)) == 1:
            return ord(two) - ord(one), "letters"
    return None


_DATE = re.compile(
    r"(\d{4})([-/._]?)(\d{1,2})\2(\d{1,2})|(\d{1,2})([-/._]?)(\d{1,2})\6(\d{4}|\d{2})"
)


def _date_bits(text: str) -> float | None:
    """Bits of a date in one of the usual forms, or of a year."""
    if len(text) == 4 and text.isdecimal() and int(text) in YEARS:
        return log2(len(YEARS))
    found = _DATE.fullmatch(text)
    if not found:
        return None
    y1, mark1, a1, b1, a2, mark2, b2, y2 = found.groups()
    y, a, b = int(y1 or y2), int(a1 or a2), int(b1 or b2)
    if not ((len(y1 or y2) == 2 or y in YEARS) and 1 <= min(a, b) <= 12 and 1 <= max(a, b) <= 31):
        return None
    return log2(366 * len(YEARS)) + (2.0 if mark1 or mark2 else 0.0)


def segments(value: str, words: dict[str, int]) -> Iterator[tuple[int, int, float]]:
    """(start, end, bits) of every word, date, repeat and walk in a value.

    A word costs its rank, its upper-case letters and a bit for each character that stands for a
    letter it resembles. A repeat copies the unit before it, in powers of two or as often as it goes.
    """
    size = len(value)
    plain = [c.lower() for c in value]
    alike = [LOOKALIKES.get(c, c) for c in plain]
    known, letters = "".join(plain), "".join(alike)
    whole = len(known) == len(letters) == size
    for i in range(size):
        if whole:
            for j in range(i + WORD_CHARS[0], min(size, i + WORD_CHARS[1]) + 1):
                rank = words.get(known[i:j])
                swapped = 0
                if rank is None:
                    rank = words.get(letters[i:j])
                    swapped = sum(map(str.__ne__, known[i:j], letters[i:j]))
                if rank is not None:
                    yield i, j, SEGMENT_BITS + log2(rank + 1) + _case_bits(value[i:j]) + swapped
        if value[i].isdigit():
            for j in range(i + 4, min(size, i + 10) + 1):
                bits = _date_bits(value[i:j])
                if bits is not None:
                    yield i, j, SEGMENT_BITS + bits
        bits, last = SEGMENT_BITS + log2(len(_keys())), None
        for j in range(i + 1, min(size, i + WALK_STEPS + 1)):
            step = step_of(value[j - 1], value[j])
            if step is None:
                break
            bits += 1.0 if step == last else 3.0
            last = step
            if j - i >= 2:
                yield i, j + 1, bits + _case_bits(value[i : j + 1])
    for unit in range(1, min(UNIT_CHARS, size // 2) + 1):
        run = 0
        for i in range(size - 1, unit - 1, -1):
            # Characters from here on that equal those one unit earlier.
            run = run + 1 if value[i] == value[i - unit] else 0
            most = run // unit
            copies = 1
            while copies < most:
                yield i, i + copies * unit, SEGMENT_BITS + log2(UNIT_CHARS) + log2(copies + 1)
                copies *= 2
            if most:
                yield i, i + most * unit, SEGMENT_BITS + log2(UNIT_CHARS) + log2(most + 1)


def guess_bits(value: str, words: dict[str, int]) -> float:
    """Bits of the cheapest cut of a value; what no segment covers is guessed by the character."""
    ends: dict[int, list[tuple[int, float]]] = {}
    for start, end, bits in segments(value, words):
        ends.setdefault(end, []).append((start, bits))
    # The least cost of each prefix, and of those whose last character is guessed on its own.
    best, single = [0.0], [float("inf")]
    for j in range(1, len(value) + 1):
        single.append(char_bits(value[j - 1]) + min(single[-1], best[-1] + SEGMENT_BITS))
        best.append(min([single[-1], *(best[i] + bits for i, bits in ends.get(j, ()))]))
    return best[-1]


# --- Texts --------------------------------------------------------------------------------------------


def base_spans(text: bytes, lower: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns in UTF-8 bytes; ``lower`` is the text in lower case."""
    spans = []
    if any(stem in lower for stem in STEMS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_CHARS:
                spans.append((*m.span(), "assign"))
    if b"AKIA" in text:
        spans += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    spans += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return spans


def context_values(text: bytes, lower: bytes) -> list[tuple[int, int]]:
    """Places of the values that follow the name of a credential, without a full stop at the end."""
    if not any(stem in lower for stem in STEMS):
        return []
    places = []
    for m in CONTEXT.finditer(text):
        start = m.start(m.lastindex)
        value = m[m.lastindex].rstrip(b".!?:")
        if len(value) >= VALUE_CHARS:
            places.append((start, start + len(value)))
    return places


def secrets_of(text: bytes | None, words: dict[str, int], least: float = SECRET_BITS) -> list[tuple]:
    """(kind, start, end, bits) by start, then base kinds before values; bits of values only.

    Places count code points, the end excluded.
    """
    if not text:
        return []
    lower = text.lower()
    spans = [(*s, None) for s in base_spans(text, lower)]
    for start, end in context_values(text, lower):
        bits = guess_bits(text[start:end].decode("utf-8", "replace"), words)
        if bits >= least:
            spans.append((start, end, VALUE, bits))
    if not spans:
        return []
    order = (*BASE, VALUE)
    spans.sort(key=lambda s: (s[0], order.index(s[2])))
    if not text.isascii():
        place, at, points = {}, 0, 0
        for edge in sorted({e for s in spans for e in s[:2]}):
            points += len(text[at:edge].decode("utf-8", "replace"))
            at, place[edge] = edge, points
        spans = [(place[a], place[b], kind, bits) for a, b, kind, bits in spans]
    return [(kind, a, b, bits) for a, b, kind, bits in spans]


_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_in(text: bytes | None) -> set[bytes]:
    """The words of a text outside of its secrets' places."""
    if not text:
        return set()
    lower = text.lower()
    places = [(a, b) for a, b, _ in base_spans(text, lower)] + context_values(text, lower)
    if places:
        kept = bytearray(text)
        for a, b in places:
            kept[a:b] = b" " * (b - a)
        text = bytes(kept)
    low, high = WORD_CHARS
    return {w for w in text.translate(_TO_WORDS).split() if low <= len(w) <= high}


def common_words(docs: DataFrame, work: Work, text_col: str = "text", most: int = WORDS) -> DataFrame:
    """(word, rank) of the ``most`` words that the most documents hold, from rank 1.

    Words that equally many documents hold go by a hash of the word.

    Words are runs of letters, with A to Z lower-cased, of 3 to 24 bytes. Words of a value in a
    credential's place are not counted there. Null texts and an empty table have none.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def hand_on() -> pa.RecordBatch:
            columns = [pa.array(list(held), pa.binary()).cast(pa.string())]
            columns.append(pa.array(list(held.values()), pa.int64()))
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                for text in batch.column(0).slice(at, 250).to_pylist():
                    held.update(words_in(text))
                if len(held) > HELD_WORDS:
                    yield hand_on()
        yield hand_on()

    texts = docs.select(F.col(text_col).cast("binary").alias("text"))
    counted = texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = work.table(counted.withColumn("place", F.xxhash64("word")), "words")
    top = _most_frequent(counted, most).orderBy(F.desc("n"), "place", "word").limit(most).collect()
    work.drop(counted)
    rows = [(row["word"], rank) for rank, row in enumerate(top, 1)]
    return docs.sparkSession.createDataFrame(rows, "word string, rank int")


def _most_frequent(counted: DataFrame, most: int) -> DataFrame:
    """Little more than the ``most`` first of (word, n, place), so that their sort stays small.

    The count at the last rank is read off the number of words per count. Of the words that share
    it, those with the lowest hashes are taken: as many as are due, and six deviations more.
    """
    held = 0
    for row in counted.groupBy("n").count().orderBy(F.desc("n")).limit(most).collect():
        if held + row["count"] >= most:
            due = most - held
            share = min(1.0, (due + 6 * due**0.5 + 10) / row["count"])
            low = F.col("place") < int(share * 2**64) - 2**63 if share < 1 else F.lit(True)
            return counted.filter((F.col("n") > row["n"]) | ((F.col("n") == row["n"]) & low))
        held += row["count"]
    return counted


def find_secrets(
    docs: DataFrame,
    words: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_bits: float = SECRET_BITS,
) -> DataFrame:
    """A row per document: doc_id, spans, an array of (kind, start, end, bits).

    Kinds ``assign``, ``access`` and ``hex`` are the fixed patterns; ``value`` is a value after the
    name of a credential, after ``Bearer``, or for a user inside a URL, of six characters or more,
    that takes at least ``least_bits`` bits to guess with ``words``. Spans go by start, then by kind
    in this order; places count code points. A value may lie inside another span. Null and empty texts
    have no spans; repeated rows and ids stay rows of their own; an empty table gives no rows. Further
    columns are ignored.
    """
    ranks = {r["word"]: r["rank"] for r in words.limit(WORDS).collect()}
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    span = T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("bits", T.DoubleType()),
        ]
    )
    schema = T.StructType(
        [T.StructField("doc_id", id_type(docs, id_col)), T.StructField("spans", T.ArrayType(span))]
    )
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("bits", pa.float64())])
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                found = [
                    [dict(zip(span.fieldNames(), s)) for s in secrets_of(t, held.value, least_bits)]
                    for t in part.column(1).to_pylist()
                ]
                columns = [part.column(0), pa.array(found, kind)]
                yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(scan, schema)
