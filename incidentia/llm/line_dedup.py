"""Line deduplication by a segment-partition edit join.

A line is split into one segment more than the edit threshold, so a line within the threshold holds
at least one segment unchanged, moved by no more characters than were inserted or deleted before it.
Lines are indexed by their segments; a line probes the indexes of its own length and of the lengths
below it, with just those substrings that can be the unchanged segment. Lines that meet are verified
with a banded edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentia.llm.common import Work, first_by, fresh, small
from incidentia.llm.linking import link_buckets

#: Edits up to which lines are alike.
EDITS = 2
#: Shortest line, in characters, and the length from which all edits are allowed. Shorter lines are
#: allowed fewer in proportion: one edit from 10 characters, none below.
MIN_CHARS = 1
FUZZY_CHARS = 20

#: Letters whose counts are compared before a distance is taken.
LETTERS = "etaoinshrdlu"

_BLANKS = " \t\r\x0b\x0c"


def lines_of(source: DataFrame, min_chars: int) -> DataFrame:
    """(row, doc_id, line_no, line, node) of lines that count, trimmed; ``node`` is a 64-bit hash."""
    line = F.btrim("col", F.lit(_BLANKS))
    return (
        source.select("row", "doc_id", F.posexplode(F.split("text", "\n")))
        .select("row", "doc_id", F.col("pos").alias("line_no"), line.alias("line"))
        .filter(F.length("line") >= min_chars)
        .withColumn("node", F.xxhash64("line"))
    )


def coded(line: Column) -> Column:
    """Four bytes a character, so that a substring is found without reading what is before it."""
    return F.encode(line, "UTF-32")


def probes(code: Column, length: Column, edits: int) -> Column:
    """The buckets of a line's substrings; an odd number marks one of its own indexed segments.

    ``code`` is the coded line and ``length`` its characters.
    """
    parts = edits + 1
    found = []
    for shorter in range(edits + 1):
        indexed = length - shorter
        base, longer = (indexed / parts).cast("int"), indexed % parts
        for i in range(parts):
            # The last segments are one longer; segment i of the indexed line starts here, from 0.
            size = base + (longer >= parts - i).cast("int")
            start = base * i + F.greatest(F.lit(0), longer + (i - parts))
            lowest = max(-i, shorter - (edits - i))
            highest = min(i, shorter + (edits - i))
            for move in range(lowest, highest + 1):
                at = start + move
                piece = F.substring(code, at * 4 + 1, size * 4)
                own = int(shorter == 0 and move == 0)
                bucket = F.xxhash64(F.lit(edits), F.lit(i), indexed, piece).bitwiseAND(-2).bitwiseOR(own)
                found.append(F.when((at >= 0) & (at + size <= length), bucket))
    return F.array(*found)


def floor_of(edits: int, most: int, fuzzy_chars: int) -> int:
    """Length of the shorter line from which so many edits of at most ``most`` are allowed."""
    return -(-edits * fuzzy_chars // max(most, 1))


def all_probes(code: Column, length: Column, edits: int, fuzzy_chars: int) -> Column:
    """The buckets for each number of edits that a line can be within of another."""
    found = []
    for e in range(min(1, edits), edits + 1):
        here = length >= floor_of(e, edits, fuzzy_chars)
        if e < edits:
            # The longer line of a pair exceeds the shorter one by the edits at most.
            here = here & (length < floor_of(e + 1, edits, fuzzy_chars) + e)
        found.append(F.when(here, probes(code, length, e)).otherwise(F.array().cast("array<long>")))
    return F.concat(*found)


def _bag(line: str) -> Column:
    """How often a line has each of the letters."""
    return F.array(
        *(F.length(line) - F.length(F.translate(line, c, "")) for c in LETTERS)
    )


def alike_lines(
    docs: DataFrame,
    work: Work,
    id_col: str = "doc_id",
    text_col: str = "text",
    edits: int = EDITS,
    min_chars: int = MIN_CHARS,
    fuzzy_chars: int = FUZZY_CHARS,
) -> DataFrame:
    """A row per line that counts: row, doc_id, line_no, first_doc_id, first_line_no, n_alike, kept.

    Lines are cut at ``\\n``, trimmed, and count from ``min_chars`` characters. Equal lines are
    alike, and so are lines of ``fuzzy_chars`` characters or more within ``edits`` insertions,
    deletions and substitutions; if the shorter line is shorter than that, its share of ``edits`` is
    allowed, rounded down. Links make classes. The first line of a class by id, row and number
    is kept, null ids last. Null and empty texts have no such line; an empty table gives no rows. ``row`` is the
    place in ``docs``, which should be a table that is read, as it is read several times.
    """
    source = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
    )
    lines = lines_of(source, min_chars)
    fuzzy = lines.filter(F.length("line") >= floor_of(min(1, edits), edits, fuzzy_chars))
    code = coded(F.col("line"))
    keyed = fuzzy.select("node", code.alias("code"), F.length("line").alias("length"))
    keys = all_probes(F.col("code"), F.col("length"), edits, fuzzy_chars)
    # Read twice: it is smaller than the text, and costs more to make than to keep.
    keyed = work.table(keyed.select("node", keys.alias("keys")), "keys")
    probed = keyed.select("node", F.explode("keys").alias("x")).filter("x IS NOT NULL")
    probed = probed.select(
        "node", F.col("x").bitwiseAND(-2).alias("bucket"), (F.col("x") % 2 != 0).alias("own")
    )
    # Partial results shrink the copies of a line before the shuffle.
    live = probed.groupBy("bucket").agg(
        F.min("node").alias("lo"), F.max("node").alias("hi"), F.max("own").alias("own")
    )
    live, seen = work.counted(live.filter("own AND lo < hi").select("bucket"), "live")
    members = probed.select("node", "bucket").join(small(live, seen["rows"]), "bucket").distinct()
    members = work.table(members, "members")
    nodes, seen = work.counted(members.select("node").distinct(), "nodes")
    texts = fuzzy.select("node", "line").join(small(nodes, seen["rows"]), "node")
    texts = texts.groupBy("node").agg(F.min("line").alias("line"))
    texts = work.table(
        texts.select("node", F.struct("line", _bag("line").alias("bag")).alias("item")), "texts"
    )

    def alike(x: Column, y: Column) -> Column:
        # An edit changes the counts of two letters by one at most, which is soon told.
        apart = sum((F.abs(x["bag"][i] - y["bag"][i]) for i in range(len(LETTERS))), F.lit(0))
        least = F.least(F.length(x["line"]), F.length(y["line"]))
        allowed = F.least(F.lit(edits), F.floor(least * edits / fuzzy_chars))
        near = F.abs(F.length(x["line"]) - F.length(y["line"])) <= allowed
        distance = F.levenshtein(x["line"], y["line"], edits)
        return near & (apart <= 2 * allowed) & distance.between(0, allowed)

    _, classes = link_buckets(members, texts, alike, work)
    classes, seen = work.counted(classes, "classes")
    work.drop(texts, nodes, members, live, keyed)
    named = lines.select("row", "doc_id", "line_no", "node").join(
        small(classes, seen["rows"]), "node", "left"
    )
    named = work.table(
        named.select("row", "doc_id", "line_no", F.coalesce("label", "node").alias("label")), "lines"
    )
    first = first_by("doc_id", "row", "line_no").alias("first")
    many = named.groupBy("label").agg(first, F.count("*").alias("n")).filter("n > 1")
    return named.join(many, "label", "left").select(
        "row",
        "doc_id",
        "line_no",
        F.coalesce("first.doc_id", "doc_id").alias("first_doc_id"),
        F.coalesce("first.line_no", "line_no").alias("first_line_no"),
        F.coalesce("n", F.lit(1)).cast("long").alias("n_alike"),
        F.coalesce(
            (F.col("first.row") == F.col("row")) & (F.col("first.line_no") == F.col("line_no")),
            F.lit(True),
        ).alias("kept"),
    )


def drop_repeated_lines(
    docs: DataFrame, work: Work, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """``docs`` without the lines that are not the first of their class.

    Other lines stay as they are, in their order. A document that loses every line that is not
    blank goes; one that had none stays. All columns are returned.
    """
    gone = alike_lines(docs, work, id_col, text_col, **options).filter("NOT kept")
    gone, seen = work.counted(gone.select("row", "line_no"), "gone")
    row, lost = fresh(docs, "_row"), fresh(docs, "_lost")
    by_row = gone.groupBy(F.col("row").alias(row)).agg(F.collect_list("line_no").alias(lost))
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    rows = rows.join(small(by_row, seen["rows"]), row, "left")
    left = F.filter(F.split(text_col, "\n"), lambda line, i: ~F.array_contains(lost, i))
    cut = F.col(lost).isNotNull()
    text = F.when(cut, F.array_join(left, "\n")).otherwise(F.col(text_col))
    kept = ~cut | F.col(text_col).rlike(r"\S")
    rows = rows.withColumn(text_col, text).filter(F.coalesce(kept, F.lit(True)))
    return rows.select(*docs.columns)
