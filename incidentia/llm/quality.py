"""Quality rules: decision lists learned by sequential covering, applied as Spark conditionals.

Statistics are built-in expressions of the text. The learner grows one conjunction of thresholds
after another on counts that Spark gathers per feature and bin, prunes it on rows held back for
that, takes what it covers away and goes on. The list becomes one ``CASE WHEN`` in its order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentia.llm.common import Work

_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÈÉÊËÎÏÔÙÛÁÍÓÚÑ"

#: What rules may test, as expressions of the statistics: all are shares, so length alone decides
#: nothing.
FEATURES = {
    "mean_word": "word_chars / n_words",
    "symbol_share": "n_symbols / n_words",
    "capital_share": "n_capitals / word_chars",
    "mark_share": "n_marks / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
}


def _without(text: Column, characters: str) -> Column:
    """Characters of the text that are not among ``characters``, counted."""
    return F.length(F.translate(text, characters, ""))


def text_statistics(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines (with a word), n_capitals, n_marks (exclamation marks); all counts are long.

    Words lie between blanks, tabs and line ends. Null and empty texts have no words and zeros
    everywhere. Repeated rows and ids stay rows of their own, further columns are ignored. Windows
    of three words are told apart by a 64-bit hash inside one text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    spaced = F.translate("text", _BLANKS, " " * len(_BLANKS))
    lines = F.filter(
        F.split("text", "\n"), lambda line: F.length(F.translate(line, _BLANKS, "")) > 0
    )
    words = base.select(
        "doc_id",
        _without(F.col("text"), _BLANKS).alias("word_chars"),
        (F.length("text") - _without(F.col("text"), _SYMBOLS)).alias("n_symbols"),
        (F.length("text") - _without(F.col("text"), _CAPITALS)).alias("n_capitals"),
        (F.length("text") - _without(F.col("text"), "!")).alias("n_marks"),
        lines.alias("lines"),
        F.array_remove(F.split(spaced, " "), "").alias("words"),
    )
    hashed = words.select(
        "*",
        F.size("words").alias("n_words"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("codes"),
    ).drop("words", "lines")
    # A window's hash is made from those of its words.
    second = F.slice("codes", 2, F.greatest(F.size("codes"), F.lit(1)))
    third = F.slice("codes", 3, F.greatest(F.size("codes"), F.lit(1)))
    pairs = F.zip_with("codes", second, lambda a, b: F.xxhash64(a, b))
    windows = F.zip_with(pairs, third, lambda a, b: F.xxhash64(a, b))
    count = F.greatest(F.col("n_words") - 2, F.lit(0))
    windowed = hashed.select("*", F.slice(windows, 1, count).alias("windows")).drop("codes")
    # Only texts with a repeated window need the places of theirs, sorted beside their equals.
    sorted_windows = F.sort_array(
        F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = windowed.withColumn("placed", F.when(repeats, sorted_windows)).drop("windows")
    size = F.greatest(F.size("placed"), F.lit(1))
    before = F.concat(
        F.array(F.lit(None).cast("struct<w:bigint,i:int>")), F.slice("placed", 1, size - 1)
    )
    beside = F.zip_with(
        "placed",
        before,
        lambda x, y: F.struct(x["w"].alias("w"), x["i"].alias("i"), (x["w"] == y["w"]).alias("s")),
    )
    places = F.zip_with(
        beside,
        F.slice("placed", 2, size),
        lambda x, y: F.when(F.coalesce(x["s"], F.lit(False)) | (x["w"] == y["w"]), x["i"]),
    )
    found = placed.withColumn("places", F.sort_array(F.array_compact(places))).drop("placed")
    # A window covers three words, or as many as lie before the next window's first.
    steps = F.zip_with(
        "places",
        F.slice("places", 2, F.greatest(F.size("places"), F.lit(1))),
        lambda here, there: F.least(F.lit(3), F.coalesce(there - here, F.lit(3))),
    )
    covered = F.aggregate(steps, F.lit(0), lambda total, step: total + step)
    return found.select(
        "doc_id",
        *(
            F.col(c).cast("long")
            for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")
        ),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        *(F.col(c).cast("long") for c in ("n_lines", "n_capitals", "n_marks")),
    )


def with_features(stats: DataFrame, features: dict[str, str] = FEATURES) -> DataFrame:
    """Adds the features; a share of nothing is 0."""
    return stats.withColumns(
        {name: F.expr(f"coalesce(try_divide({rule.replace(' / ', ', ')}), 0D)")
         for name, rule in features.items()}
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction, and how many bad and good rows of the pruning part it covers."""

    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def column(self) -> Column:
        return reduce(Column.__and__, (c.column() for c in self.conditions))

    def __str__(self) -> str:
        return f"{' AND '.join(map(str, self.conditions))} ({self.bad} bad, {self.good} good)"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first that holds rejects a row, and a row that none holds for is kept."""

    rules: tuple[Rule, ...]

    def verdict(self) -> Column:
        """True to keep, as one conditional over the feature columns."""
        kept = F.lit(True)
        for rule in reversed(self.rules):
            kept = F.when(rule.column(), F.lit(False)).otherwise(kept)
        return kept

    def number(self) -> Column:
        """The place of the rule that rejects a row, from 1; null for those kept."""
        place = F.lit(None).cast("int")
        for number, rule in reversed(list(enumerate(self.rules, 1))):
            place = F.when(rule.column(), F.lit(number)).otherwise(place)
        return place


def learn_decision_list(
    labelled: DataFrame,
    features: list[str],
    bad: Column,
    work: Work,
    key: str = "doc_id",
    bins: int = 24,
    max_rules: int = 8,
    max_conditions: int = 3,
    min_bad: int = 5,
    min_precision: float = 0.95,
) -> DecisionList:
    """Learns rules that cover bad rows from feature columns and a boolean.

    Rows with a null verdict are left out. Thresholds lie halfway between quantiles of the bad
    and of the good rows. Rules grow on two thirds of the rows, by information gain, and are pruned on the rest, by
    a hash of ``key``; a rule must cover ``min_bad`` bad rows there with at least
    ``min_precision`` of what it covers bad. Each step gathers counts per feature and bin, whatever
    the number of rows. Covering ends after ``max_rules`` rules of at most ``max_conditions`` each. No
    rows, or none that is bad, give an empty list. A feature may not be called ``bad``, ``good``
    or ``grow``.
    """
    if {"bad", "grow", "good"} & {f.lower() for f in features}:
        raise ValueError("a feature may not be called bad, good or grow")
    known = labelled.select(
        *features,
        bad.alias("bad"),
        (F.pmod(F.xxhash64(F.lit("grow"), F.col(key)), F.lit(3)) > 0).alias("grow"),
    ).filter("bad IS NOT NULL")
    cuts = _thresholds(known, features, bins)
    if not any(cuts.values()):
        return DecisionList(())
    binned = known.select(
        "bad",
        "grow",
        *(_bin(f, cuts[f]).alias(f) for f in features),
    )
    # Rows alike in every bin count as one.
    rows = work.table(
        binned.groupBy("grow", *features).agg(
            F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")
        ),
        "binned",
    )
    rules: list[Rule] = []
    left, barred = F.lit(True), set()
    while len(rules) < max_rules:
        tests = _grow(rows.filter(F.col("grow") & left), features, max_conditions, barred)
        if not tests:
            break
        opening = tests[0][:2]
        tests, n_bad, n_good = _prune(rows.filter(~F.col("grow") & left), tests)
        if n_bad < min_bad or n_bad < min_precision * (n_bad + n_good):
            # The next rule opens with another feature.
            barred.add(opening)
            continue
        conditions = tuple(Condition(f, up, cuts[f][b]) for f, up, b in tests)
        rules.append(Rule(conditions, n_bad, n_good))
        left = left & ~_all(tests)
    return DecisionList(tuple(rules))


def _thresholds(known: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    shares = [F.lit(i / bins) for i in range(1, bins)]
    found = known.groupBy("bad").agg(
        *(F.percentile_approx(f, F.array(*shares), 2000).alias(f) for f in features)
    )
    cuts: dict[str, set[float]] = {f: set() for f in features}
    for row in found.collect():
        for f in features:
            cuts[f].update(row[f] or ())
    # Halfway between neighbours, so that values like those seen fall clearly on one side.
    return {f: _between(sorted(values)) for f, values in cuts.items()}


def _between(values: list[float]) -> list[float]:
    return [(a + b) / 2 for a, b in zip(values, values[1:])]


def _bin(feature: str, cuts: list[float]) -> Column:
    """How many thresholds lie below the value."""
    return sum((F.when(F.col(feature) > t, 1).otherwise(0) for t in cuts), F.lit(0))


def _test(test: tuple[str, bool, int]) -> Column:
    feature, above, number = test
    return F.col(feature) > number if above else F.col(feature) <= number


def _all(tests: list[tuple[str, bool, int]]) -> Column:
    return reduce(Column.__and__, map(_test, tests), F.lit(True))


def _grow(
    rows: DataFrame, features: list[str], most: int, barred: set[tuple[str, bool]]
) -> list[tuple[str, bool, int]]:
    """Adds the test with the largest gain until no good row is covered.

    The first test is of no feature and direction that is ``barred``.
    """
    tests: list[tuple[str, bool, int]] = []
    while len(tests) < most:
        pairs = F.explode(
            F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in features))
        )
        counted = (
            rows.filter(_all(tests))
            .select("bad", "good", pairs.alias("x"))
            .groupBy("x.f", "x.b")
            .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
            .collect()
        )
        best, gain = None, 1e-9
        for f in features:
            cells = sorted((r["b"], r["bad"], r["good"]) for r in counted if r["f"] == f)
            p, n = sum(c[1] for c in cells), sum(c[2] for c in cells)
            if not p or not n:
                continue
            below_p = below_n = 0
            for b, cell_p, cell_n in cells[:-1]:
                below_p, below_n = below_p + cell_p, below_n + cell_n
                for up, q, m in ((False, below_p, below_n), (True, p - below_p, n - below_n)):
                    if q and (tests or (f, up) not in barred):
                        won = q * (math.log2(q / (q + m)) - math.log2(p / (p + n)))
                        if won > gain:
                            best, gain = (f, up, b), won
        if best is None:
            break
        tests.append(best)
    return tests


def _prune(rows: DataFrame, tests: list) -> tuple[list, int, int]:
    """The first tests that do best on rows they were not grown on, with what they cover there."""
    if not tests:
        return [], 0, 0
    sums = []
    for k in range(1, len(tests) + 1):
        covered = _all(tests[:k])
        sums += [F.sum(F.when(covered, F.col(c))).alias(f"{c}{k}") for c in ("bad", "good")]
    row = rows.agg(*sums).first()
    best, worth = (tests, 0, 0), -2.0
    for k in range(1, len(tests) + 1):
        p, n = row[f"bad{k}"] or 0, row[f"good{k}"] or 0
        if p + n and (p - n) / (p + n) > worth:
            best, worth = (tests[:k], p, n), (p - n) / (p + n)
    return best
