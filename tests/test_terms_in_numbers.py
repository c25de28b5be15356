"""Terms are counted, weighed and scored as numbers, text by text the same as one by one."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from incidentia.operators import features as FE
from incidentia.operators import linear as LI

TEXTS = ["aa bb aa bb cc", None, "", "a b", "aa", "bb cc x dd  aa", "cc dd aa bb aa", "ää ää ßß", "aa bb aa bb cc"]
PARTS = [0, 1, 0, 1, 2, 0, 2, 1, 1]


def refuse(*args, **kwargs):
    raise AssertionError("one by one")


@pytest.mark.parametrize("grams", [(1, 1), (1, 2), (2, 2), (1, 3), (3, 4)])
@pytest.mark.parametrize("held", [1, 2, 1000])
def test_terms_are_added_up_without_a_python_object_each(monkeypatch, grams, held):
    known = {}
    for part, text in zip(PARTS, TEXTS):
        terms = FE.text_grams(text, grams)
        for term, n in Counter(terms).items():
            df, cf = known.get((part, term), (0, 0))
            known[part, term] = (df + 1, cf + n)
    monkeypatch.setattr(FE, "text_grams", refuse)
    monkeypatch.setattr(FE, "Counter", refuse)
    monkeypatch.setattr(FE, "HELD_TERMS", held)
    texts, found = pa.array(TEXTS), Counter()
    cf = Counter()
    for run in FE._stretches(texts):
        rows = FE._added_up(np.array(PARTS)[run.start : run.stop], texts.slice(run.start, len(run)), grams)
        for row in rows.to_pylist():
            found[row["part"], row["term"]] += row["df"]
            cf[row["part"], row["term"]] += row["cf"]
    assert {key: (found[key], cf[key]) for key in found} == known


@pytest.mark.parametrize("grams", [(1, 1), (1, 2), (2, 2), (1, 3)])
def test_weights_are_found_without_a_python_object_each(monkeypatch, grams):
    terms = ["cc", "aa bb", "aa", "bb aa bb", "ää", "zz", "bb cc dd", "dd aa"]
    idf = np.array([1.5, 2.0, 1.0, 3.0, 0.0, 1.0, 2.5, 1.25])
    known = []
    for text in TEXTS:
        counts = Counter(t for t in FE.text_grams(text, grams) if t in terms)
        values = {terms.index(t): (math.log(n) + 1) * idf[terms.index(t)] for t, n in counts.items()}
        length = math.sqrt(sum(v * v for v in values.values())) or 1.0
        known.append({k: pytest.approx(values[k] / length) for k in sorted(values)})
    monkeypatch.setattr(FE, "text_grams", refuse)
    at, values, ends = FE._Weights.of(terms, idf, grams).weigh(pa.array(TEXTS))
    found = [dict(zip(at[a:b].tolist(), values[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:])]
    assert found == known and [list(f) for f in found] == [list(k) for k in known]


def test_linear_scores_are_made_where_the_weights_are(spark):
    """No lambda runs per weight and class: they cost most of the query before."""
    rows = [(str(i), t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "report_number string, clean_text string")
    vocab = spark.createDataFrame([("aa", 1.0), ("bb", 2.0), ("aa bb", 1.5)], "term string, idf double")
    space = FE.TermSpace.fit(vocab)
    table = spark.createDataFrame([("aa", [1.0, -1.0]), ("aa bb", [0.5, 2.0])], "term string, coef array<double>")
    scores = LI.linear_scores(df, space, table, {"x": 0.25, "y": -0.5})
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "aggregate(" not in plan
    factors = {r["term"]: r["coef"] for r in table.collect()}
    weights = df.select("report_number", space.weigh(F.col("clean_text"), spark).alias("w")).collect()
    known = {}
    for key, (places, values) in weights:
        for k, (label, intercept) in enumerate([("x", 0.25), ("y", -0.5)]):
            own = [v * factors[space.terms[at]][k] for at, v in zip(places, values) if space.terms[at] in factors]
            known[key, label] = pytest.approx(sum(own) + intercept)
    assert {(r[0], r[1]): r[2] for r in scores.collect()} == known
