import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from incidentia.functions import text as TX
from incidentia.operators import features as FE
from incidentia.operators import linear as LI
from incidentia.operators import logistic as LR
from incidentia.operators import metrics as M
from incidentia.operators import models as MO

TEXTS = {
    "D": ["patient died after pump failure", "death reported after device stopped pumping"],
    "I": ["patient suffered burn injury at implant site", "infection and pain after implant procedure"],
    "M": ["device alarm sounded battery failed", "screen froze and battery did not charge"],
}
QUICK = {"min_df": 1, "max_iter": 60}


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (f"{label}{i}", label, f"{texts[i % 2]} case {'abcdefghij'[i % 10] * 3}")
        for label, texts in TEXTS.items()
        for i in range({"D": 30, "I": 15, "M": 15}[label])
    ]
    return spark.createDataFrame(data, "report_number string, severity_label string, clean_text string").cache()


@pytest.fixture(scope="module")
def model(rows):
    return MO.fit_text_model(rows, MO.Params(**QUICK))


DOCS = ["aa bb aa", "aa bb cc", "bb cc dd", "aa dd dd dd", "bb", "x y"]


def brute_force_weights(docs, min_df, max_df, cap):
    grams = []
    for doc in docs:
        words = [w for w in doc.split() if len(w) > 1]
        grams.append(Counter(words + [" ".join(p) for p in zip(words, words[1:])]))
    df = Counter(t for g in grams for t in g)
    cf = sum(grams, Counter())
    kept = [t for t in df if min_df <= df[t] <= max_df * len(docs)]
    kept = sorted(kept, key=lambda t: (-cf[t], t))[:cap]
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in kept}
    out = {}
    for i, g in enumerate(grams):
        raw = {t: (1 + math.log(n)) * idf[t] for t, n in g.items() if t in idf}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        out.update({(str(i), t): w / norm for t, w in raw.items()})
    return kept, out


@pytest.mark.parametrize("min_df, max_df, cap", [(1, 1.0, 100), (2, 0.6, 100), (1, 1.0, 3)])
def test_tfidf_against_brute_force(spark, min_df, max_df, cap):
    df = spark.createDataFrame([(str(i), d) for i, d in enumerate(DOCS)], "report_number string, clean_text string")
    stats = FE.term_stats(FE.term_frequency(df))
    vocab = FE.vocabulary(stats, FE.document_count(df).scalar(), min_df, max_df, cap)
    kept, expected = brute_force_weights(DOCS, min_df, max_df, cap)
    assert {r["term"] for r in vocab.collect()} == set(kept)
    space = FE.TermSpace.fit(vocab)
    got = {(r[0], r[1]): r[2] for r in FE.tfidf_weights(df, space).collect()}
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k]) for k in got)
    assert space.transform(df).count() == len(DOCS)  # rows without a term stay


def test_fold_statistics_equal_a_recount(spark):
    df = spark.createDataFrame(
        [(str(i), i % 2, d) for i, d in enumerate(DOCS)], "report_number string, fold int, clean_text string"
    )
    folds = FE.fold_term_stats(FE.term_frequency(df, "fold"), 2, min_df=1)
    for fold in (0, 1):
        direct = FE.term_stats(FE.term_frequency(df.filter(F.col("fold") != fold)))
        got = {tuple(r) for r in FE.training_stats(folds, fold, (1, 2)).collect()}
        assert got == {tuple(r) for r in direct.select("term", "df", "cf").collect()}


def test_cap_takes_equals_in_term_order(spark):
    stats = spark.createDataFrame([("a", 1, 5), ("d", 1, 2), ("b", 1, 2), ("c", 1, 2), ("e", 1, 1)], "term string, df long, cf long")
    assert [r[0] for r in FE.most_common(stats, 3).collect()] == ["a", "b", "c"]
    assert FE.most_common(stats, 50).count() == 5


def test_empty_vocabulary_is_an_error(spark, rows):
    with pytest.raises(ValueError, match="empty vocabulary"):
        MO.fit_text_model(rows, MO.Params(min_df=1_000))


def test_fitted_model_learns(rows, model):
    scored = model.transform(rows)
    assert M.evaluate(scored, "severity_label", "predicted_label").first()["accuracy"] > 0.95
    row = scored.first()
    assert set(row["probabilities"]) == {"D", "I", "M"}
    assert sum(row["probabilities"].values()) == pytest.approx(1.0, abs=1e-5)
    assert row["predicted_label"] == max(row["probabilities"], key=row["probabilities"].get)


def test_blank_text_is_scored_too(spark, model):
    df = spark.createDataFrame([("",), ("zzz",)], "clean_text string")
    assert model.transform(df).filter("predicted_label IS NOT NULL").count() == 2


def test_save_and_load(spark, rows, model, tmp_path):
    path = str(tmp_path / "model")
    model.save(spark, path)
    model.save(spark, path)  # again, over the first
    loaded = MO.TextModel.load(spark, path)
    assert loaded.params == model.params and loaded.labels == model.labels

    def scores(m):
        return {r[0]: r[1] for r in m.transform(rows).select("report_number", "probabilities").collect()}

    assert scores(loaded) == scores(model)
    with pytest.raises(FileNotFoundError):
        MO.TextModel.load(spark, str(tmp_path / "none"))


def test_scores_equal_the_relational_form(spark, rows, model):
    by_term = model.coefficients(spark).groupBy("term").agg(
        F.map_from_entries(F.collect_list(F.struct("label", "coef"))).alias("m")
    )
    packed = by_term.select("term", F.array(*[F.col("m")[lb] for lb in model.labels]).alias("coef"))
    intercepts = dict(zip(model.labels, model.head.intercepts()))
    relational = LI.linear_scores(rows, model.space, packed, intercepts)
    best = relational.groupBy("report_number").agg(F.max_by("label", "score").alias("best"))
    direct = model.transform(rows).select("report_number", "predicted_label")
    assert best.join(direct, "report_number").filter("best <> predicted_label").count() == 0


def test_rows_of_one_key_are_scored_apart(spark, rows, model):
    text = rows.first()["clean_text"]
    docs = spark.createDataFrame([("k", text), ("k", text), (None, text)], "report_number string, clean_text string")
    coefficients = spark.createDataFrame([(t, [1.0]) for t in model.space.terms], "term string, coef array<double>")
    scores = [r["score"] for r in LI.linear_scores(docs, model.space, coefficients, {"D": 0.5}).collect()]
    assert len(scores) == 3 and len(set(scores)) == 1 and scores[0] > 0.5


def test_svm(rows):
    svm = MO.fit_text_model(rows, MO.Params("svm", **QUICK))
    scored = svm.transform(rows)
    assert set(scored.first()["decision_scores"]) == {"D", "I", "M"}
    assert M.evaluate(scored, "severity_label", "predicted_label").first()["accuracy"] > 0.9


def test_two_classes_give_two_scores(spark, rows):
    two = rows.filter("severity_label <> 'M'")
    for kind, column in (("logreg", "probabilities"), ("svm", "decision_scores")):
        model = MO.fit_text_model(two, MO.Params(kind, **QUICK))
        assert set(model.transform(two).first()[column]) == {"D", "I"}
        assert LI.top_terms(model.coefficients(spark), 2).count() == 4


def test_unknown_model_type():
    with pytest.raises(ValueError):
        MO.Params("forest")


def test_grid_and_tuning(rows):
    grid = MO.param_grid(grid={"ngram_range": [(1, 1), (1, 2)], "C": [0.1, 1.0]}, max_features=200, **QUICK)
    assert len(MO.param_grid()) == 12 and len(grid) == 4
    scores = {r["position"]: r["mean_f1"] for r in MO.grid_scores(rows, grid, n_splits=2).collect()}
    assert set(scores) == {0, 1, 2, 3} and all(0.5 < s <= 1 for s in scores.values())
    tuned = MO.tune(rows, grid[:1], n_splits=2)
    assert tuned.params == grid[0]


def test_cross_validation(rows):
    result = MO.summarise(MO.cross_validate(rows, MO.Params(**QUICK), n_splits=3))
    assert len(result["cv_f1_per_fold"]) == 3 and result["cv_f1_mean"] > 0.8
    assert result["cv_f1_std"] == pytest.approx(np.std(result["cv_f1_per_fold"]))


def test_embedding_head(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=4) + 3 * (i % 3)], i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    scored = MO.fit_embedding_model(df, max_iter=50).transform(df)
    assert M.scores(M.confusion_counts(scored, "label", "predicted_label")).first()["accuracy"] > 0.9
    assert MO.cross_validate_embeddings(df, max_iter=50).count() == 3


def test_predict_batches(spark):
    def load_constant():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(1, "abc"), (2, "")], "id int, t string")
    out = LI.predict_from_logits(MO.predict_batches(df, load_constant, "t"), "logits", ["x", "y"])
    assert [r["predicted_label"] for r in out.orderBy("id").collect()] == ["x", "y"]
    assert df.columns == ["id", "t"]


def test_predict_batches_sends_its_input_alone(spark):
    def load_length():
        return lambda values: [[float(len(v))] for v in values]

    df = spark.createDataFrame([(1, "abc", "long text"), (2, "", "other")], "id int, t string, rest string")
    scored = MO.predict_batches(df, load_length, "t").filter("logits[0] > 0")
    assert [(r["id"], r["rest"], r["logits"]) for r in scored.collect()] == [(1, "long text", [3.0])]
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [run(t#") == 1
    assert MO.predict_batches(df.limit(0), load_length, "t").count() == 0


def _sparse_rows(rng, n, width, classes):
    sizes = rng.integers(0, 5, n)
    indices = np.concatenate([rng.choice(width, k, replace=False) for k in sizes])
    return indices.astype(int), rng.normal(size=sizes.sum()), sizes, rng.integers(0, classes, n)


@pytest.mark.parametrize("classes", [2, 3])
def test_logistic_gradient_against_differences(classes):
    rng = np.random.default_rng(classes)
    indices, values, sizes, y = _sparse_rows(rng, 30, 6, classes)
    cost = rng.uniform(0.5, 2.0, classes)
    w = rng.normal(size=(7, 1 if classes == 2 else classes))
    losses, gradient = LR.row_losses(indices, values, sizes, y, w, cost)
    dense = np.zeros((30, 7))
    dense[np.repeat(np.arange(30), sizes), indices] = values
    dense[:, -1] = 1.0

    def loss(w):
        f = dense @ w
        f = np.column_stack((np.zeros(30), f)) if classes == 2 else f
        return sum(cost[c] * (np.log(np.exp(row).sum()) - row[c]) for row, c in zip(f, y))

    assert losses.sum() == pytest.approx(loss(w))
    for at in np.ndindex(*w.shape):
        step = np.zeros_like(w)
        step[at] = 1e-5
        slope = (loss(w + step) - loss(w - step)) / 2e-5
        assert gradient[at] == pytest.approx(slope, abs=1e-6)


@pytest.mark.parametrize("classes", [2, 3])
def test_logistic_fit_ends_at_a_minimum(spark, classes):
    rng = np.random.default_rng(7)
    indices, values, sizes, y = _sparse_rows(rng, 60, 6, classes)
    ends = np.cumsum(sizes)
    table = [
        (int(c), indices[e - k : e].tolist(), values[e - k : e].tolist()) for c, e, k in zip(y, ends, sizes)
    ]
    df = spark.createDataFrame(table, "class int, indices array<int>, values array<double>")
    cost = [1.0, 2.0, 0.5][:classes]
    w, b = LR.fit_logistic(df, 6, cost, 2.0, 500, 1e-6)
    assert w.shape == (1 if classes == 2 else classes, 6)
    _, gradient = LR.row_losses(indices, values, sizes, y, np.vstack((w.T, b)), np.array(cost))
    gradient *= 2.0
    gradient[:-1] += w.T
    assert np.abs(gradient).max() < 1e-3


def test_fits_that_differ_in_c_share_their_passes(rows, monkeypatch):
    from incidentia.operators import hinge

    vectors = MO.TermSpace.fit(
        FE.vocabulary(FE.term_stats(FE.term_frequency(rows)), F.lit(60), 1), (1, 2)
    ).transform(rows)
    passes = []
    real = hinge.table_losses
    for module, kind, scores in ((LR, "logreg", "probabilities"), (hinge, "svm", "decision_scores")):
        monkeypatch.setattr(module, "table_losses", lambda *a: passes.append(len(a[1])) or real(*a))
        found, alone = [], []
        for C in (0.1, 1.0, 10.0):
            passes.clear()
            found.append(MO.fit_head(vectors, "severity_label", "features", kind, C))
            alone.append(len(passes))
        passes.clear()
        together = MO.fit_heads(vectors, "severity_label", "features", kind, (0.1, 1.0, 10.0))
        assert len(passes) == max(alone) and sum(passes) == sum(alone)
        for one, other in zip(found, together):
            assert np.allclose(one.class_coefficients(), other.class_coefficients(), atol=1e-12)
            assert np.allclose(one.intercepts(), other.intercepts(), atol=1e-12)


def test_a_pass_reads_blocks_not_rows(spark):
    from incidentia.operators import hinge

    data = [(i % 3, [i % 5, 5] if i % 4 else [], [1.0, 0.5] if i % 4 else []) for i in range(40)]
    df = spark.createDataFrame(data, "class int, indices array<int>, values array<double>").repartition(20)
    blocks = hinge.packed(df)
    w, cost = np.random.default_rng(3).normal(size=(7, 3)), np.array([0.5, 1.0, 2.0])
    ((losses, gradient),) = hinge.table_losses(blocks, [w], cost)
    assert blocks.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert blocks.count() <= 20
    blocks.unpersist()
    expected_losses, expected = np.zeros(3), w * 0
    for y, indices, values in data:
        x = np.zeros(7)
        x[indices], x[-1] = values, 1.0
        for k in range(3):
            sign, weight = (1, cost[k]) if y == k else (-1, 1)
            short = max(0.0, 1 - sign * (x @ w[:, k]))
            expected_losses[k] += weight * short**2
            expected[:, k] -= 2 * weight * sign * short * x
    assert np.allclose(losses, expected_losses) and np.allclose(gradient, expected)


def test_statistics_from_texts_equal_counted_terms(spark, monkeypatch):
    texts = [*DOCS * 3, None, "", "x", "ab ab  ab cd", "ünder straße ab"]
    df = spark.createDataFrame(
        [(str(i), i % 3, d) for i, d in enumerate(texts)], "report_number string, fold int, clean_text string"
    )
    tf = FE.term_frequency(df, keep=["fold"])
    old = TX.ngrams(TX.clean_tokens(F.col("clean_text")))
    plain = Counter((r[0], t) for r in df.select("report_number", old).collect() for t in r[1] or [])
    assert {(r["report_number"], r["term"]): r["tf"] for r in tf.collect()} == plain
    monkeypatch.setattr(FE, "HELD_TERMS", 3)  # handed on in many pieces
    whole = {tuple(r) for r in FE.text_term_stats(df).collect()}
    assert whole == {tuple(r) for r in FE.term_stats(tf).collect()}
    parts = [FE.text_fold_stats(df, 3, 2), FE.fold_term_stats(tf, 3, 2)]
    found = [{(r[0], *r[1], *r[2]) for r in p.collect()} for p in parts]
    assert found[0] == found[1] and found[0]
    # A task's sums, not every text's terms, reach the shuffle on the term.
    monkeypatch.setattr(FE, "HELD_TERMS", 1000)
    given = FE._group_terms(df.coalesce(1), "clean_text", (1, 2), F.lit(0))
    assert given.count() == len(whole) < tf.count()


def test_steps_scaled_by_curvature_take_fewer_passes(spark, monkeypatch):
    """Features as common as words are; classes of the SVM end one by one."""
    from incidentia.operators import hinge

    rng = np.random.default_rng(5)
    common = 1.0 / np.arange(1, 121)
    data = []
    for i in range(400):
        own = np.sort(rng.choice(120, 12, replace=False, p=common / common.sum()))
        values = rng.uniform(0.5, 1.5, 12)
        y = int(3 * rng.random() < (own % 3 == 1).sum() / 4) + int(i % 9 == 0)
        data.append((y, own.tolist(), (values / np.linalg.norm(values)).tolist()))
    df = spark.createDataFrame(data, "class int, indices array<int>, values array<double>").coalesce(2).cache()
    cost, ends = [0.8, 1.2, 2.0], {}
    for module, fit in ((LR, LR.fit_logistics), (hinge, hinge.fit_squared_hinge)):
        passes, real = [], module.table_losses
        monkeypatch.setattr(module, "table_losses", lambda *a: passes.append(a[1]) or real(*a))
        ends[module] = fit(df, 120, cost, [10.0], 1000, 1e-4)[0]
        monkeypatch.setattr(module, "table_losses", real)
        assert len(passes) <= 60  # 104 and 294 without
    assert passes[0][0].shape[1] == 3 and passes[-1][0].shape[1] < 3
    y = np.array([row[0] for row in data])
    indices = np.concatenate([row[1] for row in data])
    values = np.concatenate([row[2] for row in data])
    w, b = ends[hinge]
    point = np.vstack((w.T, b))
    for at, share in ((point * 0, None), (point, 1e-4)):
        _, gradient = hinge.row_losses(indices, values, np.full(400, 12), y, at, np.array(cost))
        length = np.linalg.norm(at + 10.0 * gradient, axis=0)
        start = length if share is None else start
    assert (length <= 1.001e-4 * start).all()


def test_sums_of_a_task_take_no_counter_term_by_term(spark, monkeypatch):
    def refuse(self, other=(), /, **kwargs):
        assert not isinstance(other, dict)
        real(self, other, **kwargs)

    real = Counter.update
    monkeypatch.setattr(Counter, "update", refuse)
    given = []
    df = spark.createDataFrame([("aa bb aa",), ("aa",)], "clean_text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda rows, add_up, schema: given.append(add_up) or rows)
    FE._group_terms(df, "clean_text", (1, 2), F.lit(0))
    texts = pa.RecordBatch.from_pydict({"part": [0, 0], "text": ["aa bb aa", "aa"]})
    (found,) = given[0](iter([texts]))
    sums = {r["term"]: (r["df"], r["cf"]) for r in found.to_pylist()}
    assert sums == {"aa": (2, 3), "bb": (1, 1), "aa bb": (1, 1), "bb aa": (1, 1)}
