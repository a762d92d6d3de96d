"""Ridge by merged moments against direct solutions, a hot fold, and accuracy tracks longer than the memory."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paddock.ml import gram, models
from paddock.operators import prediction

FEATURES = ["a", "b", "c"]


def direct(x, y, alpha):
    m, my = x.mean(0), y.mean()
    w = np.linalg.solve((x - m).T @ (x - m) + alpha * np.eye(x.shape[1]), (x - m).T @ (y - my))
    return my - m @ w, w


@pytest.fixture(scope="module")
def table(spark):
    """Folds of very unequal size: fold 2 holds most rows; features far from zero."""
    rng = np.random.default_rng(4)
    fold = np.r_[np.zeros(20), np.ones(10), np.full(600, 2), np.full(30, 3)].astype(int)
    x = rng.normal(size=(len(fold), 3)) * [1, 5, 0.1] + [1e4, -3, 7]
    y = x @ [0.5, -2, 30] + rng.normal(size=len(fold))
    df = spark.createDataFrame([(int(f), *map(float, v), float(t)) for f, v, t in zip(fold, x, y)], "test_fold int, a double, b double, c double, target double").repartition(7).persist()
    return df, fold, x, y


@pytest.mark.parametrize("alpha", [0.0, 1.0, 500.0])
def test_lines(table, alpha):
    df, fold, x, y = table
    for f, line in gram.fold_models(gram.moments(df, FEATURES, "test_fold"), [alpha]):
        intercept, w = direct(x[fold < f], y[fold < f], alpha)
        assert line.coefficients == pytest.approx(w, rel=1e-6) and line.intercept == pytest.approx(intercept, rel=1e-6)
    assert gram.fit(df, FEATURES, alpha).coefficients == pytest.approx(direct(x, y, alpha)[1], rel=1e-6)


def test_folds(table):
    df, fold, x, y = table
    got = {(r["alpha"], r["fold"]): r["mae"] for r in gram.cross_validate(df, FEATURES, [1.0, 50.0]).collect()}
    assert set(got) == {(a, f) for a in (1.0, 50.0) for f in (1, 2, 3)}
    for (a, f), mae in got.items():
        intercept, w = direct(x[fold < f], y[fold < f], a)
        assert mae == pytest.approx(np.abs(x[fold == f] @ w + intercept - y[fold == f]).mean(), rel=1e-6)
    best, scores = gram.tune(df, FEATURES, [1.0, 50.0])
    means = {a: np.mean([m for (b, _), m in got.items() if a == b]) for a in (1.0, 50.0)}
    assert best.alpha == min(means, key=means.get)
    assert {r["alpha"]: r["chosen"] for r in scores.collect()} == {a: int(a == best.alpha) for a in means}


def test_same_as_registry(table):
    """The registry's ridge, solved by the library's own optimiser, gives the same line."""
    df, _, x, y = table
    small = df.withColumn("a", F.col("a") - 1e4)
    model = models.fit("ridge", small, FEATURES).stages[-1]
    line = gram.fit(small, FEATURES)
    assert list(model.coefficients) == pytest.approx(line.coefficients, rel=1e-3) and model.intercept == pytest.approx(line.intercept, rel=1e-2)


def test_odd_rows(spark):
    """NULL features count as 0, rows without a label not at all; a constant or repeated feature gives the shortest line; nothing gives no line."""
    rows = spark.createDataFrame([(1, 1.0, 1.0, 5.0, 2.0), (1, 2.0, 2.0, 5.0, 4.0), (1, None, None, 5.0, 0.0), (1, 9.0, 9.0, 5.0, None)], "test_fold int, a double, b double, c double, target double")
    line = gram.fit(rows, FEATURES, 0.0)
    assert line.coefficients == pytest.approx((1.0, 1.0, 0.0)) and line.intercept == pytest.approx(0.0)
    assert gram.fold_models(gram.moments(rows, FEATURES, "test_fold"), [1.0]) == []
    assert gram.cross_validate(rows, FEATURES, [1.0]).count() == 0
    assert gram.total([]) is None


def test_ensemble_with_failures(spark):
    r = random.Random(1)
    data = [(i + 1, float(r.randrange(1, 21)), float(i % 2)) for i in range(200)]
    rows = spark.createDataFrame([(n, a, b, a + 3 * b) for n, a, b in data], "no int, a double, b double, target double").persist()
    tree = {"numTrees": 1, "bootstrap": False, "maxDepth": 1, "minInstancesPerNode": 1, "featureSubsetStrategy": "all"}
    kept = models.train_ensemble(rows, ["a"], "no", bases=["ridge", "random_forest", "missing"], overrides={"random_forest": tree}, columns={"random_forest": ["b"]}, refit=True)
    table = {x["model"]: x for x in kept.comparison(spark).collect()}
    assert set(table) == {"ridge", "random_forest", "missing"} and "unknown model" in table["missing"]["error"] and table["missing"]["weight"] is None
    assert table["ridge"]["mae"] < table["random_forest"]["mae"] and table["ridge"]["weight"] > table["random_forest"]["weight"]
    leaves = {round(x["base_random_forest"], 9) for x in kept.predict(rows).collect()}
    means = {round(float(np.mean([a + 3 * b for _, a, b in data if b == side])), 9) for side in (0.0, 1.0)}
    assert leaves == means  # fitted again on all rows


def test_accuracy_history(spark):
    """A model with many more evaluations than the memory, and one with a single one."""
    r = random.Random(3)
    scores = {"hot": [r.random() * 12 for _ in range(700)], "once": [2.0]}
    rows = spark.createDataFrame([(m, f"r{i}", i + 1, s) for m, v in scores.items() for i, s in enumerate(v)], "model string, race_id string, eval_no int, mae double").repartition(5)
    got = {(x["model"], x["eval_no"]): (x["accuracy"], x["accuracy_before"]) for x in prediction.accuracy_history(rows).collect()}
    for model, values in scores.items():
        state = None
        for i, s in enumerate(values):
            score = max(0.0, 1 - s / 10)
            before, state = state, score if state is None else 0.7 * state + 0.3 * score
            assert got[model, i + 1][0] == pytest.approx(state, rel=1e-12)
            assert got[model, i + 1][1] == (None if before is None else pytest.approx(before, rel=1e-12))
