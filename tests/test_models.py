"""Models: registry, ensembles, cross-validation, tuning, storage."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from paddock.ml import models

FEATURES = ["grid", "skill"]
SMALL = {"random_forest": {"numTrees": 5, "maxDepth": 4}, "gradient_boosting": {"maxIter": 4, "maxDepth": 3}, "ridge": {}}


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(42)
    data = []
    for i in range(160):
        grid, skill = r.randrange(1, 21), r.random()
        data.append((i + 1, grid, skill, max(1.0, min(20.0, grid * 0.8 + (1 - skill) * 4))))
    return models.prepare(spark.createDataFrame(data, "no int, grid int, skill double, place double"), FEATURES, "place").persist()


def test_registry():
    assert {"random_forest", "gradient_boosting", "xgboost", "lightgbm", "ridge"} <= set(models.available_models())
    with pytest.raises(ValueError):
        models.create_model("none", FEATURES)


@pytest.mark.parametrize("strategy", ["weighted_average", "voting", "dynamic", "stacking"])
def test_ensemble(rows, strategy):
    e = models.train_ensemble(rows, FEATURES, "no", strategy, ["random_forest", "ridge", "missing"], SMALL)
    assert "missing" in e.failures and len(e.models) == 2
    if strategy != "stacking":
        assert sum(e.weights.values()) == pytest.approx(1.0)
    mae = e.predict(rows).agg(F.avg(F.abs(F.col("y_pred") - F.col("target")))).first()[0]
    assert mae < 3.0
    assert {i["model"] for i in e.info()} == {"random_forest", "ridge"}


def test_cross_validation(rows):
    folds = models.cross_validate("ridge", rows, FEATURES, "no", 3).collect()
    assert sorted(f.fold for f in folds) == [1, 2, 3] and all(f.mae < 2 for f in folds)


def test_tuning(rows):
    best = models.tune("ridge", rows, FEATURES, "no", {"alpha": [0.1, 1000.0]}, draws=None, k=2)
    assert best["parameters"] == {"alpha": 0.1}


def test_storage_and_importance(spark, rows, tmp_path):
    model = models.fit("gradient_boosting", rows, FEATURES, **SMALL["gradient_boosting"])
    path = models.save_model(model, "gb", str(tmp_path), {"mae": 1.0})
    again = models.load_model(path)
    a, b = (m.transform(rows).agg(F.sum("y_pred")).first()[0] for m in (model, again))
    assert a == pytest.approx(b)
    assert models.list_models(spark, str(tmp_path)).first().metrics == {"mae": 1.0}
    assert models.feature_importance(model, FEATURES)[0][0] == "grid"
    assert 0 < models.initial_accuracy(models.scored(model, rows, "gb", ["no"])).first().accuracy <= 1
