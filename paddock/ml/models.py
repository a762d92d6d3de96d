"""Regression models on finishing places: registry, training, ensembles, tuning, storage."""

from __future__ import annotations

import itertools
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.operators import evaluation

SEED = 42
LABEL = "target"

# --- fixed values: model parameters ---------------------------------------------------
PARAMETERS: dict[str, dict] = {
    "random_forest": {"numTrees": 200, "maxDepth": 15, "minInstancesPerNode": 2, "featureSubsetStrategy": "sqrt"},
    "gradient_boosting": {"maxIter": 150, "stepSize": 0.1, "maxDepth": 8, "minInstancesPerNode": 2, "subsamplingRate": 0.8},
    "xgboost": {"maxIter": 200, "stepSize": 0.1, "maxDepth": 8, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"},
    "lightgbm": {"maxIter": 200, "stepSize": 0.1, "maxDepth": 8, "featureSubsetStrategy": "onethird"},
    "ridge": {"alpha": 1.0},
}
# --- fixed values: search spaces --------------------------------------------------------
SEARCH: dict[str, dict[str, list]] = {
    "random_forest": {"numTrees": [100, 200, 300], "maxDepth": [10, 15, 20], "minInstancesPerNode": [1, 2, 4], "featureSubsetStrategy": ["sqrt", "log2", "all"]},
    "gradient_boosting": {"maxIter": [100, 150, 200], "stepSize": [0.05, 0.1, 0.15], "maxDepth": [6, 8, 10], "subsamplingRate": [0.7, 0.8, 0.9]},
    "xgboost": {"maxIter": [100, 200, 300], "maxDepth": [6, 8, 10], "stepSize": [0.05, 0.1, 0.15], "subsamplingRate": [0.7, 0.8, 0.9]},
    "lightgbm": {"maxIter": [100, 200, 300], "maxDepth": [6, 8, 10], "stepSize": [0.05, 0.1, 0.15]},
    "ridge": {"alpha": [0.1, 1.0, 10.0]},
}
ENSEMBLE_BASES = ("random_forest", "xgboost", "lightgbm", "gradient_boosting")
SCALED = ("gradient_boosting",)


def available_models() -> list[str]:
    return sorted(PARAMETERS)


def create_model(name: str, features: Sequence[str], rows: int | None = None, spread: float = 1.0, **overrides) -> Pipeline:
    """An unfitted pipeline by registry name. Ridge needs the number of training rows and the population standard
    deviation of their label for its penalty."""
    if name not in PARAMETERS:
        raise ValueError(f"unknown model: {name}")
    params = {**PARAMETERS[name], **overrides}
    stages: list = [VectorAssembler(inputCols=list(features), outputCol="raw_features")]
    source = "raw_features"
    if name in SCALED:
        stages.append(StandardScaler(inputCol=source, outputCol="scaled_features", withMean=True))
        source = "scaled_features"
    common = {"featuresCol": source, "labelCol": LABEL, "predictionCol": "y_pred"}
    if name == "ridge":
        # the penalty alpha of a sum of squares is alpha / n for the mean loss minimised here, on a label of deviation 1
        alpha = params.pop("alpha")
        stages.append(LinearRegression(**common, **params, regParam=alpha * spread / max(rows or 1, 1), elasticNetParam=0.0, standardization=False))
    elif name == "random_forest":
        stages.append(RandomForestRegressor(**common, **params, seed=SEED))
    else:
        stages.append(GBTRegressor(**common, **params, seed=SEED))
    return Pipeline(stages=stages)


def prepare(rows: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Numeric features with NULL as 0 and a double label."""
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features} | {LABEL: F.col(label).cast("double")})


def fit(name: str, rows: DataFrame, features: Sequence[str], **overrides) -> PipelineModel:
    n, spread = rows.agg(F.count(F.lit(1)), F.stddev_pop(LABEL)).first() if name == "ridge" else (None, None)
    return create_model(name, features, n, spread or 1.0, **overrides).fit(rows)


def scored(model: PipelineModel, rows: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Predictions in long form (keys, model, y_true, y_pred)."""
    return model.transform(rows).select(*keys, F.lit(name).alias("model"), F.col(LABEL).alias("y_true"), "y_pred")


@dataclass
class Ensemble:
    """Fitted base models with the weights or the meta model of a strategy."""

    strategy: str
    features: list[str]
    models: dict[str, PipelineModel]
    weights: dict[str, float] = field(default_factory=dict)
    meta: PipelineModel | None = None
    failures: dict[str, str] = field(default_factory=dict)
    errors: dict[str, float] = field(default_factory=dict)

    def comparison(self, spark: SparkSession) -> DataFrame:
        """One row per base model: its mean absolute error on the held-out rows and its weight, or why it could not be trained."""
        rows = [(n, self.errors.get(n), self.weights.get(n), None) for n in self.models] + [(n, None, None, why) for n, why in self.failures.items()]
        return spark.createDataFrame(rows, "model string, mae double, weight double, error string")

    def predict(self, rows: DataFrame) -> DataFrame:
        """Add ``y_pred`` to prepared rows; all base models run in one pass over the rows."""
        out, columns = rows, {}
        for name, model in self.models.items():
            keep = [*out.columns]
            out = model.transform(out).select(*keep, F.col("y_pred").alias(f"base_{name}"))
            columns[name] = F.col(f"base_{name}")
        if self.meta is not None:
            return self.meta.transform(out)
        return out.withColumn("y_pred", reduce(lambda a, b: a + b, [c * self.weights.get(n, 0.0) for n, c in columns.items()]))

    def info(self) -> list[dict]:
        """Strategy, weight and parameters of each base model."""
        return [
            {"model": n, "strategy": self.strategy, "weight": self.weights.get(n), "parameters": {p.name: v for p, v in m.stages[-1].extractParamMap().items()}}
            for n, m in self.models.items()
        ]


def train_ensemble(
    rows: DataFrame, features: Sequence[str], order: str, strategy: str = "weighted_average",
    bases: Sequence[str] = ENSEMBLE_BASES, overrides: Mapping[str, dict] | None = None, holdout: float = 0.3,
    columns: Mapping[str, Sequence[str]] | None = None, refit: bool = False,
) -> Ensemble:
    """Fit base models on the earlier rows and weigh them on the later ones.

    ``rows`` are prepared and stored, as every model reads them; ``order`` is a dense row number in time order. A base model
    that fails is left out and noted. ``columns`` gives a base features of its own; with ``refit`` the
    models are fitted again on all rows once they are weighed. Only one weight and one error per model come to the driver.
    """
    if strategy not in ("weighted_average", "stacking", "voting", "dynamic"):
        raise ValueError(f"unknown strategy: {strategy}")
    cut = int(rows.count() * (1 - holdout))
    train, valid = rows.where(F.col(order) <= cut), rows.where(F.col(order) > cut)
    ensemble = Ensemble(strategy, list(features), {})
    for name in bases:
        try:
            ensemble.models[name] = fit(name, train, (columns or {}).get(name, features), **(overrides or {}).get(name, {}))
        except Exception as error:  # noqa: BLE001 - a failing base model must not end the training
            ensemble.failures[name] = str(error)
    if not ensemble.models:
        raise ValueError("no base model could be trained")
    if strategy == "stacking":
        wide = Ensemble("voting", list(features), ensemble.models, {}).predict(train).drop("y_pred")
        names = [f"base_{n}" for n in ensemble.models]
        ensemble.meta = fit("ridge", wide.select(LABEL, *names), names)
        return ensemble
    long = reduce(DataFrame.unionByName, [scored(m, valid, n, [order]) for n, m in ensemble.models.items()])
    chosen = evaluation.ensemble_weights(long).where(F.col("strategy") == strategy)
    ensemble.weights = {r["model"]: r["weight"] for r in chosen.collect()}
    errors = long.groupBy("model").agg(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("mae"))
    ensemble.errors = {r["model"]: r["mae"] for r in errors.collect()}
    if refit:
        ensemble.models = {n: fit(n, rows, (columns or {}).get(n, features), **(overrides or {}).get(n, {})) for n in ensemble.models}
    return ensemble


def cross_validate(name: str, rows: DataFrame, features: Sequence[str], order: str, k: int = 5, **overrides) -> DataFrame:
    """Metrics per fold: expanding training part, then the next equal block as test."""
    n = rows.count()
    size = n // (k + 1)
    parts = []
    for i in range(k):
        start = n - (k - i) * size
        model = fit(name, rows.where(F.col(order) <= start), features, **overrides)
        test = rows.where((F.col(order) > start) & (F.col(order) <= start + size))
        parts.append(scored(model, test, name, [order]).withColumn("test_fold", F.lit(i + 1)))
    return evaluation.fold_metrics(reduce(DataFrame.unionByName, parts))


def tune(name: str, rows: DataFrame, features: Sequence[str], order: str, space: Mapping[str, list] | None = None,
         draws: int | None = 50, k: int = 3) -> dict:
    """Best parameters by mean MAE over time-ordered folds; random draws, or the whole grid without ``draws``."""
    space = SEARCH[name] if space is None else space
    grid = [dict(zip(space, choice)) for choice in itertools.product(*space.values())]
    if draws is not None and draws < len(grid):
        grid = random.Random(SEED).sample(grid, draws)
    best: dict = {}
    for params in grid:
        mae = cross_validate(name, rows, features, order, k, **params).agg(F.avg("mae")).first()[0]
        if not best or mae < best["mae"]:
            best = {"mae": mae, "parameters": params}
    return best


def feature_importance(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    """Importances (or absolute coefficients) by feature, largest first."""
    last = model.stages[-1]
    weights = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    return sorted(zip(features, map(float, weights)), key=lambda x: (-x[1], x[0]))


def initial_accuracy(long: DataFrame) -> DataFrame:
    """Accuracy of a freshly trained model: 1 - MAE/10, at least 0."""
    return long.groupBy("model").agg(
        F.greatest(F.lit(0.0), F.lit(1.0) - F.avg(F.abs(F.col("y_pred") - F.col("y_true"))) / 10.0).alias("accuracy")
    )


def save_model(model: PipelineModel, name: str, root: str, metrics: Mapping[str, float] | None = None, kind: str = "", config: Mapping[str, str] | None = None) -> str:
    """Store a fitted model and append a row to the catalogue beside it."""
    path = f"{root}/models/{name}"
    model.write().overwrite().save(path)
    spark = SparkSession.getActiveSession()
    row = spark.createDataFrame(
        [(name, kind or type(model.stages[-1]).__name__, path, dict(metrics or {}), dict(config or {}))],
        "name string, kind string, path string, metrics map<string,double>, config map<string,string>",
    )
    row.withColumn("created", F.current_timestamp()).write.mode("append").parquet(f"{root}/model_catalogue")
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def list_models(spark: SparkSession, root: str) -> DataFrame:
    """Stored models, newest first."""
    return spark.read.parquet(f"{root}/model_catalogue").orderBy(F.col("created").desc(), "name")
