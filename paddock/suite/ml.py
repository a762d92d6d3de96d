"""Model queries. The `closed_` ones are fitted in settings that have a closed form in SQL; the others are checked by
rows and by tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from paddock.ml import gram, models
from paddock.operators import evaluation
from paddock.plans import training
from paddock.plans.training import FEATURES
from paddock.suite.base import Query, on_tables

def _ridge(spark, sf_dir):
    """Places of the last fifth of the rows from a line through the earlier ones."""
    rows = training.matrix(spark, sf_dir)
    line = gram.fit(rows.where(~F.col("is_test")), FEATURES)
    return rows.where("is_test").select("race_id", "driver_id", F.lit("ridge").alias("model"), F.col(models.LABEL).alias("y_true"), line.expression(FEATURES).alias("y_pred"))


def _forest(spark, sf_dir):
    model = models.fit("random_forest", training.matrix(spark, sf_dir), FEATURES, numTrees=10, maxDepth=5)
    return spark.createDataFrame(models.feature_importance(model, FEATURES), "feature string, importance double")


def _closed(name, **overrides):
    """Places of finishers from the grid place, or from whether it is one of the first five."""

    def build(t):
        feature = "grid" if name == "ridge" else "front"
        rows = t.race_result.where("finished").select("race_id", "driver_id", "final_position", F.col("grid_position").alias("grid"), (F.col("grid_position") <= 5).cast("int").alias("front"))
        ready = models.prepare(rows, [feature], "final_position")
        return models.scored(models.fit(name, ready, [feature], **overrides), ready, name, ["race_id", "driver_id"])

    return on_tables(build)


_RIDGE = """WITH m AS (SELECT avg(grid_position) AS mx, avg(final_position) AS my, covar_pop(grid_position, final_position) * count(*) AS sxy, var_pop(grid_position) * count(*) AS sxx FROM race_result WHERE finished)
    SELECT race_id, driver_id, 'ridge' AS model, my + sxy / (sxx + %s) * (grid_position - mx) AS y_pred FROM race_result, m WHERE finished"""
_LEAVES = "SELECT race_id, driver_id, '%s' AS model, avg(final_position) OVER (PARTITION BY grid_position <= 5) AS y_pred FROM race_result WHERE finished"
_ONE_TREE = {"maxDepth": 1, "minInstancesPerNode": 1, "featureSubsetStrategy": "all"}
_FITTED = "race_id:s driver_id:s model:s y_pred:d"

QUERIES = {
    "closed_ridge": Query(_closed("ridge"), _RIDGE % "1", _FITTED),
    "closed_ridge_strong": Query(_closed("ridge", alpha=5000.0), _RIDGE % "5000", _FITTED),
    "closed_forest": Query(_closed("random_forest", numTrees=1, bootstrap=False, **_ONE_TREE), _LEAVES % "random_forest", _FITTED),
    "closed_boosting": Query(_closed("gradient_boosting", maxIter=1, subsamplingRate=1.0, **_ONE_TREE), _LEAVES % "gradient_boosting", _FITTED),
    "closed_xgboost": Query(_closed("xgboost", maxIter=1, subsamplingRate=1.0, **_ONE_TREE), _LEAVES % "xgboost", _FITTED),
    "trained_ridge_metrics": Query(
        lambda spark, sf_dir: evaluation.core_metrics(_ridge(spark, sf_dir)), None,
        "model:s n:b mae:d rmse:d median_absolute_error:d within_3_pct:d within_5_pct:d within_10_pct:d exact_pct:d spearman_correlation:d",
    ),
    "trained_ridge_predictions": Query(_ridge, None, "race_id:s driver_id:s y_true:d y_pred:d"),
    "trained_forest_importance": Query(_forest, None, "feature:s importance:d"),
}
