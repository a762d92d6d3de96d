"""Queries on training: cross-validation, tuning and stacking by moments, a fitted ensemble inside the prediction, and the
accuracy of models race by race. All models have closed forms in SQL: ridge on two features, and trees of one split."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock import values
from paddock.functions import scores
from paddock.ml import gram, models
from paddock.operators import prediction
from paddock.plans import canonical, predictions, training
from paddock.plans.blocks import number_rows
from paddock.suite.base import Query, predicted_query
from paddock.suite.sources import _C, _requests

ALPHAS = (0.1, 1.0, 10.0, 1000.0)
_DATA = f",\n{predictions.SQL},{training.SQL}"


def _query(build, sql: str, columns: str) -> Query:
    return Query(lambda spark, sf_dir: build(training.matrix(spark, sf_dir)), sql, columns, _DATA)


def _line(source: str, by: str = "") -> str:
    """Moments of x1, x2 and y of a source, for ridge lines of two features."""
    sums = ", ".join(f"covar_pop({a}, {b}) * count(*) AS s{a}{b}" for a, b in (("x1", "x1"), ("x1", "x2"), ("x2", "x2"), ("x1", "y"), ("x2", "y")))
    return f"SELECT {by and by + ', '}avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, {sums} FROM {source}{by and f' GROUP BY {by}'}"


_SOLVED = """((sx2x2 + alpha) * sx1y - sx1x2 * sx2y) / ((sx1x1 + alpha) * (sx2x2 + alpha) - sx1x2 * sx1x2) AS w1,
    ((sx1x1 + alpha) * sx2y - sx1x2 * sx1y) / ((sx1x1 + alpha) * (sx2x2 + alpha) - sx1x2 * sx1x2) AS w2"""
_ALPHAS = "alphas(alpha) AS (VALUES " + ", ".join(f"({a}::DOUBLE)" for a in ALPHAS) + ")"


def _folds(fold: str, k: int) -> str:
    return f"""{_ALPHAS}, earlier AS (SELECT f.fold, t.x1, t.x2, t.y FROM (SELECT unnest(range(1, {k} + 1)) AS fold) f JOIN training t ON t.{fold} < f.fold),
      lines AS (SELECT *, {_SOLVED} FROM ({_line('earlier', 'fold')}), alphas),
      tested AS (SELECT alpha, fold, race_id, driver_id, y AS y_true, my + w1 * (x1 - m1) + w2 * (x2 - m2) AS y_pred FROM training t JOIN lines ON t.{fold} = fold),
      scores AS (SELECT alpha, fold, avg(abs(y_pred - y_true)) AS mae, sqrt(avg((y_pred - y_true) ** 2)) AS rmse, count(*) FILTER (WHERE abs(y_pred - y_true) <= 3) * 100 / count(*) AS within_3_pct FROM tested GROUP BY ALL)"""


# ---- stack of the stored predictions ---------------------------------------------------------------

_STACK = ["m_grid", "m_score"]


def _stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meta model on the predictions of two models, fitted on the earlier rows and applied to the later ones."""
    base = predictions.predicted(spark, sf_dir).predictions.select("race_id", "driver_id", *_STACK)
    rows = training.matrix(spark, sf_dir).select("race_id", "driver_id", models.LABEL, "is_test").join(base, ["race_id", "driver_id"])
    meta = gram.stacked(rows, _STACK, ~F.col("is_test"))
    return rows.where("is_test").select("race_id", "driver_id", F.col(models.LABEL).alias("y_true"), meta.expression(_STACK).alias("y_pred"))


# ---- a fitted ensemble --------------------------------------------------------------------------------

_ONE_TREE = {"maxDepth": 1, "minInstancesPerNode": 1, "featureSubsetStrategy": "all"}
_BASES = {
    "ridge": (list(training.PAIR), {}),
    "random_forest": (["front"], {"numTrees": 1, "bootstrap": False, **_ONE_TREE}),
    "gradient_boosting": (["fast"], {"maxIter": 1, "subsamplingRate": 1.0, **_ONE_TREE}),
}
_UNKNOWN = "neural_network"


@dataclass(frozen=True)
class Fitted:
    ensemble: models.Ensemble
    predictions: DataFrame
    confidence: DataFrame


_built: dict[tuple[str, str], Fitted] = {}


def _ranked(t: canonical.Tables, ensemble: models.Ensemble, bases: list[str]) -> DataFrame:
    """``prediction.fitted`` of all races, without the place distribution. Features follow from the entry, so the models run beside
    it, and only entries, outputs and rounded places go through the shuffles."""
    entries = predictions.entry_rows(t)
    kept = entries.columns
    # the models see the place on the grid of each row of the race and driver
    twins = training.with_twins(entries, ["grid_position", "result_idx"]).withColumn("entry", F.struct(*kept))
    seen = twins.withColumns({"grid_position": F.col("twin.grid_position"), "result_idx": F.col("twin.result_idx")})
    scored = ensemble.predict(training.features(seen, "entry")).select("entry.*", F.col("y_pred").alias("adjusted"), *bases)
    placed = scored.withColumn("_place", prediction.predicted_place())
    listed = prediction.field_positions(placed, "_place").withColumn("spread", prediction.deviation(bases))
    return prediction.outcome(predictions.request_rows(listed)).drop("_place", "circuit_id", "grid_position", "rainfall")


def fitted(spark: SparkSession, sf_dir: str) -> Fitted:
    """Predictions of all races by an ensemble fitted on the earlier 70 % of the rows and weighed on the others."""
    key = (spark.sparkContext.applicationId, os.path.normpath(sf_dir))
    if key not in _built:
        t = canonical.tables(spark, sf_dir)
        ensemble = models.train_ensemble(
            training.matrix(spark, sf_dir), list(training.PAIR), "row_no", bases=[*_BASES, _UNKNOWN],
            overrides={n: o for n, (_, o) in _BASES.items()}, columns={n: c for n, (c, _) in _BASES.items()},
        )
        names = {n: f"base_{n}" for n in ensemble.models}
        root = canonical.store(spark, sf_dir)
        rows = canonical.write_table(_ranked(t, ensemble, list(names.values())), f"{root}/fitted", spark)
        accuracy = sum(max(0.0, 1.0 - e / 10.0) for e in ensemble.errors.values()) / len(ensemble.errors)
        if len(names) > 1:
            confidence = prediction.joint_confidence(rows, list(names.values()), accuracy)
        else:
            confidence = prediction.race_confidence(prediction.base_rows(rows, names), accuracy)
        confidence = canonical.write_table(confidence, f"{root}/fitted_confidence", spark, False)
        # twenty doubles that follow from one
        rows = rows.withColumn("probability_distribution", scores.place_distribution(F.col("adjusted")))
        _built[key] = Fitted(ensemble, rows, confidence)
    return _built[key]


_FITTED = f"""early AS (SELECT * FROM training WHERE row_no <= CAST(floor(n * (1 - 0.3::DOUBLE)) AS BIGINT)),
  line AS (SELECT *, {_SOLVED} FROM ({_line('early')}), (SELECT 1.0::DOUBLE AS alpha)),
  leaves AS (SELECT avg(y) FILTER (WHERE front) AS front_1, avg(y) FILTER (WHERE NOT front) AS front_0, avg(y) FILTER (WHERE fast) AS fast_1, avg(y) FILTER (WHERE NOT fast) AS fast_0, avg(y) AS every FROM early),
  base AS (SELECT r.*, my + w1 * (grid - m1) + w2 * (car - m2) AS ridge, coalesce(CASE WHEN grid <= 5 THEN front_1 ELSE front_0 END, every) AS random_forest,
      coalesce(CASE WHEN car >= 0.8 THEN fast_1 ELSE fast_0 END, every) AS gradient_boosting FROM rated r, line, leaves),
  errors AS (SELECT avg(abs(ridge - y)) AS e1, avg(abs(random_forest - y)) AS e2, avg(abs(gradient_boosting - y)) AS e3
    FROM base JOIN training USING (race_id, driver_id) WHERE row_no > CAST(floor(n * (1 - 0.3::DOUBLE)) AS BIGINT)),
  weights AS (SELECT *, 1 / (1 + e1) / s AS v1, 1 / (1 + e2) / s AS v2, 1 / (1 + e3) / s AS v3, (greatest(0, 1 - e1 / 10) + greatest(0, 1 - e2 / 10) + greatest(0, 1 - e3 / 10)) / 3 AS accuracy
    FROM (SELECT *, 1 / (1 + e1) + 1 / (1 + e2) + 1 / (1 + e3) AS s FROM errors)),
  adjusted AS (SELECT *, ridge * v1 + random_forest * v2 + gradient_boosting * v3 AS adjusted, (ridge + random_forest + gradient_boosting) / 3 AS mu FROM base, weights),
  guess AS (SELECT *, least(n_drivers, greatest(1, CAST(round_even(adjusted, 0) AS BIGINT))) AS place, sqrt(((ridge - mu) ** 2 + (random_forest - mu) ** 2 + (gradient_boosting - mu) ** 2) / 3) AS spread FROM adjusted),
  listing AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY place, result_idx) AS list_no, CASE WHEN place <= 10 THEN {predictions._points}[place] ELSE 0 END::DOUBLE AS expected_points,
    greatest(0.1, least(0.95, 1 - spread / 5)) AS confidence_score FROM guess),
  fitted AS (SELECT *, least(n_drivers, list_no + max(place - list_no) OVER (PARTITION BY race_id ORDER BY list_no)) AS predicted_position FROM listing),
  longer AS (SELECT race_id, driver_id, unnest(['ridge', 'random_forest', 'gradient_boosting']) AS model, unnest([ridge, random_forest, gradient_boosting]) AS y_pred FROM base),
  agreeing AS (SELECT a.race_id, coalesce(abs(covar_pop(a.y_pred, b.y_pred) / nullif(stddev_pop(a.y_pred) * stddev_pop(b.y_pred), 0)), NULL) AS agreement
    FROM longer a JOIN longer b ON a.race_id = b.race_id AND a.driver_id = b.driver_id AND a.model < b.model GROUP BY a.race_id, a.model, b.model),
  sure AS (SELECT *, model_agreement * 0.3 + prediction_variance * 0.25 + historical_accuracy * 0.25 + 0.2 AS overall_confidence FROM (
    SELECT race_id, coalesce(a, 0.5) AS model_agreement, greatest(0, 1 - v / 50) AS prediction_variance, (SELECT accuracy FROM weights) AS historical_accuracy
    FROM (SELECT race_id, avg(v) AS v FROM (SELECT race_id, driver_id, var_pop(y_pred) AS v FROM longer GROUP BY ALL) GROUP BY 1) LEFT JOIN (SELECT race_id, avg(agreement) AS a FROM agreeing GROUP BY 1) USING (race_id)))"""
_E = values.REQUEST_ERRORS


def _fitted(build, sql: str, columns: str) -> Query:
    return Query(lambda spark, sf_dir: build(fitted(spark, sf_dir)), f"WITH {_FITTED} {sql}", columns, _DATA)


# ---- accuracy race by race --------------------------------------------------------------------------------


def _history(p) -> DataFrame:
    long = predictions.long_predictions(p.predictions).where(F.col("y_true").isNotNull())
    per_race = long.groupBy("model", "race_id", "race_date").agg(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("mae"))
    return prediction.accuracy_history(number_rows(per_race, ["model"], [F.col("race_date"), F.col("race_id")], canonical.days("race_date"), "eval_no"))


_TRACK = """r AS (SELECT model, race_id, race_date, greatest(0, 1 - avg(abs(y_pred - y_true)) / 10) AS score FROM long_prediction WHERE y_true IS NOT NULL GROUP BY ALL),
  lists AS (SELECT model, race_id, row_number() OVER w AS eval_no, list(score) OVER (w ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS seen FROM r WINDOW w AS (PARTITION BY model ORDER BY race_date, race_id)),
  states AS (SELECT *, list_reduce(seen, lambda a, s: 0.7 * a + 0.3 * s) AS accuracy FROM lists),
  track AS (SELECT *, lag(accuracy) OVER (PARTITION BY model ORDER BY eval_no) AS accuracy_before FROM states)"""

QUERIES = {
    "cv_ridge_folds": _query(
        lambda m: gram.cross_validate(m, training.PAIR, ALPHAS), f"WITH {_folds('test_fold', training.FOLDS)} SELECT * FROM scores", "alpha:d fold:b mae:d rmse:d within_3_pct:d"
    ),
    "cv_ridge_predictions": _query(
        lambda m: gram.fold_predictions(m, training.PAIR, [1.0]).select("race_id", "driver_id", "fold", "y_true", "y_pred"),
        f"WITH {_folds('test_fold', training.FOLDS)} SELECT * FROM tested WHERE alpha = 1", "race_id:s driver_id:s fold:b y_true:d y_pred:d",
    ),
    "tuned_ridge": _query(
        lambda m: gram.tune(m, training.PAIR, ALPHAS, "tuning_fold")[1],
        f"""WITH {_folds('tuning_fold', training.TUNING_FOLDS)}, means AS (SELECT alpha, avg(mae) AS mae_mean, stddev_pop(mae) AS mae_std FROM scores GROUP BY 1)
        SELECT alpha, mae_mean, mae_std, CAST(row_number() OVER (ORDER BY mae_mean, alpha) = 1 AS INT) AS chosen, my - w1 * m1 - w2 * m2 AS intercept, w1 AS w0, w2 AS w1
        FROM (SELECT alpha, m1, m2, my, {_SOLVED} FROM ({_line('training')}), alphas) JOIN means USING (alpha)""",
        "alpha:d mae_mean:d mae_std:d chosen:b intercept:d w0:d w1:d",
    ),
    "stacked_meta": Query(
        _stack,
        f"""WITH stack AS (SELECT race_id, driver_id, m_grid AS x1, m_score AS x2, y, row_no > CAST(floor(n * (1 - 0.2::DOUBLE)) AS BIGINT) AS is_test FROM training JOIN prediction USING (race_id, driver_id)),
        line AS (SELECT *, {_SOLVED} FROM ({_line('(SELECT * FROM stack WHERE NOT is_test)')}), (SELECT 1.0::DOUBLE AS alpha))
        SELECT race_id, driver_id, y AS y_true, my + w1 * (x1 - m1) + w2 * (x2 - m2) AS y_pred FROM stack, line WHERE is_test""",
        "race_id:s driver_id:s y_true:d y_pred:d", _DATA,
    ),
    "ensemble_comparison": _fitted(
        lambda f: f.ensemble.comparison(f.predictions.sparkSession),
        f"""SELECT unnest(['ridge', 'random_forest', 'gradient_boosting', '{_UNKNOWN}']) AS model, unnest([e1, e2, e3, NULL]) AS mae, unnest([v1, v2, v3, NULL]) AS weight,
          unnest([NULL, NULL, NULL, 'unknown model: {_UNKNOWN}']) AS error FROM weights""",
        "model:s mae:d weight:d error:s",
    ),
    "race_predictions_fitted": _fitted(
        lambda f: f.predictions, "SELECT * FROM fitted", "race_id:s driver_id:s list_no:b predicted_position:b adjusted:d expected_points:d confidence_score:d"
    ),
    "race_confidence_fitted": _fitted(
        lambda f: f.confidence, "SELECT * FROM sure", "race_id:s model_agreement:d prediction_variance:d historical_accuracy:d overall_confidence:d"
    ),
    "batch_fitted": _fitted(
        lambda f: prediction.batch(_requests(f), f.predictions, f.confidence),
        f""", q AS (SELECT *, concat_ws('; ', CASE WHEN {_C} % 19 = 0 THEN '{_E[0]}' END, CASE WHEN {_C} % 23 = 0 THEN '{_E[1]}' END, CASE WHEN {_C} % 29 = 0 THEN '{_E[2]}' END,
            CASE WHEN {_C} % 29 <> 0 AND {_C} % 41 = 0 AND n_drivers > 1 THEN '{_E[3]}' END, CASE WHEN {_C} % 29 <> 0 AND {_C} % 37 = 0 THEN '{_E[4]}' END, CASE WHEN {_C} % 31 = 0 THEN '{_E[5]}' END) AS e
          FROM fitted JOIN sure USING (race_id) WHERE list_no = 1)
        SELECT race_id, CASE WHEN e = '' THEN overall_confidence ELSE 0 END AS confidence, CASE WHEN e = '' THEN driver_name END AS winner, nullif(e, '') AS error FROM q""",
        "race_id:s confidence:d winner:s error:s",
    ),
    "model_accuracy_history": predicted_query(
        _history, f"WITH {_TRACK} SELECT * FROM track", "model:s race_id:s eval_no:b accuracy:d accuracy_before:d"
    ),
    "race_confidence_as_of": predicted_query(
        lambda p: prediction.confidence_as_of(p.confidence, _history(p)),
        f"""WITH {_TRACK}, known AS (SELECT race_id, avg(accuracy_before) AS h FROM track GROUP BY 1), joined AS (SELECT c.* EXCLUDE (historical_accuracy, overall_confidence), coalesce(h, historical_accuracy) AS historical_accuracy
          FROM confidence c LEFT JOIN known USING (race_id)) SELECT *, model_agreement * 0.3 + prediction_variance * 0.25 + historical_accuracy * 0.25 + data_quality * 0.2 AS overall_confidence FROM joined""",
        "race_id:s historical_accuracy:d overall_confidence:d",
    ),
}
